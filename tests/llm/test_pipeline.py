"""The pipeline, stage by stage, against brute force on each stage's own input."""

from collections import Counter, defaultdict

import numpy as np
from test_text_ops import ascii_lower, brute_components, brute_print, check_pieces

import corpus_pipeline
from tessera.llm import mixing, toxicity


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, inputs[-1], sf).cache()
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        inputs.append(out)
    raw, clean, unique, far, mixed, packed = ([r.asDict() for r in d.collect()] for d in inputs)

    entries, w = toxicity.fit(docs, labels)
    matcher, w = toxicity.Matcher(entries), np.array(w)
    good = [r for r in raw if w[0] + np.array(toxicity.features(r["text"], matcher)) @ w[1:] < 0]
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(clean, key=key) == sorted(good, key=key) and 0 < len(good) < len(raw)
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert len({r["doc_id"] for r in raw} & toxic) > 2 * len({r["doc_id"] for r in clean} & toxic)

    groups = defaultdict(list)
    for r in clean:
        groups[ascii_lower(r["text"])].append(r)
    want = [min(g, key=lambda r: r["doc_id"]) for g in groups.values()]
    assert sorted(unique, key=key) == sorted(want, key=key)

    comp = brute_components({r["doc_id"]: brute_print(r["text"]) for r in sorted(unique, key=key)})
    assert sorted(far, key=key) == sorted((r for r in unique if comp[r["doc_id"]] == r["doc_id"]), key=key)

    taken = Counter({r.doc_id: r.taken for r in mixing.taken_words(inputs[3]).collect()})
    got = Counter()
    for r in mixed:
        got[r["doc_id"]] += len(r["text"].encode().split())
    assert +got == +taken

    pieces = inputs[-1].collect()
    enc_total = sum(r.length for r in pieces)
    heads = Counter(r.doc_id for r in pieces if r.start == 0)
    assert heads == Counter(r["doc_id"] for r in mixed)
    assert enc_total == sum(r.doc_tokens for r in pieces if r.start == 0)
    once = inputs[3].coalesce(2)
    check_pieces(corpus_pipeline.pack_sequences(spark, once, sf).collect(), [(r["doc_id"], r["text"]) for r in far])


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_on_edge_and_empty_tables(spark, sf, edge, empty):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns: every stage keeps the schema and what it should."""
    left = {}
    for table in (edge, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf).cache()
            if name != "packing":
                assert out.schema.simpleString() == table.schema.simpleString()
                left[name, table is empty] = Counter(r.doc_id for r in out.collect())
                docs = out
            elif table is empty:
                assert out.count() == 0
    assert all(not c for (_, none), c in left.items() if none)
    raw = Counter(r.doc_id for r in edge.collect())
    assert left["toxicity", False] == raw
    # 2 and its repeat are copies of 1; 3 (null) and 4 (empty) are equal; 9 differs from 6 by a word
    assert left["exact_dedup", False] == Counter([1, 3, None, 5, 6, 7, 8, 9])
    assert left["simhash_near_dedup", False] == Counter([1, 3, None, 6, 7, 8])
    assert set(left["mixing", False]) <= {1, None, 6, 7, 8}

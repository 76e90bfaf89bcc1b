"""Operators 3, 5, 7, 8 and 9 against brute force."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tessera.llm import bpe, exact, media, packing, simhash, token_counts
from tessera.llm.components import components, stars


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_exact_matches_sql(spark, sf):
    got = sorted(map(tuple, exact.op5_exact_dedup(spark, sf).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.sql(exact.OP5_SQL).fetchall())


def test_exact_edges(spark, edge, empty):
    got = exact.exact_dedup(edge, keep="largest").collect()
    groups = defaultdict(list)
    for r in got:
        assert r.text_sha256 == hashlib.sha256(ascii_lower(r.row.text or "").encode()).hexdigest()
        groups[r.text_sha256].append(r)
    for rows in groups.values():
        ids = [r.row.doc_id for r in rows]
        assert {r.keep_id for r in rows} == {max((i for i in ids if i is not None), default=None)}
        assert {r.group_size for r in rows} == {len(rows)} and sum(r.kept for r in rows) == 1
    assert exact.exact_dedup(empty).count() == 0
    assert exact.kept_rows(edge).columns == edge.columns and exact.kept_rows(edge).count() == len(groups)


def test_exact_hot_group(spark):
    rows = [(i, "Same Text" if i % 3 else f"t{i % 50}", "x") for i in range(3000)] + [(9999, "same text", "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(8)
    got = exact.exact_dedup(df, keep="largest").filter("row.text like '%ame %ext'").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(9999, 2002)} and sum(r.kept for r in got) == 1


def test_token_counts(spark, sf, edge, empty, tmp_path):
    enc = bpe.encoder(bpe.default_path())
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), edge):
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), n := len(enc.library.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in df.collect())
        cache = str(tmp_path / "cache")
        for _ in range(2):
            got = sorted((r[0] or -1, *r[1:]) for r in token_counts.token_counts(df, cache).collect())
            assert got == want
    assert spark.read.parquet(cache).groupBy("content_digest").count().filter("count > 1").count() == 0
    assert token_counts.token_counts(empty).count() == 0


def test_fast_ids_equal_library(spark, sf):
    enc = bpe.encoder(bpe.default_path())
    samples = [*texts(spark, sf).values(), "a b  c\n\n d'll 1²３ ñ €5–6", "<|endoftext|>x", "x​y", "́ͅe", " \x0b\x0c\x1f  q r"]
    assert enc.fast is not None
    for t in samples:
        assert enc.ids(t) == enc.library.encode(t, add_special_tokens=False).ids


def check_pieces(rows, docs):
    enc = bpe.encoder(bpe.default_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in docs:
        ids = np.array([*enc.library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc.pop(d), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start:at].tobytes())
        assert at == len(ids)
    assert not by_doc
    used = pad = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
        used += at
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad / (used + pad)


def test_packing(spark, sf, edge, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check_pieces(packing.pack(docs).collect(), texts(spark, sf).items()) < 0.004
    unique = edge.dropDuplicates(["doc_id"]).coalesce(1)
    check_pieces(packing.pack(unique).collect(), [(r.doc_id, r.text or "") for r in unique.collect()])
    assert packing.pack(empty).count() == 0


def brute_plan(doc_ends, sentence_ends, window):
    """Least cost over every pair of candidate cuts."""
    at = sorted({*doc_ends, *sentence_ends} | {0})
    cost = {0: 0.0}
    for j in at[1:]:
        best = float("inf")
        for i in (i for i in at if i < j):
            n = -(-(j - i) // window)
            if n <= packing.QUEUES:
                best = min(best, cost[i] + n * window - (j - i) + (n - 1) * packing.HARD_CUT)
                if j == at[-1] and j - i < window:
                    best = min(best, cost[i] + packing._tail(j - i, window)[0])
        cost[j] = best + (0 if j in doc_ends else packing.SENTENCE_CUT)
    return cost[at[-1]]


@pytest.mark.parametrize("seed", range(12))
def test_packing_plan_is_optimal(seed):
    rng = np.random.default_rng(seed)
    window = 128
    doc_ends = np.cumsum(rng.integers(1, 110, 30))
    slots = rng.choice(int(doc_ends[-1]) // packing.SLOT, 20, replace=False)
    sentences = np.sort(slots * packing.SLOT + 7)
    sentences = sentences[(sentences > 0) & (sentences < doc_ends[-1])]
    ends = packing.plan(doc_ends, sentences, True, window)
    assert ends[-1] == doc_ends[-1]
    cost, free, soft = 0, set(doc_ends.tolist()), set(sentences.tolist())
    for a, b in zip([0, *ends], ends):
        n = b - a
        assert 0 < n <= window
        cost += 0 if n & (n - 1) == 0 and b > doc_ends[-1] - window else window - n
        if b != doc_ends[-1]:
            cost += 0 if b in free else packing.SENTENCE_CUT if b in soft else packing.HARD_CUT
    assert cost <= brute_plan(doc_ends.tolist(), sentences.tolist(), window) + 1e-9


@pytest.mark.parametrize("seed", range(6))
def test_packing_tries_every_sentence_end(seed):
    rng = np.random.default_rng(seed)
    window = 128
    doc_ends = np.cumsum(rng.integers(100, 400, 12))
    sentences = np.flatnonzero(rng.random(int(doc_ends[-1])) < 0.1)[1:]
    ends = packing.plan(doc_ends, sentences, True, window)
    cost, free, soft = 0, set(doc_ends.tolist()), set(sentences.tolist())
    for a, b in zip([0, *ends], ends):
        n = b - a
        assert 0 < n <= window
        cost += 0 if n & (n - 1) == 0 and b > doc_ends[-1] - window else window - n
        if b != doc_ends[-1]:
            cost += 0 if b in free else packing.SENTENCE_CUT if b in soft else packing.HARD_CUT
    assert cost <= brute_plan(doc_ends.tolist(), sentences.tolist(), window) + 1e-9


def test_packing_carries_over(spark, monkeypatch):
    big = spark.createDataFrame([(i, "word and more. " * (i % 700)) for i in range(300)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(packing, "BUFFER", 1 << 15)
    check_pieces(packing.pack(big).collect(), [(r.doc_id, r.text) for r in big.collect()])


def test_media(spark, sf, edge, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), edge):
        col = media.jpeg_column(df)
        stored = defaultdict(set)
        for r in col.collect():
            stored[r.doc_id].add(hashlib.sha256(r.media).hexdigest())
        seen = {}
        want = {(r.doc_id, r.text) for r in df.collect()}
        for r in media.media_features(col).collect():
            raw = next(t.encode() for d, t in ((d, t or "") for d, t in want) if d == r.doc_id and len(t.encode()) == r.n_bytes)
            payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
            assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 in stored[r.doc_id]
            assert seen.setdefault(r.payload_sha256, r.feature) == r.feature
    assert media.media_features(media.jpeg_column(empty)).count() == 0


def test_media_frames_and_general_decoder(monkeypatch):
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, media.ROWS * 24 + 576, np.uint8).tobytes()
    frames = media.thumbnail(media.encode_payload(payload))
    assert len(frames) == 2 and b"".join(t.tobytes() for *_, t in frames) == payload
    small = payload[:1152]
    monkeypatch.setattr(media, "_even", lambda dc, ac: None)
    (w, h, thumb), = media.thumbnail(media.encode_payload(small))
    assert (w, h, thumb.tobytes()) == (192, 384, small)
    with pytest.raises(ValueError):
        media.thumbnail(b"not a picture")


def brute_print(t, k=3):
    w = ascii_lower(t).encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i: i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, sf, edge, empty):
    docs = texts(spark, sf)
    prints = {d: brute_print(t) for d, t in sorted(docs.items())}
    comp = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, sf).collect()}
    assert got == {d: (f"{p:016x}", comp[d]) for d, p in prints.items()}
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count() and {r.component_id for r in rows if r.fp == 0} == {3}
    kept = simhash.kept_rows(edge)
    assert kept.columns == edge.columns
    comp = brute_components(dict(enumerate(brute_print(r.text or "") for r in edge.collect())))
    assert kept.count() == len(set(comp.values()))
    assert simhash.near_duplicates(empty).count() == 0 == simhash.kept_rows(empty).count()


def test_simhash_keeps_one_of_each_component(spark):
    """Rows that repeat wholly, and texts that no row has an id for."""
    a, b, c = ("alpha beta gamma delta", "one two three four five", "completely other words here now")
    rows = [(7, a, 1), (7, a, 1), (7, a, 2), (None, a, 3), (None, b, 4), (None, b, 4), (None, c, 5)]
    kept = simhash.kept_rows(spark.createDataFrame(rows, "doc_id long, text string, k_hash long")).collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == sorted([(False, a), (True, b), (True, c)])


def test_simhash_chains(spark):
    rng = np.random.default_rng(5)
    fps = []
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            fps.append(x)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    comp = brute_components(dict(zip(range(len(fps)), fps)))
    want = defaultdict(set)
    for i, c in comp.items():
        want[c].add(signed[i])
    from tessera.llm.components import components

    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.near_links(df)).collect()}
    got = defaultdict(set)
    for s in signed:
        got[roots.get(s, s)].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_many_members(monkeypatch):
    rng = np.random.default_rng(2)
    low = np.unique(rng.integers(0, 1 << 12, 500, np.uint64)) | np.uint64(7 << 40)
    few = simhash.forest(low, np.uint64(0xFFFFFFFF << 32))
    monkeypatch.setattr(simhash, "MANY", 2)
    many = simhash.forest(low, np.uint64(0xFFFFFFFF << 32))
    assert len(few) == len(many) and all((a ^ b).bit_count() <= 3 for a, b in few + many)


def test_stars_equal_union_find():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (2, 1), (30, 20), (400, 300), (400, 900)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        at = list(range(n))

        def find(x):
            while at[x] != x:
                x = at[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = sorted((find(x), find(y)))
            at[y] = x
        node, root = stars(a, b)
        assert dict(zip(node.tolist(), root.tolist())) == {x: find(x) for x in {*a.tolist(), *b.tolist()} if find(x) != x}
    chain = np.arange(5000)
    node, root = stars(chain[1:], chain[:-1])
    assert len(node) == 4999 and not root.any()


def test_components_in_parts(spark, monkeypatch):
    """Star joins over parts' stars give the components that one part gives."""
    rng = np.random.default_rng(4)
    links = [(int(x), int(y)) for x, y in rng.integers(0, 300, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    df = spark.createDataFrame(links, "a long, b long")
    whole = sorted(map(tuple, components(df).collect()))
    monkeypatch.setattr("tessera.llm.components.LOCAL", 50)
    assert sorted(map(tuple, components(df).collect())) == whole

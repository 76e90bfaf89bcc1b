"""Goldens, properties and edge cases of the object-store operators."""

import hashlib
import itertools
import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import bytes as fb
from tessera.operators import antientropy, catalog, chunking, cluster, erasure, gateway, healing, integrity, multipart, placement, quorum, wal

NODES = [("node-1", "rack-1"), ("node-2", "rack-1"), ("node-3", "rack-2"), ("node-4", "rack-2"), ("node-5", "rack-3")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(n, r, "ALIVE") for n, r in NODES], "node_id string, rack string, status string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_hash_goldens(spark):
    one = spark.range(1)
    assert one.select(F.crc32(F.lit(b"123456789"))).first()[0] == 3421780262
    assert one.select(fb.rendezvous_score(F.lit("chk-1"), F.lit("node-1"))).first()[0] == 270639613054351
    assert one.select(fb.be_uint(F.lit(bytes([0, 1, 2, 255])), 1, 3)).first()[0] == 0x0102FF
    got = one.select(*[fb.human_size(F.lit(n)).alias(str(n)) for n in (0, 1, 1024, 1536, 1 << 30)]).first()
    assert list(got) == ["0 B", "1 B", "1 KB", "1.5 KB", "1 GB"]


def test_erasure_goldens():
    assert erasure.generator(4, 2)[4:].tolist() == [[142, 244, 71, 167], [244, 142, 167, 71]]
    assert erasure.generator(2, 1)[2:].tolist() == [[1, 142]]
    shards = erasure.encode(b"hello world", 4, 2)
    assert [s.hex() for s in shards[4:]] == ["d8064f", "e56b2e"]
    body = bytes((i * 37 + 13) & 255 for i in range(333))
    shards = erasure.encode(body, 2, 1)
    assert len(shards[0]) == 167 and hashlib.sha256(shards[2]).hexdigest().startswith("595b0911ba63efa1")
    assert erasure.decode([None, *shards[1:]], 2, 1, 333) == body
    with pytest.raises(ValueError, match="Insufficient shards"):
        erasure.decode([b"abc", None, None, None, None, None], 4, 2, 11)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 5), st.integers(0, 3))
def test_any_k_shards_decode(data, k, m):
    shards = erasure.encode(data, k, m)
    for have in itertools.combinations(range(k + m), k):
        assert erasure.decode([s if i in have else None for i, s in enumerate(shards)], k, m, len(data)) == data


def test_erasure_columns(spark):
    body = bytes(range(256)) * 3
    df = spark.createDataFrame([(i, body[:i]) for i in (0, 1, 5, 82, 700)], "id int, body binary")
    s = df.select("id", "body", F.length("body").alias("n"), erasure.encode_column(F.col("body"), 4, 2).alias("s"))
    for lost in ([], [0, 1], [1, 4], [4, 5]):
        out = s.select("body", erasure.decode_column(erasure.lose(F.col("s"), lost), F.col("n"), 4, 2).alias("got"), "s", erasure.reconstruct_column(erasure.lose(F.col("s"), lost), 4, 2).alias("r"))
        assert all(r.body == r.got and list(r.s) == list(r.r) for r in out.collect())


@pytest.mark.parametrize(("n", "want"), [(3, {"chk-a": "415", "chk-b": "254", "chk-c": "245"}), (6, {"chk-a": "41532", "chk-b": "25413", "chk-c": "24513"})])
def test_placement_goldens(spark, nodes, n, want):
    keys = spark.createDataFrame([(k,) for k in want], "key string")
    got = {}
    for r in sorted(placement.place(keys, nodes, n).collect(), key=lambda r: r.pos):
        got[r.key] = got.get(r.key, "") + r.node_id[-1]
    assert got == want


def loop_placement(key, nodes, n):
    scored = sorted(nodes, key=lambda x: (-int(hashlib.sha256(f"{key}:{x[0]}".encode()).hexdigest()[:12], 16), x[0]))
    leaders, rest, seen = [], [], set()
    for node in scored:
        (rest if node[1] in seen else leaders).append(node[0])
        seen.add(node[1])
    return (leaders + rest)[:n]


def test_placement_equals_loop(spark, nodes):
    keys = [f"k{i}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for n in (1, 2, 4):
        got = {}
        placed = placement.place(df, nodes, n)
        for r in sorted(placed.collect(), key=lambda r: r.pos):
            got.setdefault(r.key, []).append(r.node_id)
        assert got == {k: loop_placement(k, NODES, n) for k in keys}
    spare = {r.key: r.node_id for r in placement.surrogate(df, nodes, placement.place(df, nodes, 2)).collect()}
    assert all(spare[k] not in loop_placement(k, NODES, 2) for k in keys)
    dead = nodes.withColumn("status", F.when(F.col("node_id") == "node-1", "DEAD").otherwise("ALIVE"))
    assert placement.place(df, dead, 5).filter("node_id = 'node-1'").count() == 0


def test_chunks_and_ranges(spark):
    big = bytes((i * 31 + 7) & 255 for i in range(204_800))
    df = spark.createDataFrame([(1, big), (2, b""), (3, "né".encode())], "doc_id long, body binary")
    c = chunking.chunks(df, 65_536)
    sizes = {}
    for r in sorted(c.collect(), key=lambda r: (r.doc_id, r.idx)):
        sizes.setdefault(r.doc_id, []).append(len(r.payload))
    assert sizes == {1: [65536] * 3 + [8192], 2: [0], 3: [3]}
    got = {r.doc_id: r for r in chunking.read_range(c, 1000, 4999).collect()}
    assert got[1].body == big[1000:5000] and got[1].chunks_read == 1 and 3 not in got
    assert hashlib.sha256(got[1].body).hexdigest().startswith("303b5d89")
    across = {r.doc_id: r for r in chunking.read_range(c, 65_000, 131_072).collect()}[1]
    assert across.body == big[65_000:131_073] and across.chunks_read == 3


def test_catalog(spark):
    v = spark.createDataFrame([("a", "k", 1, "v1", 5, False), ("a", "k", 2, "v2", 6, False), ("a", "b:c", 3, "v3", 7, False), ("a:b", "c", 4, "v4", 8, True)], "bucket string, key string, seq long, version_id string, size long, is_deleted boolean")
    assert {(r.bucket, r.key, r.version_id) for r in catalog.latest(v).collect()} == {("a", "k", "v2"), ("a", "b:c", "v3"), ("a:b", "c", "v4")}
    assert catalog.live(v).count() == 2
    asked = spark.createDataFrame([("a", "k", "v1"), ("a", "k", None), ("a:b", "c", None), ("z", "z", None)], "bucket string, key string, version_id string")
    assert {(r.key, r.found_id): (r.status, r["size"]) for r in catalog.lookup(v, asked).collect()} == {("k", "v1"): (200, 5), ("k", "v2"): (200, 6), ("c", "v4"): (404, None), ("z", None): (404, None)}
    deleted = catalog.tombstones(v, asked.select("bucket", "key").distinct())
    assert {r.key: r.status for r in deleted.collect()} == {"k": 204, "c": 404, "z": 404}
    assert catalog.list_prefix(v, "a", "b").count() == 1 and catalog.list_prefix(v, None, "", 2).count() == 2


def test_prefix_reaches_the_scan(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("url").alias("key"))
    plan = catalog.list_prefix(pages, None, "https://th")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan and "html" not in plan


def test_multipart(spark):
    p = spark.createDataFrame([(1, 2, 0, b"Chunk 2 "), (1, 1, 1, b"old"), (1, 3, 2, b"Chunk 3"), (1, 1, 3, b"Chunk 1 ")], "upload_id long, part_number long, seq long, body binary")
    r = multipart.complete(p).first()
    assert r.body == b"Chunk 1 Chunk 2 Chunk 3" and (r.part_count, r["size"]) == (3, 23) and r.etag == "mp-" + hashlib.sha256(b"Chunk 1 ").hexdigest()[:16] + "-3"
    assert [c.idx for c in sorted(multipart.stitched(p).collect(), key=lambda c: c.part_number)] == [0, 1, 2]


def test_quorums(spark):
    o = spark.createDataFrame([(1, "a", 1, True, False), (1, "b", 2, False, True), (2, "a", 1, False, True), (3, "a", 1, True, False), (3, "b", 2, True, False)], "chunk_id long, node_id string, ordinal long, success boolean, corrupt boolean")
    assert {r.chunk_id: r.status for r in quorum.write_quorum(o).collect()} == {1: 503, 2: 503, 3: 201}
    assert {r.need for r in quorum.erasure_write_quorum(o).collect()} == {5}
    assert {r.chunk_id: (r.status, r.canonical_node) for r in quorum.read_quorum(o).collect()} == {1: (200, "a"), 2: (503, None), 3: (200, "a")}
    assert rows(quorum.read_repairs(o).select("chunk_id", "node_id", "source_node")) == [(1, "b", "a")]


def test_envelope_faults(spark):
    c = spark.createDataFrame([(f"c{i}", b"payload-%d" % i) for i in range(8)], "chunk_id string, payload binary")
    built = integrity.build(c)
    one = built.first()
    meta_len = int.from_bytes(one.content[8:10], "big")
    head = one.content[: 10 + meta_len]
    assert int.from_bytes(one.content[10 + meta_len: 14 + meta_len], "big") == zlib.crc32(head) and json.loads(head[10:])["payloadLength"] == 9
    col, n = F.col("content"), F.length("content")
    k = F.substring("chunk_id", 2, 1).cast("int")
    bad = built.withColumn("content", F.when(k == 1, integrity.flip(col, F.lit(0))).when(k == 2, integrity.flip(col, F.lit(20))).when(k == 3, F.substring(col, F.lit(1), n - 1)).when(k == 4, integrity.flip(col, n - 1)).when(k == 5, F.substring(col, 1, 9)).when(k == 6, F.substring(col, 1, 40)).otherwise(col))
    got = {r.chunk_id: r.status for r in integrity.verify(bad).collect()}
    assert got == {"c0": "ok", "c1": "magic", "c2": "header_crc", "c3": "length", "c4": "bitrot", "c5": "short", "c6": "truncated", "c7": "ok"}
    assert integrity.verify(bad, checksum=False).filter("chunk_id = 'c4'").first().status == "ok"
    scrubbed = integrity.scrub(integrity.verify(bad).withColumn("node_id", F.lit(1)))
    assert tuple(scrubbed.first()) == (1, 8, 2, 6)


def test_merkle_and_transfers(spark):
    assert antientropy.EMPTY_ROOT.startswith("e3b0c442") and antientropy.fold([]) == antientropy.EMPTY_ROOT
    items = spark.createDataFrame([("A", "k1", "v1", "h"), ("B", "k1", "v1", "h"), ("B", "k2", "v1", "h"), ("C", "k1", "v1", "other")], "node_id string, key string, version string, hash string")
    nodes = spark.createDataFrame([("A", "ALIVE"), ("B", "ALIVE"), ("C", "ALIVE"), ("D", "DEAD")], "node_id string, status string")
    pairs = antientropy.ring(nodes)
    assert rows(pairs) == [("A", "B"), ("B", "C"), ("C", "A")]
    assert rows(antientropy.transfers(items, pairs)) == [("B", "A", "k2"), ("B", "C", "k2")]
    assert antientropy.differing(items, pairs).count() == 4
    assert antientropy.ring(nodes.limit(1)).count() == 0
    ids = items.withColumn("node_id", F.ascii("node_id").cast("long"))
    got = {r.node_id: (r["items"], r.root) for r in antientropy.roots(ids).collect()}
    leaf = lambda k: hashlib.sha256(f"{k}:v1:h".encode()).hexdigest()
    assert got[65] == (1, leaf("k1")) and got[66] == (2, hashlib.sha256(f"{leaf('k1')}:{leaf('k2')}".encode()).hexdigest())
    same = antientropy.bucket_roots(ids.filter("node_id = 65").unionByName(ids.filter("node_id = 65").withColumn("node_id", F.lit(1).cast("long"))))
    assert same.select("root").distinct().count() == 1


def test_healing(spark, nodes):
    r = spark.createDataFrame([(1, f"node-{i}", i) for i in (1, 2, 3)] + [(2, "node-1", 1), (3, "node-2", 1), (3, "node-4", 2), (3, "node-5", 3)], "chunk_id long, node_id string, ordinal long")
    dead = nodes.withColumn("status", F.when(F.col("node_id") == "node-1", "DEAD").otherwise("ALIVE"))
    flags = spark.createDataFrame([(1, "node-3")], "chunk_id long, node_id string")
    plan = healing.replicated_plan(healing.with_health(r, dead, flags))
    got = {p.chunk_id: (p.healthy, p.priority, p.lost, p.source_node, p.first_bad) for p in plan.collect()}
    assert got == {1: (1, 1, False, "node-2", "node-1"), 2: (0, 1, True, None, "node-1")}
    target, = healing.repair_targets(plan, r, dead).collect()
    assert target.chunk_id == 1 and target.target_node in ("node-4", "node-5")
    shards = spark.createDataFrame([(1, i, i != 1) for i in range(5)], "chunk_id long, shard_index long, healthy boolean")
    assert healing.missing_shards(shards, 4, 2).first().missing == [1, 5]


def test_faults_and_hints(spark, nodes):
    links = cluster.severed(nodes.filter("rack = 'rack-1'"), nodes.filter("rack = 'rack-3'"))
    assert links.count() == 4
    calls = spark.createDataFrame([("node-1", "node-5"), ("node-1", "node-3"), ("node-4", "node-3")], "src string, dst string")
    assert rows(cluster.blocked(calls, links, nodes.filter("node_id = 'node-4'"))) == [("node-1", "node-3", False), ("node-1", "node-5", True), ("node-4", "node-3", True)]
    hints = cluster.hints(spark.createDataFrame([(1, "node-1"), (2, "node-2")], "chunk_id long, node_id string"), spark.createDataFrame([(1, "node-5")], "chunk_id long, node_id string"))
    assert rows(hints) == [("node-5", "node-1", 1)]
    delivered, kept = cluster.replay(hints, nodes)
    assert delivered.count() == 1 and kept.count() == 0
    assert cluster.badge(nodes).first().badge == "OPTIMAL"


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 7.0)], "g string, v double")
    got = {r.g: (r.n, r.p50, r.p95, r.p99) for r in cluster.latency(df, "g", "v").collect()}
    assert got == {"a": (100, 50.0, 95.0, 99.0), "b": (1, 7.0, 7.0, 7.0)}
    assert spark.range(1).select(cluster.percentile(F.array().cast("array<double>"), 0.5)).first()[0] == 0


def test_wal(spark):
    bodies = [json.dumps({"seq": i, "ts": i, "action": "PUT_OBJECT", "data": {"k": i}}).encode() for i in range(4)]
    log = b"".join(len(b).to_bytes(4, "big") + zlib.crc32(b).to_bytes(4, "big") + b for b in bodies)
    native = spark.createDataFrame([(b,) for b in bodies], "b binary").select(wal.frame(F.col("b")).alias("f")).collect()
    assert b"".join(r.f for r in native) == log
    broken = bytearray(log)
    broken[len(log) // 2 + 12] ^= 255
    df = spark.createDataFrame([("whole", log), ("cut", log[:-3]), ("rot", bytes(broken)), ("none", b"")], "log string, content binary")
    assert {r["log"]: r["count"] for r in wal.entries(df).groupBy("log").count().collect()} == {"whole": 4, "cut": 3, "rot": 2}
    e = spark.createDataFrame([("a", "x", 1, "PUT_OBJECT", "v1", 1), ("a", "x", 2, "PUT_OBJECT", "v2", 2), ("a", "y", 3, "DELETE_OBJECT", None, None), ("a", "x", 4, "NOISE", None, None), ("a", "z", 5, "PUT_OBJECT", "v5", 1), ("a", "z", 6, "DELETE_OBJECT", None, None)], "bucket string, key string, seq long, action string, version_id string, size long")
    assert rows(wal.fold(e)) == [("a", "x", 2, "v2", 2, 2)]
    assert rows(wal.recover(e.filter("seq = 1"), 1, e)) == rows(wal.fold(e))
    objects = spark.createDataFrame([("c", ["n1", "n2"]), ("d", ["n9"])], "chunk_id string, replica_nodes array<string>")
    moves = spark.createDataFrame([("c", 2, "n3", "n4"), ("c", 1, "n1", "n3"), ("c", 3, "gone", "n7")], "chunk_id string, seq long, old_node string, new_node string")
    assert rows(wal.move_replicas(objects, moves)) == [("c", ["n4", "n2", "n7"]), ("d", ["n9"])]


def test_healing_counters_count_nodes(spark, nodes, monkeypatch):
    """Chunk 1 can be healed; 2 is lost; 3 lies on every alive node, so no target is left.  No node is scored."""
    alive = [n for n, _ in NODES if n != "node-1"]
    r = [(1, "node-2", 7, 1), (2, "node-1", 5, 1)] + [(3, n, 9, i) for i, n in enumerate(alive)]
    r = spark.createDataFrame(r, "chunk_id long, node_id string, size long, ordinal long")
    dead = nodes.withColumn("status", F.when(F.col("node_id") == "node-1", "DEAD").otherwise("ALIVE"))
    flags = spark.createDataFrame([(3, "node-2"), (3, "node-3")], "chunk_id long, node_id string")
    health = healing.with_health(r, dead, flags)
    assert rows(healing.counters(health, dead)) == [(3, 2, 1, 1, 7)]
    assert rows(healing.counters(health.limit(0), dead)) == [(0, 0, 0, 0, 0)]
    targets = healing.repair_targets(healing.replicated_plan(health), r, dead)
    assert [t.chunk_id for t in targets.collect()] == [1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 3, 6])
def test_scored_rows_are_never_sorted_or_stored(spark, n):
    """A key's scores live in one array of the list of nodes, however many there are; ties and gone nodes as in the loop."""
    many = spark.range(40_000).select(F.col("id").alias("node_id"), (F.col("id") % 4).alias("rack"), F.lit("ALIVE").alias("status"))
    keys = spark.createDataFrame([("chk-1",), ("chk-2",), ("chk-2",)], "key string")
    gone = spark.createDataFrame([("chk-2", loop_placement("chk-2", [(i, i % 4) for i in range(40_000)], 1)[0]), ("chk-1", -5)], "key string, node_id long")
    placed = placement.place(keys, many, n, excluded=gone)
    assert not any(word in plan_of(placed) for word in ("Window", "NestedLoopJoin", "CartesianProduct"))
    out = {g.key: g.node_id for g in gone.collect()}
    got = {}
    for r in sorted(placed.collect(), key=lambda r: r.pos):
        got.setdefault(r.key, []).append(r.node_id)
    assert got == {k: loop_placement(k, [(i, i % 4) for i in range(40_000) if i != out[k]], n) for k in out}


def test_targets_of_more_nodes_than_a_list_holds(spark, nodes, monkeypatch):
    df = spark.createDataFrame([(f"k{i}", ["node-1", "node-9"] if i % 2 else None) for i in range(40)] + [(None, None)], "key string, gone array<string>")
    tables = lambda n: sorted(((r.key or "", [tuple(t) for t in r.targets], r.spare and tuple(r.spare)) for r in placement.with_targets(df, nodes, n, gone="gone", spare=True).collect()), key=str)
    listed = [tables(n) for n in (1, 2, 4, 9)]
    monkeypatch.setattr(placement, "MAX_NODES", 2)
    assert listed == [tables(n) for n in (1, 2, 4, 9)]
    assert all(len(t) == 5 - (k != "" and int(k[1:]) % 2) and s is None for k, t, s in listed[3])


def test_put_scores_once_or_not_at_all(spark, nodes):
    """Targets and surrogate come from one pass over the nodes; states without node ids need none; failures as written."""
    objects = spark.createDataFrame([(i, bytes(range(i)) * 3) for i in range(9)], "doc_id long, body binary").withColumn("bucket", F.lit("b"))
    fails = (F.col("doc_id") + F.col("idx") + F.col("ordinal")) % 3 == 0
    for alive in (0, 1, 2, 3, 5):
        some = nodes.withColumn("status", F.when(F.substring("node_id", 6, 1).cast("int") <= alive, "ALIVE").otherwise("DEAD"))
        full, states = gateway.written(objects, some, fails, 8), gateway.outcomes(objects, some, fails, 8)
        assert plan_of(full).count("ArrowEvalPython") == 1 and "ArrowEvalPython" not in plan_of(states)
        assert rows(full.drop("node_id")) == rows(states) and rows(gateway.put(objects, full)) == rows(gateway.put(objects, states))
        up = [x for x in NODES if int(x[0][-1]) <= alive]
        for r in full.collect():
            chosen = loop_placement(r.chunk_id, up, 3)
            spare = max((x for x in up if x[0] not in chosen), key=lambda x: hashlib.sha256(f"{r.chunk_id}:{x[0]}".encode()).digest(), default=(None,))[0]
            assert r.node_id == (spare if (r.doc_id + r.idx + r.ordinal) % 3 == 0 else chosen[r.ordinal - 1])


def test_shards_are_placed_and_made_once(spark, nodes):
    objects = spark.createDataFrame([(i, bytes(range(i))) for i in range(9)], "doc_id long, body binary")
    stored = gateway.put_shards(objects, nodes, 2, 1)
    assert plan_of(stored).count("ArrowEvalPython") == 2
    got = rows(stored.select("doc_id", "shard_index", "node_id", "shard"))
    assert got == [(i, s, loop_placement(f"chk-{i}", NODES, 3)[s], erasure.encode(bytes(range(i)), 2, 1)[s]) for i in range(9) for s in range(3)]
    assert gateway.put_shards(objects, nodes.limit(2), 2, 1).count() == 18


def test_erasure_repairs_run_each_step_once(spark, nodes):
    held = [(i, s, f"node-{s + 1}", x, s != i % 4) for i in range(8) for s, x in enumerate(erasure.encode(bytes(range(i)), 2, 1))]
    shards = spark.createDataFrame(held, "chunk_id long, shard_index long, node_id string, shard binary, healthy boolean")
    repaired = healing.erasure_repairs(shards, nodes, 2, 1)
    assert plan_of(repaired).count("ArrowEvalPython") == 2
    left = NODES[3:]
    want = [(i, i % 4, loop_placement(f"{i}.s{i % 4}", left, 1)[0], erasure.encode(bytes(range(i)), 2, 1)[i % 4]) for i in range(8) if i % 4 < 3]
    assert rows(repaired) == want


@pytest.mark.parametrize("name", ["erasure_repairs", "repair_targets", "placement_ec6", "placement_top3", "put_shards", "put_writes", "placement_surrogate"])
def test_keys_are_scored_within_the_jvm(spark, sf, name):
    """Python is given the few ranks of a key; the hashes of all nodes are made and left in the JVM."""
    assert "run(UDF(" in plan_of(__spark_entry__.queries()[name](spark, sf))


@pytest.mark.parametrize("n", [1, 2, 6])
def test_placement_of_odd_keys_and_names(spark, n):
    """Keys and ids of any length and script, nodes without a rack, and more targets than racks, as in the loop."""
    some = [("a", "r1"), ("b" * 70, "r1"), ("é", None), ("節点", None), ("", "r2"), ("x:y", "r2"), ("z", "r2")]
    nodes = spark.createDataFrame([(*x, "ALIVE") for x in some], "node_id string, rack string, status string")
    keys = ["", "k", "ключ", "k" * 54, "k" * 55, "k" * 56, "k" * 300]
    got = {}
    for r in sorted(placement.place(spark.createDataFrame([(k,) for k in keys], "key string"), nodes, n).collect(), key=lambda r: r.pos):
        got.setdefault(r.key, []).append(r.node_id)
    assert got == {k: loop_placement(k, some, n) for k in keys}


def tasks_with_rows(placed):
    return placed.select(F.spark_partition_id().alias("p")).distinct().count()


def test_surrogates_of_distinct_keys_are_placed_in_many_tasks(spark, nodes):
    """Keys that a query made distinct, and a join with the excluded nodes, leave no dealing of few bytes to one task."""
    held = spark.range(4000).select((F.col("id") % 2000).alias("chunk_id"), F.concat(F.lit("node-"), (1 + F.col("id") % 5).cast("string")).alias("node_id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # as many as keys are dealt to
    try:
        assert tasks_with_rows(placement.surrogate(held.select("chunk_id").distinct(), nodes, held, "chunk_id")) > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

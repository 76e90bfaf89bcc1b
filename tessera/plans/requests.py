"""Named queries of whole requests, repair cycles, stored state and transitions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, chunking, cluster, gateway, healing, integrity, multipart, wal
from ..sources import store
from ..sources import testbed as T
from ..sources.shared import scratch
from ..streaming import detector
from . import registry as R
from .registry import CHUNK, CHUNKS, HEALTH, LATEST, NODES, REPLICAS, SCORE, VERSIONS, query

# erasure shards in SQL: parity bytes are sums over the field of byte products with the rows' constants

#: Rows of the 4+2 generator below the identity, and the field's polynomial.
PARITY_ROWS, FIELD = ((142, 244, 71, 167), (244, 142, 167, 71)), 0x11D


def _times(constant: int) -> str:
    """SQL for constant * b in the field: the sum of constant * x^i over b's bits."""
    terms = []
    for i in range(8):
        terms.append(f"((b >> {i}) & 1) * {constant}")
        constant = constant << 1 ^ (FIELD if constant & 128 else 0)
    out = terms[0]
    for t in terms[1:]:
        out = f"xor({out}, {t})"
    return out


_MUL = " UNION ALL ".join(f"SELECT {p}::BIGINT AS p, {s}::BIGINT AS s, b, {_times(c)} AS v FROM range(256) t(b)" for p, row in enumerate(PARITY_ROWS) for s, c in enumerate(row))
EC = f"""mul AS ({_MUL}),
bodies AS (SELECT doc_id, encode(text) AS body, greatest(1, ceil(octet_length(encode(text)) / 4.0))::BIGINT AS n FROM documents),
data AS (SELECT doc_id, n, s, body[s * n + 1 : (s + 1) * n] AS part FROM bodies, (SELECT unnest([0, 1, 2, 3])::BIGINT AS s)),
full_data AS (SELECT doc_id, n, s, part || unhex(repeat('00', (n - octet_length(part))::INT)) AS shard FROM data),
places AS (SELECT doc_id, s, j, ('0x' || hex(shard[j + 1 : j + 1]))::BIGINT AS b FROM (SELECT doc_id, s, shard, unnest(range(n)) AS j FROM full_data)),
sums AS (SELECT doc_id, p, j, bit_xor(v) AS v FROM places JOIN mul USING (s, b) GROUP BY 1, 2, 3),
ec AS (SELECT doc_id, s AS shard_index, shard FROM full_data UNION ALL
  SELECT doc_id, 4 + p, unhex(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY j)) FROM sums GROUP BY doc_id, p)"""


@query(f"""WITH {EC} SELECT doc_id, shard_index, CASE WHEN shard_index < 4 THEN 'Data' ELSE 'Parity' END AS role, octet_length(shard)::BIGINT AS size, sha256(shard) AS checksum_hex FROM ec""")
def ec_encode(spark, sf_dir):
    from ..operators import erasure

    shards = T.objects(spark, sf_dir).select("doc_id", F.posexplode(erasure.encode_column(F.col("body"), 4, 2)).alias("shard_index", "shard"))
    return erasure.inspect(shards, 4).select("doc_id", F.col("shard_index").cast("long").alias("shard_index"), "role", F.length("shard").cast("long").alias("size"), F.sha2("shard", 256).alias("checksum_hex"))


# PUT and GET


def _ranked(keys: str, n: int) -> str:
    """scored and placed of ``keys`` (a table with chunk_id)."""
    return f"""scored AS (SELECT chunk_id, node_id, rack, {SCORE.format(key='chunk_id')} AS score FROM (SELECT DISTINCT chunk_id FROM {keys}), nodes WHERE status = 'ALIVE'),
    led AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, rack ORDER BY score DESC, node_id) AS rr FROM scored),
    placed AS (SELECT * FROM (SELECT chunk_id, node_id, score, row_number() OVER (PARTITION BY chunk_id ORDER BY rr > 1, score DESC, node_id) AS pos FROM led) WHERE pos <= {n})"""


_WRITES = f"""{NODES}, {CHUNKS}, {_ranked('chunks', 3)},
sent AS (SELECT c.doc_id, c.idx, c.chunk_id, p.pos AS ordinal, p.node_id, octet_length(c.payload)::BIGINT AS size, (c.doc_id + c.idx + p.pos) % 4 = 0 AS failed FROM chunks c JOIN placed p USING (chunk_id)),
spare AS (SELECT chunk_id, arg_max(node_id, (score, -node_id)) AS spare_id FROM scored WHERE (chunk_id, node_id) NOT IN (SELECT (chunk_id, node_id) FROM placed) GROUP BY 1),
writes AS (SELECT doc_id, idx, chunk_id, ordinal, CASE WHEN failed THEN spare_id ELSE node_id END AS node_id, size,
  CASE WHEN NOT failed THEN 'written' WHEN spare_id IS NOT NULL THEN 'hinted' ELSE 'failed' END AS state FROM sent LEFT JOIN spare USING (chunk_id))"""


def _writes(spark, sf_dir, by=gateway.written):
    fails = (F.col("doc_id") + F.col("idx") + F.col("ordinal")) % 4 == 0
    return by(T.objects(spark, sf_dir), T.nodes(spark, sf_dir), fails, CHUNK, 3)


@query(f"WITH {_WRITES} SELECT * FROM writes")
def put_writes(spark, sf_dir):
    return _writes(spark, sf_dir)


@query(f"""WITH {_WRITES}, per AS (SELECT doc_id, chunk_id, count_if(state <> 'failed') AS ok, count_if(state = 'hinted') AS hinted FROM writes GROUP BY 1, 2),
whole AS (SELECT doc_id, count(*) AS chunk_count, sum(ok)::BIGINT AS replica_count, sum(hinted)::BIGINT AS hint_count, min(ok) AS least FROM per GROUP BY 1)
SELECT d.doc_id, source AS bucket, octet_length(encode(text))::BIGINT AS size, sha256(encode(text)) AS etag, chunk_count, replica_count, hint_count, CASE WHEN least >= 2 THEN 201 ELSE 503 END::BIGINT AS status
FROM documents d JOIN whole USING (doc_id)""")
def put_object(spark, sf_dir):
    return gateway.put(T.objects(spark, sf_dir), _writes(spark, sf_dir, gateway.outcomes), 2)


_READS = f"""{CHUNKS}, reads AS (SELECT *, CASE WHEN (doc_id + idx) % 11 = 0 THEN 'missing' WHEN (doc_id + idx + o) % 5 = 0 THEN 'corrupt' WHEN (doc_id + idx + o) % 7 = 0 THEN 'missing' ELSE 'ok' END AS status
  FROM chunks, (SELECT unnest([1, 2, 3]) AS o))"""


def _get_sql(start: int, where: str) -> str:
    return f"""WITH {_READS}, per AS (SELECT doc_id, idx, count_if(status = 'ok') AS valid, count_if(status = 'corrupt') AS corrupt FROM reads WHERE "offset" + octet_length(payload) > {start} OR {start} = 0 GROUP BY 1, 2),
    whole AS (SELECT doc_id, min(valid) AS least, sum(CASE WHEN valid > 0 THEN corrupt ELSE 0 END)::BIGINT AS repairs FROM per GROUP BY 1)
    SELECT doc_id, CASE WHEN least >= 1 THEN 200 ELSE 503 END::BIGINT AS status, CASE WHEN least >= 1 THEN octet_length(encode(text)) - {start} END::BIGINT AS size,
    CASE WHEN least >= 1 THEN sha256(encode(text)[{start} + 1:]) END AS sha, repairs FROM whole JOIN documents USING (doc_id) WHERE {where}"""


def _reads(spark, sf_dir):
    c = chunking.chunks(T.objects(spark, sf_dir), CHUNK).withColumn("size", F.length("payload").cast("long")).withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.lit(3))))
    n = F.col("doc_id") + F.col("idx")
    status = F.when(n % 11 == 0, "missing").when((n + F.col("ordinal")) % 5 == 0, "corrupt").when((n + F.col("ordinal")) % 7 == 0, "missing").otherwise("ok")
    return c.withColumn("status", status).withColumn("payload", F.when(F.col("status") != "missing", F.col("payload")))


def _got(rows):
    return rows.select("doc_id", "status", F.length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha"), "repairs")


@query(_get_sql(0, "true"))
def get_object(spark, sf_dir):
    return _got(gateway.get(_reads(spark, sf_dir)))


@query(_get_sql(1000, "octet_length(encode(text)) > 1000"))
def get_range_to_end(spark, sf_dir):
    return _got(gateway.get(_reads(spark, sf_dir), 1000))


# erasure PUT, GET and repair

_PLACED_SHARDS = f"docs AS (SELECT doc_id, 'chk-' || doc_id AS chunk_id FROM documents), {_ranked('docs', 6)}, shards AS (SELECT doc_id, chunk_id, shard_index, node_id, shard FROM ec JOIN docs USING (doc_id) JOIN (SELECT chunk_id, node_id, pos - 1 AS shard_index FROM placed) USING (chunk_id, shard_index))"


@query(f"WITH {NODES}, {EC}, {_PLACED_SHARDS} SELECT doc_id, chunk_id, shard_index, node_id, sha256(shard) AS checksum FROM shards")
def put_shards(spark, sf_dir):
    return gateway.put_shards(T.objects(spark, sf_dir), T.nodes(spark, sf_dir)).drop("shard")


@query("""WITH s AS (SELECT doc_id, i, (doc_id + 2 * i) % 4 = 0 AS missing, (doc_id + i) % 5 = 0 AS rotten FROM documents, (SELECT unnest(range(6)) AS i)),
c AS (SELECT doc_id, count_if(NOT missing AND NOT rotten) AS valid, count_if(rotten AND NOT missing)::BIGINT AS corrupt FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN valid >= 4 THEN 200 ELSE 503 END::BIGINT AS status, CASE WHEN valid >= 4 THEN sha256(encode(text)) END AS sha, corrupt FROM c JOIN documents USING (doc_id)""")
def get_shards(spark, sf_dir):
    from ..operators import erasure

    o = T.objects(spark, sf_dir)
    s = o.select("doc_id", F.posexplode(erasure.encode_column(F.col("body"), 4, 2)).alias("shard_index", "shard"))
    i, d = F.col("shard_index"), F.col("doc_id")
    s = s.withColumn("checksum", F.sha2("shard", 256)).withColumn("shard", F.when((d + 2 * i) % 4 == 0, None).when((d + i) % 5 == 0, integrity.flip(F.col("shard"), F.lit(0))).otherwise(F.col("shard")))
    got = gateway.get_shards(o.select("doc_id", F.length("body").alias("size")), s)
    return got.select("doc_id", "status", F.sha2("body", 256).alias("sha"), "corrupt")


@query(f"""WITH {NODES}, {EC}, {_PLACED_SHARDS}, h AS (SELECT *, (doc_id + shard_index) % 5 <> 0 AND NOT (doc_id % 7 = 0 AND shard_index < 3) AS healthy FROM shards),
todo AS (SELECT chunk_id FROM h GROUP BY 1 HAVING count_if(healthy) BETWEEN 4 AND 5), bad AS (SELECT doc_id, chunk_id, i AS shard_index, chunk_id || '.s' || i AS shard_key FROM docs JOIN todo USING (chunk_id), (SELECT unnest(range(6)) AS i)
  WHERE (chunk_id, i) NOT IN (SELECT (chunk_id, shard_index) FROM h WHERE healthy)),
offers AS (SELECT b.chunk_id, b.doc_id, b.shard_index, n.node_id, {SCORE.format(key='b.shard_key').replace('node_id', 'n.node_id')} AS score FROM bad b, nodes n WHERE n.status = 'ALIVE' AND (b.chunk_id, n.node_id) NOT IN (SELECT (chunk_id, node_id) FROM shards)),
best AS (SELECT chunk_id, doc_id, shard_index, arg_max(node_id, (score, -node_id)) AS target_node FROM offers GROUP BY 1, 2, 3)
SELECT chunk_id, shard_index, target_node, sha256(shard) AS sha FROM best JOIN ec USING (doc_id, shard_index)""")
def erasure_repairs(spark, sf_dir):
    nodes = T.nodes(spark, sf_dir)
    s = gateway.put_shards(T.objects(spark, sf_dir), nodes)
    healthy = ((F.col("doc_id") + F.col("shard_index")) % 5 != 0) & ~((F.col("doc_id") % 7 == 0) & (F.col("shard_index") < 3))
    rebuilt = healing.erasure_repairs(s.select("chunk_id", "shard_index", "node_id", "shard", healthy.alias("healthy")), nodes)
    return rebuilt.select("chunk_id", "shard_index", "target_node", F.sha2("shard", 256).alias("sha"))


# repair cycles

_PLAN = f"plan AS ({R._plan_sql(3, 'h <= 1', 'h = 0', 'replicated')})"
_TARGETS = f"""scored AS (SELECT p.chunk_id, n.node_id, {SCORE.format(key='p.chunk_id').replace('node_id', 'n.node_id')} AS score FROM plan p, nodes n WHERE NOT p.lost AND n.status = 'ALIVE' AND (p.chunk_id, n.node_id) NOT IN (SELECT (chunk_id, node_id) FROM replicas)),
targets AS (SELECT DISTINCT chunk_id FROM scored)"""


@query(f"WITH {HEALTH}, {_PLAN} SELECT *, row_number() OVER (ORDER BY priority, chunk_id) - 1 AS position FROM plan")
def repair_queue(spark, sf_dir):
    return healing.queue(healing.replicated_plan(R._health(spark, sf_dir)))


@query(f"""WITH {HEALTH}, {_PLAN}, {_TARGETS}, sizes AS (SELECT chunk_id, max(size) AS size FROM replicas GROUP BY 1)
SELECT (SELECT count(*) FROM plan) AS queued, (SELECT count(*) FROM plan WHERE priority = 1) AS critical, (SELECT count(*) FROM plan WHERE lost) AS lost,
count(*) AS healed, coalesce(sum(size), 0)::BIGINT AS healed_bytes FROM targets JOIN sizes USING (chunk_id)""")
def healing_counters(spark, sf_dir):
    return healing.counters(R._health(spark, sf_dir), T.nodes(spark, sf_dir))


@query(f"WITH {REPLICAS} SELECT count(*) AS repairs FROM replicas r WHERE outcome = 'R' AND ordinal <= 3 AND chunk_id IN (SELECT chunk_id FROM replicas WHERE outcome <> 'R')")
def read_repair_counter(spark, sf_dir):
    from ..operators import quorum

    return quorum.read_repairs(R._outcomes(spark, sf_dir)).agg(F.count(F.lit(1)).alias("repairs"))


@query(f"WITH {R.STORED_SQL} SELECT chunk_id, node_id, status FROM stored WHERE status <> 'ok'")
def scrub_flags(spark, sf_dir):
    return integrity.corrupted(integrity.verify(R._stored(spark, sf_dir)))


@query(f"""WITH {R.STORED_SQL} SELECT chunk_id, node_id FROM stored WHERE status <> 'ok' AND status <> 'bitrot' UNION SELECT chunk_id, -1 FROM stored WHERE status = 'short'""")
def flags_after_repair(spark, sf_dir):
    found = integrity.corrupted(integrity.verify(R._stored(spark, sf_dir)))
    before = found.filter("status = 'short'").select("chunk_id", F.lit(-1).cast("long").alias("node_id"))
    return healing.clear_flags(healing.add_flags(before, found), found.filter("status = 'bitrot'"))


# nodes and links

_EVENTS = "ev AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'kill' WHEN 'signup' THEN 'revive' WHEN 'purchase' THEN CASE WHEN event_id % 200 = 0 THEN 'heal' ELSE 'none' END ELSE 'none' END AS op, 1 + user_id % (SELECT count(*) FROM supplier) AS node_id FROM events)"


@query(f"""WITH {NODES}, {_EVENTS}, h AS (SELECT coalesce(max(seq), -1) AS healed FROM ev WHERE op = 'heal'), l AS (SELECT node_id, max(seq) AS seq, arg_max(op, seq) AS op FROM ev WHERE op IN ('kill', 'revive') GROUP BY 1)
SELECT node_id, rack, CASE WHEN seq > healed THEN CASE WHEN op = 'kill' THEN 'DEAD' ELSE 'ALIVE' END WHEN healed >= 0 THEN 'ALIVE' ELSE status END AS status FROM nodes LEFT JOIN l USING (node_id), h""")
def node_transitions(spark, sf_dir):
    n = T.table(spark, sf_dir, "supplier").count()
    heal = F.when(F.col("event_id") % 200 == 0, "heal").otherwise("none")
    op = F.when(F.col("action") == "error", "kill").when(F.col("action") == "signup", "revive").when(F.col("action") == "purchase", heal).otherwise("none")
    events = T.heartbeats(spark, sf_dir).select(F.col("event_id").alias("seq"), op.alias("op"), (1 + F.col("node_id") % n).alias("node_id"))
    return cluster.transitions(T.nodes(spark, sf_dir), events)


@query(f"WITH {NODES}, {R._LINKS} SELECT src, dst FROM links WHERE src % 3 <> 0 AND dst % 3 <> 0")
def links_after_reconnect(spark, sf_dir):
    return cluster.reconnect(R._links(spark, sf_dir), T.nodes(spark, sf_dir).filter("node_id % 3 = 0"))


_CHANGES = f"""{R._BEATS}, g AS (SELECT node_id, epoch_us(ts) // 1000 AS beat, epoch_us(lag(ts) OVER w) // 1000 AS prev, coalesce(epoch_us(lead(ts) OVER w), epoch_us((SELECT max(ts) FROM beats))) // 1000 AS nxt FROM beats WINDOW w AS (PARTITION BY node_id ORDER BY ts, event_id)),
changes AS (SELECT node_id, beat AS at_ms, 'ALIVE' AS status FROM g WHERE prev IS NULL OR beat - prev > {R.SUSPECT * 1000}
UNION ALL SELECT node_id, beat + {R.SUSPECT * 1000}, 'SUSPECT' FROM g WHERE nxt - beat > {R.SUSPECT * 1000} UNION ALL SELECT node_id, beat + {R.DEAD * 1000}, 'DEAD' FROM g WHERE nxt - beat > {R.DEAD * 1000})"""


@query(f"WITH {_CHANGES} SELECT * FROM changes")
def heartbeat_transitions(spark, sf_dir):
    return detector.transitions_of(T.heartbeats(spark, sf_dir), R.SUSPECT, R.DEAD)


@query(f"WITH {_CHANGES} SELECT * FROM changes")
def streaming_transitions(spark, sf_dir):
    return detector.run_available(detector.transitions(R._stream(spark, sf_dir), R.SUSPECT, R.DEAD), scratch(spark, "transitions"))


@query(f"""WITH {REPLICAS}, {R._HINTS}, {_CHANGES} SELECT c.node_id AS target_id, at_ms, surrogate_id, chunk_id FROM changes c JOIN hints h ON h.target_id = c.node_id WHERE status = 'ALIVE' AND surrogate_id <> c.node_id""")
def streaming_hint_replay(spark, sf_dir):
    changes = detector.transitions(R._stream(spark, sf_dir), R.SUSPECT, R.DEAD)
    return detector.run_available(detector.replay_on_return(changes, R._hints(spark, sf_dir)), scratch(spark, "returns"))


# catalog and multipart


@query(f"WITH {VERSIONS}, {LATEST} SELECT bucket, key, seq, version_id, size FROM latest WHERE NOT is_deleted AND bucket = 'BUILDING' AND starts_with(key::VARCHAR, '1') ORDER BY seq LIMIT 1000")
def list_objects(spark, sf_dir):
    return catalog.list_objects(T.versions(spark, sf_dir), "BUILDING", "1").select("bucket", "key", "seq", "version_id", "size")


@query(f"""WITH {R._PARTS}, staged AS (SELECT upload_id, count(*) AS n FROM parts GROUP BY 1), asked AS (SELECT c_custkey AS upload_id, CASE WHEN c_custkey % 4 = 0 THEN 'abort' ELSE 'complete' END AS action FROM customer WHERE c_custkey < 1000)
SELECT upload_id, action, CASE WHEN upload_id % 10 >= 8 THEN 404 WHEN action = 'abort' THEN 204 WHEN n IS NULL THEN 409 ELSE 200 END::BIGINT AS status, coalesce(n, 0)::BIGINT AS part_count FROM asked LEFT JOIN staged USING (upload_id)""")
def multipart_requests(spark, sf_dir):
    asked = T.table(spark, sf_dir, "customer").filter("c_custkey < 1000").select(F.col("c_custkey").alias("upload_id"), F.when(F.col("c_custkey") % 4 == 0, "abort").otherwise("complete").alias("action"))
    sessions = T.table(spark, sf_dir, "customer").filter("c_custkey % 10 < 8").select(F.col("c_custkey").alias("upload_id"))
    return multipart.answer(asked, sessions, T.parts(spark, sf_dir))


# stored state: written to the shared folder and read back

_META = """'{"chunkId":"' || chunk_id || '","timestamp":0,"payloadLength":' || octet_length(payload) || ',"checksumHex":"' || sha256(payload) || '"}'"""


def _chunk_table(spark, sf_dir):
    path = scratch(spark, "chunks")
    store.write_chunks(integrity.build(chunking.chunks(T.objects(spark, sf_dir), CHUNK)), path)
    return spark.read.parquet(path)


@query(f"WITH {CHUNKS} SELECT chunk_id, 14 + octet_length(encode({_META})) + octet_length(payload) AS size_on_disk FROM chunks")
def chunk_list(spark, sf_dir):
    return _chunk_table(spark, sf_dir).select("chunk_id", F.length("content").cast("long").alias("size_on_disk"))


@query(f"WITH {CHUNKS} SELECT chunk_id, 'ok' AS status, sha256(payload) AS stated_hash FROM chunks")
def chunk_heads(spark, sf_dir):
    return integrity.verify(_chunk_table(spark, sf_dir), checksum=False).select("chunk_id", "status", "stated_hash")


@query(f"WITH {CHUNKS} SELECT chunk_id, octet_length(payload)::BIGINT AS size FROM chunks WHERE idx % 3 <> 0")
def chunk_delete(spark, sf_dir):
    gone = chunking.chunks(T.objects(spark, sf_dir), CHUNK).filter("idx % 3 = 0")
    left = store.delete_chunks(_chunk_table(spark, sf_dir), gone)
    return integrity.verify(left).select("chunk_id", F.length("payload").cast("long").alias("size"))


@query(f"""WITH {REPLICAS}, {R._HINTS} SELECT target_id, chunk_id::VARCHAR AS chunk_id, sha256(encode('body ' || chunk_id)) AS sha, chunk_id AS ts FROM hints""")
def hint_store(spark, sf_dir):
    path = scratch(spark, "hints")
    hints = R._hints(spark, sf_dir).select("target_id", "chunk_id", F.concat(F.lit("body "), F.col("chunk_id").cast("string")).cast("binary").alias("payload"), F.col("chunk_id").alias("ts"))
    store.write_hints(hints, path)
    return store.read_hints(spark, path).select("target_id", "chunk_id", F.sha2("payload", 256).alias("sha"), "ts")


@query(f"WITH {R._LOG} SELECT count(*) AS entries, max(seq) AS max_seq, count_if(seq > 500)::BIGINT AS after_snapshot FROM log")
def log_append(spark, sf_dir):
    path, log = scratch(spark, "log"), R._log(spark, sf_dir)
    store.append_log(log.filter("seq <= 500"), path)
    store.append_log(log.filter("seq > 500"), path)
    back = spark.read.parquet(path)
    kept = wal.truncated(back, 500).agg(F.count(F.lit(1)).alias("after_snapshot"))
    return back.agg(F.count(F.lit(1)).alias("entries"), F.max("seq").alias("max_seq")).crossJoin(kept)


@query(f"WITH {R._LOG} {R._FOLD.format(log='log').replace('SELECT bucket, key, seq, version_id, size, puts', 'SELECT bucket, key, seq, version_id, size')}")
def snapshot_recovery(spark, sf_dir):
    path, log = scratch(spark, "snapshot"), R._log(spark, sf_dir).withColumn("key", F.col("key").cast("string"))
    state = wal.fold(log.filter("seq <= 700")).withColumn("action", F.lit("PUT_OBJECT"))
    store.write_snapshot(state.select("bucket", "key", "seq", "action", "version_id", "size"), path)
    snapshot, seq = store.read_snapshot(spark, path)
    return wal.recover(snapshot, seq, wal.truncated(log, seq)).drop("puts").withColumn("key", F.col("key").cast("long"))


@query("""SELECT name, min(seq) AS created_seq FROM (SELECT source AS name, doc_id AS seq FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'default', NULL) GROUP BY 1""")
def wal_buckets(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    entries = docs.select(F.col("source").alias("bucket"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, "CREATE_BUCKET").otherwise("PUT_OBJECT").alias("action"))
    return wal.buckets(entries, "default")


_UPDATES = "upd AS (SELECT chunk_id, ordinal, node_id, CASE WHEN node_id IN (SELECT node_id FROM nodes WHERE status = 'DEAD') THEN -node_id ELSE node_id END AS now FROM replicas)"


def _placement_log(spark, sf_dir):
    """Log entries that move every copy on a dead node to the node of the negative number."""
    r, dead = T.replicas(spark, sf_dir), T.nodes(spark, sf_dir).filter("status = 'DEAD'").select("node_id")
    data = F.struct(F.col("chunk_id").cast("string").alias("chunkId"), F.col("node_id").alias("oldNodeId"), (-F.col("node_id")).alias("newNodeId"), F.col("ordinal").alias("shardIndex"))
    return r.join(dead, "node_id").select(F.col("ordinal").alias("seq"), F.lit("UPDATE_CHUNK_PLACEMENT").alias("action"), F.to_json(data).alias("data"))


@query(f"WITH {NODES}, {REPLICAS}, {_UPDATES} SELECT chunk_id::VARCHAR AS chunk_id, string_agg(ordinal || ':' || now, ',' ORDER BY ordinal, node_id) AS shards FROM upd GROUP BY 1")
def placement_update_shards(spark, sf_dir):
    r = T.replicas(spark, sf_dir)
    objects = r.groupBy(F.col("chunk_id").cast("string").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("shard_index"), "node_id"))).alias("shards"))
    moved = wal.move_shards(objects, wal.placement_moves(_placement_log(spark, sf_dir)))
    return moved.select("chunk_id", F.array_join(F.transform("shards", lambda s: F.concat_ws(":", s.shard_index.cast("string"), s.node_id.cast("string"))), ",").alias("shards"))


# scalar functions


@query("""SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, url_encode(url) AS encoded, rpad(url, 40, ' ') AS padded,
strftime(make_timestamp(page_id * 86400001000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM pages""")
def text_functions(spark, sf_dir):
    from ..functions import bytes as fb

    url = F.col("url")
    # the form encoding's plus stands for a blank; %20 and ~ are as in URIs
    encoded = F.replace(F.replace(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return T.table(spark, sf_dir, "pages").select("page_id", fb.escape_html(url).alias("escaped"), encoded.alias("encoded"), fb.padded(url, 40).alias("padded"), fb.iso_time(F.col("page_id") * 86400001).alias("iso"))

"""Named queries over the benchmark tables, and DuckDB SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as fb
from ..operators import antientropy, catalog, chunking, cluster, erasure, healing, integrity, multipart, placement, quorum, wal
from ..sources import testbed as T
from ..sources.shared import scratch
from ..streaming import detector

CHUNK = 1024
SUSPECT, DEAD = 6 * 3600, 24 * 3600

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: State tables as SQL, shared by the oracles.
NODES = """nodes AS (SELECT s_suppkey AS node_id, n_regionkey::BIGINT AS rack,
  CASE WHEN s_suppkey % 10 = 0 THEN 'DEAD' WHEN s_suppkey % 7 = 0 THEN 'SUSPECT' ELSE 'ALIVE' END AS status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
REPLICAS = """replicas AS (SELECT l_orderkey AS chunk_id, l_suppkey AS node_id, sum(l_quantity::BIGINT)::BIGINT AS size,
  min(l_returnflag) AS outcome, min(l_linenumber)::BIGINT AS ordinal FROM lineitem GROUP BY 1, 2)"""
VERSIONS = """versions AS (SELECT c_mktsegment AS bucket, o_custkey AS key, o_orderkey AS seq, 'v-' || o_orderkey AS version_id,
  floor(o_totalprice)::BIGINT AS size, o_orderstatus = 'F' AS is_deleted FROM orders JOIN customer ON o_custkey = c_custkey)"""
LATEST = "latest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) = 1)"
FLAGS = "flags AS (SELECT chunk_id, node_id FROM replicas WHERE outcome = 'R' AND ordinal = 1)"
HEALTH = f"""{NODES}, {REPLICAS}, {FLAGS}, health AS (SELECT r.*, coalesce(n.status, 'DEAD') = 'ALIVE' AND f.node_id IS NULL AS healthy
  FROM replicas r LEFT JOIN nodes n USING (node_id) LEFT JOIN flags f ON f.chunk_id = r.chunk_id AND f.node_id = r.node_id)"""
CHUNKS = f"""chunks AS (SELECT doc_id, i AS idx, 'chk-' || doc_id || '-' || i AS chunk_id, i * {CHUNK} AS "offset", body[i * {CHUNK} + 1 : (i + 1) * {CHUNK}] AS payload
  FROM (SELECT doc_id, encode(text) AS body, unnest(range(greatest(1, ceil(octet_length(encode(text)) / {CHUNK}.0)::BIGINT))) AS i FROM documents))"""
SCORE = "('0x' || substr(sha256({key} || ':' || node_id), 1, 12))::BIGINT"


def placed_sql(n: int, keys: str, extra: str = "") -> str:
    return f"""WITH {NODES}, keys AS ({keys}), scored AS (SELECT key, node_id, rack, {SCORE.format(key='key')} AS score FROM keys, nodes WHERE status = 'ALIVE' {extra}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key, rack ORDER BY score DESC, node_id) AS rr FROM scored),
    placed AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY rr > 1, score DESC, node_id) AS pos, node_id, rack, score FROM ranked)
    SELECT * FROM placed WHERE pos <= {n}"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# objects and chunks


@query("SELECT doc_id, source AS bucket, doc_id::VARCHAR AS key, octet_length(encode(text))::BIGINT AS size, sha256(encode(text)) AS etag FROM documents")
def object_etag(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    return o.select("doc_id", "bucket", "key", F.length("body").cast("long").alias("size"), F.sha2("body", 256).alias("etag"))


@query(f"WITH {CHUNKS} SELECT doc_id, idx, chunk_id, octet_length(payload)::BIGINT AS size, sha256(payload) AS checksum_hex FROM chunks")
def object_chunks(spark, sf_dir):
    c = chunking.chunks(T.objects(spark, sf_dir), CHUNK)
    return c.select("doc_id", "idx", "chunk_id", F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("checksum_hex"))


@query("""SELECT doc_id, octet_length(b)::BIGINT AS size, sha256(b) AS sha, (least(4, (n - 1) // 1024) + 1)::BIGINT AS chunks_read
FROM (SELECT doc_id, encode(text)[1001:5000] AS b, octet_length(encode(text)) AS n FROM documents) WHERE n > 1000""")
def chunk_range_read(spark, sf_dir):
    got = chunking.read_range(chunking.chunks(T.objects(spark, sf_dir), CHUNK), 1000, 4999)
    return got.select("doc_id", F.length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha"), "chunks_read").filter("size > 0")


@query("SELECT chunks, count(*) AS objects FROM (SELECT greatest(1, ceil(octet_length(encode(text)) / 1024.0))::BIGINT AS chunks FROM documents) GROUP BY 1")
def chunks_per_object(spark, sf_dir):
    o = T.objects(spark, sf_dir).select(chunking.chunk_count(F.length("body"), CHUNK).cast("long").alias("chunks"))
    return o.groupBy("chunks").agg(F.count(F.lit(1)).alias("objects"))


# catalog


@query(f"WITH {VERSIONS}, {LATEST} SELECT * FROM latest")
def latest_version(spark, sf_dir):
    return catalog.latest(T.versions(spark, sf_dir))


@query(f"WITH {VERSIONS}, {LATEST} SELECT bucket, key, seq, version_id, size, sha256(version_id) AS etag FROM latest WHERE NOT is_deleted")
def live_objects(spark, sf_dir):
    return catalog.live(T.versions(spark, sf_dir)).select("bucket", "key", "seq", "version_id", "size", F.sha2("version_id", 256).alias("etag"))


@query(f"""WITH {VERSIONS}, {LATEST} SELECT key, size, version_id, sha256(version_id) AS etag, 'REPLICATION' AS policy, epoch_ms(o_orderdate)::BIGINT AS last_modified
FROM latest JOIN orders ON o_orderkey = seq WHERE NOT is_deleted""")
def head_object(spark, sf_dir):
    dated = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("last_modified"))
    live = catalog.live(T.versions(spark, sf_dir)).join(dated, "seq")
    return live.select("key", "size", "version_id", F.sha2("version_id", 256).alias("etag"), F.lit("REPLICATION").alias("policy"), "last_modified")


@query(f"""WITH {VERSIONS}, {LATEST}, asked AS (SELECT c_mktsegment AS bucket, c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'v-' || c_custkey END AS version_id FROM customer),
named AS (SELECT a.bucket, a.key, coalesce(a.version_id, l.version_id) AS found_id FROM asked a LEFT JOIN latest l USING (bucket, key))
SELECT bucket, key, found_id, CASE WHEN NOT v.is_deleted THEN 200 ELSE 404 END::BIGINT AS status, CASE WHEN NOT v.is_deleted THEN v.size END AS size
FROM named LEFT JOIN (SELECT bucket, key, version_id AS found_id, size, is_deleted FROM versions) v USING (bucket, key, found_id)""")
def version_lookup(spark, sf_dir):
    asked = T.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("bucket"), F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("v-"), F.col("c_custkey").cast("string"))).alias("version_id"))
    return catalog.lookup(T.versions(spark, sf_dir), asked)


@query(f"""WITH {VERSIONS}, {LATEST} SELECT c_mktsegment AS bucket, c_custkey AS key, CASE WHEN NOT is_deleted THEN 204 ELSE 404 END::BIGINT AS status,
CASE WHEN NOT is_deleted THEN 'del-' || seq END AS version_id FROM customer LEFT JOIN latest ON bucket = c_mktsegment AND key = c_custkey""")
def delete_object(spark, sf_dir):
    asked = T.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("bucket"), F.col("c_custkey").alias("key"))
    return catalog.tombstones(T.versions(spark, sf_dir), asked)


@query("""SELECT source AS name, min(doc_id) AS created_at, 'REPLICATION' AS default_policy FROM documents WHERE source NOT IN ('src0', 'src1') GROUP BY 1""")
def create_bucket(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    have = spark.createDataFrame([("src0",), ("src1",)], "name string")
    return catalog.create_buckets(have, docs.select(F.col("source").alias("name"), F.col("doc_id").alias("created_at"), F.lit("REPLICATION").alias("default_policy")))


@query("SELECT source AS bucket, doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING min(doc_id) % 2 = 0)")
def put_into_buckets(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select(F.col("source").alias("bucket"), "doc_id")
    have = docs.groupBy(F.col("bucket").alias("name")).agg(F.min("doc_id").alias("low")).filter("low % 2 = 0")
    return catalog.append_versions(have, docs)


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://th')")
def list_prefix(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages").select("page_id", "url").withColumnRenamed("url", "key")
    return catalog.list_prefix(pages, None, "https://th").select("page_id", F.col("key").alias("url"))


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'http') ORDER BY page_id LIMIT 100")
def list_limit(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages").select("page_id", "url").withColumnRenamed("url", "key")
    return catalog.list_prefix(pages, None, "http", 100, "page_id").select("page_id", F.col("key").alias("url"))


# placement

_DOC_KEYS = "SELECT 'chk-' || doc_id AS key FROM documents"


def _doc_keys(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select(F.concat(F.lit("chk-"), F.col("doc_id").cast("string")).alias("key"))


@query(placed_sql(3, _DOC_KEYS))
def placement_top3(spark, sf_dir):
    return placement.place(_doc_keys(spark, sf_dir), T.nodes(spark, sf_dir), 3)


@query(placed_sql(6, _DOC_KEYS))
def placement_ec6(spark, sf_dir):
    return placement.place(_doc_keys(spark, sf_dir), T.nodes(spark, sf_dir), 6)


@query(f"""WITH {NODES}, {REPLICAS}, keys AS (SELECT DISTINCT chunk_id FROM replicas),
scored AS (SELECT chunk_id, node_id, rack, {SCORE.format(key='chunk_id')} AS score FROM keys, nodes WHERE status = 'ALIVE' AND (chunk_id, node_id) NOT IN (SELECT (chunk_id, node_id) FROM replicas))
SELECT chunk_id, 1::BIGINT AS pos, arg_max(node_id, (score, -node_id)) AS node_id, arg_max(rack, (score, -node_id)) AS rack, max(score) AS score FROM scored GROUP BY 1""")
def placement_surrogate(spark, sf_dir):
    r = T.replicas(spark, sf_dir)
    return placement.surrogate(r.select("chunk_id").distinct(), T.nodes(spark, sf_dir), r, "chunk_id")


@query(f"WITH {NODES} SELECT node_id, rack FROM nodes WHERE status = 'ALIVE' AND node_id NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def excluded_nodes(spark, sf_dir):
    gone = T.table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_suppkey").alias("node_id"))
    return T.nodes(spark, sf_dir).filter("status = 'ALIVE'").join(gone, "node_id", "left_anti").select("node_id", "rack")


# quorums


def _outcomes(spark, sf_dir):
    bad = F.col("outcome") == "R"
    return T.replicas(spark, sf_dir).withColumn("success", ~bad).withColumn("corrupt", bad & (F.col("ordinal") <= 3))


def _write_sql(need: int) -> str:
    return f"""WITH {REPLICAS} SELECT chunk_id, count(*) AS targets, count_if(outcome <> 'R')::BIGINT AS successes, {need}::BIGINT AS need,
    CASE WHEN count_if(outcome <> 'R') >= {need} THEN 201 ELSE 503 END::BIGINT AS status FROM replicas GROUP BY 1"""


def _read_sql(need: int) -> str:
    return f"""WITH {REPLICAS} SELECT chunk_id, count(*) AS targets, count_if(outcome <> 'R')::BIGINT AS successes, {need}::BIGINT AS need,
    CASE WHEN count_if(outcome <> 'R') >= {need} THEN 200 ELSE 503 END::BIGINT AS status, arg_min(node_id, (ordinal, node_id)) FILTER (outcome <> 'R') AS canonical_node FROM replicas GROUP BY 1"""


@query(_write_sql(2))
def write_quorum_status(spark, sf_dir):
    return quorum.write_quorum(_outcomes(spark, sf_dir))


@query(_write_sql(5))
def ec_quorum_status(spark, sf_dir):
    return quorum.erasure_write_quorum(_outcomes(spark, sf_dir))


@query(_read_sql(1))
def read_quorum_status(spark, sf_dir):
    return quorum.read_quorum(_outcomes(spark, sf_dir))


@query(_read_sql(4))
def ec_read_quorum_status(spark, sf_dir):
    return quorum.read_quorum(_outcomes(spark, sf_dir), 4)


@query(f"""WITH {REPLICAS}, src AS (SELECT chunk_id, arg_min(node_id, (ordinal, node_id)) AS source_node FROM replicas WHERE outcome <> 'R' GROUP BY 1)
SELECT chunk_id, node_id, source_node FROM replicas JOIN src USING (chunk_id) WHERE outcome = 'R' AND ordinal <= 3""")
def read_repair(spark, sf_dir):
    return quorum.read_repairs(_outcomes(spark, sf_dir))


# joins with nodes


@query(f"WITH {NODES}, {REPLICAS} SELECT chunk_id, node_id, rack, status FROM replicas JOIN nodes USING (node_id)")
def replica_node_join(spark, sf_dir):
    return cluster.resolve(T.replicas(spark, sf_dir), T.nodes(spark, sf_dir)).select("chunk_id", "node_id", "rack", "status")


@query(f"""WITH {NODES}, {REPLICAS} SELECT chunk_id, node_id, ordinal, rack, coalesce(status, 'MISSING') AS status
FROM replicas LEFT JOIN (SELECT * FROM nodes WHERE status <> 'DEAD') USING (node_id)""")
def shard_node_left_join(spark, sf_dir):
    known = T.nodes(spark, sf_dir).filter("status <> 'DEAD'")
    return cluster.resolve(T.replicas(spark, sf_dir), known, "left").select("chunk_id", "node_id", "ordinal", "rack", "status")


@query(f"WITH {REPLICAS} SELECT node_id, min(chunk_id) AS first_chunk FROM replicas GROUP BY 1")
def node_first_chunk(spark, sf_dir):
    return cluster.first_chunk(T.replicas(spark, sf_dir))


@query(f"WITH {REPLICAS} SELECT node_id, count(*) AS chunks, sum(size)::BIGINT AS bytes FROM replicas GROUP BY 1")
def disk_usage(spark, sf_dir):
    return cluster.disk_usage(T.replicas(spark, sf_dir))


@query(f"""WITH {NODES}, {REPLICAS}, u AS (SELECT node_id, count(*) AS chunks, sum(size)::BIGINT AS bytes FROM replicas GROUP BY 1)
SELECT node_id, rack, status, coalesce(chunks, 0)::BIGINT AS chunks, coalesce(bytes, 0)::BIGINT AS bytes FROM nodes LEFT JOIN u USING (node_id)""")
def node_usage(spark, sf_dir):
    return cluster.node_usage(T.nodes(spark, sf_dir), T.replicas(spark, sf_dir))


@query(f"""WITH {NODES} SELECT rack, count(*) AS nodes, count_if(status = 'ALIVE')::BIGINT AS alive, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS members FROM nodes GROUP BY 1""")
def rack_summary(spark, sf_dir):
    return cluster.racks(T.nodes(spark, sf_dir))


@query(f"""WITH {NODES} SELECT count(*) AS total, count_if(status = 'ALIVE')::BIGINT AS alive,
CASE WHEN count_if(status = 'ALIVE') = count(*) THEN 'OPTIMAL' WHEN count_if(status = 'ALIVE') >= 2 THEN 'DEGRADED' ELSE 'CRITICAL' END AS badge FROM nodes""")
def cluster_badge(spark, sf_dir):
    return cluster.badge(T.nodes(spark, sf_dir))


@query(f"""WITH {NODES}, {REPLICAS}, {VERSIONS}, {LATEST} SELECT 'nodes' AS item, count(*)::BIGINT AS n FROM nodes UNION ALL SELECT 'alive', count(*) FROM nodes WHERE status = 'ALIVE'
UNION ALL SELECT 'objects', count(*) FROM latest WHERE NOT is_deleted UNION ALL SELECT 'buckets', count(DISTINCT bucket) FROM versions
UNION ALL SELECT 'replicas', count(*) FROM replicas UNION ALL SELECT 'bytes', sum(size)::BIGINT FROM replicas UNION ALL SELECT 'hints', count(*) FROM replicas WHERE outcome = 'R'
UNION ALL SELECT 'flags', count(*) FROM replicas WHERE outcome = 'R' AND ordinal = 1 UNION ALL SELECT 'severed', 2 * (SELECT count(*) FROM nodes WHERE rack = 0) * (SELECT count(*) FROM nodes WHERE rack = 1)
UNION ALL SELECT 'queued', count(*) FROM (SELECT chunk_id FROM replicas r LEFT JOIN nodes n USING (node_id) GROUP BY 1 HAVING count_if(coalesce(n.status, 'DEAD') = 'ALIVE' AND NOT (r.outcome = 'R' AND r.ordinal = 1)) < 3)""")
def cluster_status(spark, sf_dir):
    nodes, replicas, versions = T.nodes(spark, sf_dir), T.replicas(spark, sf_dir), T.versions(spark, sf_dir)
    one = lambda item, df, agg=F.count(F.lit(1)): df.agg(agg.cast("long").alias("n")).select(F.lit(item).alias("item"), "n")
    out = one("nodes", nodes)
    parts = [one("alive", nodes.filter("status = 'ALIVE'")), one("objects", catalog.live(versions)), one("buckets", versions, F.count_distinct("bucket")), one("replicas", replicas), one("bytes", replicas, F.sum("size"))]
    parts += [one("hints", _hints(spark, sf_dir)), one("flags", replicas.filter("outcome = 'R' AND ordinal = 1")), one("severed", _links(spark, sf_dir)), one("queued", healing.replicated_plan(_health(spark, sf_dir)))]
    for part in parts:
        out = out.unionByName(part)
    return out


# network faults

_LINKS = "links AS (SELECT a.node_id AS src, b.node_id AS dst FROM nodes a, nodes b WHERE a.rack = 0 AND b.rack = 1 UNION SELECT b.node_id, a.node_id FROM nodes a, nodes b WHERE a.rack = 0 AND b.rack = 1)"


def _links(spark, sf_dir):
    n = T.nodes(spark, sf_dir)
    return cluster.severed(n.filter("rack = 0"), n.filter("rack = 1"))


@query(f"WITH {NODES}, {_LINKS} SELECT * FROM links")
def severed_links(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"""WITH {NODES}, {_LINKS}, calls AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 + 1 AS dst FROM lineitem), lone AS (SELECT node_id FROM nodes WHERE status = 'SUSPECT')
SELECT src, dst, (src IN (SELECT node_id FROM lone) OR dst IN (SELECT node_id FROM lone) OR (src, dst) IN (SELECT (src, dst) FROM links)) AS blocked FROM calls""")
def blocked_calls(spark, sf_dir):
    calls = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100 + 1).alias("dst")).distinct()
    return cluster.blocked(calls, _links(spark, sf_dir), T.nodes(spark, sf_dir).filter("status = 'SUSPECT'"))


# multipart

_PARTS = "parts AS (SELECT conv_id AS upload_id, turn + 1 AS part_number, encode(text) AS body FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY turn DESC) = 1)"


@query(f"""WITH {_PARTS} SELECT upload_id, count(*) AS part_count, sum(octet_length(body))::BIGINT AS size,
'mp-' || substr(string_agg(sha256(body), '' ORDER BY part_number), 1, 16) || '-' || count(*) AS etag, sha256(encode(string_agg(decode(body), '' ORDER BY part_number))) AS body_sha FROM parts GROUP BY 1""")
def multipart_assemble(spark, sf_dir):
    return multipart.complete(T.parts(spark, sf_dir)).select("upload_id", "part_count", "size", "etag", F.sha2("body", 256).alias("body_sha"))


@query(f"""WITH {_PARTS} SELECT upload_id, row_number() OVER (PARTITION BY upload_id ORDER BY part_number) - 1 AS idx, part_number, 'chk-mp-' || upload_id || '-p' || part_number AS chunk_id, octet_length(body)::BIGINT AS size FROM parts""")
def multipart_chunks(spark, sf_dir):
    return multipart.stitched(T.parts(spark, sf_dir))


# integrity


def _stored(spark, sf_dir):
    """Envelopes of every chunk, some broken by the chunk's number: magic, header, cut, payload."""
    built = integrity.build(chunking.chunks(T.objects(spark, sf_dir), CHUNK))
    part = lambda i: F.element_at(F.split("chunk_id", "-"), i).cast("long")
    n = part(2) * 31 + part(3)
    kind, c, size = n % 97, F.col("content"), F.length("content")
    broken = (
        F.when(kind == 1, integrity.flip(c, F.lit(0))).when(kind == 2, integrity.flip(c, F.lit(12))).when(kind == 3, F.substring(c, F.lit(1), size - 1))
        .when(kind == 4, integrity.flip(c, size - 1)).when(kind == 5, F.substring(c, 1, 9)).otherwise(c)
    )
    return built.select("chunk_id", broken.alias("content"), (n % 8).alias("node_id"), kind.alias("kind"))


@query(f"WITH {CHUNKS} SELECT chunk_id, octet_length(payload)::BIGINT AS size, sha256(payload) AS sha, 'ok' AS status FROM chunks")
def envelope_roundtrip(spark, sf_dir):
    back = integrity.verify(integrity.build(chunking.chunks(T.objects(spark, sf_dir), CHUNK)))
    return back.select("chunk_id", F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha"), "status")


#: The status each injected fault shows: of an empty payload the last byte is the header checksum's.
STORED_SQL = f"""{CHUNKS}, numbered AS (SELECT chunk_id, payload, octet_length(payload) = 0 AS bare, (doc_id * 31 + idx) % 97 AS kind, (doc_id * 31 + idx) % 8 AS node_id FROM chunks),
stored AS (SELECT chunk_id, node_id, CASE kind WHEN 1 THEN 'magic' WHEN 2 THEN 'header_crc' WHEN 3 THEN CASE WHEN bare THEN 'truncated' ELSE 'length' END WHEN 4 THEN CASE WHEN bare THEN 'header_crc' ELSE 'bitrot' END
  WHEN 5 THEN 'short' ELSE 'ok' END AS status FROM numbered)"""


@query(f"WITH {STORED_SQL} SELECT status, count(*) AS chunks FROM stored GROUP BY 1")
def verify_statuses(spark, sf_dir):
    return integrity.verify(_stored(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("chunks"))


@query(f"WITH {STORED_SQL} SELECT node_id, count(*) AS total, count_if(status = 'ok')::BIGINT AS healthy, count_if(status <> 'ok')::BIGINT AS corrupted FROM stored GROUP BY 1")
def scrub_report(spark, sf_dir):
    return integrity.scrub(integrity.verify(_stored(spark, sf_dir)))


# erasure


def _degraded(spark, sf_dir):
    o = T.objects(spark, sf_dir).select("doc_id", F.length("body").alias("size"), erasure.encode_column(F.col("body"), 4, 2).alias("s"))
    return o.select("doc_id", "size", F.when(F.col("doc_id") % 3 == 0, erasure.lose(F.col("s"), [0, 1])).when(F.col("doc_id") % 3 == 1, erasure.lose(F.col("s"), [1, 4])).otherwise(F.col("s")).alias("s"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS size, sha256(encode(text)) AS sha FROM documents")
def ec_decode_degraded(spark, sf_dir):
    body = erasure.decode_column(F.col("s"), F.col("size"), 4, 2)
    return _degraded(spark, sf_dir).select("doc_id", body.alias("body")).select("doc_id", F.length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha"))


@query("""WITH d AS (SELECT doc_id, encode(text) AS b, greatest(1, ceil(octet_length(encode(text)) / 4.0))::BIGINT AS n FROM documents)
SELECT doc_id, n AS shard_size, sha256(b[1:n] || unhex(repeat('00', (n - octet_length(b[1:n]))::INT))) AS shard_sha FROM d""")
def ec_reconstruct(spark, sf_dir):
    rebuilt = _degraded(spark, sf_dir).select("doc_id", F.element_at(erasure.reconstruct_column(F.col("s"), 4, 2), 1).alias("shard"))
    return rebuilt.select("doc_id", F.length("shard").cast("long").alias("shard_size"), F.sha2("shard", 256).alias("shard_sha"))


@query(f"""WITH {REPLICAS} SELECT chunk_id, node_id, ordinal - 1 AS shard_index, CASE WHEN ordinal - 1 < 4 THEN 'Data' ELSE 'Parity' END AS role FROM replicas""")
def placement_inspector(spark, sf_dir):
    shards = T.replicas(spark, sf_dir).select("chunk_id", "node_id", (F.col("ordinal") - 1).alias("shard_index"))
    return erasure.inspect(shards, 4)


# anti-entropy

_ITEMS = f"{REPLICAS}, items AS (SELECT node_id, chunk_id AS key, 'v1' AS version, md5(size::VARCHAR) AS hash FROM replicas)"
_RING = "alive AS (SELECT node_id FROM nodes WHERE status = 'ALIVE'), ring AS (SELECT * FROM (SELECT node_id AS a, coalesce(lead(node_id) OVER (ORDER BY node_id), (SELECT min(node_id) FROM alive)) AS b FROM alive) WHERE a <> b)"
_DIFF = "diff AS (SELECT a, b, key, hash_a, hash_b FROM (SELECT a, b, key, hash AS hash_a FROM ring JOIN items ON node_id = a) FULL JOIN (SELECT a, b, key, hash AS hash_b FROM ring JOIN items ON node_id = b) USING (a, b, key) WHERE hash_a IS DISTINCT FROM hash_b)"


def _items(spark, sf_dir):
    return T.replicas(spark, sf_dir).select("node_id", F.col("chunk_id").alias("key"), F.lit("v1").alias("version"), F.md5(F.col("size").cast("string").cast("binary")).alias("hash"))


@query(f"WITH {_ITEMS} SELECT node_id, key, version, hash, sha256(key || ':' || version || ':' || hash) AS leaf FROM items")
def merkle_leaves(spark, sf_dir):
    return antientropy.leaves(_items(spark, sf_dir))


LEVELS = 6


def _folded(deepest: int, first: str, hashed: str) -> str:
    """SQL tables h<deepest> to h0: ``first``, then pairs hashed level by level."""
    steps = [f"h{deepest} AS ({first})"]
    for d in range(deepest - 1, -1, -1):
        steps.append(f"h{d} AS ({hashed.format(d=d, up=d + 1)})")
    return ", ".join(steps)


_LEAVES = f"{_ITEMS}, leaves AS (SELECT node_id, key, sha256(key || ':' || version || ':' || hash) AS leaf FROM items)"
#: Segments of the midpoint tree by depth and place; a segment of one item is its leaf, others hash their halves.
_DEPTH = 16
_SEGMENTS = f"""counted AS (SELECT node_id, count(*)::BIGINT AS n FROM leaves GROUP BY 1), placed AS (SELECT node_id, leaf, row_number() OVER (PARTITION BY node_id ORDER BY key) - 1 AS at FROM leaves),
seg AS (SELECT node_id, 0 AS depth, 0::BIGINT AS i, 0::BIGINT AS lo, n AS hi FROM counted UNION ALL
  SELECT node_id, depth + 1, i * 2 + side, CASE side WHEN 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE side WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END FROM seg, (SELECT unnest([0, 1])::BIGINT AS side) WHERE hi - lo > 1 AND depth < {_DEPTH}),
own AS (SELECT s.node_id, depth, i, leaf AS h FROM seg s JOIN placed p ON p.node_id = s.node_id AND p.at = s.lo WHERE s.hi - s.lo = 1)"""
_ROOT = _folded(_DEPTH, f"SELECT node_id, i, h FROM own WHERE depth = {_DEPTH}", "SELECT node_id, i, h FROM own WHERE depth = {d} UNION ALL SELECT node_id, i // 2, sha256(min(h) FILTER (i % 2 = 0) || ':' || min(h) FILTER (i % 2 = 1)) FROM h{up} GROUP BY 1, 2")


@query(f"WITH RECURSIVE {_LEAVES}, {_SEGMENTS}, {_ROOT} SELECT node_id, n AS items, h AS root FROM h0 JOIN counted USING (node_id)")
def merkle_root(spark, sf_dir):
    return antientropy.roots(_items(spark, sf_dir))


_BUCKETS = _folded(
    LEVELS, f"SELECT node_id, ('0x' || substr(leaf, 1, 4))::BIGINT % {1 << LEVELS} AS i, sha256(string_agg(leaf, '' ORDER BY leaf)) AS h FROM leaves GROUP BY 1, 2",
    f"SELECT node_id, i // 2 AS i, sha256(coalesce(min(h) FILTER (i % 2 = 0), '{antientropy.EMPTY_ROOT}') || ':' || coalesce(min(h) FILTER (i % 2 = 1), '{antientropy.EMPTY_ROOT}')) AS h FROM h{{up}} GROUP BY 1, 2",
)


@query(f"WITH {_LEAVES}, {_BUCKETS} SELECT node_id, h AS root FROM h0")
def merkle_bucket_root(spark, sf_dir):
    return antientropy.bucket_roots(_items(spark, sf_dir), LEVELS)


@query(f"WITH {NODES}, {_RING} SELECT * FROM ring")
def ring_pairs(spark, sf_dir):
    return antientropy.ring(T.nodes(spark, sf_dir))


@query(f"WITH {NODES}, {_ITEMS}, {_RING}, {_DIFF} SELECT * FROM diff")
def antientropy_diff(spark, sf_dir):
    return antientropy.differing(_items(spark, sf_dir), antientropy.ring(T.nodes(spark, sf_dir)))


@query(f"""WITH {NODES}, {_ITEMS}, {_RING}, {_DIFF} SELECT CASE WHEN hash_b IS NULL THEN a ELSE b END AS src, CASE WHEN hash_b IS NULL THEN b ELSE a END AS dst, key
FROM diff WHERE hash_a IS NULL OR hash_b IS NULL""")
def antientropy_transfers(spark, sf_dir):
    return antientropy.transfers(_items(spark, sf_dir), antientropy.ring(T.nodes(spark, sf_dir)))


# healing


def _health(spark, sf_dir):
    r = T.replicas(spark, sf_dir)
    return healing.with_health(r, T.nodes(spark, sf_dir), r.filter("outcome = 'R' AND ordinal = 1").select("chunk_id", "node_id"))


def _plan_sql(desired: int, critical: str, lost: str, kind: str) -> str:
    return f"""SELECT chunk_id, '{kind}' AS kind, h AS healthy, n - h AS bad, {desired} - h AS needed, CASE WHEN {critical} THEN 1 ELSE 2 END::BIGINT AS priority, {lost} AS lost, source_node, first_bad
    FROM (SELECT chunk_id, count(*) AS n, count_if(healthy)::BIGINT AS h, arg_min(node_id, (ordinal, node_id)) FILTER (healthy) AS source_node, arg_min(node_id, (ordinal, node_id)) FILTER (NOT healthy) AS first_bad FROM health GROUP BY 1) WHERE h < {desired}"""


@query(f"WITH {HEALTH} {_plan_sql(3, 'h <= 1', 'h = 0', 'replicated')}")
def repair_plan_replicated(spark, sf_dir):
    return healing.replicated_plan(_health(spark, sf_dir))


@query(f"WITH {HEALTH} {_plan_sql(6, 'h = 4', 'h < 4', 'erasure')}")
def repair_plan_erasure(spark, sf_dir):
    return healing.erasure_plan(_health(spark, sf_dir))


@query(f"""WITH {HEALTH}, plan AS ({_plan_sql(3, 'h <= 1', 'h = 0', 'replicated')}),
scored AS (SELECT p.chunk_id, n.node_id, {SCORE.format(key='p.chunk_id').replace('node_id', 'n.node_id')} AS score FROM plan p, nodes n WHERE NOT p.lost AND n.status = 'ALIVE' AND (p.chunk_id, n.node_id) NOT IN (SELECT (chunk_id, node_id) FROM replicas)),
best AS (SELECT chunk_id, arg_max(node_id, (score, -node_id)) AS target_node FROM scored GROUP BY 1)
SELECT chunk_id, priority, source_node, first_bad, target_node FROM plan JOIN best USING (chunk_id)""")
def repair_targets(spark, sf_dir):
    return healing.repair_targets(healing.replicated_plan(_health(spark, sf_dir)), T.replicas(spark, sf_dir), T.nodes(spark, sf_dir))


@query(f"""WITH {HEALTH}, have AS (SELECT chunk_id, list(DISTINCT ordinal - 1) FILTER (healthy) AS have FROM health GROUP BY 1)
SELECT chunk_id, array_to_string(list_sort(list_filter([0, 1, 2, 3, 4, 5], lambda x: NOT coalesce(list_contains(have, x), false))), ',') AS missing FROM have""")
def missing_shards(spark, sf_dir):
    shards = _health(spark, sf_dir).withColumn("shard_index", F.col("ordinal") - 1)
    return healing.missing_shards(shards, 4, 2).select("chunk_id", F.array_join(F.array_sort("missing"), ",").alias("missing"))


# hints

_HINTS = "hints AS (SELECT r.node_id AS target_id, 1 + (r.node_id + r.chunk_id) % (SELECT count(*) FROM supplier) AS surrogate_id, r.chunk_id FROM replicas r WHERE outcome = 'R')"


def _hints(spark, sf_dir):
    n = T.table(spark, sf_dir, "supplier").count()
    failed = T.replicas(spark, sf_dir).filter("outcome = 'R'")
    return failed.select(F.col("node_id").alias("target_id"), (1 + (F.col("node_id") + F.col("chunk_id")) % n).alias("surrogate_id"), "chunk_id")


@query(f"WITH {REPLICAS}, {_HINTS} SELECT target_id, count(*) AS pending FROM hints GROUP BY 1")
def pending_hints(spark, sf_dir):
    return cluster.pending(_hints(spark, sf_dir))


@query(f"WITH {NODES}, {REPLICAS}, {_HINTS} SELECT h.* FROM hints h JOIN nodes n ON n.node_id = target_id WHERE status = 'ALIVE' AND surrogate_id <> target_id")
def hint_replay(spark, sf_dir):
    return cluster.replay(_hints(spark, sf_dir), T.nodes(spark, sf_dir))[0]


@query(f"WITH {NODES}, {REPLICAS}, {_HINTS} SELECT h.* FROM hints h WHERE target_id NOT IN (SELECT node_id FROM nodes WHERE status = 'ALIVE')")
def hints_kept(spark, sf_dir):
    return cluster.replay(_hints(spark, sf_dir), T.nodes(spark, sf_dir))[1]


# log


@query("SELECT user_id::VARCHAR AS log, event_id AS seq, epoch_us(ts) // 1000 AS ts, event_type AS action, '{\"value\":' || floor(value * 100)::BIGINT || '}' AS data FROM events")
def wal_frames(spark, sf_dir):
    ts = F.unix_millis("ts")
    body = F.to_json(F.struct(F.col("event_id").alias("seq"), ts.alias("ts"), "action", F.struct(F.floor(F.col("value") * 100).alias("value")).alias("data"))).cast("binary")
    frames = T.heartbeats(spark, sf_dir).select("node_id", "event_id", wal.frame(body).alias("frame"))
    return wal.entries(frames.groupBy(F.col("node_id").alias("log")).agg(chunking.joined("frame", "event_id").alias("content")))


_LOG = f"{VERSIONS}, log AS (SELECT bucket, key, seq, CASE WHEN is_deleted THEN 'DELETE_OBJECT' ELSE 'PUT_OBJECT' END AS action, version_id, size FROM versions)"
_FOLD = "SELECT bucket, key, seq, version_id, size, puts FROM (SELECT *, count_if(action = 'PUT_OBJECT') OVER (PARTITION BY bucket, key)::BIGINT AS puts, row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) AS last FROM {log}) WHERE last = 1 AND action = 'PUT_OBJECT'"


def _log(spark, sf_dir):
    return T.versions(spark, sf_dir).select("bucket", "key", "seq", F.when(F.col("is_deleted"), "DELETE_OBJECT").otherwise("PUT_OBJECT").alias("action"), "version_id", "size")


@query(f"WITH {_LOG} {_FOLD.format(log='log')}")
def wal_replay(spark, sf_dir):
    return wal.fold(_log(spark, sf_dir))


@query(f"WITH {_LOG}, joined AS (SELECT * FROM log WHERE seq <= 500 AND action = 'PUT_OBJECT' UNION ALL SELECT * FROM log WHERE seq > 500) {_FOLD.format(log='joined')}")
def boot_recovery(spark, sf_dir):
    log = _log(spark, sf_dir)
    return wal.recover(log.filter("seq <= 500 AND action = 'PUT_OBJECT'"), 500, log)


@query(f"""WITH {NODES}, {REPLICAS}, moved AS (SELECT chunk_id, ordinal, node_id, CASE WHEN node_id IN (SELECT node_id FROM nodes WHERE status = 'DEAD') THEN -node_id ELSE node_id END AS now FROM replicas)
SELECT chunk_id, string_agg(now::VARCHAR, ',' ORDER BY ordinal, node_id) AS replica_nodes FROM moved GROUP BY 1""")
def placement_update(spark, sf_dir):
    r = T.replicas(spark, sf_dir)
    objects = r.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "node_id"))), lambda x: x.node_id).alias("replica_nodes"))
    dead = placement.small(T.nodes(spark, sf_dir).filter("status = 'DEAD'").select("node_id"))
    moves = r.join(dead, "node_id").select("chunk_id", F.col("ordinal").alias("seq"), F.col("node_id").alias("old_node"), (-F.col("node_id")).alias("new_node"))
    return wal.move_replicas(objects, moves).select("chunk_id", F.array_join("replica_nodes", ",").alias("replica_nodes"))


# detection and latency

_BEATS = "beats AS (SELECT user_id AS node_id, ts, event_id, event_type AS action, value FROM events)"
_GAPS = f"""WITH {_BEATS}, g AS (SELECT node_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY node_id ORDER BY ts, event_id)) AS us FROM beats)
SELECT node_id, event_id, us // 1000 AS gap_ms, CASE WHEN us > {DEAD} * 1000000::BIGINT THEN 'DEAD' ELSE 'SUSPECT' END AS missed FROM g WHERE us > {SUSPECT} * 1000000::BIGINT"""


@query(f"""WITH {_BEATS}, l AS (SELECT node_id, count(*) AS beats, (epoch_us((SELECT max(ts) FROM beats)) - epoch_us(max(ts))) / 1000000.0 AS gap FROM beats GROUP BY 1)
SELECT node_id, beats, round(gap, 3) AS elapsed, CASE WHEN gap > {DEAD} THEN 'DEAD' WHEN gap > {SUSPECT} THEN 'SUSPECT' ELSE 'ALIVE' END AS status FROM l""")
def heartbeat_status(spark, sf_dir):
    return detector.status_at_end(T.heartbeats(spark, sf_dir), SUSPECT, DEAD)


@query(_GAPS)
def heartbeat_gaps(spark, sf_dir):
    return detector.gaps(T.heartbeats(spark, sf_dir), SUSPECT, DEAD)


def _stream(spark, sf_dir):
    schema = T.table(spark, sf_dir, "events").schema
    # a stream reads folders; a single file is named by a glob
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select(F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("action"), "value")


@query(_GAPS)
def streaming_detector(spark, sf_dir):
    return detector.run_available(detector.detect(_stream(spark, sf_dir), SUSPECT, DEAD), scratch(spark, "detector"))


@query(f"WITH {_BEATS} SELECT epoch(time_bucket(INTERVAL '60 minutes', ts))::BIGINT AS window_start, action, count(*) AS n, round(sum(value), 4) AS total FROM beats GROUP BY 1, 2")
def streaming_heartbeat_windows(spark, sf_dir):
    return detector.run_available(detector.windows(_stream(spark, sf_dir)), scratch(spark, "windows"), "complete")


def _rank_sql(p: float) -> str:
    return f"list_sort(list(value))[least(floor(count(*) * {p})::BIGINT, count(*) - 1) + 1]"


@query(f"SELECT event_type AS action, count(*) AS n, round(avg(value), 6) AS mean, {_rank_sql(0.5)} AS p50, {_rank_sql(0.95)} AS p95, {_rank_sql(0.99)} AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return cluster.latency(T.heartbeats(spark, sf_dir), "action", "value")


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity::BIGINT * 65536)::DOUBLE / 1048576 / (sum(l_linenumber::BIGINT)::DOUBLE / 1000), 6) AS mib_per_sec,
round(count(*) / (sum(l_linenumber::BIGINT)::DOUBLE / 1000), 6) AS ops_per_sec FROM lineitem GROUP BY 1""")
def throughput(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity").cast("long") * 65536).alias("bytes"), F.col("l_linenumber").cast("long").alias("ms"))
    return cluster.throughput(li, "l_returnflag", "bytes", "ms")


# scalar functions


@query("""SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_\\-\\.]', '_', 'g') AS name, split_part(url, '/', 3) AS host, hex(encode(url)) AS hexed, base64(encode(url)) AS b64 FROM pages""")
def scalar_functions(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", fb.safe_name(F.col("url")).alias("name"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.hex(F.encode("url", "utf-8")).alias("hexed"), fb.base64_line(F.encode("url", "utf-8")).alias("b64"))


@query("""WITH s AS (SELECT o_orderkey, (o_orderkey * o_orderkey)::BIGINT AS size FROM orders), p AS (SELECT *, CASE WHEN size < 1 THEN 0 ELSE least(4, floor(ln(size) / ln(1024) + 1e-12)) END AS k FROM s)
SELECT o_orderkey, regexp_replace(printf('%.1f', round(size / pow(1024.0, k), 1)), '\\.0$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][k::INT + 1] AS label FROM p""")
def human_sizes(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", fb.human_size(F.col("o_orderkey") * F.col("o_orderkey")).alias("label"))

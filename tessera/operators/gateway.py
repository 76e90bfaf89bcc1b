"""Whole requests as one plan each: PUT, GET, erasure PUT and GET."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import erasure
from .chunking import chunks, joined
from .placement import with_targets


def written(objects: DataFrame, nodes: DataFrame, fails: Column, size: int = 1 << 20, n: int = 3) -> DataFrame:
    """Replica writes of every chunk: doc_id, idx, chunk_id, ordinal, node_id, size, state.

    ``fails`` over (doc_id, idx, ordinal, node_id) tells which writes don't arrive.  A failed write leaves a hint with
    the chunk's surrogate, which is recorded as the replica (state hinted); without any other node it is failed.
    """
    parts = chunks(objects, size).select("doc_id", "idx", "chunk_id", F.length("payload").cast("long").alias("size"))
    placed = with_targets(parts, nodes, n, "chunk_id", spare=True).select("doc_id", "idx", "chunk_id", "size", "spare", F.posexplode("targets").alias("__at", "__target"))
    sent = placed.select("doc_id", "idx", "chunk_id", (F.col("__at") + 1).cast("long").alias("ordinal"), "__target.node_id", "size", F.col("spare.node_id").alias("__spare")).withColumn("failed", fails)
    state = F.when(~F.col("failed"), "written").when(F.col("failed") & F.col("__spare").isNotNull(), "hinted").otherwise("failed")
    return sent.select("doc_id", "idx", "chunk_id", "ordinal", F.when(F.col("failed"), F.col("__spare")).otherwise(F.col("node_id")).alias("node_id"), "size", state.alias("state"))


def outcomes(objects: DataFrame, nodes: DataFrame, fails: Column, size: int = 1 << 20, n: int = 3) -> DataFrame:
    """``written`` without the nodes: doc_id, idx, chunk_id, ordinal, size, state, where ``fails`` is over (doc_id, idx, ordinal).

    Which nodes are chosen doesn't change a state: a chunk has ``n`` targets or all alive nodes, and a surrogate if more
    are alive, so nodes are counted and not scored.
    """
    parts = chunks(objects, size).select("doc_id", "idx", "chunk_id", F.length("payload").cast("long").alias("size"))
    alive = nodes.filter(F.col("status") == "ALIVE").agg(F.count(F.lit(1)).alias("__alive"))
    targets = F.when(F.col("__alive") > 0, F.sequence(F.lit(1).cast("long"), F.least(F.col("__alive"), F.lit(n))))
    sent = parts.crossJoin(F.broadcast(alive)).withColumn("ordinal", F.explode(targets)).withColumn("failed", fails)
    state = F.when(~F.col("failed"), "written").when(F.col("failed") & (F.col("__alive") > n), "hinted").otherwise("failed")
    return sent.select("doc_id", "idx", "chunk_id", "ordinal", "size", state.alias("state"))


def put(objects: DataFrame, writes: DataFrame, w: int = 2) -> DataFrame:
    """Version rows of a PUT: doc_id, bucket, size, etag, chunk_count, replica_count, hint_count, status.

    201 where every chunk has ``w`` writes that arrived or are hinted, else 503.
    """
    arrived = F.col("state") != "failed"
    by_chunk = writes.groupBy("doc_id", "chunk_id").agg(F.count_if(arrived).alias("ok"), F.count_if(F.col("state") == "hinted").alias("hinted"))
    whole = by_chunk.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("ok").alias("replica_count"), F.sum("hinted").alias("hint_count"), F.min("ok").alias("least"))
    head = objects.select("doc_id", "bucket", F.length("body").cast("long").alias("size"), F.sha2("body", 256).alias("etag"))
    status = F.when(F.coalesce("least", F.lit(0)) >= w, 201).otherwise(503).cast("long")
    return head.join(whole, "doc_id", "left").select("doc_id", "bucket", "size", "etag", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chunk_count", "replica_count", "hint_count")], status.alias("status"))


def get(replicas: DataFrame, start: int = 0, end: int | None = None, r: int = 1) -> DataFrame:
    """Bodies from replica reads (doc_id, idx, offset, size, ordinal, status, payload): doc_id, status, body, repairs.

    All replicas of a chunk are read; the first valid one by ordinal is its content, corrupt ones count as repairs, and
    a chunk with fewer than ``r`` valid ones makes the answer 503.  Of a byte range, chunks outside are never read.
    """
    last = (1 << 31) - 2 if end is None else end
    touched = replicas if (start, end) == (0, None) else replicas.filter((F.col("offset") <= last) & (F.col("offset") + F.col("size") > start))
    ok = F.col("status") == "ok"
    chunk = touched.groupBy("doc_id", "idx", "offset").agg(F.count_if(ok).alias("valid"), F.count_if(F.col("status") == "corrupt").alias("corrupt"), F.min(F.when(ok, F.struct("ordinal", "payload"))).alias("first"))
    body, n = F.col("first.payload"), F.length("first.payload")
    lo = F.greatest(F.lit(0), F.lit(start) - F.col("offset"))
    cut = F.substring(body, (lo + 1).cast("int"), (F.least(n, F.lit(last + 1) - F.col("offset")) - lo).cast("int"))
    whole = chunk.withColumn("piece", cut).groupBy("doc_id").agg(F.min("valid").alias("least"), F.sum(F.when(F.col("valid") > 0, F.col("corrupt")).otherwise(0)).cast("long").alias("repairs"), joined("piece", "idx").alias("body"))
    good = F.col("least") >= r
    return whole.select("doc_id", F.when(good, 200).otherwise(503).cast("long").alias("status"), F.when(good, F.col("body")).alias("body"), "repairs")


def put_shards(objects: DataFrame, nodes: DataFrame, k: int = 4, m: int = 2) -> DataFrame:
    """Erasure PUT: doc_id, chunk_id, shard_index, node_id, shard, checksum; shard i goes to the i-th target.

    A cluster of fewer than k + m nodes stores fewer shards.
    """
    own = objects.select("doc_id", "body", F.concat(F.lit("chk-"), F.col("doc_id").cast("string")).alias("chunk_id"))
    placed = with_targets(own, nodes, k + m, "chunk_id").select("doc_id", "chunk_id", F.col("targets.node_id").alias("__nodes"), erasure.encode_column(F.col("body"), k, m).alias("__shards"))
    shards = placed.select("doc_id", "chunk_id", "__nodes", F.posexplode("__shards").alias("__at", "shard")).filter(F.col("__at") < F.size("__nodes"))
    return shards.select("doc_id", "chunk_id", F.col("__at").cast("long").alias("shard_index"), F.get("__nodes", F.col("__at")).alias("node_id"), "shard", F.sha2("shard", 256).alias("checksum"))


def get_shards(objects: DataFrame, shards: DataFrame, k: int = 4, m: int = 2) -> DataFrame:
    """Erasure GET: (doc_id, size) and shard reads (doc_id, shard_index, shard or null, checksum) -> doc_id, status, body, corrupt.

    Shards whose bytes don't match their checksum are corrupt; k valid ones decode, fewer answer 503.
    """
    valid = F.col("shard").isNotNull() & (F.sha2("shard", 256) == F.col("checksum"))
    read = shards.withColumn("valid", F.coalesce(valid, F.lit(False)))
    have = F.collect_list(F.when(F.col("valid"), F.struct(F.col("shard_index").cast("int").alias("i"), "shard")))
    chunk = read.groupBy("doc_id").agg(F.map_from_entries(have).alias("have"), F.count_if(F.col("shard").isNotNull() & ~F.col("valid")).alias("corrupt"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(k + m - 1)), lambda i: F.try_element_at("have", i))
    rows = objects.select("doc_id", "size").join(chunk.select("doc_id", "corrupt", F.size("have").alias("valid"), slots.alias("slots")), "doc_id", "left")
    good = F.coalesce("valid", F.lit(0)) >= k
    body = erasure.decode_column(F.when(good, F.col("slots")), F.col("size"), k, m)
    return rows.select("doc_id", F.when(good, 200).otherwise(503).cast("long").alias("status"), F.when(good, body).alias("body"), F.coalesce("corrupt", F.lit(0)).cast("long").alias("corrupt"))

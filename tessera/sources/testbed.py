"""Object-store state read out of the benchmark tables.

documents are objects (bucket = source, key = id, body = UTF-8 text); pages are objects with path-like keys;
supplier, nation and region make nodes in racks; lineitem rows are replicas of chunks (orders) on nodes; orders of a
customer are versions of a key; conversations are multipart uploads; events are heartbeats and log entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, bucket, key, body."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("bucket"), F.col("doc_id").cast("string").alias("key"), F.encode("text", "utf-8").alias("body"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, rack, status: every tenth node is dead, every seventh of the others suspect."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    status = F.when(F.col("s_suppkey") % 10 == 0, "DEAD").when(F.col("s_suppkey") % 7 == 0, "SUSPECT").otherwise("ALIVE")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("node_id"), F.col("n_regionkey").cast("long").alias("rack"), status.alias("status"))


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, node_id, size, outcome, ordinal: one replica per chunk and node, its first line."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("node_id")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("size"), F.min("l_returnflag").alias("outcome"), F.min("l_linenumber").cast("long").alias("ordinal")
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket, key, seq, version_id, size, is_deleted: orders by customer; an order with status F is a tombstone."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("bucket"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("v-"), F.col("o_orderkey").cast("string")).alias("version_id"), F.floor("o_totalprice").alias("size"), (F.col("o_orderstatus") == "F").alias("is_deleted"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upload_id, part_number, seq, body: a turn is a part."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("upload_id"), (F.col("turn") + 1).alias("part_number"), F.col("turn").alias("seq"), F.encode("text", "utf-8").alias("body"))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, ts, event_id, action, value; the table's zone-less times are read as UTC."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("action"), "value", "props")

"""Merkle leaves and roots, divergence between replicas, ring synchronisation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def leaves(items: DataFrame) -> DataFrame:
    """``items`` (node_id, key, version, hash) with the leaf hash."""
    return items.withColumn("leaf", F.sha2(F.concat_ws(":", F.col("key").cast("string"), "version", "hash").cast("binary"), 256))


def fold(level: list[str]) -> str:
    """The root of sorted leaf hashes, split at the middle."""
    if not level:
        return EMPTY_ROOT
    if len(level) == 1:
        return level[0]
    mid = len(level) // 2
    return hashlib.sha256(f"{fold(level[:mid])}:{fold(level[mid:])}".encode()).hexdigest()


def roots(items: DataFrame) -> DataFrame:
    """node_id, items, root of the midpoint tree over items in key order.

    A node's leaves (64 characters an item) are folded in one task: the tree's shape depends on their number.  For
    nodes whose leaves outgrow a task use ``bucket_roots``, which is made of shuffled aggregates only.
    """

    def run(table: pa.Table) -> pa.Table:
        ordered = table.sort_by([("key", "ascending")])
        return pa.table({"node_id": ordered.column("node_id")[:1].cast(pa.int64()), "items": pa.array([len(ordered)], pa.int64()), "root": [fold(ordered.column("leaf").to_pylist())]})

    return leaves(items).select("node_id", "key", "leaf").groupBy("node_id").applyInArrow(run, "node_id long, items long, root string")


def bucket_levels(items: DataFrame, leaves_a_bucket: int = 256) -> int:
    """Levels that leave about ``leaves_a_bucket`` leaves of the largest node in a bucket, 16 at most."""
    most = items.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return min(16, max(1, (most // leaves_a_bucket).bit_length()))


def bucket_roots(items: DataFrame, levels: int | None = None) -> DataFrame:
    """node_id, root of a tree of fixed shape: 2^levels buckets by leaf prefix, then pairs up, level by level.

    All sides of a comparison need the same ``levels``; by default they follow the largest node's items.
    """
    levels = bucket_levels(items) if levels is None else levels
    bucket = F.conv(F.substring("leaf", 1, 4), 16, 10).cast("int") % (1 << levels)
    now = leaves(items).groupBy("node_id", bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), "").cast("binary"), 256).alias("h"))
    for _ in range(levels):
        side = lambda b: F.coalesce(F.max(F.when(F.col("bucket") % 2 == b, F.col("h"))), F.lit(EMPTY_ROOT))
        now = now.groupBy("node_id", F.floor(F.col("bucket") / 2).cast("int").alias("up")).agg(F.sha2(F.concat_ws(":", side(0), side(1)).cast("binary"), 256).alias("h")).withColumnRenamed("up", "bucket")
    return now.select("node_id", F.col("h").alias("root"))


def ring(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of each alive node with the next, the last with the first; none below two nodes."""
    alive = nodes.filter(F.col("status") == "ALIVE").select("node_id")
    everything = Window.orderBy("node_id")
    nxt = F.coalesce(F.lead("node_id").over(everything), F.first("node_id").over(everything.rowsBetween(Window.unboundedPreceding, 0)))
    return alive.select(F.col("node_id").alias("a"), nxt.alias("b")).filter("a <> b")


def differing(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys that differ between the nodes of each pair: (a, b, key, hash_a, hash_b), a missing side null."""
    own = items.select("node_id", "key", "hash")
    left = pairs.join(own.withColumnsRenamed({"node_id": "a", "hash": "hash_a"}), "a")
    right = pairs.join(own.withColumnsRenamed({"node_id": "b", "hash": "hash_b"}), "b")
    both = left.join(right, ["a", "b", "key"], "full_outer")
    return both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("a", "b", "key", "hash_a", "hash_b")


def transfers(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Copies (src, dst, key) that make both ends of each pair hold the union of their keys."""
    one = differing(items, pairs).filter(F.col("hash_a").isNull() | F.col("hash_b").isNull())
    from_a = F.col("hash_b").isNull()
    return one.select(F.when(from_a, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(from_a, F.col("b")).otherwise(F.col("a")).alias("dst"), "key")

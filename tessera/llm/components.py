"""Connected components: parts of the links first, each in a task's memory, then large-star and small-star joins.

A task takes about ``LOCAL`` links and leaves a star of each component that it sees; where all links are one such part,
that is the result.  Else rounds of star joins follow.  Each round is two shuffled aggregates and joins over the links, written to the shared folder, so a lost executor
costs at most a round; nothing about single links reaches the driver but two sums that tell whether a round changed
anything.  The number of rounds is logarithmic in the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SALTS, LOCAL = 8, 100_000
LINKS = "a long, b long"


def join_salted(many: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """``many`` joined to ``one`` (a row per key); a key's rows are dealt by ``spread`` over ``SALTS`` tasks."""
    salted = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"]).drop("__salt")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return join_salted(both.filter(F.col("b") > F.col("a")), low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` run from the larger end a to the smaller b."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = join_salted(links, low, "a", "b").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionByName(moved)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component among these links) of all nodes that aren't the smallest."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    low = np.arange(len(nodes))
    while True:
        up = low.copy()
        np.minimum.at(up, low[x], low[y])
        np.minimum.at(up, low[y], low[x])
        while (up != up[up]).any():
            up = up[up]
        up = up[low]
        if (up == low).all():
            break
        low = up
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in stars(*(np.concatenate(c) for c in zip(*held)))], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long) that is not its component's smallest."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = materialize(now, "links")
    parts = -(-now.count() // LOCAL)
    now = materialize(now.repartition(max(1, parts)).mapInArrow(_local, LINKS), "links")
    if parts <= 1:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    while True:
        seen = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
        if seen == state or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
        now = materialize(_small_star(_large_star(now)).distinct(), "links")


def smallest_of_component(nodes: DataFrame, roots: DataFrame, node: str, low: str, name: str) -> DataFrame:
    """``nodes`` with ``name``, the smallest ``low`` in the node's component, and ``root``; ``roots`` as of ``components``."""
    ends = roots.select(F.col("node").alias(node), "root").unionByName(roots.select(F.col("root").alias(node), "root").distinct())
    placed = nodes.join(ends, node, "left")
    linked = placed.filter(F.col("root").isNotNull())
    named = join_salted(linked, linked.groupBy("root").agg(F.min(low).alias(name)), "root", node)
    alone = placed.filter(F.col("root").isNull()).withColumn(name, F.col(low)).withColumn("root", F.col(node))
    return named.select(*nodes.columns, name, "root").unionByName(alone.select(*nodes.columns, name, "root"))

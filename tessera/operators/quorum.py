"""Write and read quorums over outcome rows (chunk_id, success)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tally(outcomes: DataFrame, need: Column, extra: list[Column] | None = None) -> DataFrame:
    counted = outcomes.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("targets"), F.count_if("success").alias("successes"), *(extra or []))
    return counted.withColumn("need", need.cast("long"))


def write_quorum(outcomes: DataFrame, w: int = 2) -> DataFrame:
    """503 where fewer than w targets exist or succeed, else 201."""
    out = _tally(outcomes, F.lit(w))
    ok = (F.col("targets") >= F.col("need")) & (F.col("successes") >= F.col("need"))
    return out.withColumn("status", F.when(ok, 201).otherwise(503).cast("long"))


def erasure_write_quorum(outcomes: DataFrame, k: int = 4, m: int = 2) -> DataFrame:
    """The same with k + ceil(m / 2)."""
    return write_quorum(outcomes, k + -(-m // 2))


def read_quorum(outcomes: DataFrame, r: int = 1) -> DataFrame:
    """200 where at least r replicas are valid; the canonical one is the first valid by ordinal."""
    canonical = F.min(F.when(F.col("success"), F.struct("ordinal", "node_id"))).alias("first")
    out = _tally(outcomes, F.lit(r), [canonical])
    return out.select("chunk_id", "targets", "successes", "need", F.when(F.col("successes") >= F.col("need"), 200).otherwise(503).cast("long").alias("status"), F.col("first.node_id").alias("canonical_node"))


def read_repairs(outcomes: DataFrame) -> DataFrame:
    """Corrupt replicas of chunks that have a valid one: (chunk_id, node_id, source_node)."""
    source = outcomes.filter("success").groupBy("chunk_id").agg(F.min(F.struct("ordinal", "node_id")).alias("s")).select("chunk_id", F.col("s.node_id").alias("source_node"))
    return outcomes.filter(~F.col("success") & F.col("corrupt")).select("chunk_id", "node_id").join(source, "chunk_id")

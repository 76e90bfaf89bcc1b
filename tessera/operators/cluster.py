"""Joins and roll-ups over nodes: usage, racks, badge, hints, network faults, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import offsets, range_of, splitters
from .placement import small


def disk_usage(replicas: DataFrame) -> DataFrame:
    return replicas.groupBy("node_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"))


def node_usage(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    """Every node with its usage, 0 where it holds nothing."""
    out = nodes.join(disk_usage(replicas), "node_id", "left")
    return out.select("node_id", "rack", "status", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def racks(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("rack").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("status") == "ALIVE").alias("alive"), F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("members"))


def badge(nodes: DataFrame) -> DataFrame:
    out = nodes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ALIVE").alias("alive"))
    return out.withColumn("badge", F.when(F.col("alive") == F.col("total"), "OPTIMAL").when(F.col("alive") >= 2, "DEGRADED").otherwise("CRITICAL"))


def resolve(replicas: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """Replicas with their node's rack and status; ``how='left'`` keeps those of unknown nodes as failed."""
    out = replicas.join(small(nodes), "node_id", how)
    return out if how == "inner" else out.withColumn("status", F.coalesce("status", F.lit("MISSING")))


def first_chunk(replicas: DataFrame) -> DataFrame:
    """The first chunk each node holds."""
    return replicas.groupBy("node_id").agg(F.min("chunk_id").alias("first_chunk"))


def hints(failed: DataFrame, surrogates: DataFrame) -> DataFrame:
    """Hints for failed writes: (surrogate_id, target_id, chunk_id); a chunk without a surrogate fails instead."""
    return failed.select("chunk_id", F.col("node_id").alias("target_id")).join(surrogates.select("chunk_id", F.col("node_id").alias("surrogate_id")), "chunk_id").select("surrogate_id", "target_id", "chunk_id")


def pending(hints: DataFrame) -> DataFrame:
    return hints.groupBy("target_id").agg(F.count(F.lit(1)).alias("pending"))


def replay(hints: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(delivered, kept): hints of alive targets are written and deleted, others stay."""
    alive = small(nodes.filter(F.col("status") == "ALIVE").select(F.col("node_id").alias("target_id")))
    due = hints.filter(F.col("surrogate_id") != F.col("target_id"))
    return due.join(alive, "target_id", "left_semi"), hints.join(alive, "target_id", "left_anti")


def severed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both directions of a partition between two node lists (src, dst)."""
    ab = small(a.select(F.col("node_id").alias("src"))).crossJoin(small(b.select(F.col("node_id").alias("dst"))))
    return ab.unionByName(ab.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reconnect(links: DataFrame, healed: DataFrame) -> DataFrame:
    """Severed links left after nodes (node_id) are connected again: none that begins or ends at one."""
    out = links
    for end in ("src", "dst"):
        out = out.join(healed.select(F.col("node_id").alias(end)), end, "left_anti")
    return out.select("src", "dst")


def transitions(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Node status after events (seq, op, node_id): kill, revive, or heal, which revives all.

    A node's last event counts, unless a heal came after it; other ops are ignored.
    """
    last = events.filter(F.col("op").isin("kill", "revive")).groupBy("node_id").agg(F.max(F.struct("seq", "op")).alias("last"))
    healed = events.filter(F.col("op") == "heal").agg(F.max("seq").alias("healed"))
    own = nodes.join(last, "node_id", "left").crossJoin(F.broadcast(healed))
    recent = F.col("last.seq") > F.coalesce("healed", F.lit(-(1 << 62)))
    status = F.when(recent, F.when(F.col("last.op") == "kill", "DEAD").otherwise("ALIVE")).when(F.col("healed").isNotNull(), "ALIVE").otherwise(F.col("status"))
    return own.select("node_id", "rack", status.alias("status"))


def blocked(calls: DataFrame, links: DataFrame, isolated: DataFrame) -> DataFrame:
    """``calls`` (src, dst) with blocked: an isolated end, or the link cut either way."""
    lone = isolated.select("node_id")
    cut = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("cut", F.lit(True))
    ends = lambda c, n: lone.select(F.col("node_id").alias(c), F.lit(True).alias(n))
    out = calls.join(cut, ["src", "dst"], "left").join(small(ends("src", "from_lone")), "src", "left").join(small(ends("dst", "to_lone")), "dst", "left")
    return out.select("src", "dst", F.coalesce("cut", "from_lone", "to_lone", F.lit(False)).alias("blocked"))


def percentile(values: Column, p: float) -> Column:
    """sorted[floor(n p)] of an array column, its last element at p = 1, 0 if empty."""
    n = F.size(values)
    at = F.least(F.floor(n * F.lit(p)).cast("int"), n - 1)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.element_at(values, F.greatest(at, F.lit(0)) + 1))


def latency(samples: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, p50, p95, p99 per group by exact ranks.

    Values are dealt into ranges, ranges are counted, and only those that hold a wanted rank are sorted, each by itself.
    """
    rows = samples.select(group, F.col(value).alias("v"))
    ranged = rows.withColumn("__range", range_of(F.col("v"), splitters(rows, "v")))
    counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    ranks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    wanted = counted.select(group, "n", *[F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1).alias(name) for name, p in ranks.items()])
    held = offsets(ranged, [], [group]).join(wanted, group)
    inside = lambda name: (F.col(name) >= F.col("__ahead")) & (F.col(name) < F.col("__ahead") + F.col("__size"))
    held = held.filter(inside("p50") | inside("p95") | inside("p99")).select(group, "__range", "__ahead", *ranks)
    ordered = ranged.join(held, [group, "__range"]).withColumn("__at", F.col("__ahead") + F.row_number().over(Window.partitionBy(group, "__range").orderBy("v")) - 1)
    picked = ordered.groupBy(group).agg(*[F.max(F.when(F.col("__at") == F.col(name), F.col("v"))).alias(name) for name in ranks])
    return counted.join(picked, group).select(group, "n", "mean", *ranks)


def throughput(samples: DataFrame, group: str, size: str, millis: str) -> DataFrame:
    """MiB and operations per second of each group."""
    out = samples.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.sum(millis).alias("ms"))
    sec = F.col("ms") / 1000
    return out.select(group, "n", F.round(F.col("bytes") / (1 << 20) / sec, 6).alias("mib_per_sec"), F.round(F.col("n") / sec, 6).alias("ops_per_sec"))

"""Rack-aware rendezvous placement."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jvm
from ..functions.bytes import score_digits

#: Nodes are a dimension; a broadcast of more rows than this is refused and the join shuffles instead.
MAX_NODES = 100_000


def small(df: DataFrame, rows: int = MAX_NODES) -> DataFrame:
    """``df`` marked for broadcast if its counted size allows it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _fetched(nodes: DataFrame) -> pa.Table | None:
    """The alive nodes (node_id, rack, name), by rack and id; None if they are too many for one list."""
    own = nodes.filter(F.col("status") == "ALIVE").select("node_id", "rack").withColumn("name", F.coalesce(F.concat(F.lit(":"), F.col("node_id").cast("string")), F.lit("")).cast("binary"))
    found = own.limit(MAX_NODES + 1).toArrow()
    if found.num_rows > MAX_NODES:
        return None
    found = found.take(pc.sort_indices(found, sort_keys=[("rack", "ascending"), ("node_id", "ascending")]))
    return found.combine_chunks()


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key to a stated number of partitions: a plain shuffle of few bytes would end in one task.

    Dealt by the key's hash, as Spark leaves a shuffle by the key itself out where its input is dealt by that key.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), F.xxhash64(key))


def _listed(nodes: pa.Table) -> bytes:
    """The list of nodes as Ranker.java reads it: turn among ids (ties go by node id), rack, length of the name, name."""
    racks = pc.fill_null(nodes.column("rack").combine_chunks().dictionary_encode().indices, -1).to_pylist()
    order = pc.sort_indices(nodes.column("node_id").combine_chunks()).to_numpy()
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    names = nodes.column("name").to_pylist()
    return struct.pack(">i", len(names)) + b"".join(struct.pack(">iii", t, r, len(x)) + x for t, r, x in zip(turn.tolist(), racks, names))


def _ranked(nodes: DataFrame, found: pa.Table, n: int, key: Column, gone: Column | None, spare: bool) -> Column:
    """array of (node_id, rack, score): a key's targets, with ``spare`` one more."""
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    item = T.StructType([T.StructField("node_id", kinds["node_id"]), T.StructField("rack", kinds["rack"]), T.StructField("score", T.LongType())])

    def run(ranks: pa.Array) -> pa.Array:
        got = ranks.to_pylist()
        at, scores = np.frombuffer(b"".join(got), ">i8").astype(np.int64).reshape(-1, 2).T
        chosen = [found.column(c).combine_chunks().take(pa.array(at)) for c in ("node_id", "rack")]
        items = pa.StructArray.from_arrays([*chosen, pa.array(scores)], ["node_id", "rack", "score"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(g) // 16 for g in got]), pa.int32()), items)

    left_out = F.lit(None).cast("array<string>") if gone is None else gone.cast("array<string>")
    ranks = jvm.call(nodes.sparkSession, "Ranker", [_listed(found), n, spare], "binary", key.cast("string").cast("binary"), left_out)
    # as "nondeterministic" it isn't run again for the filters that the optimizer infers from posexplode
    return F.arrow_udf(run, T.ArrayType(item)).asNondeterministic()(ranks)


def with_targets(rows: DataFrame, nodes: DataFrame, n: int, key: str = "key", gone: str | None = None, spare: bool = False) -> DataFrame:
    """``rows``, whatever else they hold, with targets (array of node_id, rack, score, in order) and spare, of the same kind.

    Targets are the rack leaders by score, then the others by score; ties go by node id.  ``gone`` names a column with a
    key's own few nodes, which are left out.  ``spare`` asks for the best node besides the targets, else it is null.

    The work is keys x nodes, by definition: SHA-256 has no shortcut to its largest value.  Rows are dealt out by key,
    then each key scores the whole list of nodes in one array of the JVM, whose SHA-256 takes a fraction of the time of a
    call from Python, and keeps its few best, so that no scored row is sorted, stored or sent, and memory is bounded by
    the list.  Python gets 16 bytes a target and puts ids and racks to them.  More than ``MAX_NODES`` nodes are ranked by windows over rows.
    """
    found = _fetched(nodes)
    if found is None:
        return _with_targets_by_windows(rows, nodes, n, key, gone, spare)
    ranked = spread(rows, key).withColumn("__ranked", _ranked(nodes, found, n, F.col(key), None if gone is None else F.col(gone), spare))
    return ranked.withColumn("targets", F.slice("__ranked", 1, n)).withColumn("spare", F.get("__ranked", F.lit(n))).drop("__ranked")


def _with_targets_by_windows(rows: DataFrame, nodes: DataFrame, n: int, key: str, gone: str | None, spare: bool) -> DataFrame:
    """``with_targets`` of any number of nodes; every scored row is sorted."""
    own = rows.select(key).distinct() if gone is None else rows.groupBy(key).agg(F.first(gone).alias("__gone"))
    pairs = own.repartition(key).crossJoin(nodes.filter(F.col("status") == "ALIVE").select("node_id", "rack"))
    if gone is not None:
        pairs = pairs.filter(~F.coalesce(F.array_contains("__gone", F.col("node_id")), F.lit(False)))
    scored = pairs.select(key, "node_id", "rack", score_digits(F.col(key), F.col("node_id")).alias("__digits"))
    order = [F.col("__digits").desc(), F.col("node_id")]
    scored = scored.withColumn("rr", F.row_number().over(Window.partitionBy(key, "rack").orderBy(*order))).filter(F.col("rr") <= n + 1)
    scored = scored.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(F.col("rr") > 1, *order)))
    # the spare is the best of what the targets leave, whatever its rack
    scored = scored.withColumn("left", F.row_number().over(Window.partitionBy(key).orderBy(F.col("pos") <= n, *order)))
    item = F.struct("node_id", "rack", F.conv("__digits", 16, 10).cast("long").alias("score"))
    best = F.min(F.when((F.col("pos") > n) & (F.col("left") == 1), F.struct("left", item.alias("item"))))
    lists = scored.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos") <= n, F.struct("pos", item.alias("item"))))).alias("__targets"), best.alias("__best"))
    out = rows.withColumn("__key", F.col(key)).join(lists.withColumnRenamed(key, "__own"), F.col("__key").eqNullSafe(F.col("__own")), "left").drop("__key", "__own")
    out = out.withColumn("targets", F.coalesce(F.transform("__targets", lambda t: t.item), F.array())).withColumn("spare", F.when(F.lit(spare), F.col("__best.item")))
    return out.drop("__targets", "__best")


def place(keys: DataFrame, nodes: DataFrame, n: int, key: str = "key", excluded: DataFrame | None = None) -> DataFrame:
    """A row (key, pos, node_id, rack, score) for each of a distinct key's ``n`` targets, as ``with_targets`` finds them.

    ``excluded`` are rows (key, node_id) of nodes that are left out.
    """
    own = keys.select(key).distinct()
    if excluded is not None:
        own = own.join(excluded.groupBy(key).agg(F.collect_set("node_id").alias("__gone")), key, "left")
    ranked = with_targets(own, nodes, n, key, None if excluded is None else "__gone")
    return ranked.select(key, F.posexplode("targets").alias("__at", "__target")).select(key, (F.col("__at") + 1).cast("long").alias("pos"), "__target.node_id", "__target.rack", "__target.score")


def surrogate(keys: DataFrame, nodes: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """The one node a hint goes to: placement without any of the targets."""
    return place(keys, nodes, 1, key, excluded=targets)

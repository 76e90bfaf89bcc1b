"""The write-ahead log: framing, parsing, folding, recovery.

A frame is length (4 bytes, big-endian), CRC-32 of the payload (4) and the payload, a JSON object.  Frames have no
index, so a log is parsed in order by one task; logs are many and each is bounded by its snapshots.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import to_be

ENTRIES = "log string, seq long, ts long, action string, data string"


def frame(payload: Column) -> Column:
    return F.concat(to_be(F.length(payload), 4), to_be(F.crc32(payload), 4), payload)


def parse(log: bytes) -> Iterator[tuple[int, int | None, str, str]]:
    """Entries up to the first cut-off frame, wrong checksum or bad JSON."""
    at = 0
    while at + 8 <= len(log):
        size, crc = int.from_bytes(log[at: at + 4], "big"), int.from_bytes(log[at + 4: at + 8], "big")
        body = log[at + 8: at + 8 + size]
        if len(body) < size or zlib.crc32(body) != crc:
            return
        try:
            e = json.loads(body)
        except ValueError:
            return
        yield e.get("seq"), e.get("ts"), e.get("action"), json.dumps(e.get("data"), separators=(",", ":"), sort_keys=True)
        at += 8 + size


def entries(logs: DataFrame) -> DataFrame:
    """Entries of ``logs`` (log, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name.as_py(), *e) for name, content in zip(batch.column("log"), batch.column("content")) for e in parse(content.as_py())]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], [c.split()[0] for c in ENTRIES.split(", ")])

    return logs.select(F.col("log").cast("string").alias("log"), "content").mapInArrow(run, ENTRIES)


def fold(entries: DataFrame) -> DataFrame:
    """The state after a log of (bucket, key, seq, action, version_id, size): the last version of each live key.

    A delete without anything to delete is ignored; unknown actions are too.
    """
    known = entries.filter(F.col("action").isin("PUT_OBJECT", "DELETE_OBJECT"))
    by_key = Window.partitionBy("bucket", "key")
    ranked = known.withColumn("puts", F.count_if(F.col("action") == "PUT_OBJECT").over(by_key)).withColumn("last", F.row_number().over(by_key.orderBy(F.col("seq").desc())))
    return ranked.filter((F.col("last") == 1) & (F.col("action") == "PUT_OBJECT")).select("bucket", "key", "seq", "version_id", "size", "puts")


def recover(snapshot: DataFrame, snapshot_seq: int, log: DataFrame) -> DataFrame:
    """State from a snapshot of put entries and what the log holds after it."""
    later = log.filter(F.col("seq") > snapshot_seq)
    return fold(snapshot.select(later.columns).unionByName(later))


def buckets(entries: DataFrame, default: str | None = None) -> DataFrame:
    """Buckets after a log's CREATE_BUCKET entries (bucket, seq): the first creation counts, ``default`` always exists."""
    made = entries.filter(F.col("action") == "CREATE_BUCKET").groupBy(F.col("bucket").alias("name")).agg(F.min("seq").alias("created_seq"))
    if default is None:
        return made
    base = entries.sparkSession.createDataFrame([(default,)], "name string")
    return base.join(made.filter(F.col("name") == default), "name", "left").unionByName(made.filter(F.col("name") != default))


MOVE = "chunkId string, oldNodeId long, newNodeId long, shardIndex long"


def placement_moves(entries: DataFrame) -> DataFrame:
    """Moves of UPDATE_CHUNK_PLACEMENT entries (seq, action, data as JSON); shard_index is null for replicas."""
    move = F.from_json("data", MOVE)
    rows = entries.filter(F.col("action") == "UPDATE_CHUNK_PLACEMENT").select("seq", move.alias("m"))
    return rows.select(F.col("m.chunkId").alias("chunk_id"), "seq", F.col("m.oldNodeId").alias("old_node"), F.col("m.newNodeId").alias("new_node"), F.col("m.shardIndex").alias("shard_index"))


def move_shards(objects: DataFrame, moves: DataFrame) -> DataFrame:
    """``objects`` (chunk_id, shards: array of shard_index, node_id) with each move's shard on its new node, by seq.

    A move names the old node, and the shard's index or null for any; one that fits no shard changes nothing.
    """
    steps = moves.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("seq", "old_node", "new_node", "shard_index"))).alias("steps"))
    one = lambda s, x: F.when((x.node_id == s.old_node) & F.coalesce(x.shard_index == s.shard_index, F.lit(True)), F.struct(x.shard_index.alias("shard_index"), s.new_node.alias("node_id"))).otherwise(x)
    moved = F.aggregate("steps", F.col("shards"), lambda acc, s: F.transform(acc, lambda x: one(s, x)))
    return objects.join(steps, "chunk_id", "left").select("chunk_id", F.when(F.col("steps").isNull(), F.col("shards")).otherwise(moved).alias("shards"))


def truncated(entries: DataFrame, snapshot_seq: int) -> DataFrame:
    """What stays of a log once a snapshot holds everything up to ``snapshot_seq``."""
    return entries.filter(F.col("seq") > snapshot_seq)


def move_replicas(objects: DataFrame, moves: DataFrame) -> DataFrame:
    """Placement updates: ``objects`` (chunk_id, replica_nodes) with each move's old node replaced, in order of seq.

    A move whose old node isn't there appends the new one.
    """
    steps = moves.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("seq", "old_node", "new_node"))).alias("steps"))
    swap = F.aggregate(
        "steps", F.col("replica_nodes"),
        lambda acc, s: F.when(F.array_contains(acc, s.old_node), F.transform(acc, lambda n: F.when(n == s.old_node, s.new_node).otherwise(n))).otherwise(F.array_append(acc, s.new_node)),
    )
    return objects.join(steps, "chunk_id", "left").select("chunk_id", F.when(F.col("steps").isNull(), F.col("replica_nodes")).otherwise(swap).alias("replica_nodes"))

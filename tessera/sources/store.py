"""Stored state: chunk files, chunk tables, snapshots, hints and the log, as sources and sinks.

A store written by single files is read through Spark's ``binaryFile`` source: listings prune the content column, so
no body is opened.  What this engine writes itself are Parquet tables, committed whole by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, wal

SNAPSHOT = "bucket string, key string, seq long, action string, version_id string, size long"
HINT = "targetNodeId string, chunkId string, payloadBase64 string, timestamp long"


def _base_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def chunk_files(spark: SparkSession, root: str) -> DataFrame:
    """chunk_id, size_on_disk, modified, content of every ``*.chk`` file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.chk").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace(_base_name(F.col("path")), r"\.chk$", "").alias("chunk_id"), F.col("length").alias("size_on_disk"), F.col("modificationTime").alias("modified"), "content")


def list_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Names, sizes and times; no content is read."""
    return chunk_files(spark, root).drop("content")


def read_chunks(spark: SparkSession, root: str, verify: bool = True, magic: bytes = integrity.MAGIC) -> DataFrame:
    """Verified chunks: chunk_id, size_on_disk, status, payload."""
    return integrity.verify(chunk_files(spark, root).select("chunk_id", "content"), verify, magic)


def head_chunks(spark: SparkSession, root: str, magic: bytes = integrity.MAGIC) -> DataFrame:
    """Headers alone: no payload is hashed."""
    return integrity.verify(chunk_files(spark, root).select("chunk_id", "content"), False, magic).drop("payload")


def merkle_items(spark: SparkSession, root: str, node_id: int, magic: bytes = integrity.MAGIC) -> DataFrame:
    """Merkle items of a node's readable chunks; the hash is the one their metadata states."""
    good = integrity.verify(chunk_files(spark, root).select("chunk_id", "content"), False, magic).filter("status = 'ok'")
    return good.select(F.lit(node_id).cast("long").alias("node_id"), F.col("chunk_id").alias("key"), F.lit("v1").alias("version"), F.col("stated_hash").alias("hash"))


def write_chunks(envelopes: DataFrame, path: str, mode: str = "append") -> None:
    """Envelopes as a table (chunk_id, content), one atomic commit."""
    envelopes.select("chunk_id", "content").write.mode(mode).parquet(path)


def delete_chunks(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunk table without ``gone``."""
    return stored.join(gone.select("chunk_id"), "chunk_id", "left_anti")


def hint_files(spark: SparkSession, root: str) -> DataFrame:
    """target_id, chunk_id, payload, ts of ``<target>___<chunk>.hint`` files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hint").option("recursiveFileLookup", "true").load(root)
    name = F.split(F.regexp_replace(_base_name(F.col("path")), r"\.hint$", ""), "___", 2)
    hint = F.from_json(F.col("content").cast("string"), HINT)
    return files.select(name[0].alias("target_id"), name[1].alias("chunk_id"), F.unbase64(hint["payloadBase64"]).alias("payload"), hint["timestamp"].alias("ts"))


def hint_body(target: Column, chunk: Column, payload: Column, ts: Column) -> Column:
    """A hint as JSON."""
    return F.to_json(F.struct(target.alias("targetNodeId"), chunk.alias("chunkId"), F.base64(payload).alias("payloadBase64"), ts.alias("timestamp")))


def write_hints(hints: DataFrame, path: str) -> None:
    """Append hints (target_id, chunk_id, payload, ts) as a table of JSON bodies, one atomic commit."""
    target, chunk = F.col("target_id").cast("string"), F.col("chunk_id").cast("string")
    hints.select("target_id", hint_body(target, chunk, F.col("payload"), F.col("ts")).alias("body")).write.mode("append").parquet(path)


def read_hints(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Hints of such a table, of one target if named: target_id, chunk_id, payload, ts."""
    rows = spark.read.parquet(path)
    rows = rows if target is None else rows.filter(F.col("target_id").cast("string") == target)
    hint = F.from_json("body", HINT)
    return rows.select("target_id", hint["chunkId"].alias("chunk_id"), F.unbase64(hint["payloadBase64"]).alias("payload"), hint["timestamp"].alias("ts"))


def log_files(spark: SparkSession, root: str, glob: str = "*.log") -> DataFrame:
    """Entries of write-ahead log files, each up to its first broken frame."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root)
    return wal.entries(files.select(F.col("path").alias("log"), "content"))


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def write_snapshot(state: DataFrame, path: str) -> None:
    """Put entries of the live state; a later recovery takes the log from the largest seq on."""
    fields = [f.split() for f in SNAPSHOT.split(", ")]
    state.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields]).write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(entries, largest seq); a snapshot that isn't there is empty."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], SNAPSHOT), 0
    state = spark.read.schema(SNAPSHOT).parquet(path)
    return state, state.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

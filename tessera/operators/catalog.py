"""Buckets, versions, tombstones and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("bucket", "key")


def latest(versions: DataFrame, order: str = "seq") -> DataFrame:
    """The last appended version of each (bucket, key)."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col(order).desc()))
    return versions.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def live(versions: DataFrame) -> DataFrame:
    """Latest versions that aren't tombstones."""
    return latest(versions).filter(~F.col("is_deleted"))


def lookup(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (bucket, key, version_id or null for the latest) with status 200 or 404; deleted versions are 404."""
    named = versions.select(*KEY, F.col("version_id"), "size", "is_deleted")
    last = latest(versions).select(*KEY, F.col("version_id").alias("last_id"))
    asked = wanted.join(last, [*KEY], "left").withColumn("found_id", F.coalesce("version_id", "last_id")).drop("version_id", "last_id")
    out = asked.join(named.withColumnRenamed("version_id", "found_id"), [*KEY, "found_id"], "left")
    ok = F.col("is_deleted").isNotNull() & ~F.col("is_deleted")
    return out.select(*KEY, "found_id", F.when(ok, 200).otherwise(404).cast("long").alias("status"), F.when(ok, F.col("size")).alias("size"))


def list_prefix(objects: DataFrame, bucket: str | None, prefix: str, limit: int | None = None, order: str = "seq") -> DataFrame:
    """Objects of a bucket whose key starts with ``prefix``, in insertion order; both predicates reach the scan."""
    out = objects if bucket is None else objects.filter(F.col("bucket") == bucket)
    out = out.filter(F.col("key").startswith(prefix))
    return out if limit is None else out.orderBy(order).limit(limit)


def list_objects(versions: DataFrame, bucket: str, prefix: str = "", limit: int = 1000) -> DataFrame:
    """Live objects of a bucket by prefix, in insertion order, ``limit`` at most."""
    mine = versions.filter((F.col("bucket") == bucket) & F.col("key").cast("string").startswith(prefix))
    return live(mine).orderBy("seq").limit(limit)


def tombstones(versions: DataFrame, deletes: DataFrame) -> DataFrame:
    """DELETE: status 204 and a tombstone row for live keys, 404 for absent or deleted ones."""
    now = latest(versions).select(*KEY, "is_deleted", F.col("seq").alias("last_seq"), "size")
    out = deletes.join(now, [*KEY], "left")
    ok = F.col("is_deleted").isNotNull() & ~F.col("is_deleted")
    return out.select(*KEY, F.when(ok, 204).otherwise(404).cast("long").alias("status"), F.when(ok, F.concat(F.lit("del-"), F.col("last_seq").cast("string"))).alias("version_id"))


def create_buckets(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """Insert if absent: those of ``asked`` (name, created_at, default_policy) that don't exist, first come."""
    first = asked.groupBy("name").agg(F.min(F.struct("created_at", "default_policy")).alias("f")).select("name", "f.*")
    return first.join(existing.select("name"), "name", "left_anti")


def append_versions(buckets: DataFrame, puts: DataFrame) -> DataFrame:
    """PUT metadata: only into buckets that exist."""
    return puts.join(buckets.select(F.col("name").alias("bucket")), "bucket", "left_semi")

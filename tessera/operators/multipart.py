"""Multipart uploads: the last body of a part number wins, parts are stitched by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunking import joined


def winners(parts: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("upload_id", "part_number").orderBy(F.col("seq").desc()))
    return parts.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def stitched(parts: DataFrame) -> DataFrame:
    """Chunks of the completed object, renumbered from 0: upload_id, idx, part_number, chunk_id, size."""
    idx = F.row_number().over(Window.partitionBy("upload_id").orderBy("part_number")) - 1
    chunk = F.concat(F.lit("chk-mp-"), F.col("upload_id").cast("string"), F.lit("-p"), F.col("part_number").cast("string"))
    return winners(parts).select("upload_id", idx.cast("long").alias("idx"), "part_number", chunk.alias("chunk_id"), F.length("body").cast("long").alias("size"))


def complete(parts: DataFrame) -> DataFrame:
    """upload_id, part_count, size, etag, body: an upload's parts are bounded by the object's size."""
    first = F.substring(F.sha2(F.min_by("body", "part_number"), 256), 1, 16)
    rows = winners(parts).groupBy("upload_id").agg(F.count(F.lit(1)).alias("part_count"), F.sum(F.length("body")).cast("long").alias("size"), first.alias("head"), joined("body", "part_number").alias("body"))
    return rows.select("upload_id", "part_count", "size", F.concat(F.lit("mp-"), "head", F.lit("-"), F.col("part_count").cast("string")).alias("etag"), "body")


def answer(requests: DataFrame, sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """``requests`` (upload_id, action: complete or abort) with a status: 404 for unknown uploads, 409 to complete one
    without parts, 204 for an abort (its parts stay stored), else 200."""
    staged = parts.groupBy("upload_id").agg(F.countDistinct("part_number").alias("part_count"))
    known = requests.join(sessions.select("upload_id", F.lit(True).alias("open")).distinct(), "upload_id", "left").join(staged, "upload_id", "left")
    count = F.coalesce("part_count", F.lit(0)).cast("long")
    status = F.when(F.col("open").isNull(), 404).when(F.col("action") == "abort", 204).when(count == 0, 409).otherwise(200)
    return known.select("upload_id", "action", status.cast("long").alias("status"), count.alias("part_count"))

"""Exact deduplication by content sort, with DataFrame functions only.

Rows are range-partitioned by sampled splitters over (first 64 characters of the normalised text, 64-bit hash), sorted
externally by the whole normalised text, and neighbours are compared in full by the window operator, which opens a
group wherever two adjacent sort keys differ.  Splitters are short, so sampling stays small whatever the texts' size.

Hot groups: texts holding more than 1/(8 n) of the rows over n partitions would fill one task.  There are fewer than
8 n of them; the driver holds their hashes (8 bytes each), and their rows are sorted in the same way, but by (hash, salt,
text), salts dealt row by row: each salted run is compared neighbour by neighbour, its best id and size meet those of
the text's other runs (at most n rows a text), and go back to the run.  The route never changes the result.

Memory: sorting is external and a window holds one group's rows, spilling beyond; long texts are compared whole and
never gathered.

Defined cases: null text counts as empty; empty texts form one group; null ids lose against any id, and a group of
null ids keeps one row with a null ``keep_id``; of rows that tie in text and id exactly one is kept; other columns,
whatever their names, ride along inside the struct ``row``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, partitions, table

PREFIX = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: ``row`` (struct of the input's columns), keep_id, group_size, kept, text_sha256."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    best = F.min if keep == "smallest" else F.max
    first = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()

    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(F.lower(text)).alias("h"))

    total = docs.count()
    often = rows.groupBy("h").count().filter(F.col("count") * F.lit(8 * n) > F.lit(max(total, 64 * n)))
    hot = [r.h for r in often.select("h").collect()]
    norm = ascii_lower(text)

    same = Window.partitionBy("k", "h", "norm")
    cold = (
        rows.filter(~F.col("h").isin(hot))
        .select("row", "id", "h", F.substring(F.lower(text), 1, PREFIX).alias("k"))
        .repartitionByRange("k", "h")
        .withColumn("norm", norm)
        .withColumn("at", F.row_number().over(same.orderBy(first)))
        .withColumn("keep_id", best("id").over(same))
        .withColumn("group_size", F.count(F.lit(1)).over(same))
        .select("row", "keep_id", "group_size", (F.col("at") == 1).alias("kept"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    )

    if not hot:
        return cold
    run = Window.partitionBy("h", "salt", "norm")
    warm = (
        rows.filter(F.col("h").isin(hot))
        .select("row", "id", "h", F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("salt"), norm.alias("norm"))
        .withColumn("at", F.row_number().over(run.orderBy(first)))
        .withColumn("run_id", best("id").over(run))
        .withColumn("run_size", F.count(F.lit(1)).over(run))
    )
    runs = warm.filter("at = 1").select("h", "salt", "norm", "run_id", "run_size")
    # the run that keeps its first row: that of the best id, the lowest salt of equal ones
    order = F.min(F.struct(F.col("run_id").isNull(), "run_id", "salt")) if keep == "smallest" else F.max(F.struct("run_id", -F.col("salt")))
    totals = runs.groupBy("h", "norm").agg(best("run_id").alias("keep_id"), F.sum("run_size").alias("group_size"), F.abs(order.getField("salt" if keep == "smallest" else "col2")).alias("winner"))
    named = runs.select("h", "salt", "norm").join(totals, ["h", "norm"])
    return cold.unionByName(
        warm.join(named, ["h", "salt", "norm"])
        .select("row", "keep_id", "group_size", ((F.col("salt") == F.col("winner")) & (F.col("at") == 1)).alias("kept"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    )


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The input's columns, one row for each distinct normalised text."""
    return exact_dedup(docs, **options).filter("kept").select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep="largest").select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

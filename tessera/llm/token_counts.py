"""Token counts through a digest cache.

A text's count depends on its bytes and the tokenizer's version alone.  The cache is a Parquet folder of
(content_digest, tokenizer_digest, n_tokens).  Each run digests every text natively, finds the distinct digests the
cache lacks, encodes one representative text for each, appends the new counts as a batch of files, and joins counts
back to the rows.  Appends are whole files under fresh names, so readers see a batch completely or not at all, and a
batch written twice repeats equal counts only.

Texts move only for digests that the cache lacks: up to ``FEW`` of them are broadcast to the scan (40 bytes each), more
meet the texts in a shuffle.  Where a cache is to be kept, ``cache`` or the setting ``tessera.tokenCache`` names its
folder; else each run starts a new one in the shared folder.

Skew: distinct digests come from a partial aggregate; texts move by row id, which no group of copies can heat; counts of
hot digests, whose number the partitions bound, reach their rows by broadcast.

Defined cases: null text counts as empty (0 tokens); repeated rows each get the count; rows with a null id are
encoded too; other columns are ignored; an empty table gives no rows.  A long text is encoded whole, in one task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, partitions, scratch, table, text_or_empty

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"
FEW = 10_000


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def _counter(path: str, version: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = bpe.encoder(path), set()
        for batch in batches:
            fresh = []
            for i, d in enumerate(batch.column("content_digest").to_pylist()):
                if d not in seen:
                    seen.add(d)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            digests, texts = batch.column("content_digest"), batch.column("text")
            n = [len(enc.ids(t.as_py())) for t in texts]
            yield pa.RecordBatch.from_arrays([digests.cast(pa.binary()), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    return count


def token_counts(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).  ``cache``: a folder kept between runs."""
    spark = docs.sparkSession
    path = tokenizer or bpe.default_path()
    version = tokenizer_digest(path)
    cache = cache or spark.conf.get("tessera.tokenCache", None) or scratch(spark, "token-cache")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(cache)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jpath)

    def known() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    digested = rows.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content_digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    misses = digested.groupBy("content_digest").agg(F.min("doc_id").alias("rep")).join(known().select("content_digest"), "content_digest", "left_anti")
    misses = materialize(misses, "token-misses")
    if not (missing := misses.count()):
        return _joined(docs, digested, known, limit)
    misses = misses.select("rep", F.col("content_digest").alias("d"))
    texts = rows.withColumn("content_digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("t")
    chosen = texts.join(
        F.broadcast(misses) if missing <= FEW else misses.hint("shuffle_hash"),
        (F.col("t.doc_id").eqNullSafe(F.col("rep"))) & (F.col("content_digest") == F.col("d")),
        "left_semi",
    ).select("content_digest", "text")
    # a representative's repeated rows may be in several tasks
    chosen.mapInArrow(_counter(path, version), CACHE).dropDuplicates(["content_digest"]).write.mode("append").parquet(cache)
    return _joined(docs, digested, known, limit)


def _joined(docs: DataFrame, digested: DataFrame, known: Callable[[], DataFrame], limit: int) -> DataFrame:
    """Counts from the cache, joined back to the rows."""
    spark = docs.sparkSession
    # digests of more than 1/(8 n) of the rows, under 8 n of them, get their counts by broadcast
    n = partitions(spark)
    total = docs.count()
    often = digested.groupBy("content_digest").count().filter(F.col("count") * F.lit(8 * n) > F.lit(max(total, 64 * n))).select("content_digest")
    hot = F.broadcast(known().join(F.broadcast(often), "content_digest").withColumnRenamed("n_tokens", "hot_tokens"))
    routed = digested.join(hot, "content_digest", "left")
    cold = routed.filter(F.col("hot_tokens").isNull()).drop("hot_tokens").join(known(), "content_digest", "left")
    warm = routed.filter(F.col("hot_tokens").isNotNull()).withColumnRenamed("hot_tokens", "n_tokens")
    return (
        cold.unionByName(warm)
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))

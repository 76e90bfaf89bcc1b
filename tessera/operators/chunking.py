"""Fixed-size chunks of bodies, and byte ranges read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_count(size: Column, chunk: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / F.lit(chunk))).cast("int")


def chunks(objects: DataFrame, size: int = 1 << 20) -> DataFrame:
    """doc_id, idx, chunk_id, offset, payload; an empty body is one empty chunk."""
    count = chunk_count(F.length("body"), size)
    rows = objects.select("doc_id", "body", F.explode(F.sequence(F.lit(0), count - 1)).alias("idx"))
    offset = F.col("idx") * size
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), F.concat(F.lit("chk-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("idx").cast("string")).alias("chunk_id"), offset.cast("long").alias("offset"), F.substring("body", offset + 1, F.lit(size)).alias("payload"))


def read_range(chunked: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Bytes [start, end] of each object, to its last byte if ``end`` is None: chunks that don't overlap are never gathered."""
    if end is None:
        end = (1 << 31) - 2
    size = F.length("payload")
    hit = chunked.filter((F.col("offset") <= end) & (F.col("offset") + size > start))
    lo = F.greatest(F.lit(0), F.lit(start) - F.col("offset"))
    hi = F.least(size, F.lit(end + 1) - F.col("offset"))
    cut = hit.select("doc_id", "idx", F.substring("payload", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    return cut.groupBy("doc_id").agg(joined("piece", "idx").alias("body"), F.count(F.lit(1)).alias("chunks_read"))


def joined(piece: str, order: str) -> Column:
    """Aggregate: the pieces of a body end to end, each copied once."""
    return F.expr(f"listagg({piece}) WITHIN GROUP (ORDER BY {order})")

"""Chunk envelopes: building, verifying, scrubbing, injected faults.

An envelope is the magic (8 bytes), the metadata's length (2, big-endian), metadata as JSON, a CRC-32 of all that
(4, big-endian) and the payload.  Verification is one ordered CASE: the first failing check names the status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import be_uint, to_be

#: First bytes of an envelope; stores with another magic pass theirs.
MAGIC = b"TESSERA\0"
META = "chunkId string, timestamp long, payloadLength long, checksumHex string"


def build(chunks: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """chunk_id, content."""
    meta = F.to_json(F.struct(F.col("chunk_id").alias("chunkId"), F.lit(0).cast("long").alias("timestamp"), F.length("payload").cast("long").alias("payloadLength"), F.sha2("payload", 256).alias("checksumHex"))).cast("binary")
    fits = F.when(F.length(meta) < 1 << 16, meta).otherwise(F.raise_error(F.lit("chunk metadata is longer than 65535 bytes")).cast("binary"))
    head = F.concat(F.lit(magic), to_be(F.length(meta), 2), fits)
    return chunks.select("chunk_id", F.concat(head, to_be(F.crc32(head), 4), F.col("payload")).alias("content"))


def flip(content: Column, offset: Column) -> Column:
    """The byte at a zero-based offset replaced by its complement."""
    at = offset + F.lit(1)
    old = F.conv(F.hex(F.substring(content, at, F.lit(1))), 16, 10).cast("int")
    return F.overlay(content, F.unhex(F.lpad(F.hex(F.lit(255) - old), 2, "0")), at, F.lit(1))


def verify(files: DataFrame, checksum: bool = True, magic: bytes = MAGIC) -> DataFrame:
    """``files`` without content, and size_on_disk, status, payload, stated_hash: status names the first check that fails, or is ok."""
    c, n = F.col("content"), F.length("content")
    end = F.col("meta_len") + 10
    rows = files.select(*[x for x in files.columns if x != "size_on_disk"], n.alias("size_on_disk"), F.when(n >= 10, be_uint(c, 8, 2)).otherwise(F.lit(0)).cast("int").alias("meta_len"))
    rows = rows.withColumn("meta_text", F.substring(c, F.lit(11), F.col("meta_len"))).withColumn("meta", F.from_json(F.col("meta_text").cast("string"), META)).withColumn("payload", F.substring(c, end + 5, n))
    status = (
        F.when(F.col("size_on_disk") < 14, "short")
        .when(F.substring(c, 1, 8) != F.lit(magic), "magic")
        .when(F.col("size_on_disk") < end + 4, "truncated")
        .when(be_uint(c, end, 4) != F.crc32(F.substring(c, F.lit(1), end)), "header_crc")
        .when(F.col("meta.payloadLength").isNull(), "metadata")
        .when(F.col("meta.payloadLength") != F.length("payload"), "length")
    )
    if checksum:
        status = status.when(F.col("meta.checksumHex") != F.sha2("payload", 256), "bitrot")
    own = [c for c in files.columns if c not in ("content", "size_on_disk")]
    return rows.select(*own, F.col("size_on_disk").cast("long").alias("size_on_disk"), status.otherwise("ok").alias("status"), "payload", F.col("meta.checksumHex").alias("stated_hash"))


def scrub(verified: DataFrame) -> DataFrame:
    """node_id, total, healthy, corrupted of verified rows with a node_id."""
    ok = F.col("status") == "ok"
    return verified.groupBy("node_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("healthy"), F.count_if(~ok).alias("corrupted"))


def corrupted(verified: DataFrame) -> DataFrame:
    """Corruption flags of a scrub: (chunk_id, node_id, status) of every row that isn't ok."""
    return verified.filter(F.col("status") != "ok").select("chunk_id", "node_id", "status")

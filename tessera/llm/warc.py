"""WARC archives: a deterministic sharded writer and a streaming reader.

Which of equal payloads is the response is settled first, on digests alone: a partial aggregate gives each digest's
smallest page id.  Pages are then dealt to shards by splitters - quantiles of a content-hashed sample of page ids, so
the same pages always make the same shards - and sorted; revisit decisions travel as extra rows sorted just before
their page, so page bodies are shuffled once.  A writer task regenerates headers and digests, compresses each record
as its own gzip member and rolls to the next file at ``roll`` compressed bytes.  Files are written under temporary
names and renamed when whole; the manifest (file, records, bytes, SHA-256) is committed as a table last, and readers
open what it lists only.  A repeated task writes the same bytes under the same final name.

Defined cases: null html is an empty payload; null urls leave the target out; null page ids sort last and are the
response only if no other row has the payload; of rows equal in id and payload the first is response or revisit as
its id tells, the others revisit it; other columns, whatever their names, are ignored; an empty table gives no files
and no rows.  A long page is one record, held whole in one task's memory and never split over files.  Rows equal in id
stay in one shard, since their records are numbered.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, scratch, table

DATE, ROLL, SAMPLE = "2024-01-01T00:00:00Z", 128 << 20, 50_000
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(uri: str):
    from pyarrow import fs

    # one slash after the scheme, as Hadoop writes local paths, means no authority
    uri = re.sub(r"^([a-zA-Z][a-zA-Z0-9+.-]+):/(?!/)", r"\1:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}/{copy}'.encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, copy: int) -> bytes:
    """One record; ``refers_to``: None for a response, (page id,) of the response for a revisit."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, copy)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to[0], digest, 0)}"]
        if refers_to[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to[0]}")
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Files:
    """Rolling output of one shard."""

    def __init__(self, root: str, shard: int, roll: int):
        self.fs, self.root = _filesystem(root)
        self.shard, self.roll, self.part, self.out, self.done = shard, roll, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.part, self.out = self.part + 1, None


def _writer(root: str, roll: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done, key, verdict, copy = None, [], None, None, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "page_id", "digest", "first", "is_page", "url", "html")]
            for at in range(batch.num_rows):
                shard, page_id, digest, first, is_page, url, html = (c[at].as_py() for c in cols)
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        done += files.done
                    files = _Files(root, shard, roll)
                if key != (page_id, digest):
                    key, verdict, copy = (page_id, digest), None, 0
                if not is_page:
                    verdict = (first,)
                    continue
                to = verdict if copy == 0 else verdict or (page_id,)
                files.add(_member(record(page_id, url, html, to, copy)))
                copy += 1
        if files is not None:
            files.close()
            done += files.done
        cols = list(zip(*done)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "records", "bytes", "sha256"])

    return write


def write_warc(pages: DataFrame, root: str, roll: int = ROLL, min_revisit: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``root``; returns the committed manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    digests = materialize(rows.select("page_id", F.sha1("html").alias("digest"), F.length("html").alias("size")), "warc-digests")
    shards = partitions(spark)
    every = max(1, digests.count() // SAMPLE)
    sample = digests.filter(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)).select("page_id").distinct()
    ids = np.sort(np.array([r[0] for r in sample.collect()], np.int64))
    cuts = np.unique(ids[[len(ids) * k // shards for k in range(1, shards)]]) if len(ids) else ids

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        known = page_id.notna()
        return pd.Series(np.where(known, np.searchsorted(cuts, page_id.fillna(0).astype("int64"), side="right"), len(cuts))).astype("int32")

    firsts = digests.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    revisits = (
        digests.select("page_id", "digest").join(firsts.filter("n > 1"), "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("first")))
        .select("page_id", "digest", "first").distinct()
    )
    none = F.lit(None)
    both = rows.select("page_id", F.sha1("html").alias("digest"), none.cast("long").alias("first"), F.lit(True).alias("is_page"), "url", "html").unionByName(
        revisits.select("page_id", "digest", "first", F.lit(False).alias("is_page"), none.cast("string").alias("url"), none.cast("binary").alias("html"))
    )
    fs, path = _filesystem(root)
    fs.create_dir(path, recursive=True)
    # one number for each task that hashes to it, so that no two shards share a task
    tries = spark.range(40 * shards).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(shards)).alias("task")).agg(F.min("k").alias("k"))
    routes = {r.task: r.k for r in tries.collect()}
    route = F.element_at(F.lit([routes.get(t, t) for t in range(shards)]), F.col("shard") + 1)
    sharded = both.withColumn("shard", shard_of("page_id")).withColumn("route", route).repartition(shards, "route").drop("route")
    sharded = sharded.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "is_page", "url")
    sharded.mapInArrow(_writer(root, roll), MANIFEST).write.parquet(f"{root}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream, one at a time."""
    z, out = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            out.append(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive is cut short")


def _headers(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data.decode().split("\r\n")[1:])}


def _reader(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(root)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        rows: list[tuple] = []
        for batch in batches:
            for name, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                n = 0
                with fs.open_input_stream(os.path.join(path, name), compression=None) as stream:
                    for data in _members(stream):
                        head, _, rest = data.partition(b"\r\n\r\n")
                        head = _headers(head)
                        block = rest[: int(head["content-length"])]
                        if head["warc-block-digest"] != "sha1:" + base32_sha1(block):
                            raise ValueError(f"{name}: block digest differs")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size, digest = int(_headers(http)["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"{name}: payload digest differs")
                        ids = [int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((ids[0], size, digest, head["warc-type"], ids[1]))
                        n += 1
                        if len(rows) == 4096:
                            yield batch_of(rows)
                            rows = []
                if n != expected:
                    raise ValueError(f"{name}: {n} records, {expected} in the manifest")
        if rows:
            yield batch_of(rows)

    return read


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """A row per record of the archives that the manifest lists; digests are checked against the bytes."""
    n = max(1, min(manifest.count(), 16 * partitions(manifest.sparkSession)))
    return manifest.select("file", "records").repartition(n, "file").mapInArrow(_reader(root), RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "warc")
    return read_warc(write_warc(table(spark, sf_dir, "pages"), root), root)

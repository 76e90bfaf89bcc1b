"""Files and tables of a store: written, read back, broken, deleted."""

import base64
import json
import zlib

from pyspark.sql import functions as F

import pytest

from tessera.operators import integrity, wal
from tessera.sources import shared, store


def test_chunk_files(spark, tmp_path):
    c = spark.createDataFrame([(f"chk-{i}.s{i}", bytes([i]) * i) for i in range(6)], "chunk_id string, payload binary")
    for r in integrity.build(c, b"OTHER01\0").collect():
        data = bytearray(r.content)
        if r.chunk_id == "chk-3.s3":
            data[-1] ^= 255
        (tmp_path / f"{r.chunk_id}.chk").write_bytes(bytes(data))
    (tmp_path / "note.txt").write_text("no chunk")
    root = str(tmp_path)
    listed = store.list_chunks(spark, root)
    assert listed.count() == 6 and "content" not in listed.columns
    got = {r.chunk_id: r.status for r in store.read_chunks(spark, root, magic=b"OTHER01\0").collect()}
    assert got.pop("chk-3.s3") == "bitrot" and set(got.values()) == {"ok"}
    assert {r.status for r in store.head_chunks(spark, root, b"OTHER01\0").collect()} == {"ok"}
    assert {r.status for r in store.read_chunks(spark, root).collect()} == {"magic"}
    assert store.merkle_items(spark, root, 7, b"OTHER01\0").filter("length(hash) = 64 and node_id = 7").count() == 6


def test_chunk_table(spark, tmp_path):
    c = spark.createDataFrame([("a", b"1"), ("b", b"2")], "chunk_id string, payload binary")
    path = str(tmp_path / "chunks")
    store.write_chunks(integrity.build(c), path)
    left = store.delete_chunks(spark.read.parquet(path), spark.createDataFrame([("a",), ("zz",)], "chunk_id string"))
    assert [r.chunk_id for r in integrity.verify(left).filter("status = 'ok'").collect()] == ["b"]


def test_hints(spark, tmp_path):
    row = spark.range(1).select(store.hint_body(F.lit("node-2"), F.lit("chk-1"), F.lit(b"body"), F.lit(5)).alias("j")).first()
    assert base64.b64decode(json.loads(row.j)["payloadBase64"]) == b"body"
    (tmp_path / "node-2___chk-1.hint").write_text(row.j)
    assert [tuple(r) for r in store.hint_files(spark, str(tmp_path)).collect()] == [("node-2", "chk-1", bytearray(b"body"), 5)]


def test_log_and_snapshot(spark, tmp_path):
    bodies = [json.dumps({"seq": i, "ts": 0, "action": "PUT_OBJECT", "data": {}}).encode() for i in range(3)]
    (tmp_path / "wal.log").write_bytes(b"".join(len(b).to_bytes(4, "big") + zlib.crc32(b).to_bytes(4, "big") + b for b in bodies) + b"\0\0")
    assert sorted(r.seq for r in store.log_files(spark, str(tmp_path)).collect()) == [0, 1, 2]
    log = spark.createDataFrame([("a", "x", 1, "PUT_OBJECT", "v1", 1), ("a", "y", 2, "PUT_OBJECT", "v2", 1), ("a", "x", 3, "DELETE_OBJECT", None, None)], store.SNAPSHOT)
    path = str(tmp_path / "snapshot")
    empty, seq = store.read_snapshot(spark, path)
    assert (empty.count(), seq) == (0, 0)
    store.write_snapshot(log.filter("seq <= 2"), path)
    state, seq = store.read_snapshot(spark, path)
    assert seq == 2
    assert sorted(r.key for r in wal.recover(state, seq, log).collect()) == ["y"]
    store.append_log(log, str(tmp_path / "table"))
    store.append_log(log, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6


class Settings:
    def __init__(self, **conf):
        self.conf = self
        self.settings = conf

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_shared_folder():
    assert shared.shared_dir(Settings(**{"spark.master": "local[8]"})).startswith("file://")
    assert shared.scratch(Settings(**{"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://x/y/"}), "a").startswith("hdfs://x/y/tessera/a-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Settings(**{"spark.master": "spark://host:7077"}))

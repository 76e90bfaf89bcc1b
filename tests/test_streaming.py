"""Streams whose history is split over batches, against the same operators over tables."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import testbed
from tessera.streaming import detector

SUSPECT, DEAD = 6 * 3600, 24 * 3600


@pytest.fixture()
def beats(spark, sf):
    return testbed.heartbeats(spark, sf).select("node_id", "ts", "event_id", "action", "value")


def split_stream(spark, beats, folder, parts=4):
    """The heartbeats as a stream of files in order of time, one file to a batch."""
    os.makedirs(folder)
    rows = beats.orderBy("ts", "event_id").toPandas()
    for k in range(parts):
        part = rows.iloc[len(rows) * k // parts: len(rows) * (k + 1) // parts]
        path = f"{folder}/{k}.parquet"
        part.to_parquet(path, coerce_timestamps="us", index=False)
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    raw = spark.readStream.schema(beats.schema.simpleString().removeprefix("struct<").removesuffix(">").replace("timestamp", "timestamp_ntz").replace(":", " ")).option("maxFilesPerTrigger", 1).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def test_transitions_over_batches(spark, beats, tmp_path):
    stream = split_stream(spark, beats, str(tmp_path / "in"))
    got = detector.run_available(detector.transitions(stream, SUSPECT, DEAD), str(tmp_path / "out"))
    want = detector.transitions_of(beats, SUSPECT, DEAD)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.status for r in got.collect()} == {"ALIVE", "SUSPECT", "DEAD"}


def test_gaps_over_batches(spark, beats, tmp_path):
    stream = split_stream(spark, beats, str(tmp_path / "in"), 3)
    got = detector.run_available(detector.detect(stream, SUSPECT, DEAD), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, detector.gaps(beats, SUSPECT, DEAD).collect()))


def test_silent_node_is_reported(spark):
    """A node that never beats again is suspected and then dead; one that returns is alive again."""
    rows = [(1, 0), (2, 0), (2, 5), (2, 40), (3, 100)]
    beats = spark.createDataFrame([(n, s, k) for k, (n, s) in enumerate(rows)], "node_id long, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(map(tuple, detector.transitions_of(beats, 10, 30).collect()))
    assert got == [
        (1, 0, "ALIVE"), (1, 10_000, "SUSPECT"), (1, 30_000, "DEAD"),
        (2, 0, "ALIVE"), (2, 15_000, "SUSPECT"), (2, 35_000, "DEAD"), (2, 40_000, "ALIVE"), (2, 50_000, "SUSPECT"), (2, 70_000, "DEAD"),
        (3, 100_000, "ALIVE"),
    ]

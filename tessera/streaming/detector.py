"""Failure detection over heartbeats: batch status, stateful stream, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _seconds(column: str):
    return F.unix_micros(column) / F.lit(1_000_000)


def status_at_end(beats: DataFrame, suspect: float, dead: float) -> DataFrame:
    """Each node's status at the last heartbeat of all, by seconds since its own last."""
    end = beats.agg(F.max("ts").alias("end_ts"))
    last = beats.groupBy("node_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("beats"))
    gap = _seconds("end_ts") - _seconds("last_ts")
    return last.crossJoin(F.broadcast(end)).select("node_id", "beats", F.round(gap, 3).alias("elapsed"), F.when(gap > dead, "DEAD").when(gap > suspect, "SUSPECT").otherwise("ALIVE").alias("status"))


def gaps(beats: DataFrame, suspect: float, dead: float) -> DataFrame:
    """Heartbeats that ended a silence: (node_id, event_id, gap_ms, missed)."""
    own = Window.partitionBy("node_id").orderBy("ts", "event_id")
    gap = (F.unix_micros("ts") - F.unix_micros("before")) / F.lit(1_000_000)
    rows = beats.withColumn("before", F.lag("ts").over(own)).filter(F.col("before").isNotNull())
    millis = F.floor((F.unix_micros("ts") - F.unix_micros("before")) / 1000).cast("long")
    return rows.select("node_id", "event_id", millis.alias("gap_ms"), F.when(gap > dead, "DEAD").when(gap > suspect, "SUSPECT").otherwise("ALIVE").alias("missed")).filter("missed <> 'ALIVE'")


def detect(stream: DataFrame, suspect: float, dead: float) -> DataFrame:
    """The same over a stream: a node's last heartbeat is its state, batches may split its history anywhere."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beats = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        before, out = (state.get[0] if state.exists else None), []
        for ts, event_id in zip(beats["ts"], beats["event_id"]):
            now = ts.value // 1000
            if before is not None and (gap := (now - before) / 1e6) > suspect:
                out.append((key[0], event_id, (now - before) // 1000, "DEAD" if gap > dead else "SUSPECT"))
            before = now if before is None else max(before, now)
        state.update((before,))
        if out:
            yield pd.DataFrame(out, columns=["node_id", "event_id", "gap_ms", "missed"])

    schema = "node_id long, event_id long, gap_ms long, missed string"
    return stream.groupBy("node_id").applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


STATUS = "node_id long, at_ms long, status string"


def transitions_of(beats: DataFrame, suspect: float, dead: float) -> DataFrame:
    """Status changes of each node by the end of a table of heartbeats: (node_id, at_ms, status).

    A node is alive from its first beat, suspect ``suspect`` seconds after a beat that no other follows by then, dead
    after ``dead`` seconds, and alive again with the next beat.
    """
    end = beats.agg(F.max("ts").alias("end_ts"))
    own = Window.partitionBy("node_id").orderBy("ts", "event_id")
    rows = beats.select("node_id", "ts", F.lag("ts").over(own).alias("before"), F.lead("ts").over(own).alias("after")).crossJoin(F.broadcast(end))
    ms = lambda c: F.floor(F.unix_micros(c) / 1000).cast("long")
    at, quiet = ms("ts"), ms(F.coalesce("after", "end_ts")) - ms("ts")
    new = F.col("before").isNull() | (ms("ts") - ms("before") > int(suspect * 1000))
    change = lambda when, delay, name: F.when(when, F.struct((at + delay).alias("at_ms"), F.lit(name).alias("status")))
    found = F.array(change(new, 0, "ALIVE"), *[change(quiet > limit, limit, name) for name, limit in (("SUSPECT", int(suspect * 1000)), ("DEAD", int(dead * 1000)))])
    return rows.select("node_id", F.explode(F.array_compact(found)).alias("c")).select("node_id", "c.*")


def transitions(stream: DataFrame, suspect: float, dead: float, delay: str = "0 seconds") -> DataFrame:
    """The same over a stream, as they happen: event-time timers report nodes that stay silent."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    limits = {"SUSPECT": int(suspect * 1000), "DEAD": int(dead * 1000)}

    class Detector(StatefulProcessor):
        """State: the last beat in milliseconds and the status.  A timer waits for the next silence that counts."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at long, status string")

        def silence(self, last: int, status: str, now: int) -> tuple[list[tuple[int, str]], str]:
            """Changes between the last beat and ``now``, without a beat."""
            out = []
            for name, limit in limits.items():
                if now - last > limit and (status, name) in (("ALIVE", "SUSPECT"), ("SUSPECT", "DEAD")):
                    out.append((last + limit, name))
                    status = name
            return out, status

        def watch(self, last: int, status: str) -> None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if (name := {"ALIVE": "SUSPECT", "SUSPECT": "DEAD"}.get(status)) is not None:
                self.handle.registerTimer(last + limits[name] + 1)

        def rows(self, key: tuple, changes: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
            if changes:
                yield pd.DataFrame([(key[0], *c) for c in changes], columns=["node_id", "at_ms", "status"])

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            beats = sorted(t.value // 1_000_000 for frame in rows for t in frame["ts"])
            last, status = self.last.get() if self.last.exists() else (None, None)
            out = []
            for at in beats:
                if last is not None and at > last:
                    changes, status = self.silence(last, status, at)
                    out += changes
                if status != "ALIVE":
                    out.append((at, "ALIVE"))
                last, status = at if last is None else max(last, at), "ALIVE"
            self.last.update((last, status))
            self.watch(last, status)
            yield from self.rows(key, out)

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            last, status = self.last.get()
            changes, status = self.silence(last, status, timerValues.getCurrentWatermarkInMs())
            self.last.update((last, status))
            self.watch(last, status)
            yield from self.rows(key, changes)

        def close(self) -> None:
            pass

    marked = stream.select("node_id", "ts").withWatermark("ts", delay)
    return marked.groupBy("node_id").transformWithStateInPandas(statefulProcessor=Detector(), outputStructType=STATUS, outputMode="Append", timeMode="EventTime")


def replay_on_return(changes: DataFrame, hints: DataFrame) -> DataFrame:
    """Stream-static join: hints (target_id, surrogate_id, chunk_id) of nodes that a stream of changes reports alive."""
    back = changes.filter(F.col("status") == "ALIVE").select(F.col("node_id").alias("target_id"), "at_ms")
    return back.join(hints.filter(F.col("surrogate_id") != F.col("target_id")), "target_id").select("target_id", "at_ms", "surrogate_id", "chunk_id")


def windows(beats: DataFrame, minutes: int = 60) -> DataFrame:
    """Heartbeats by tumbling window and action; on a stream call ``withWatermark`` first."""
    out = beats.groupBy(F.window("ts", f"{minutes} minutes"), "action").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.unix_seconds("window.start").alias("window_start"), "action", "n", F.round("total", 4).alias("total"))


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available into Parquet under ``path`` and read the result; state is kept in RocksDB."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        return _run_available(stream, path, mode)
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)


def _run_available(stream: DataFrame, path: str, mode: str) -> DataFrame:

    def keep(batch: DataFrame, epoch: int) -> None:
        target = f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={epoch}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(keep).start()
    query.awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
    return out.select(*stream.columns)

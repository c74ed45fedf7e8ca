"""Densification of frames that come in any order: a keyed state of the frames of each scene, with an expiry of idle scenes.

    paired = insert_frames(stream, late="1 hour")      # a log of rows
    settled(spark.read.parquet(...))                   # what holds of a log

A frame that comes between two known ones withdraws the blends between them and gives those around itself. A frame that is older
than the newest of its scene by more than `late` cannot be placed any more; it is a row of kind `late`, so none is lost without
a trace. State holds the frames of that span and one before it, a scene's as one value, so that a batch reads and writes once for
each of its scenes. A scene whose newest frame is older than the stream's by more than
`late` and `idle` is forgotten, with a row of kind `expired`; rows that are older still are counted by Spark as late and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOG = "scene string, ts timestamp, kind string, t double, bt double, change int"
_ROW = Row("scene", "micros", "kind", "t", "bt", "change")


def blends(scene: str, a: tuple[int, float], b: tuple[int, float], factor: int, change: int) -> Iterator[tuple]:
    """Rows of the blends between two frames (micros, bt): +1 if they come, -1 if they go. Frames at one time have none between them."""
    for step in range(1, factor) if b[0] > a[0] else ():
        t = step / factor
        yield scene, a[0] + int((b[0] - a[0]) * t), "interpolated", t, (1 - t) * a[1] + t * b[1], change


class Inserter(StatefulProcessor):
    """Frames of a scene by time; of several at one time the least bt is the one that is blended."""

    def __init__(self, factor: int, late_micros: int):
        self.factor, self.late = factor, late_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getValueState("frames", "micros binary, bt binary")

    def known(self) -> dict[int, float]:
        held = self.frames.get()
        return dict(zip(np.frombuffer(held[0], "<i8").tolist(), np.frombuffer(held[1], "<f8").tolist())) if held else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        scene = key[0]
        # A frame without bt stands behind others of its time.
        new = sorted(((r["micros"], float("nan") if r["bt"] is None else r["bt"]) for r in rows), key=lambda x: (x[0], x[1] != x[1], x[1]))
        known = self.known()
        before = dict(known)
        newest = max([*known, new[-1][0]])
        # What is late is so for all that came before this batch, not for the rows beside it.
        oldest = (max(known) if known else -(1 << 62)) - self.late
        out = []
        for micros, bt in new:
            if micros < oldest:
                out.append((scene, micros, "late", None, bt, 1))
                continue
            out.append((scene, micros, "observed", None, bt, 1))
            if micros not in known or bt < known[micros]:
                known[micros] = bt
        # Neighbours before and after: pairs that are in one order only.
        pairs = lambda frames: {(a, frames[a], b, frames[b]) for a, b in zip(sorted(frames), sorted(frames)[1:])}
        was, now = pairs(before), pairs(known)
        for change, some in ((-1, was - now), (1, now - was)):
            for a, x, b, y in sorted(some):
                out += blends(scene, (a, x), (b, y), self.factor, change)
        kept = [m for m in known if m >= newest - self.late]
        earlier = [m for m in known if m < newest - self.late]
        if earlier:
            kept.append(max(earlier))
        kept.sort()
        self.frames.update((np.array(kept, "<i8").tobytes(), np.array([known[m] for m in kept], "<f8").tobytes()))
        if not before or newest > max(before):
            self.handle.registerTimer(newest // 1000 + 1)
        yield from map(_row, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        newest = max(self.known(), default=None)
        if newest is not None and newest // 1000 < expiredTimerInfo.getExpiryTimeInMs():  # else frames have come since
            self.frames.clear()
            yield _row((key[0], newest, "expired", None, None, 1))

    def close(self) -> None:
        pass


def _row(values: tuple) -> Row:
    scene, micros, kind, t, bt, change = values
    return _ROW(scene, micros, kind, t, None if bt != bt else bt, change)


def insert_frames(stream: DataFrame, factor: int = 2, late_seconds: int = 3600, idle_seconds: int = 86_400) -> DataFrame:
    """The log of a stream of frames (scene, ts, bt): rows scene, ts, kind (observed, interpolated, late, expired), t, bt and change, -1
    for a blend that holds no longer. Needs the RocksDB state store, which it sets."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = stream.select("scene", F.col("ts").cast("timestamp").alias("ts"), "bt").withWatermark("ts", f"{late_seconds + idle_seconds} seconds")
    own = timed.withColumn("micros", F.unix_micros("ts"))
    log = own.groupBy("scene").transformWithState(Inserter(factor, late_seconds * 1_000_000), LOG.replace("ts timestamp", "micros long"), "Append", "EventTime")
    return log.withColumn("micros", F.timestamp_micros("micros")).withColumnRenamed("micros", "ts")


def settled(log: DataFrame) -> DataFrame:
    """The rows of a log that hold: scene, ts, kind, t, bt, as often as they came and did not go."""
    key = ["scene", "ts", "kind", "t", "bt"]
    left = log.groupBy(*key).agg(F.sum("change").cast("int").alias("n")).filter("n > 0")
    return left.select(*key, F.explode(F.sequence(F.lit(1), "n"))).drop("col")

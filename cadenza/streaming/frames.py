"""Event-time operators that run alike on batch and streaming frames (columns ts, bt and keys)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, late: str | None = None) -> DataFrame:
    """ts as a timestamp with zone, which watermarks need; a watermark only on a stream."""
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", late) if late and df.isStreaming else df


def tumbling(df: DataFrame, size: str, keys: list[str], slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """n and mean of bt in tumbling, or with `slide` sliding, windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return event_time(df, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("bt").alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


def sessions(df: DataFrame, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """n and mean of bt in sessions that a gap ends."""
    return event_time(df, late).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.avg("bt").alias("mean")).select(*keys, F.col("w.start").alias("start"), "n", "mean")


def skip_present(df: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Frames whose key has not come within the watermark."""
    df = event_time(df, late)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def clock_steps(elapsed_ms, interval_ms: int):
    """Whole steps that a playback clock has made after a time."""
    return F.floor(elapsed_ms / interval_ms).cast("long")


_OUT = "scene string, ts timestamp, kind string, t double, bt double"
_STATE = "ts timestamp, bt double"


def pair_frames(df: DataFrame, factor: int = 2) -> DataFrame:
    """Streaming densification: each frame of a scene (scene, ts, bt) with the blends between it and the one before.

    The state is the last frame of each scene; a frame that is not newer than that is dropped, one without time has
    no blends. insert_frames() places late frames."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("ts", kind="stable")
        ts, bt = rows["ts"].to_numpy("datetime64[us]"), rows["bt"].to_numpy(float)
        untimed = np.isnat(ts)
        if untimed.any():
            yield pd.DataFrame({"scene": key[0], "ts": ts[untimed], "kind": "observed", "t": np.nan, "bt": bt[untimed]})
            ts, bt = ts[~untimed], bt[~untimed]
        if not len(ts):
            return
        if state.exists:
            before, value = state.get
            ts, bt = np.append(np.datetime64(before, "us"), ts), np.append(value, bt)
        # Of frames at one time the first stays; none is older than the first here, which is that of the state if there is one.
        kept = np.append(True, ts[1:] > np.maximum.accumulate(ts)[:-1])
        ts, bt = ts[kept], bt[kept]
        share = np.arange(factor) / factor
        # A row of an array: a frame's blends with the one before it, then the frame.
        step = np.roll(share, -1)
        times = ts[:-1, None] + np.floor((ts[1:] - ts[:-1])[:, None].astype("int64") * step).astype("timedelta64[us]")
        times[:, -1] = ts[1:]
        blends = (1 - step) * bt[:-1, None] + step * bt[1:, None]
        blends[:, -1] = bt[1:]
        t = np.tile(np.append(step[:-1], np.nan), len(ts) - 1)
        times, blends = times.ravel(), blends.ravel()
        if not state.exists:
            times, blends, t = np.append(ts[0], times), np.append(bt[0], blends), np.append(np.nan, t)
        state.update((ts[-1].item(), float(bt[-1])))
        yield pd.DataFrame({"scene": key[0], "ts": times, "kind": np.where(np.isnan(t), "observed", "interpolated"), "t": t, "bt": blends})

    own = df.select("scene", F.col("ts").cast("timestamp").alias("ts"), "bt")
    return own.groupBy("scene").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)

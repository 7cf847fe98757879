"""Structured Streaming forms of the tracking operators: windows with late data, sessions, and velocity with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(feed: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", by: list[str] = (), time: str = "ts", value: str = "value") -> DataFrame:
    """Count, sum and mean per window and key; rows later than ``late`` are ignored when streaming."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = feed.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total", "mean")


def sessions(feed: DataFrame, gap: str, by: list[str], late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Count per key and session, which ends after ``gap`` without a row."""
    out = feed.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


VELOCITY = "game_id string, id string, period_id int, frame_id long, t_ms long, vx double, vy double"


def moved(t: np.ndarray, x: np.ndarray, y: np.ndarray, last: tuple[int, float, float] | None) -> tuple[np.ndarray, np.ndarray, tuple[int, float, float]]:
    """Velocities of an object's rows in order of time, and the row to remember. Each row is compared with the last one
    of an earlier time, or with ``last``; rows at or before it stand still."""
    if last is not None:
        t, x, y = np.r_[last[0], t], np.r_[last[1], x], np.r_[last[2], y]
    # rows that move time on; each row's base is the one before the last of them
    top = np.maximum.accumulate(t)
    on = np.r_[True, top[1:] > top[:-1]]
    newest = np.maximum.accumulate(np.where(on, np.arange(len(t)), 0))
    base = np.where(on, np.r_[0, newest[:-1]], newest)
    dt = (t - t[base]) / 1000.0
    ahead = dt > 0
    by = np.where(ahead, dt, 1.0)
    vx, vy = (np.where(ahead, (c - c[base]) / by, 0.0) for c in (x, y))
    k = newest[-1]
    skip = last is not None
    return vx[skip:], vy[skip:], (int(t[k]), float(x[k]), float(y[k]))


def velocities(feed: DataFrame, idle: str | None = None) -> DataFrame:
    """Velocity of each object from its row before, which is kept as state; rows of a batch are put in order first.

    A row that comes with a time at or before the last one seen has no velocity: 0. With ``idle``, such as "1 hour", the
    state of an object that has sent nothing for so long is dropped; its next row is a first one. Without, it is kept.
    """
    wait = 0 if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["t_ms", "frame_id"])
        vx, vy, last = moved(pdf["t_ms"].to_numpy(np.int64), pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), state.get if state.exists else None)
        state.update(last)
        if wait:
            state.setTimeoutDuration(wait)
        names = dict(zip(("game_id", "id", "period_id"), key, strict=True))
        yield pd.DataFrame({**{k: [v] * len(pdf) for k, v in names.items()}, "frame_id": pdf["frame_id"].to_numpy(), "t_ms": pdf["t_ms"].to_numpy(), "vx": vx, "vy": vy})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return feed.groupBy("game_id", "id", "period_id").applyInPandasWithState(step, VELOCITY, "t_ms long, x double, y double", "append", timeout)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there and stop, with exactly-once files at ``path``."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()

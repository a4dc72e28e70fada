"""Telemetry as streams: deduplication, windows, and the pause state, which equals the batch form. Extension beyond the survey."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """[SRC13] First row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """[AGG09] n, low, mean, high of event-time windows; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high")).select("w.start", "w.end", "n", "low", "mean", "high")


def pause_state(stream: DataFrame, key: str, order: str, value: str, on: float, off: float) -> DataFrame:
    """[WIN15] key, order, paused for each row, the state of a key kept between batches; rows of a batch are ordered first."""

    def step(k, frames, state):
        paused = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for v in rows[value]:
            paused = 1 if v >= on else 0 if v <= off else paused
            out.append(paused)
        state.update((paused,))
        yield pd.DataFrame({key: k[0], order: rows[order], "paused": out})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, paused long", "paused long", "append", GroupStateTimeout.NoTimeout)

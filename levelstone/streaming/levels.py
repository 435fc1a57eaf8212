"""Streams of bars: per-record variables, and a lag that lives in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import levels as L


def stream_levels(bars: DataFrame, price: str = "close_price") -> DataFrame:
    """Level, distances, side and near flags of each record; no state, so any output mode."""
    p = F.col(price)
    df = bars.withColumn("nearest_level", L.round_half_up_to_step(p)).withColumn("distance_to_level", L.distance_to_level(p)).withColumn("side", L.side(L.signed_distance(p)))
    return df.withColumns({f"near_{k}": L.near(F.col("distance_to_level"), k) for k in L.NEAR_THRESHOLDS})


def stream_occupancy(bars: DataFrame, time: str = "trade_time", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean distance and share near a level for each series and window, closed by a watermark."""
    df = stream_levels(bars).withWatermark(time, late)
    near = F.avg(F.when(F.col("near_5") == 1, 1.0).otherwise(0.0)).alias("share_near_5")
    return df.groupBy("series_id", F.window(time, window)).agg(F.count("*").alias("records"), F.avg("distance_to_level").alias("mean_distance"), near)


def stream_returns(bars: DataFrame, time: str = "trade_time", price: str = "close_price") -> DataFrame:
    """Log return against the series' last record of an earlier batch or the same one; records that come after a later
    one has been used are compared with it no more and get NULL."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        last = state.get if state.exists else (None, None)
        df = pd.concat(list(frames)).sort_values(time, kind="stable")
        out = []
        for t, p in zip(df[time], df[price]):
            late = last[0] is not None and t.value < last[0]
            ok = not late and last[1] is not None and p is not None and p > 0 and last[1] > 0
            out.append((key[0], t, p, float(np.log(p / last[1])) if ok else None))
            if not late:
                last = (t.value, p)
        state.update(last)
        yield pd.DataFrame(out, columns=["series_id", time, price, "log_return"])

    rows = bars.select("series_id", time, price)
    return rows.groupBy("series_id").applyInPandasWithState(step, f"series_id string, {time} timestamp, {price} double, log_return double", "t long, price double", "append", GroupStateTimeout.NoTimeout)

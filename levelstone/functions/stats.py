"""Robust and resampling statistics as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robust_z(df: DataFrame, value: str, out: str, series: str = "series_id") -> DataFrame:
    """``df`` with 0.6745 (x - median) / MAD by series. Infinite values don't enter the median and the MAD but get a z;
    NULL where a series has no finite value or a MAD of 0. Both medians are windows over a series, in the partitioning
    that other windows of the series have: no scan and no shuffle of their own."""
    w = Window.partitionBy(series)
    x = F.col(value)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    df = df.withColumn("_median", F.median(F.when(finite, x)).over(w))
    df = df.withColumn("_mad", F.median(F.when(finite, F.abs(x - F.col("_median")))).over(w))
    return df.withColumn(out, F.when(F.col("_mad") > 0, F.lit(0.6745) * (x - F.col("_median")) / F.col("_mad"))).drop("_median", "_mad")


def two_sided_p(above: Column, below: Column, n: Column) -> Column:
    """min(1, 2 min(#>= + 1, #<= + 1) / (n + 1))."""
    return F.least(F.lit(1.0), F.lit(2.0) * F.least(above + 1, below + 1) / (n + 1))


def describe(df: DataFrame, value: str) -> DataFrame:
    """(metric, value): count, mean, std, min, 25/50/75 %, max of the non-null values, quantiles by linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = df.agg(F.count(value).cast("double").alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    rows = one.selectExpr("stack(8, 'count', `count`, 'mean', mean, 'std', std, 'min', `min`, '25%', q[0], '50%', q[1], '75%', q[2], 'max', `max`) as (metric, value)")
    return rows.select("metric", F.round("value", 6).alias("value"))

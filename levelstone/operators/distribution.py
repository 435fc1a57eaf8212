"""Distribution of distances to levels over a training window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.stats import describe

BINS = 25


def training_sample(df: DataFrame, first, last, day: str = "trade_date", price: str = "close_price") -> DataFrame:
    """Rows of the window, both ends included, with a positive close."""
    return df.where(F.col(day).between(F.lit(first), F.lit(last)) & (F.col(price) > 0))


def with_distance(closes: DataFrame, price: str = "close_price") -> DataFrame:
    return closes.withColumn("distance", L.distance_to_level(F.col(price)))


def distance_description(sample: DataFrame) -> DataFrame:
    return describe(sample, "distance")


def distance_bins(sample: DataFrame, open_last: bool = False) -> DataFrame:
    """All unit bins with counts and shares of the rows with a distance, empty bins included."""
    counts = sample.where("distance is not null").groupBy(L.unit_bin(F.col("distance"), open_last=open_last).alias("bin")).agg(F.count("*").alias("k"))
    n = sample.agg(F.count("distance").alias("n"))
    every = sample.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    rows = every.join(counts, "bin", "left").crossJoin(F.broadcast(n))  # one row
    return rows.select("bin", L.bin_label(F.col("bin")).alias("label"), F.coalesce("k", F.lit(0)).alias("observations"), F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 6).alias("proportion"))


def threshold_summary(sample: DataFrame) -> DataFrame:
    """Days within each threshold against a uniform distance."""
    counts = [F.count_if(F.col("distance") <= k).alias(f"n{k}") for k in L.NEAR_THRESHOLDS]
    one = sample.agg(F.count("distance").alias("n"), *counts)
    rows = one.selectExpr("n", f"stack({len(counts)}, " + ", ".join(f"{k}, n{k}" for k in L.NEAR_THRESHOLDS) + ") as (threshold, observations)")
    share, uniform = F.col("observations") / F.col("n"), F.col("threshold") / F.lit(L.LEVEL_STEP / 2)
    return rows.select("threshold", "observations", F.round(share, 6).alias("actual_proportion"), F.round(uniform, 6).alias("uniform_proportion"), F.round(share - uniform, 6).alias("difference"))


def occupancy_stats(sample: DataFrame) -> DataFrame:
    """(statistic, value): mean distance and shares within the thresholds."""
    shares = [F.avg(F.when(F.col("distance") <= k, 1.0).otherwise(0.0)).alias(f"s{k}") for k in L.NEAR_THRESHOLDS]
    one = sample.where("distance is not null").agg(F.avg("distance").alias("m"), *shares)
    return one.selectExpr(f"stack({len(shares) + 1}, 'mean_distance', m, " + ", ".join(f"'prop_distance_le_{k}', s{k}" for k in L.NEAR_THRESHOLDS) + ") as (statistic, value)")


def persistence(sample: DataFrame, order: str = "t") -> DataFrame:
    """Lag-1 autocorrelation of the distance and the number of changes of the nearest level."""
    w = Window.partitionBy("series_id").orderBy(order)
    level = L.round_half_up_to_step(F.col("close_price"))
    rows = sample.select("distance", F.lag("distance").over(w).alias("before"), level.alias("level"), F.lag(level).over(w).alias("level_before"))
    return rows.agg(F.round(F.corr("distance", "before"), 6).alias("lag1_autocorrelation"), F.count_if(F.col("level") != F.col("level_before")).alias("level_changes"))

"""Read-only diagnostics of raw bars: duplicates, calendar gaps, days without volume, order, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.stats import describe
from .audit import in_file_order, parse

QUANTILES = (0.9, 0.95, 0.99, 0.995, 0.999)
LISTED_DAYS = 4


def duplicate_dates(raw: DataFrame) -> DataFrame:
    """Every row of a day that occurs more than once."""
    n = F.count("parsed_date").over(Window.partitionBy("series_id", "parsed_date"))
    return parse(raw).withColumn("copies", n).where("parsed_date is not null and copies > 1").select("parsed_date", "source_row_number", "copies", "close")


def duplicate_summary(raw: DataFrame) -> DataFrame:
    d = duplicate_dates(raw).agg(F.count_distinct("parsed_date").alias("distinct_duplicated_dates"), F.count("*").alias("rows_involved"))
    return parse(raw).agg(F.count_if(F.col("parsed_date").isNull()).alias("parse_failures")).crossJoin(d)  # one row each


def gaps(raw: DataFrame) -> DataFrame:
    """Days and weekdays skipped between neighbours in file order, rows without a day left out first."""
    dated = parse(raw).where("parsed_date is not null")
    before = F.lag("parsed_date").over(in_file_order())
    g = dated.select("series_id", "source_row_number", before.alias("previous_date"), "parsed_date").where("previous_date is not null")
    return g.withColumn("calendar_days", F.datediff("parsed_date", "previous_date").cast("long")).withColumn("weekdays_skipped", L.weekdays_between(F.col("previous_date"), F.col("parsed_date")))


def gap_distribution(raw: DataFrame) -> DataFrame:
    return gaps(raw).groupBy("calendar_days").agg(F.count("*").alias("pairs")).orderBy("calendar_days")


def gap_listing(raw: DataFrame, days: int = LISTED_DAYS) -> DataFrame:
    return gaps(raw).where(F.col("calendar_days") > days).select("previous_date", "parsed_date", "calendar_days", "weekdays_skipped")


def gap_summary(raw: DataFrame) -> DataFrame:
    k = F.col("weekdays_skipped")
    return gaps(raw).agg(F.count_if(k >= 1).alias("weekday_gaps"), F.coalesce(F.sum(F.when(k >= 1, k)), F.lit(0)).alias("weekdays_skipped"), F.count_if(k > 10).alias("gaps_over_10"))


def weekday_gaps(raw: DataFrame) -> DataFrame:
    return gaps(raw).where("weekdays_skipped >= 1").select("previous_date", "parsed_date", "weekdays_skipped")


def zero_volume_days(raw: DataFrame) -> DataFrame:
    """Rows without volume: is the close stale, and the returns of that record and of the next (a look ahead by design)."""
    w = in_file_order()
    p = parse(raw).withColumn("prev_close", F.lag("close_num").over(w)).withColumn("next_close", F.lead("close_num").over(w))
    rows = p.where("volume_kg_num is null or volume_kg_num = 0")
    c = F.col("close_num")
    return rows.select("source_row_number", "volume_kg", "close_num", "prev_close", F.coalesce(c == F.col("prev_close"), F.lit(False)).alias("stale"), F.round(L.log_return(c, F.col("prev_close")), 6).alias("log_return_day"), F.round(L.log_return(F.col("next_close"), c), 6).alias("log_return_next_day"))


def sort_violations(raw: DataFrame) -> DataFrame:
    p = parse(raw).withColumn("previous_row_date", F.lag("parsed_date").over(in_file_order()))
    return p.where("parsed_date < previous_row_date").select("source_row_number", "parsed_date", "previous_row_date")


def ranges(raw: DataFrame) -> DataFrame:
    return parse(raw).withColumn("r", L.intraday_range(F.col("high_num"), F.col("low_num"), F.col("close_num"))).where("r is not null")


def range_description(raw: DataFrame) -> DataFrame:
    return describe(ranges(raw), "r")


def range_percentiles(raw: DataFrame) -> DataFrame:
    """Exact quantiles by linear interpolation, and the first day of the greatest range."""
    one = ranges(raw).agg(F.percentile("r", F.array(*map(F.lit, QUANTILES))).alias("q"), F.min_by("parsed_date", F.struct(-F.col("r"), "source_row_number")).alias("day"))
    rows = one.select("day", F.posexplode("q").alias("i", "value"))
    names = F.element_at(F.array(*map(F.lit, QUANTILES)), F.col("i") + 1)
    return rows.select(names.alias("quantile"), F.round("value", 6).alias("value"), F.date_format("day", "yyyy-MM-dd").alias("day_of_greatest"))

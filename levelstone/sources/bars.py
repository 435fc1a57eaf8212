"""Price bars from the star-schema tables, and raw bars with planted faults.

A bar table has series_id, trade_date, source_row_number, open/high/low/close_price and volume_kg_raw. Windows are
partitioned by series, so many series spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_COLUMNS = ("date", "open", "high", "low", "close", "volume_kg")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly random walk from events: (series_id, t, trade_time, close_price). Rows are hours, not events."""
    events = read_table(spark, sf_dir, "events").select("ts", "value")
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("trade_time")).agg(F.avg("value").alias("v"), F.sqrt(F.count("*").cast("double")).alias("s"))
    mean = events.agg(F.avg("value").alias("mean"))
    step = (F.col("v") - F.col("mean")) * F.col("s") / F.lit(4000.0)
    rows = hours.crossJoin(F.broadcast(mean)).select(F.lit("walk").alias("series_id"), "trade_time", step.alias("r"))  # one row
    w = Window.partitionBy("series_id").orderBy("trade_time")
    price = F.round(F.lit(300.0) * F.exp(F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0))), 4)
    return rows.select("series_id", (F.row_number().over(w) - 1).cast("long").alias("t"), "trade_time", price.alias("close_price"))


def walk_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk as daily bars, one day for each of its hours: highs and lows from the hour's events, volume their number."""
    hours = read_table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("trade_time")).agg(F.avg("value").alias("m"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("*").cast("double").alias("volume_kg_raw"))
    rows = walk_bars(spark, sf_dir).join(hours, "trade_time")
    c = F.col("close_price")
    high, low = c * (1 + (F.col("hi") - F.col("m")) / 4000.0), c * (1 - (F.col("m") - F.col("lo")) / 4000.0)
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("t").cast("int"))
    return rows.select("series_id", day.alias("trade_date"), (F.col("t") + 2).alias("source_row_number"), c.alias("open_price"), high.alias("high_price"), low.alias("low_price"), "close_price", "volume_kg_raw")


def walk_decisions(walk: DataFrame) -> DataFrame:
    """Days of the walk that are excluded, by series: some for an extreme range, some as placeholders."""
    n = F.col("source_row_number")
    rule = F.when(n % 40 == 7, "extreme_intraday_range").when(n % 90 == 65, "zero_volume_kg")
    rows = walk.select("series_id", F.date_format("trade_date", "yyyy-MM-dd").alias("date"), rule.alias("rule")).where("rule is not null")
    return rows.withColumns({"disposition": F.lit("exclude"), "reason": F.lit("planted"), "reviewer": F.lit("reviewer"), "decided_on": F.lit("2026-01-01")})


def orders_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday bars from orders: first and last price of a day by order key, in thousands, and the number of orders."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("trade_date"), (F.floor(F.col("o_totalprice") / 10) / 100).alias("price"))
    o = o.where(F.weekday("trade_date") < 5)
    days = o.groupBy("trade_date").agg(F.min_by("price", "o_orderkey").alias("open_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"), F.max_by("price", "o_orderkey").alias("close_price"), F.count("*").cast("double").alias("volume_kg_raw"))
    w = Window.partitionBy("series_id").orderBy("trade_date")
    days = days.withColumn("series_id", F.lit("orders")).withColumn("source_row_number", (F.row_number().over(w) + 1).cast("long"))
    return days.select("series_id", "trade_date", "source_row_number", "open_price", "high_price", "low_price", "close_price", "volume_kg_raw")


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each supplier: daily bars of line prices."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("series_id"), F.to_date("l_shipdate").alias("trade_date"), (F.col("l_extendedprice") / 1000).alias("price"), "l_orderkey", "l_linenumber", "l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "price")
    days = li.groupBy("series_id", "trade_date").agg(F.min_by("price", key).alias("open_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"), F.max_by("price", key).alias("close_price"), F.sum("l_quantity").alias("volume_kg_raw"))
    w = Window.partitionBy("series_id").orderBy("trade_date")
    return days.withColumn("source_row_number", (F.row_number().over(w) + 1).cast("long"))


def dirty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order bars as raw text in file order, with faults planted by row number so that every audit rule finds some."""
    b = orders_bars(spark, sf_dir).withColumn("n", F.col("source_row_number"))
    b = b.where(~((F.col("n") % 40).isin(7, 8) | F.col("n").between(300, 316)))

    def at(k: int, r: int):
        return F.col("n") % k == r

    day = F.col("trade_date")
    date = F.when(at(97, 5), "bad-date").when(at(89, 4), "").when(at(83, 3), F.date_format(F.date_sub(day, 1), "yyyy-MM-dd")).when(at(101, 50), F.date_format(F.date_sub(day, 9), "yyyy-MM-dd")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    high = F.when(at(67, 5), F.col("low_price")).otherwise(F.col("high_price"))
    low = F.when(at(67, 5), F.col("high_price")).otherwise(F.col("low_price"))
    close = F.when(at(53, 11), F.col("close_price") * 4).otherwise(F.col("close_price"))

    def text(c):
        return c.cast("string")

    return b.select(
        "series_id",
        F.col("n").alias("source_row_number"),
        date.alias("date"),
        F.when(at(71, 1), "").when(at(73, 2), "n/a").when(at(79, 3), "0").otherwise(text(F.col("open_price"))).alias("open"),
        F.when(at(107, 1), "").when(at(109, 2), "high").when(at(113, 3), "-1").otherwise(text(high)).alias("high"),
        F.when(at(127, 1), " ").when(at(131, 2), "--").when(at(137, 3), "0").otherwise(text(low)).alias("low"),
        F.when(at(59, 7), "-1.5").when(at(139, 1), "").when(at(149, 2), "x").otherwise(text(close)).alias("close"),
        F.when(at(47, 1), "0").when(at(43, 2), "-5").when(at(41, 3), "").when(at(37, 4), "abc").when(at(31, 5), text(F.col("volume_kg_raw") * 10)).otherwise(text(F.col("volume_kg_raw"))).alias("volume_kg"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision table for the dirty bars: dispositions by day, one of them unknown and one for a day without a bar."""
    b = orders_bars(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("exclude", "keep", "set_nan", "not_applicable", "exclude", "maybe"))), (F.col("source_row_number") / 50 % 6 + 1).cast("int"))
    known = b.where(F.col("source_row_number") % 50 == 0).select(F.date_format("trade_date", "yyyy-MM-dd").alias("date"), F.lit("extreme_intraday_range").alias("rule"), kind.alias("disposition"))
    lost = spark.range(1).select(F.lit("1900-01-01").alias("date"), F.lit("weekday_gap").alias("rule"), F.lit("exclude").alias("disposition"))
    return known.unionByName(lost).select("date", "rule", "disposition", F.lit("planted").alias("reason"), F.lit("reviewer").alias("reviewer"), F.lit("2026-01-01").alias("decided_on"))

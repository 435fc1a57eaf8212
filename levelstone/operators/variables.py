"""Research variables of price bars: levels, sides, returns, ranges, volume baselines, lags, flags and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels as L

KEYS = ("series_id", "trade_date", "source_row_number")
STATE_COLUMNS = ("nearest_level", "signed_distance", "distance_to_level", "near_2", "near_3", "near_5", "near_10", "side", "side_near_5")
COUNTED = ("nearest_level", "signed_distance", "distance_to_level", "near_2", "near_3", "near_5", "near_10", "side", "side_near_5", "log_return", "abs_log_return", "parkinson_variance", "parkinson_volatility", "log_volume", "normal_log_volume_20d_lagged", "abnormal_volume_20d")
BASELINE, BREAK = 20, 0.20


def by_day():
    """Records of a series in order of day and source row; days that can't be read come last."""
    return Window.partitionBy("series_id").orderBy(F.col("trade_date").asc_nulls_last(), "source_row_number")


def add_index(df: DataFrame) -> DataFrame:
    return df.withColumn("trading_index", (F.row_number().over(by_day()) - 1).cast("long"))


def add_round_level_variables(df: DataFrame, step: float = L.LEVEL_STEP) -> DataFrame:
    p = F.col("close_price")
    df = df.withColumn("nearest_level", L.round_half_up_to_step(p, step)).withColumn("signed_distance", L.signed_distance(p, step)).withColumn("distance_to_level", L.distance_to_level(p, step))
    df = df.withColumns({f"near_{k}": L.near(F.col("distance_to_level"), k) for k in L.NEAR_THRESHOLDS}).withColumn("side", L.side(F.col("signed_distance")))
    return df.withColumn("side_near_5", F.when(F.col("near_5") == 1, F.col("side")).otherwise("not_near"))


def add_return_variables(df: DataFrame) -> DataFrame:
    df = df.withColumn("prev_close_price", F.lag("close_price").over(by_day()))
    return df.withColumn("log_return", L.log_return(F.col("close_price"), F.col("prev_close_price"))).withColumn("abs_log_return", F.abs("log_return"))


def add_parkinson_variables(df: DataFrame) -> DataFrame:
    h, low = F.col("high_price"), F.col("low_price")
    df = df.withColumn("parkinson_valid_input", L.parkinson_valid(h, low).cast("int")).withColumn("parkinson_variance", L.parkinson_variance(h, low))
    return df.withColumn("parkinson_volatility", F.sqrt("parkinson_variance"))


def add_volume_variables(df: DataFrame, window: int = BASELINE) -> DataFrame:
    """Baseline of the ``window`` records before the current one; NULL unless all of them traded."""
    before = by_day().rowsBetween(-window, -1)
    df = df.withColumn("volume_valid_for_log", F.coalesce(F.col("volume_kg_raw") > 0, F.lit(False)).cast("int")).withColumn("log_volume", L.log_volume(F.col("volume_kg_raw")))
    df = df.withColumn("volume_history_count_20d_lagged", F.count("log_volume").over(before).cast("double"))
    df = df.withColumn("normal_log_volume_20d_lagged", F.when(F.col("volume_history_count_20d_lagged") == window, F.avg("log_volume").over(before)))
    return df.withColumn("abnormal_volume_20d", F.col("log_volume") - F.col("normal_log_volume_20d_lagged"))


def add_lagged_state_variables(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_lag1": F.lag(c).over(by_day()) for c in STATE_COLUMNS})


def flag_conditions(threshold: float = BREAK) -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("date_parse_failed", c("trade_date").isNull()),
        ("duplicate_date", c("trade_date").isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy("series_id", "trade_date")) > 1)),
        ("close_missing_or_non_numeric", c("close_price").isNull()),
        *[(f"{k}_non_positive", c(k) <= 0) for k in ("open_price", "high_price", "low_price", "close_price")],
        ("high_below_low", c("high_price") < c("low_price")),
        ("parkinson_input_invalid", c("parkinson_valid_input") == 0),
        ("volume_missing_or_non_numeric", c("volume_kg_raw").isNull()),
        ("volume_negative", c("volume_kg_raw") < 0),
        ("volume_zero", c("volume_kg_raw") == 0),
        ("insufficient_20d_lagged_volume_history", c("normal_log_volume_20d_lagged").isNull() & c("log_volume").isNotNull()),
        ("potential_price_break_or_data_gap", c("abs_log_return") > threshold),
    ]


def add_quality_flags(df: DataFrame, threshold: float = BREAK) -> DataFrame:
    fired = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flag_conditions(threshold)]))
    return df.withColumn("variable_construction_flags", F.array_join(fired, ";"))


def construct_variables(bars: DataFrame) -> DataFrame:
    """All variables of typed bars; rows and keys are kept."""
    df = add_index(bars)
    for step in (add_round_level_variables, add_return_variables, add_parkinson_variables, add_volume_variables, add_lagged_state_variables, add_quality_flags):
        df = step(df)
    return df


def variable_counts(df: DataFrame) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in COUNTED])
    pairs = ", ".join(f"'{c}', {c}" for c in COUNTED)
    return one.selectExpr("n", f"stack({len(COUNTED)}, {pairs}) as (variable, valid)").select("variable", "valid", (F.col("n") - F.col("valid")).alias("missing"))


def near_counts(df: DataFrame) -> DataFrame:
    """Near days by threshold; shares of all rows, and of the rows with a distance."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count("distance_to_level").alias("d"), *[F.count_if(F.col(f"near_{k}") == 1).alias(f"n{k}") for k in L.NEAR_THRESHOLDS])
    rows = one.selectExpr("n", "d", f"stack({len(L.NEAR_THRESHOLDS)}, " + ", ".join(f"{k}, n{k}" for k in L.NEAR_THRESHOLDS) + ") as (threshold, near_days)")
    return rows.select("threshold", "near_days", F.round(F.col("near_days") / F.col("n"), 6).alias("share_of_rows"), F.round(F.col("near_days") / F.col("d"), 6).alias("share_of_distances"))


def side_counts(df: DataFrame) -> DataFrame:
    return df.where("near_5 = 1").groupBy("side").agg(F.count("*").alias("days"))


def flag_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.split("variable_construction_flags", ";")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count("*").alias("rows_flagged"))


def manual_judgment(df: DataFrame, threshold: float = BREAK) -> DataFrame:
    name = "potential_price_break_or_data_gap"
    n = df.where(F.array_contains(F.split("variable_construction_flags", ";"), name)).agg(F.count("*").alias("rows_flagged"))
    return n.where("rows_flagged > 0").select(F.lit(name).alias("issue"), "rows_flagged", F.lit(f"abs(log_return) > {threshold}").alias("rule"))


def validations(df: DataFrame, source_rows: DataFrame, window: int = BASELINE, step: float = L.LEVEL_STEP) -> DataFrame:
    """(check_name, passed): the variables against independent recomputations by explicit row offsets.

    The baseline is averaged anew by joining each record with those 1 to ``window`` places before it; the lags are
    compared, null-safely, with the record one place before. Both joins are equi-joins on series and place.
    """
    c = F.col
    nested = (F.coalesce(c("near_2"), F.lit(0)) <= F.coalesce(c("near_3"), F.lit(0))) & (F.coalesce(c("near_3"), F.lit(0)) <= F.coalesce(c("near_5"), F.lit(0))) & (F.coalesce(c("near_5"), F.lit(0)) <= F.coalesce(c("near_10"), F.lit(0)))
    pattern = F.lit(True)
    for k in L.NEAR_THRESHOLDS:
        pattern = pattern & (c(f"near_{k}").isNull() == c("distance_to_level").isNull())
    simple = df.agg(
        F.coalesce(F.bool_and(c("distance_to_level").between(0, step / 2 + 1e-10)), F.lit(True)).alias("distance_to_level_between_0_and_25"),
        F.coalesce(F.bool_and(nested), F.lit(True)).alias("near_threshold_nesting"),
        (F.coalesce(F.bool_and(pattern), F.lit(True)) & (F.count_if(c("near_5") == 0) > 0)).alias("near_flags_missing_only_when_distance_missing"),
        F.count("*").alias("n"),
    )
    later = df.select("series_id", "source_row_number", "log_volume", F.explode(F.sequence(c("trading_index") + 1, c("trading_index") + window)).alias("trading_index"))
    again = later.groupBy("series_id", "trading_index").agg(F.count("log_volume").alias("k"), F.avg("log_volume").alias("expected"))
    held = df.where(c("normal_log_volume_20d_lagged").isNotNull()).select("series_id", "trading_index", "normal_log_volume_20d_lagged").join(again, ["series_id", "trading_index"], "left")
    right = (c("k") == window) & (F.abs(c("normal_log_volume_20d_lagged") - c("expected")) <= 1e-12)
    volume = held.agg(F.coalesce(F.bool_and(F.coalesce(right, F.lit(False))), F.lit(True)).alias("volume_20d_baseline_lagged_no_current_or_future"))
    before = df.select("series_id", (c("trading_index") + 1).alias("trading_index"), *[c(s).alias(f"_{s}") for s in STATE_COLUMNS])
    same = F.lit(True)
    for s in STATE_COLUMNS:
        same = same & c(f"{s}_lag1").eqNullSafe(c(f"_{s}"))
    lag = df.join(before, ["series_id", "trading_index"], "left").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("lagged_state_variables_from_previous_row"))
    rows = source_rows.agg(F.count("*").alias("rows"))
    one = simple.crossJoin(volume).crossJoin(lag).crossJoin(rows).withColumn("row_count_preserved", c("n") == c("rows"))  # one row each
    names = [x for x in one.columns if x not in ("n", "rows")]
    return one.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{x}', {x}" for x in names) + ") as (check_name, passed)")


WALKTHROUGH = (
    ("nearest_level", "step * floor(close / step + 0.5)"),
    ("signed_distance", "close - nearest_level"),
    ("distance_to_level", "abs(signed_distance)"),
    ("log_return", "ln(close / close before)"),
    ("parkinson_variance", "ln(high / low)^2 / (4 ln 2)"),
    ("log_volume", "ln(1 + volume)"),
    ("normal_log_volume_20d_lagged", "mean of log_volume over the 20 records before"),
    ("abnormal_volume_20d", "log_volume - normal_log_volume_20d_lagged"),
)


def walkthrough(df: DataFrame) -> DataFrame:
    """(place, trade_date, variable, formula, value): every formula worked out for the first record that has them all."""
    whole = df.where(" and ".join(f"{name} is not null" for name, _ in WALKTHROUGH)).orderBy("series_id", "trading_index").limit(1)
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("variable"), F.lit(f).alias("formula"), F.round(n, 6).alias("value")) for i, (n, f) in enumerate(WALKTHROUGH, 1)])
    return whole.select("trade_date", F.inline(rows))


SAMPLE = (
    ("near_5_below", "near_5 = 1 and side = 'below'"),
    ("near_5_above", "near_5 = 1 and side = 'above'"),
    ("at_level", "side = 'at_level'"),
    ("not_near_5", "near_5 = 0"),
    ("near_midpoint", "distance_to_level between 24.5 and 25.0"),
    ("positive_abnormal_volume", "abnormal_volume_20d > 0"),
    ("negative_abnormal_volume", "abnormal_volume_20d < 0"),
    ("high_parkinson_volatility", "parkinson_volatility is not null"),
    ("low_parkinson_volatility", "parkinson_volatility is not null"),
)


def manual_sample(df: DataFrame, each: int = 2, most: int = 18, fallback: int = 10) -> DataFrame:
    """The first ``each`` records of every criterion, ``most`` in all; the first ``fallback`` records if none holds.

    One pass: a record goes to the criteria it meets, and a ranked window per criterion keeps the first ones.
    """
    met = F.array_compact(F.array(*[F.when(F.expr(cond), F.struct(F.lit(i).alias("criterion"), F.lit(name).alias("sample_reason"))) for i, (name, cond) in enumerate(SAMPLE)]))
    first = F.when(F.col("criterion") == 7, -F.col("parkinson_volatility")).when(F.col("criterion") == 8, F.col("parkinson_volatility")).otherwise(F.lit(0.0))
    rows = df.withColumn("_m", F.explode(met)).select("*", "_m.*").drop("_m")
    w = Window.partitionBy("criterion").orderBy(first, "series_id", "trading_index")
    kept = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).drop("_r")
    kept = kept.orderBy("criterion", "series_id", "trading_index").limit(most)
    plain = df.orderBy("series_id", "trading_index").limit(fallback).withColumn("criterion", F.lit(-1)).withColumn("sample_reason", F.lit("fallback_first_rows"))
    none = kept.agg(F.count("*").alias("_k")).where("_k = 0")
    return kept.unionByName(plain.join(none, F.lit(True), "left_semi").select(kept.columns))

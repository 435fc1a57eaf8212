"""The analysis dataset: decisions are checked, excluded days leave, volume leaves with its flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels as L
from ..sources import files

DISPOSITIONS = ("exclude", "keep", "set_nan", "not_applicable")
DECISION_COLUMNS = ("date", "rule", "disposition", "reason", "reviewer", "decided_on")


def unknown_dispositions(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False))).groupBy("disposition").agg(F.count("*").alias("decisions"))


def series_of(decisions: DataFrame) -> list[str]:
    """Decisions with a column series_id are about one series each, others about a day of all series."""
    return ["series_id"] if "series_id" in decisions.columns else []


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decision table as text; FileNotFoundError without the file, ValueError without its columns."""
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no decisions at {path}")
    return files.require(spark.read.option("header", True).csv(path), DECISION_COLUMNS)


def orphans(decisions: DataFrame, dataset: DataFrame) -> DataFrame:
    """Decisions about days that the dataset, or its series, doesn't have."""
    by = series_of(decisions)
    days = dataset.select(*by, F.date_format("trade_date", "yyyy-MM-dd").alias("date")).distinct()
    return decisions.join(days, [*by, "date"], "left_anti").select(*by, "date", "rule")


def excluded_days(decisions: DataFrame) -> DataFrame:
    by = series_of(decisions)
    return decisions.where("disposition = 'exclude'").select(*by, F.to_date("date").alias("trade_date")).where("trade_date is not null").distinct()


def excluded_counts(decisions: DataFrame, dataset: DataFrame) -> DataFrame:
    """Rows that each excluded day takes out, 0 included."""
    days = excluded_days(decisions)
    return days.join(dataset.select(*days.columns, F.lit(1).alias("_one")), days.columns, "left").groupBy(days.columns).agg(F.count("_one").alias("rows_removed"))


def validate(decisions: DataFrame, dataset: DataFrame) -> None:
    """ValueError for missing columns, unknown dispositions and unknown days."""
    if missing := [c for c in DECISION_COLUMNS if c not in decisions.columns]:
        raise ValueError(f"decisions lack the columns {missing}")
    if bad := [r.disposition for r in unknown_dispositions(decisions).limit(20).collect()]:
        raise ValueError(f"unknown dispositions: {bad}")
    if lost := [r.date for r in orphans(decisions, dataset).limit(20).collect()]:
        raise ValueError(f"decisions about days that aren't in the dataset: {lost}")


def analysis_dataset(variables: DataFrame, decisions: DataFrame) -> DataFrame:
    """Variables without excluded days, volume columns and volume flags. A day that can't be read is never excluded."""
    days = excluded_days(decisions)
    kept = variables.join(days, days.columns, "left_anti")
    kept = kept.select([c for c in variables.columns if "volume" not in c.lower()])
    return kept.withColumn("variable_construction_flags", L.without_volume_tokens(F.col("variable_construction_flags")))

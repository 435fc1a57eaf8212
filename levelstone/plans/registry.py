"""Every registered query: (spark, sf_dir) -> DataFrame. Doubles are rounded for comparison, never in the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.stats import robust_z as robust
from ..operators import audit, bootstrap, dataset, diagnostics, distribution, inference, variables
from ..sources import bars
from .dictionary import VARIABLES
from .file_oracle import FILE_SQL
from .file_queries import FILE_QUERIES
from .oracle import SQL

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _vars(spark, d):
    return variables.construct_variables(bars.orders_bars(spark, d))


def _dirty_vars(spark, d):
    return variables.construct_variables(audit.typed_bars(bars.dirty_raw(spark, d)))


def _walk(spark, d):
    return distribution.with_distance(bars.walk_bars(spark, d))


def _paths(spark, d, n_sim, **options):
    return inference.simulate(bars.walk_bars(spark, d), n_sim, **options)


def _found(spark, d):
    return audit.anomalies(bars.dirty_raw(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_band(spark, sf_dir)


# variables


@query
def bars_typed(spark, d):
    return variables.add_index(bars.orders_bars(spark, d))


QUERIES["bars"] = QUERIES.pop("bars_typed")


@query
def level_distance(spark, d):
    return _rounded(_vars(spark, d).select("trade_date", "close_price", "nearest_level", "signed_distance", "distance_to_level"))


@query
def level_side(spark, d):
    return _vars(spark, d).select("trade_date", "side", "side_near_5")


@query
def near_flags(spark, d):
    return _vars(spark, d).select("trade_date", "near_2", "near_3", "near_5", "near_10")


@query
def log_returns(spark, d):
    return _rounded(_vars(spark, d).select("trade_date", "prev_close_price", "log_return", "abs_log_return"))


@query
def parkinson(spark, d):
    return _rounded(_dirty_vars(spark, d).select("source_row_number", "parkinson_valid_input", "parkinson_variance", "parkinson_volatility"))


@query
def volume_baseline(spark, d):
    return _rounded(_dirty_vars(spark, d).select("source_row_number", "volume_valid_for_log", "log_volume", "volume_history_count_20d_lagged", "normal_log_volume_20d_lagged", "abnormal_volume_20d"))


@query
def lagged_states(spark, d):
    return _rounded(_dirty_vars(spark, d).select("source_row_number", *[f"{c}_lag1" for c in variables.STATE_COLUMNS]))


@query
def training_sample(spark, d):
    return distribution.training_sample(audit.typed_bars(bars.dirty_raw(spark, d)), "1993-01-01", "1996-12-31").select("trade_date", "source_row_number", "close_price")


@query
def panel_variables(spark, d):
    v = variables.construct_variables(bars.lineitem_panel(spark, d))
    return _rounded(v.groupBy("series_id").agg(F.count("*").alias("days"), F.avg("distance_to_level").alias("mean_distance"), F.avg("abs_log_return").alias("mean_abs_return"), F.avg("parkinson_volatility").alias("mean_parkinson"), F.count("abnormal_volume_20d").alias("baselines"), F.sum(F.col("near_5_lag1")).alias("near_before")))


# distribution


@query
def occupancy_stats(spark, d):
    return _rounded(distribution.occupancy_stats(_walk(spark, d)))


@query
def distance_description(spark, d):
    return distribution.distance_description(_walk(spark, d))


@query
def distance_bins(spark, d):
    return distribution.distance_bins(_walk(spark, d), open_last=True)


@query
def occupancy_bins(spark, d):
    return distribution.distance_bins(_walk(spark, d))


@query
def threshold_summary(spark, d):
    return distribution.threshold_summary(_walk(spark, d))


@query
def near_counts(spark, d):
    return variables.near_counts(_dirty_vars(spark, d))


@query
def side_counts(spark, d):
    return variables.side_counts(_dirty_vars(spark, d))


@query
def variable_counts(spark, d):
    return variables.variable_counts(_dirty_vars(spark, d))


@query
def persistence(spark, d):
    return distribution.persistence(_walk(spark, d))


# audit and diagnostics


@query
def audit_parse(spark, d):
    return audit.parse(bars.dirty_raw(spark, d)).select("source_row_number", "parsed_date", "open_num", "high_num", "low_num", "close_num", "volume_kg_num")


@query
def audit_rules(spark, d):
    return _found(spark, d).select("source_row_number", "date_raw", "parsed_date", "rule", "severity", "close")


@query
def rule_counts(spark, d):
    return audit.rule_counts(_found(spark, d))


@query
def audit_missing_counts(spark, d):
    return audit.missing_counts(bars.dirty_raw(spark, d))


@query
def audit_summary(spark, d):
    return audit.summary(bars.dirty_raw(spark, d), _found(spark, d))


def _measures(spark, d):
    return audit.measures(audit.parse(bars.dirty_raw(spark, d)))


@query
def robust_z(spark, d):
    return _rounded(robust(bars.orders_bars(spark, d), "close_price", "z").select("trade_date", "z"), 5)


def _finite(c: str):
    return F.when(F.abs(F.col(c)) < float("inf"), F.round(c, 5)).alias(c)


@query
def close_jumps(spark, d):
    return _measures(spark, d).select("source_row_number", _finite("close_change"), _finite("close_change_z"))


@query
def volume_jumps(spark, d):
    return _measures(spark, d).select("source_row_number", _finite("volume_change"), _finite("log_volume_change_z"))


@query
def intraday_range(spark, d):
    return _measures(spark, d).select("source_row_number", _finite("intraday_range"), _finite("intraday_range_z"))


@query
def weekday_gaps(spark, d):
    return diagnostics.weekday_gaps(bars.dirty_raw(spark, d))


@query
def duplicate_dates(spark, d):
    return diagnostics.duplicate_dates(bars.dirty_raw(spark, d))


@query
def duplicate_summary(spark, d):
    return diagnostics.duplicate_summary(bars.dirty_raw(spark, d))


@query
def sort_violations(spark, d):
    return diagnostics.sort_violations(bars.dirty_raw(spark, d))


@query
def gap_distribution(spark, d):
    return diagnostics.gap_distribution(bars.dirty_raw(spark, d))


@query
def gap_listing(spark, d):
    return diagnostics.gap_listing(bars.dirty_raw(spark, d))


@query
def gap_summary(spark, d):
    return diagnostics.gap_summary(bars.dirty_raw(spark, d))


@query
def zero_volume_days(spark, d):
    return diagnostics.zero_volume_days(bars.dirty_raw(spark, d))


@query
def range_percentiles(spark, d):
    return diagnostics.range_percentiles(bars.dirty_raw(spark, d))


@query
def range_description(spark, d):
    return diagnostics.range_description(bars.dirty_raw(spark, d))


# decisions, dataset, gates, checks


@query
def pending_review(spark, d):
    return audit.pending_review(_found(spark, d), bars.decisions(spark, d))


@query
def decision_orphans(spark, d):
    return dataset.orphans(bars.decisions(spark, d), _dirty_vars(spark, d))


@query
def decision_validation(spark, d):
    return dataset.unknown_dispositions(bars.decisions(spark, d))


@query
def excluded_counts(spark, d):
    return dataset.excluded_counts(bars.decisions(spark, d), _dirty_vars(spark, d))


@query
def analysis_dataset(spark, d):
    return _rounded(dataset.analysis_dataset(_dirty_vars(spark, d), bars.decisions(spark, d)).select("trade_date", "source_row_number", "close_price", "distance_to_level", "side_near_5", "near_5_lag1", "log_return", "variable_construction_flags"))


@query
def strip_flag_tokens(spark, d):
    return _dirty_vars(spark, d).select("source_row_number", L.without_volume_tokens(F.col("variable_construction_flags")).alias("flags"))


@query
def quality_flags(spark, d):
    return _dirty_vars(spark, d).select("source_row_number", "variable_construction_flags")


@query
def flag_counts(spark, d):
    return variables.flag_counts(_dirty_vars(spark, d))


@query
def gate_report(spark, d):
    return audit.gate_report(bars.dirty_raw(spark, d))


@query
def gate_offenders(spark, d):
    return audit.gate_offenders(bars.dirty_raw(spark, d)).select("gate", "parsed_date", "source_row_number")


@query
def formula_walkthrough(spark, d):
    return variables.walkthrough(_vars(spark, d))


@query
def validations(spark, d):
    raw = bars.dirty_raw(spark, d)
    return variables.validations(variables.construct_variables(audit.typed_bars(raw)), raw)


@query
def manual_sample(spark, d):
    return _rounded(variables.manual_sample(_vars(spark, d)).select("sample_reason", "trade_date", "close_price", "distance_to_level", "side", "parkinson_volatility"))


@query
def manual_judgment(spark, d):
    return variables.manual_judgment(_dirty_vars(spark, d))


@query
def variable_dictionary(spark, d):
    rows = [F.struct(F.lit(n).alias("variable"), F.lit(k).alias("kind"), F.lit(m).alias("missing_when")) for n, k, m in VARIABLES]
    return spark.range(1).select(F.inline(F.array(*rows)))


# simulation and inference


@query
def bootstrap_draws(spark, d, n_sim=bootstrap.N_SIM):
    drawn = bootstrap.draws(bootstrap.series_arrays(bars.walk_bars(spark, d)), n_sim)
    return _rounded(drawn.select("sim", "t", "step"))


@query
def bootstrap_paths(spark, d, n_sim=bootstrap.N_SIM):
    return _rounded(_paths(spark, d, n_sim).select("sim", "t", "price"), 4)


@query
def occupancy_null(spark, d, n_sim=bootstrap.N_SIM):
    return _rounded(inference.occupancy_null(_paths(spark, d, n_sim)).select("sim", "statistic", "value"))


@query
def null_band(spark, d, n_sim=bootstrap.N_SIM):
    return inference.null_band(inference.occupancy_null(_paths(spark, d, n_sim)), _walk(spark, d))


@query
def bin_band(spark, d, n_sim=bootstrap.N_SIM):
    sample = _walk(spark, d)
    return inference.bin_band(_paths(spark, d, n_sim), distribution.distance_bins(sample).select("bin", "observations"), sample.agg(F.count("distance").alias("n")))


@query
def near_far_effect(spark, d):
    return _rounded(inference.near_far_effect(bars.walk_bars(spark, d)), 8)


@query
def near_far_null(spark, d, n_sim=bootstrap.N_SIM):
    return _rounded(inference.near_far_null(_paths(spark, d, n_sim)), 8)


@query
def near_far_band(spark, d, n_sim=bootstrap.N_SIM):
    return inference.near_far_band(bars.walk_bars(spark, d), _paths(spark, d, n_sim))


@query
def power_analysis(spark, d, n_sim=bootstrap.N_SIM):
    return inference.power(null_band(spark, d, n_sim), "statistic")


@query
def centre_table(spark, d, n_sim=bootstrap.N_SIM):
    return inference.centre_table(null_band(spark, d, n_sim), _walk(spark, d).agg(F.count("distance").alias("n")))


@query
def parkinson_robustness(spark, d, n_sim=bootstrap.N_SIM):
    """Parkinson volatility after near and far days, with and without the days of extreme ranges."""
    walk = bars.walk_days(spark, d)
    return inference.parkinson_robustness(variables.construct_variables(walk), bars.walk_decisions(walk), n_sim)


@query
def stage_checks(spark, d, n_sim=bootstrap.N_SIM):
    """Alignment of yesterday's distances, and of sensitivity with the main result."""
    walk = _walk(spark, d)
    return inference.alignment(walk).unionByName(inference.sensitivity_agrees(walk, null_band(spark, d, n_sim)))


@query
def sens_block_length(spark, d, n_sim=bootstrap.N_SIM):
    return inference.block_sweep(bars.walk_bars(spark, d), (5, 20, 50, 100), n_sim)


@query
def sens_additive(spark, d, n_sim=bootstrap.N_SIM):
    return inference.sensitivity(bars.walk_bars(spark, d), _paths(spark, d, n_sim, kind="absolute"), "additive")


@query
def sens_jitter(spark, d, n_sim=bootstrap.N_SIM):
    return inference.sensitivity(bars.walk_bars(spark, d), _paths(spark, d, n_sim, offset=bootstrap.jitter(F.col("sim"))), "jittered start")


@query
def terminal_prices(spark, d, n_sim=bootstrap.N_SIM):
    return inference.terminal_prices(_paths(spark, d, n_sim), 300.0)


@query
def terminal_corr(spark, d, n_sim=bootstrap.N_SIM):
    return inference.terminal_corr(_paths(spark, d, n_sim))


QUERIES |= FILE_QUERIES
ORACLE_SQL = {k: v for k, v in (SQL | FILE_SQL).items() if k in QUERIES}

"""Observed statistics against their simulated nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.stats import two_sided_p
from . import bootstrap as B
from .dataset import excluded_days
from .distribution import BINS, occupancy_stats

Z = 1.96


def occupancy_null(simulated: DataFrame) -> DataFrame:
    """(series_id, sim, statistic, value): mean distance and shares within the thresholds, path by path."""
    d = L.distance_to_level(F.col("price"))
    shares = [F.avg(F.when(F.col("d") <= k, 1.0).otherwise(0.0)).alias(f"s{k}") for k in L.NEAR_THRESHOLDS]
    one = simulated.withColumn("d", d).groupBy("series_id", "sim").agg(F.avg("d").alias("m"), *shares)
    return one.selectExpr("series_id", "sim", f"stack({len(shares) + 1}, 'mean_distance', m, " + ", ".join(f"'prop_distance_le_{k}', s{k}" for k in L.NEAR_THRESHOLDS) + ") as (statistic, value)")


def band(null: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """``observed(key, value)`` in the null distribution of ``null(key, value)``.

    Simulations without a value don't enter quantiles and p-values; the percentile counts them as not below.
    """
    o = observed.withColumnRenamed("value", "empirical")
    rows = null.join(F.broadcast(o), key)  # one row for each statistic
    v, e = F.col("value"), F.col("empirical")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    a = rows.groupBy(key).agg(F.first("empirical").alias("empirical"), q.alias("q"), F.avg(F.when(v < e, 1.0).otherwise(0.0)).alias("below"), F.count_if(v >= e).alias("ge"), F.count_if(v <= e).alias("le"), F.count("value").alias("n_valid"))
    out = [F.col(key), F.round("empirical", 6).alias("empirical"), F.round(F.col("q")[1], 6).alias("null_median"), F.round(F.col("q")[0], 6).alias("null_p2_5"), F.round(F.col("q")[2], 6).alias("null_p97_5")]
    p = two_sided_p(F.col("ge"), F.col("le"), F.col("n_valid"))
    return a.select(*out, F.round(F.col("below") * 100, 4).alias("empirical_percentile"), F.round(p, 6).alias("two_sided_p"), ((F.col("empirical") < F.col("q")[0]) | (F.col("empirical") > F.col("q")[2])).alias("outside_band"), "n_valid")


def null_band(null: DataFrame, sample: DataFrame) -> DataFrame:
    verdict = F.when(F.col("outside_band"), "outside the null band").otherwise("inside the null band")
    return band(null, occupancy_stats(sample), "statistic").withColumn("verdict", verdict)


def null_bins(simulated: DataFrame) -> DataFrame:
    """(sim, bin, value): share of each unit bin on every path, 0 for bins that a path never meets."""
    b = L.unit_bin(L.distance_to_level(F.col("price")))
    counts = simulated.select("series_id", "sim", b.alias("bin")).groupBy("series_id", "sim").agg(F.count("*").alias("n"), *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(BINS)])
    return counts.selectExpr("sim", f"stack({BINS}, " + ", ".join(f"{i}, b{i} / cast(n as double)" for i in range(BINS)) + ") as (bin, value)")


def bin_band(simulated: DataFrame, bins: DataFrame, n: DataFrame) -> DataFrame:
    """Band of every unit bin; ``bins(bin, observations)`` and ``n(n)`` are observed."""
    observed = bins.crossJoin(F.broadcast(n)).select("bin", (F.col("observations") / F.col("n")).alias("value"))  # one row
    t = band(null_bins(simulated), observed, "bin")
    low, high = F.col("empirical") < F.col("null_p2_5"), F.col("empirical") > F.col("null_p97_5")
    return t.select("bin", L.bin_label(F.col("bin")).alias("label"), "empirical", "null_median", "null_p2_5", "null_p97_5", low.alias("below_band"), high.alias("above_band"))


def _effects(prior: Column, outcome: Column) -> list[Column]:
    out = []
    for k in L.NEAR_THRESHOLDS:
        out += [F.count_if(prior <= k).alias(f"c{k}"), F.avg(F.when(prior <= k, outcome)).alias(f"n{k}"), F.avg(F.when(prior > k, outcome)).alias(f"f{k}")]
    return out


def _by_threshold(df: DataFrame, *keys: str) -> DataFrame:
    rows = ", ".join(f"{k}, c{k}, n{k}, f{k}" for k in L.NEAR_THRESHOLDS)
    return df.selectExpr(*keys, f"stack({len(L.NEAR_THRESHOLDS)}, {rows}) as (threshold, days_near, mean_near, mean_far)").withColumn("value", F.col("mean_near") - F.col("mean_far"))


def prior_outcome(rows: DataFrame, price: str, outcome: str | None, *keys: str) -> DataFrame:
    """Yesterday's distance beside today's outcome; without an outcome column, the absolute log return."""
    w = Window.partitionBy(*keys).orderBy("t")
    before = F.lag(price).over(w)
    value = F.col(outcome) if outcome else F.abs(F.ln(F.col(price)) - F.ln(before))
    return rows.select(*keys, L.distance_to_level(before).alias("prior"), value.alias("outcome")).where("prior is not null and outcome is not null")


def near_far_effect(closes: DataFrame, outcome: str | None = None) -> DataFrame:
    """Mean outcome after near days less that after far days; NULL if a side is empty."""
    p = prior_outcome(closes, "close_price", outcome, "series_id")
    return _by_threshold(p.agg(*_effects(F.col("prior"), F.col("outcome"))))


def near_far_null(simulated: DataFrame) -> DataFrame:
    outcome = "outcome" if "outcome" in simulated.columns else None
    p = prior_outcome(simulated, "price", outcome, "series_id", "sim")
    return _by_threshold(p.groupBy("series_id", "sim").agg(*_effects(F.col("prior"), F.col("outcome"))), "series_id", "sim").select("sim", "threshold", "value")


def near_far_band(closes: DataFrame, simulated: DataFrame, outcome: str | None = None) -> DataFrame:
    observed = near_far_effect(closes, outcome)
    t = band(near_far_null(simulated), observed.select("threshold", "value"), "threshold")
    facts = observed.select("threshold", "days_near", F.round("mean_near", 6).alias("mean_near"), F.round("mean_far", 6).alias("mean_far"))
    return facts.join(t, "threshold")


def power(bands: DataFrame, key: str) -> DataFrame:
    """Standard error, distance from the centre, least detectable effect and detection floor of every band."""
    se = (F.col("null_p97_5") - F.col("null_p2_5")) / F.lit(2 * Z)
    mde = F.lit(2.8) * se
    return bands.select(key, F.round(se, 6).alias("standard_error"), F.round((F.col("empirical") - F.col("null_median")) / se, 4).alias("z"), F.round(mde, 6).alias("least_effect"), F.round(mde / F.col("null_median") * 100, 4).alias("least_effect_percent"), F.round(F.col("null_median") - mde, 6).alias("detection_floor"))


def centre_table(bands: DataFrame, n: DataFrame) -> DataFrame:
    """The mean distance from the centre of independent uniform days, and from that of the simulated null."""
    half = L.LEVEL_STEP / 2
    b = bands.where("statistic = 'mean_distance'").crossJoin(F.broadcast(n))  # one row each
    iid = F.sqrt(F.lit(half * half / 12) / F.col("n"))
    null = (F.col("null_p97_5") - F.col("null_p2_5")) / F.lit(2 * Z)
    c = F.lit(half / 2)
    e = F.col("empirical")

    def row(name, centre, lo, hi, se):
        return F.struct(F.lit(name).alias("reference"), F.round(centre, 4).alias("centre"), F.round(lo, 4).alias("lower_95"), F.round(hi, 4).alias("upper_95"), F.round(e - centre, 4).alias("difference"), F.round((e - centre) / se, 4).alias("z"))

    return b.select(F.inline(F.array(row("uniform iid benchmark", c, c - Z * iid, c + Z * iid, iid), row("bootstrap null", F.col("null_median"), F.col("null_p2_5"), F.col("null_p97_5"), null))))


def share_null(simulated: DataFrame, threshold: int = L.MAIN_THRESHOLD) -> DataFrame:
    d = L.distance_to_level(F.col("price"))
    return simulated.groupBy("series_id", "sim").agg(F.avg(F.when(d <= threshold, 1.0).otherwise(0.0)).alias("value"))


def sensitivity(closes: DataFrame, simulated: DataFrame, variant: str, threshold: int = L.MAIN_THRESHOLD) -> DataFrame:
    """One row: where the observed share falls in a null that is built in another way."""
    observed = closes.select(F.avg(F.when(L.distance_to_level(F.col("close_price")) <= threshold, 1.0).otherwise(0.0)).alias("value")).withColumn("variant", F.lit(variant))
    t = band(share_null(simulated, threshold).withColumn("variant", F.lit(variant)), observed, "variant")
    return t.select("variant", "null_median", "null_p2_5", "null_p97_5", F.round(F.col("null_p97_5") - F.col("null_p2_5"), 6).alias("band_width"), "empirical_percentile")


def block_sweep(closes: DataFrame, lengths: tuple[int, ...], n_sim: int = B.N_SIM, threshold: int = L.MAIN_THRESHOLD) -> DataFrame:
    """``sensitivity`` for several lengths of blocks, from one array of steps: each length is a variant of its series."""
    mark = "\x1f"
    arrays = B.series_arrays(closes).withColumn("block", F.explode(F.array(*map(F.lit, lengths))))
    arrays = arrays.withColumn("series_id", F.concat_ws(mark, "series_id", F.concat(F.lit("block "), F.col("block").cast("string"))))
    null = share_null(B.paths(B.draws(arrays, n_sim, F.col("block"))), threshold).withColumn("variant", F.substring_index("series_id", mark, -1))
    share = closes.select(F.avg(F.when(L.distance_to_level(F.col("close_price")) <= threshold, 1.0).otherwise(0.0)).alias("value"))
    observed = share.withColumn("variant", F.explode(F.array(*[F.lit(f"block {n}") for n in lengths])))
    t = band(null, observed, "variant")
    return t.select("variant", "null_median", "null_p2_5", "null_p97_5", F.round(F.col("null_p97_5") - F.col("null_p2_5"), 6).alias("band_width"), "empirical_percentile")


def range_sample(variables: DataFrame, excluded: DataFrame) -> DataFrame:
    """(series_id, t, close_price, outcome): closes in order, with each day's Parkinson volatility, without excluded days."""
    by = [c for c in ("series_id", "trade_date") if c in excluded.columns]
    kept = variables.where("close_price > 0 and trade_date is not null").join(excluded, by, "left_anti")
    w = Window.partitionBy("series_id").orderBy("trade_date", "source_row_number")
    return kept.select("series_id", (F.row_number().over(w) - 1).cast("long").alias("t"), "close_price", F.col("parkinson_volatility").alias("outcome"))


def parkinson_robustness(variables: DataFrame, decisions: DataFrame, n_sim: int = B.N_SIM, reinstated: str = "extreme_intraday_range") -> DataFrame:
    """Near against far with Parkinson volatility, carried through the blocks of the returns, for two samples: without all
    excluded days, and with those back that the rule ``reinstated`` excluded."""
    out = None
    for name, dropped in (("as_is", decisions), ("extreme_dates_reinstated", decisions.where(F.col("rule") != reinstated))):
        closes = range_sample(variables, excluded_days(dropped))
        paths = simulate(closes, n_sim, outcome=closes.select("series_id", "t", "outcome"))
        part = near_far_band(closes, paths, "outcome").withColumn("sample", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def alignment(sample: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(check_name, passed): yesterday's distance, read from ``sample(series_id, t, close_price, distance)``, stands beside
    today's outcome: as many as outcomes, the first that of the first close, and each that of the close before."""
    w = Window.partitionBy("series_id").orderBy("t")
    before = F.lag("close_price").over(w)
    outcome = F.abs(F.ln("close_price") - F.ln(before))
    rows = sample.select("t", F.row_number().over(w).alias("place"), F.lag("distance").over(w).alias("prior"), L.distance_to_level(before).alias("again"), outcome.alias("outcome"))
    near = F.coalesce(F.abs(F.col("prior") - F.col("again")) <= tolerance, F.lit(False))
    one = rows.where("place > 1").agg(
        (F.count("prior") == F.count("outcome")).alias("priors_match_outcomes"),
        F.coalesce(F.bool_and(F.when(F.col("place") == 2, near)), F.lit(True)).alias("first_prior_is_the_first_distance"),
        F.coalesce(F.bool_and(near), F.lit(True)).alias("every_prior_is_yesterday_s"),
    )
    return _checks(one)


def sensitivity_agrees(closes: DataFrame, bands: DataFrame, threshold: int = L.MAIN_THRESHOLD, tolerance: float = 1e-6) -> DataFrame:
    """(check_name, passed): the share that sensitivity variants compare is the one of the main result."""
    seen = closes.agg(F.avg(F.when(L.distance_to_level(F.col("close_price")) <= threshold, 1.0).otherwise(0.0)).alias("seen"))
    main = bands.where(F.col("statistic") == f"prop_distance_le_{threshold}").agg(F.first("empirical").alias("main"))
    return _checks(seen.crossJoin(main).select(F.coalesce(F.abs(F.col("seen") - F.col("main")) < tolerance, F.lit(False)).alias("sensitivity_observes_the_main_result")))  # one row each


def _checks(one: DataFrame) -> DataFrame:
    return one.selectExpr(f"stack({len(one.columns)}, " + ", ".join(f"'{c}', {c}" for c in one.columns) + ") as (check_name, passed)")


def terminals(simulated: DataFrame) -> DataFrame:
    return simulated.groupBy("series_id", "sim").agg(F.max_by("price", "t").alias("terminal"), F.max("price").alias("greatest"), F.avg(F.when(L.distance_to_level(F.col("price")) <= L.MAIN_THRESHOLD, 1.0).otherwise(0.0)).alias("share"))


def terminal_prices(simulated: DataFrame, limit: float = 1000.0) -> DataFrame:
    q = F.percentile("terminal", F.array(*map(F.lit, (0.025, 0.25, 0.5, 0.75, 0.975))))
    one = terminals(simulated).agg(q.alias("q"), F.avg(F.when(F.col("greatest") > limit, 1.0).otherwise(0.0)).alias("over"))
    names = ("p2_5", "p25", "p50", "p75", "p97_5")
    return one.select(*[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(names)], F.round("over", 6).alias("share_over_limit"))


def terminal_corr(simulated: DataFrame) -> DataFrame:
    return terminals(simulated).agg(F.round(F.corr("share", F.ln("terminal")), 6).alias("correlation"))


def simulate(closes: DataFrame, n_sim: int = B.N_SIM, block: int = B.BLOCK, kind: str = "log", offset: Column | None = None, outcome: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    return B.paths(B.draws(B.series_arrays(closes, kind, outcome), n_sim, block, starts), kind, offset=offset)

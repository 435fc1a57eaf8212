"""The registered queries in SQL, built from common table expressions, for DuckDB over the same tables."""

from __future__ import annotations

# Nothing here comes from the engine: names and conditions are written out.
STATE_COLUMNS = ("nearest_level", "signed_distance", "distance_to_level", "near_2", "near_3", "near_5", "near_10", "side", "side_near_5")
COUNTED = (*STATE_COLUMNS, "log_return", "abs_log_return", "parkinson_variance", "parkinson_volatility", "log_volume", "normal_log_volume_20d_lagged", "abnormal_volume_20d")
DICTIONARY = """
('source_row_number', 'key', 'never'), ('trading_index', 'key', 'never'), ('trade_date', 'key', 'the date can''t be read'),
('open_price', 'price', 'blank or not a number'), ('high_price', 'price', 'blank or not a number'), ('low_price', 'price', 'blank or not a number'), ('close_price', 'price', 'blank or not a number'),
('volume_kg_raw', 'volume', 'blank or not a number'),
('nearest_level', 'level', 'the close is missing'), ('signed_distance', 'level', 'the close is missing'), ('distance_to_level', 'level', 'the close is missing'),
('near_2', 'state', 'the distance is missing'), ('near_3', 'state', 'the distance is missing'), ('near_5', 'state', 'the distance is missing'), ('near_10', 'state', 'the distance is missing'),
('side', 'state', 'the distance is missing'), ('side_near_5', 'state', 'never'),
('prev_close_price', 'return', 'first record'), ('log_return', 'return', 'first record, or a price that isn''t positive'), ('abs_log_return', 'return', 'first record, or a price that isn''t positive'),
('parkinson_valid_input', 'range', 'never'), ('parkinson_variance', 'range', 'high or low isn''t valid'), ('parkinson_volatility', 'range', 'high or low isn''t valid'),
('volume_valid_for_log', 'volume', 'never'), ('log_volume', 'volume', 'no trading'), ('volume_history_count_20d_lagged', 'volume', 'never'),
('normal_log_volume_20d_lagged', 'volume', 'fewer than 20 records with trading before'), ('abnormal_volume_20d', 'volume', 'the volume or its baseline is missing'),
('nearest_level_lag1', 'state of the record before', 'first record'), ('signed_distance_lag1', 'state of the record before', 'first record'), ('distance_to_level_lag1', 'state of the record before', 'first record'),
('near_2_lag1', 'state of the record before', 'first record'), ('near_3_lag1', 'state of the record before', 'first record'), ('near_5_lag1', 'state of the record before', 'first record'), ('near_10_lag1', 'state of the record before', 'first record'),
('side_lag1', 'state of the record before', 'first record'), ('side_near_5_lag1', 'state of the record before', 'first record'),
('variable_construction_flags', 'quality', 'never')"""
SAMPLED = (
    ("near_5_below", "near_5 = 1 AND side = 'below'"),
    ("near_5_above", "near_5 = 1 AND side = 'above'"),
    ("at_level", "side = 'at_level'"),
    ("not_near_5", "near_5 = 0"),
    ("near_midpoint", "distance_to_level >= 24.5 AND distance_to_level <= 25"),
    ("positive_abnormal_volume", "abnormal_volume_20d > 0"),
    ("negative_abnormal_volume", "abnormal_volume_20d < 0"),
    ("high_parkinson_volatility", "parkinson_volatility IS NOT NULL"),
    ("low_parkinson_volatility", "parkinson_volatility IS NOT NULL"),
)
#: Simulated paths.
SIMS = 2000
K = (2, 3, 5, 10)

WALK = """
hours AS (SELECT date_trunc('hour', ts) AS trade_time, avg(value) AS v, sqrt(count(*)) AS s FROM events GROUP BY 1),
moves AS (SELECT trade_time, (v - (SELECT avg(value) FROM events)) * s / CAST(4000 AS DOUBLE) AS r FROM hours),
walk AS (SELECT row_number() OVER (ORDER BY trade_time) - 1 AS t, trade_time, round(300 * exp(sum(r) OVER (ORDER BY trade_time ROWS UNBOUNDED PRECEDING)), 4) AS close_price FROM moves),
dist AS (SELECT *, abs(close_price - 50 * floor(close_price / 50 + CAST(0.5 AS DOUBLE))) AS distance, 50 * floor(close_price / 50 + CAST(0.5 AS DOUBLE)) AS level FROM walk)"""

BARS = """
priced AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS trade_date, floor(o_totalprice / 10) / 100 AS price FROM orders WHERE isodow(o_orderdate) < 6),
days AS (SELECT trade_date, arg_min(price, o_orderkey) AS open_price, max(price) AS high_price, min(price) AS low_price, arg_max(price, o_orderkey) AS close_price, CAST(count(*) AS DOUBLE) AS volume_kg_raw FROM priced GROUP BY 1),
bars AS (SELECT 'orders' AS series_id, trade_date, row_number() OVER (ORDER BY trade_date) + 1 AS source_row_number, open_price, high_price, low_price, close_price, volume_kg_raw FROM days)"""

DIRTY = BARS + """,
gappy AS (SELECT *, source_row_number AS n FROM bars WHERE NOT (source_row_number % 40 IN (7, 8) OR source_row_number BETWEEN 300 AND 316)),
raw AS (SELECT n AS source_row_number,
  CASE WHEN n % 97 = 5 THEN 'bad-date' WHEN n % 89 = 4 THEN '' WHEN n % 83 = 3 THEN strftime(trade_date - INTERVAL 1 DAY, '%Y-%m-%d') WHEN n % 101 = 50 THEN strftime(trade_date - INTERVAL 9 DAY, '%Y-%m-%d') ELSE strftime(trade_date, '%Y-%m-%d') END AS date,
  CASE WHEN n % 71 = 1 THEN '' WHEN n % 73 = 2 THEN 'n/a' WHEN n % 79 = 3 THEN '0' ELSE CAST(open_price AS VARCHAR) END AS open,
  CASE WHEN n % 107 = 1 THEN '' WHEN n % 109 = 2 THEN 'high' WHEN n % 113 = 3 THEN '-1' WHEN n % 67 = 5 THEN CAST(low_price AS VARCHAR) ELSE CAST(high_price AS VARCHAR) END AS high,
  CASE WHEN n % 127 = 1 THEN ' ' WHEN n % 131 = 2 THEN '--' WHEN n % 137 = 3 THEN '0' WHEN n % 67 = 5 THEN CAST(high_price AS VARCHAR) ELSE CAST(low_price AS VARCHAR) END AS low,
  CASE WHEN n % 59 = 7 THEN '-1.5' WHEN n % 139 = 1 THEN '' WHEN n % 149 = 2 THEN 'x' WHEN n % 53 = 11 THEN CAST(close_price * 4 AS VARCHAR) ELSE CAST(close_price AS VARCHAR) END AS close,
  CASE WHEN n % 47 = 1 THEN '0' WHEN n % 43 = 2 THEN '-5' WHEN n % 41 = 3 THEN '' WHEN n % 37 = 4 THEN 'abc' WHEN n % 31 = 5 THEN CAST(volume_kg_raw * 10 AS VARCHAR) ELSE CAST(volume_kg_raw AS VARCHAR) END AS volume_kg
  FROM gappy),
typed AS (SELECT *, CAST(try_strptime(trim(date), '%Y-%m-%d') AS DATE) AS parsed_date, try_cast(trim(open) AS DOUBLE) AS open_num, try_cast(trim(high) AS DOUBLE) AS high_num, try_cast(trim(low) AS DOUBLE) AS low_num, try_cast(trim(close) AS DOUBLE) AS close_num, try_cast(trim(volume_kg) AS DOUBLE) AS volume_kg_num FROM raw)"""

DIRTY_BARS = DIRTY + """,
tbars AS (SELECT 'orders' AS series_id, parsed_date AS trade_date, source_row_number, open_num AS open_price, high_num AS high_price, low_num AS low_price, close_num AS close_price, volume_kg_num AS volume_kg_raw FROM typed)"""


def variables(source: str) -> str:
    """CTEs ending in ``vars``, from a table of typed bars with series_id."""
    near = ", ".join(f"CASE WHEN distance_to_level IS NOT NULL THEN CAST(distance_to_level <= {k} AS INTEGER) END AS near_{k}" for k in K)
    lags = ", ".join(f"lag({c}) OVER w AS {c}_lag1" for c in STATE_COLUMNS)
    flags = [
        ("trade_date IS NULL", "date_parse_failed"),
        ("trade_date IS NOT NULL AND copies > 1", "duplicate_date"),
        ("close_price IS NULL", "close_missing_or_non_numeric"),
        *[(f"{c} <= 0", f"{c}_non_positive") for c in ("open_price", "high_price", "low_price", "close_price")],
        ("high_price < low_price", "high_below_low"),
        ("parkinson_valid_input = 0", "parkinson_input_invalid"),
        ("volume_kg_raw IS NULL", "volume_missing_or_non_numeric"),
        ("volume_kg_raw < 0", "volume_negative"),
        ("volume_kg_raw = 0", "volume_zero"),
        ("normal_log_volume_20d_lagged IS NULL AND log_volume IS NOT NULL", "insufficient_20d_lagged_volume_history"),
        ("abs_log_return > 0.2", "potential_price_break_or_data_gap"),
    ]
    joined = "concat_ws(';', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in flags) + ")"
    order = "PARTITION BY series_id ORDER BY trade_date NULLS LAST, source_row_number"
    return f"""
v1 AS (SELECT *, row_number() OVER w - 1 AS trading_index, 50 * floor(close_price / 50 + CAST(0.5 AS DOUBLE)) AS nearest_level, close_price - 50 * floor(close_price / 50 + CAST(0.5 AS DOUBLE)) AS signed_distance,
  lag(close_price) OVER w AS prev_close_price, count(*) OVER (PARTITION BY series_id, trade_date) AS copies,
  CAST(coalesce(high_price > 0 AND low_price > 0 AND high_price >= low_price, false) AS INTEGER) AS parkinson_valid_input,
  CAST(coalesce(volume_kg_raw > 0, false) AS INTEGER) AS volume_valid_for_log, CASE WHEN volume_kg_raw > 0 THEN ln(1 + volume_kg_raw) END AS log_volume
  FROM {source} WINDOW w AS ({order})),
v2 AS (SELECT *, abs(signed_distance) AS distance_to_level, CASE WHEN signed_distance < 0 THEN 'below' WHEN signed_distance > 0 THEN 'above' WHEN signed_distance = 0 THEN 'at_level' END AS side,
  CASE WHEN close_price > 0 AND prev_close_price > 0 THEN ln(close_price / prev_close_price) END AS log_return,
  CASE WHEN parkinson_valid_input = 1 THEN pow(ln(high_price / low_price), 2) / (4 * ln(2)) END AS parkinson_variance,
  CAST(count(log_volume) OVER b AS DOUBLE) AS volume_history_count_20d_lagged, CASE WHEN count(log_volume) OVER b = 20 THEN avg(log_volume) OVER b END AS normal_log_volume_20d_lagged
  FROM v1 WINDOW b AS ({order} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
v3 AS (SELECT *, abs(log_return) AS abs_log_return, sqrt(parkinson_variance) AS parkinson_volatility, log_volume - normal_log_volume_20d_lagged AS abnormal_volume_20d, {near} FROM v2),
v4 AS (SELECT *, CASE WHEN near_5 = 1 THEN side ELSE 'not_near' END AS side_near_5, {joined} AS variable_construction_flags FROM v3),
vars AS (SELECT *, {lags} FROM v4 WINDOW w AS ({order}))"""


CLEAN_VARS = "WITH " + BARS + "," + variables("bars")
DIRTY_VARS = "WITH " + DIRTY_BARS + "," + variables("tbars")


def _z(value: str, table: str = "m1") -> str:
    return f"""{value}_c AS (SELECT median({value}) AS c FROM {table} WHERE isfinite({value})), {value}_s AS (SELECT median(abs({value} - c)) AS s FROM {table}, {value}_c WHERE isfinite({value}))"""


MEASURES = "WITH " + DIRTY + """,
m0 AS (SELECT *, lag(parsed_date) OVER (ORDER BY source_row_number) AS previous_in_file, lag(parsed_date) OVER w AS previous_date, last_value(close_num IGNORE NULLS) OVER (ORDER BY parsed_date NULLS LAST, source_row_number ROWS UNBOUNDED PRECEDING) AS filled, lag(volume_kg_num) OVER w AS prior_volume, count(parsed_date) OVER (PARTITION BY parsed_date) AS copies,
  CASE WHEN high_num > 0 AND low_num > 0 AND close_num > 0 THEN (high_num - low_num) / close_num END AS intraday_range
  FROM typed WINDOW w AS (ORDER BY parsed_date NULLS LAST, source_row_number)),
mb AS (SELECT *, lag(filled) OVER (ORDER BY parsed_date NULLS LAST, source_row_number) AS before FROM m0),
m1 AS (SELECT *, CASE WHEN before <> 0 THEN filled / before - 1 END AS close_change, CASE WHEN prior_volume <> 0 THEN (volume_kg_num - prior_volume) / prior_volume END AS volume_change,
  CASE WHEN volume_kg_num > 0 AND prior_volume > 0 THEN ln(volume_kg_num) - ln(prior_volume) END AS log_volume_change,
  (5 * floor(date_diff('day', DATE '1970-01-05', parsed_date) / CAST(7 AS DOUBLE)) + least(((date_diff('day', DATE '1970-01-05', parsed_date) % 7) + 7) % 7, 5)) - (5 * floor(date_diff('day', DATE '1970-01-05', previous_date) / CAST(7 AS DOUBLE)) + least(((date_diff('day', DATE '1970-01-05', previous_date) % 7) + 7) % 7, 5)) - 1 AS weekdays_skipped FROM mb),
""" + ", ".join(_z(v) for v in ("close_change", "log_volume_change", "intraday_range")) + """,
measures AS (SELECT m1.*, """ + ", ".join(f"CASE WHEN (SELECT s FROM {v}_s) > 0 THEN CAST(0.6745 AS DOUBLE) * ({v} - (SELECT c FROM {v}_c)) / (SELECT s FROM {v}_s) END AS {v}_z" for v in ("close_change", "log_volume_change", "intraday_range")) + " FROM m1)"


def _rules() -> str:
    raw = ("date", "open", "high", "low", "close", "volume_kg")
    rules = [("date_not_sorted", "error", "parsed_date < previous_in_file"), ("duplicate_date", "error", "parsed_date IS NOT NULL AND copies > 1"), ("date_parse_failed", "error", "parsed_date IS NULL")]
    rules += [(f"missing_{c}", "error", f"trim({c}) = ''") for c in raw]
    for c in raw[1:5]:
        rules += [(f"non_numeric_{c}", "error", f"{c}_num IS NULL AND trim({c}) <> ''"), (f"non_positive_{c}", "error", f"{c}_num <= 0")]
    rules += [("non_numeric_volume_kg", "error", "volume_kg_num IS NULL AND trim(volume_kg) <> ''"), ("zero_volume_kg", "warning", "volume_kg_num = 0"), ("negative_volume_kg", "error", "volume_kg_num < 0")]
    rules += [(f"{c}_outside_low_high", "error", f"low_num IS NOT NULL AND high_num IS NOT NULL AND NOT ({c}_num BETWEEN low_num AND high_num)") for c in ("open", "close")]
    rules += [("weekday_gap", "warning", "weekdays_skipped >= 1"), ("large_unexplained_gap", "error", "weekdays_skipped > 10")]
    rules += [("large_close_change_warning", "warning", "abs(close_change) > 0.1 OR abs(close_change_z) > 8"), ("large_volume_change_warning", "warning", "abs(volume_change) > 5 OR abs(log_volume_change_z) > 8"), ("extreme_intraday_range", "warning", "abs(intraday_range) > 0.1 OR abs(intraday_range_z) > 8")]
    return " UNION ALL ".join(f"SELECT source_row_number, date AS date_raw, strftime(parsed_date, '%Y-%m-%d') AS parsed_date, '{r}' AS rule, '{s}' AS severity, close FROM measures WHERE {c}" for r, s, c in rules)


FOUND = MEASURES + ", found AS (" + _rules() + ")"

DECISIONS = """decisions AS (SELECT strftime(trade_date, '%Y-%m-%d') AS date, 'extreme_intraday_range' AS rule, ['exclude', 'keep', 'set_nan', 'not_applicable', 'exclude', 'maybe'][CAST(source_row_number // 50 % 6 + 1 AS INTEGER)] AS disposition FROM bars WHERE source_row_number % 50 = 0
  UNION ALL SELECT '1900-01-01', 'weekday_gap', 'exclude')"""

GAPS = "WITH " + DIRTY + """,
pairs AS (SELECT lag(parsed_date) OVER (ORDER BY source_row_number) AS previous_date, parsed_date FROM typed WHERE parsed_date IS NOT NULL),
counted AS (SELECT *, date_diff('day', previous_date, parsed_date) AS calendar_days, (SELECT count(*) FROM range(CAST(0 AS BIGINT), greatest(0, date_diff('day', previous_date, parsed_date))) AS r(i) WHERE isodow(previous_date + CAST(i AS INTEGER)) < 6)
   - (SELECT count(*) FROM range(CAST(0 AS BIGINT), greatest(0, date_diff('day', parsed_date, previous_date))) AS r(i) WHERE isodow(parsed_date + CAST(i AS INTEGER)) < 6) - 1 AS weekdays_skipped FROM pairs WHERE previous_date IS NOT NULL)"""

D = "abs({0} - 50 * floor({0} / 50 + CAST(0.5 AS DOUBLE)))"


def paths(block: int = 20, kind: str = "log", start: str = "s.start_price", closes: str = "walk", name: str = "paths", outcome: bool = False) -> str:
    """CTEs ending in ``paths(sim, t, price [, outcome])``, by an explicit index into the steps."""
    p = name
    step = "ln(close_price) - ln(lag(close_price) OVER (ORDER BY t))" if kind == "log" else "close_price - lag(close_price) OVER (ORDER BY t)"
    more, also = (", outcome", ", st.outcome") if outcome else ("", "")
    run = "sum(step) OVER (PARTITION BY d.sim ORDER BY d.t ROWS UNBOUNDED PRECEDING)"
    price = f"exp(ln({start}) + {run})" if kind == "log" else f"greatest({start} + {run}, 1)"
    return f"""
{p}_steps AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, step{more} FROM (SELECT t, {step} AS step{more} FROM {closes}) WHERE step IS NOT NULL),
{p}_n AS (SELECT count(*) AS n, least(count(*), {block}) AS l FROM {p}_steps),
{p}_start AS (SELECT arg_min(close_price, t) AS start_price FROM {closes}),
{p}_draws AS (SELECT sims.sim, k.t + 1 AS t, st.step{also} FROM range({SIMS}) AS sims(sim), {p}_n, range((SELECT n FROM {p}_n)) AS k(t)
  JOIN {p}_steps st ON st.i = ((sims.sim * 1103515245 + (k.t // {p}_n.l) * 12820163 + 12345) % 2147483647) % ({p}_n.n - {p}_n.l + 1) + k.t % {p}_n.l),
{p} AS (SELECT d.sim, d.t, {price} AS price{', d.outcome' if outcome else ''} FROM {p}_draws d, {p}_start s
  UNION ALL SELECT sims.sim, 0, {start.replace('d.sim', 'sims.sim')}{', NULL' if outcome else ''} FROM range({SIMS}) AS sims(sim), {p}_start s)"""


def null_stats(name: str = "paths") -> str:
    d = D.format("price")
    return f"""
per_sim AS (SELECT sim, avg(d) AS m, {", ".join(f"avg(CASE WHEN d <= {k} THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s{k}" for k in K)} FROM (SELECT sim, {d} AS d FROM {name}) GROUP BY sim),
null_stats AS (SELECT sim, 'mean_distance' AS statistic, m AS value FROM per_sim {" ".join(f"UNION ALL SELECT sim, 'prop_distance_le_{k}', s{k} FROM per_sim" for k in K)})"""


OBSERVED = f"""
observed AS (SELECT 'mean_distance' AS statistic, avg(distance) AS value FROM dist {" ".join(f"UNION ALL SELECT 'prop_distance_le_{k}', avg(CASE WHEN distance <= {k} THEN CAST(1 AS DOUBLE) ELSE 0 END) FROM dist" for k in K)})"""


def band(null: str, observed: str, key: str, name: str = "band") -> str:
    return f"""
{name}_raw AS (SELECT {key}, any_value(o.value) AS e, quantile_cont(n.value, 0.025) AS lo, quantile_cont(n.value, 0.5) AS mid, quantile_cont(n.value, 0.975) AS hi, avg(CASE WHEN n.value < o.value THEN CAST(1 AS DOUBLE) ELSE 0 END) AS below, count(CASE WHEN n.value >= o.value THEN 1 END) AS ge, count(CASE WHEN n.value <= o.value THEN 1 END) AS le, count(n.value) AS n_valid FROM {null} n JOIN {observed} o USING ({key}) GROUP BY {key}),
{name} AS (SELECT {key}, round(e, 6) AS empirical, round(mid, 6) AS null_median, round(lo, 6) AS null_p2_5, round(hi, 6) AS null_p97_5, round(below * 100, 4) AS empirical_percentile, round(least(CAST(1 AS DOUBLE), CAST(2 AS DOUBLE) * least(ge + 1, le + 1) / (n_valid + 1)), 6) AS two_sided_p, (e < lo OR e > hi) AS outside_band, n_valid FROM {name}_raw)"""


NULL_BAND = "WITH " + WALK + "," + paths() + "," + null_stats() + "," + OBSERVED + "," + band("null_stats", "observed", "statistic")


def effects(table: str, price: str, keys: str, outcome: str | None, name: str) -> str:
    """CTEs ending in ``name(keys, threshold, days_near, mean_near, mean_far, value)``."""
    part = f"PARTITION BY {keys} " if keys else ""
    before = f"lag({price}) OVER ({part}ORDER BY t)"
    value = outcome or f"abs(ln({price}) - ln({before}))"
    k = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}, threshold" if keys else " GROUP BY threshold"
    return f"""
{name}_p AS (SELECT {k}{D.format("b")} AS prior, x FROM (SELECT {k}{before} AS b, {value} AS x FROM {table}) WHERE b IS NOT NULL AND x IS NOT NULL),
{name} AS (SELECT {k}threshold, count(CASE WHEN prior <= threshold THEN 1 END) AS days_near, avg(CASE WHEN prior <= threshold THEN x END) AS mean_near, avg(CASE WHEN prior > threshold THEN x END) AS mean_far, avg(CASE WHEN prior <= threshold THEN x END) - avg(CASE WHEN prior > threshold THEN x END) AS value FROM {name}_p, (VALUES (2), (3), (5), (10)) AS th(threshold){group})"""


def _rounded(columns: dict[str, int | None]) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" if n else c for c, n in columns.items())


def _sens(variant: str, block: int = 20, **options) -> str:
    share = "avg(CASE WHEN {} <= 5 THEN CAST(1 AS DOUBLE) ELSE 0 END)"
    return (
        "SELECT variant, null_median, null_p2_5, null_p97_5, round(null_p97_5 - null_p2_5, 6) AS band_width, empirical_percentile FROM (WITH "
        + WALK + "," + paths(block, **options)
        + f", shares AS (SELECT '{variant}' AS variant, sim, {share.format(D.format('price'))} AS value FROM paths GROUP BY sim), seen AS (SELECT '{variant}' AS variant, {share.format('distance')} AS value FROM dist),"
        + band("shares", "seen", "variant") + " SELECT * FROM band)"
    )


def _robust_sample(name: str, dropped: str) -> str:
    return (
        "SELECT * FROM (WITH " + WALK
        + f""", ends AS (SELECT date_trunc('hour', ts) AS trade_time, avg(value) AS m, max(value) AS hi, min(value) AS lo FROM events GROUP BY 1),
ranged AS (SELECT t, close_price, ln((close_price * (1 + (hi - m) / 4000)) / (close_price * (1 - (m - lo) / 4000))) AS span FROM walk JOIN ends USING (trade_time)),
closes AS (SELECT row_number() OVER (ORDER BY t) - 1 AS t, close_price, sqrt(span * span / (4 * ln(2))) AS outcome FROM ranged WHERE NOT ({dropped})),"""
        + paths(closes="closes", outcome=True) + "," + effects("closes", "close_price", "", "outcome", "seen") + "," + effects("paths", "price", "sim", "outcome", "nulls") + "," + band("nulls", "seen", "threshold")
        + f" SELECT threshold, days_near, round(mean_near, 6) AS mean_near, round(mean_far, 6) AS mean_far, empirical, null_median, null_p2_5, null_p97_5, empirical_percentile, two_sided_p, outside_band, n_valid, '{name}' AS sample FROM seen JOIN band USING (threshold))"
    )


def _describe(table: str, x: str) -> str:
    items = (("count", f"CAST(count({x}) AS DOUBLE)"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"), ("min", f"min({x})"), ("25%", f"quantile_cont({x}, 0.25)"), ("50%", f"quantile_cont({x}, 0.5)"), ("75%", f"quantile_cont({x}, 0.75)"), ("max", f"max({x})"))
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, round({e}, 6) AS value FROM {table}" for m, e in items)


def _bins(closed: bool) -> str:
    b = "least(floor(distance), 24)" if closed else "CASE WHEN distance < 25 THEN floor(distance) END"
    return f"""WITH {WALK}, c AS (SELECT CAST({b} AS INTEGER) AS bin, count(*) AS k FROM dist GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, '[' || i || ',' || (i + 1) || ')' AS label, coalesce(k, 0) AS observations, round(coalesce(k, 0) / CAST((SELECT count(*) FROM dist) AS DOUBLE), 6) AS proportion FROM range(25) AS r(i) LEFT JOIN c ON c.bin = r.i"""


def _validations() -> str:
    nulls = " AND ".join(f"(near_{k} IS NULL) = (distance_to_level IS NULL)" for k in K)
    same = " AND ".join(f"a.{c}_lag1 IS NOT DISTINCT FROM b.{c}" for c in STATE_COLUMNS)
    checks = {
        "distance_to_level_between_0_and_25": "SELECT coalesce(bool_and(distance_to_level BETWEEN 0 AND 25.0000000001), true) FROM vars",
        "near_threshold_nesting": "SELECT bool_and(coalesce(near_2, 0) <= coalesce(near_3, 0) AND coalesce(near_3, 0) <= coalesce(near_5, 0) AND coalesce(near_5, 0) <= coalesce(near_10, 0)) FROM vars",
        "near_flags_missing_only_when_distance_missing": f"SELECT bool_and({nulls}) AND count(CASE WHEN near_5 = 0 THEN 1 END) > 0 FROM vars",
        "volume_20d_baseline_lagged_no_current_or_future": "SELECT coalesce(bool_and(k = 20 AND abs(base - e) <= 1e-12), true) FROM (SELECT a.trading_index, any_value(a.normal_log_volume_20d_lagged) AS base, count(b.log_volume) AS k, avg(b.log_volume) AS e FROM vars a JOIN vars b ON b.trading_index BETWEEN a.trading_index - 20 AND a.trading_index - 1 WHERE a.normal_log_volume_20d_lagged IS NOT NULL GROUP BY 1)",
        "lagged_state_variables_from_previous_row": f"SELECT bool_and({same}) FROM vars a LEFT JOIN vars b ON b.trading_index = a.trading_index - 1",
        "row_count_preserved": "SELECT (SELECT count(*) FROM vars) = (SELECT count(*) FROM raw)",
    }
    return DIRTY_VARS + " " + " UNION ALL ".join(f"SELECT '{k}' AS check_name, ({v}) AS passed" for k, v in checks.items())


def _sample() -> str:
    first = {7: "-parkinson_volatility", 8: "parkinson_volatility"}
    parts = [f"SELECT * FROM (SELECT {i} AS criterion, '{n}' AS sample_reason, *, row_number() OVER (ORDER BY {first.get(i, '0')}, trading_index) AS rn FROM vars WHERE {c})" for i, (n, c) in enumerate(SAMPLED)]
    return CLEAN_VARS + f" SELECT sample_reason, trade_date, round(close_price, 6) AS close_price, round(distance_to_level, 6) AS distance_to_level, side, round(parkinson_volatility, 6) AS parkinson_volatility FROM ({' UNION ALL '.join(parts)}) WHERE rn <= 2 ORDER BY criterion, trading_index LIMIT 18"


def _counts(columns) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS valid, count(*) - count({c}) AS missing FROM vars" for c in columns)


_RAW = ("date", "open", "high", "low", "close", "volume_kg")
_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(CASE WHEN trim({c}) = '' THEN 1 END) AS missing, " + (f"count(CASE WHEN {c}_num IS NULL THEN 1 END) - count(CASE WHEN trim({c}) = '' THEN 1 END) AS non_numeric, count(CASE WHEN {c}_num <= 0 THEN 1 END) AS non_positive" if c != "date" else "CAST(NULL AS BIGINT) AS non_numeric, CAST(NULL AS BIGINT) AS non_positive") + " FROM typed"
    for c in _RAW
)
_RANGES = "WITH " + DIRTY + ", ranged AS (SELECT *, (high_num - low_num) / close_num AS r FROM typed WHERE high_num > 0 AND low_num > 0 AND close_num > 0)"
_NEAR = {"days_near": None, "mean_near": 8, "mean_far": 8, "value": 8}
_SIM = "WITH " + WALK + "," + paths()

SQL = {
    "bars": "WITH " + BARS + " SELECT *, row_number() OVER (ORDER BY trade_date) - 1 AS trading_index FROM bars",
    "level_distance": CLEAN_VARS + " SELECT trade_date, " + _rounded(dict.fromkeys(("close_price", "nearest_level", "signed_distance", "distance_to_level"), 6)) + " FROM vars",
    "level_side": CLEAN_VARS + " SELECT trade_date, side, side_near_5 FROM vars",
    "near_flags": CLEAN_VARS + " SELECT trade_date, near_2, near_3, near_5, near_10 FROM vars",
    "log_returns": CLEAN_VARS + " SELECT trade_date, " + _rounded(dict.fromkeys(("prev_close_price", "log_return", "abs_log_return"), 6)) + " FROM vars",
    "parkinson": DIRTY_VARS + " SELECT source_row_number, parkinson_valid_input, " + _rounded(dict.fromkeys(("parkinson_variance", "parkinson_volatility"), 6)) + " FROM vars",
    "volume_baseline": DIRTY_VARS + " SELECT source_row_number, volume_valid_for_log, " + _rounded(dict.fromkeys(("log_volume", "volume_history_count_20d_lagged", "normal_log_volume_20d_lagged", "abnormal_volume_20d"), 6)) + " FROM vars",
    "lagged_states": DIRTY_VARS + " SELECT source_row_number, " + ", ".join(f"round({c}_lag1, 6) AS {c}_lag1" if c in STATE_COLUMNS[:3] else f"{c}_lag1" for c in STATE_COLUMNS) + " FROM vars",
    "training_sample": "WITH " + DIRTY_BARS + " SELECT trade_date, source_row_number, close_price FROM tbars WHERE trade_date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31' AND close_price > 0",
    "panel_variables": """WITH lines AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / 1000 AS price, l_orderkey, l_linenumber, l_quantity FROM lineitem),
ordered AS (SELECT *, row_number() OVER (PARTITION BY series_id, trade_date ORDER BY l_orderkey, l_linenumber, price) AS a, row_number() OVER (PARTITION BY series_id, trade_date ORDER BY l_orderkey DESC, l_linenumber DESC, price DESC) AS z FROM lines),
panel AS (SELECT series_id, trade_date, max(CASE WHEN a = 1 THEN price END) AS open_price, max(price) AS high_price, min(price) AS low_price, max(CASE WHEN z = 1 THEN price END) AS close_price, sum(l_quantity) AS volume_kg_raw FROM ordered GROUP BY 1, 2),
pbars AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY trade_date) + 1 AS source_row_number FROM panel),""" + variables("pbars") + """ SELECT series_id, count(*) AS days, round(avg(distance_to_level), 6) AS mean_distance, round(avg(abs_log_return), 6) AS mean_abs_return, round(avg(parkinson_volatility), 6) AS mean_parkinson, count(abnormal_volume_20d) AS baselines, CAST(sum(near_5_lag1) AS BIGINT) AS near_before FROM vars GROUP BY series_id""",
    "occupancy_stats": "WITH " + WALK + "," + OBSERVED + " SELECT statistic, round(value, 6) AS value FROM observed",
    "distance_description": "WITH " + WALK + " " + _describe("dist", "distance"),
    "distance_bins": _bins(False),
    "occupancy_bins": _bins(True),
    "threshold_summary": "WITH " + WALK + " SELECT threshold, count(CASE WHEN distance <= threshold THEN 1 END) AS observations, round(count(CASE WHEN distance <= threshold THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS actual_proportion, round(threshold / CAST(25 AS DOUBLE), 6) AS uniform_proportion, round(count(CASE WHEN distance <= threshold THEN 1 END) / CAST(count(*) AS DOUBLE) - threshold / CAST(25 AS DOUBLE), 6) AS difference FROM dist, (VALUES (2), (3), (5), (10)) AS th(threshold) GROUP BY threshold",
    "near_counts": DIRTY_VARS + " " + " UNION ALL ".join(f"SELECT {k} AS threshold, count(CASE WHEN near_{k} = 1 THEN 1 END) AS near_days, round(count(CASE WHEN near_{k} = 1 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS share_of_rows, round(count(CASE WHEN near_{k} = 1 THEN 1 END) / CAST(count(distance_to_level) AS DOUBLE), 6) AS share_of_distances FROM vars" for k in K),
    "side_counts": DIRTY_VARS + " SELECT side, count(*) AS days FROM vars WHERE near_5 = 1 GROUP BY side",
    "variable_counts": DIRTY_VARS + " " + _counts(COUNTED),
    "persistence": "WITH " + WALK + ", p AS (SELECT distance, lag(distance) OVER (ORDER BY t) AS b, level, lag(level) OVER (ORDER BY t) AS lb FROM dist) SELECT round(corr(distance, b), 6) AS lag1_autocorrelation, count(CASE WHEN level <> lb THEN 1 END) AS level_changes FROM p",
    "audit_parse": "WITH " + DIRTY + " SELECT source_row_number, parsed_date, open_num, high_num, low_num, close_num, volume_kg_num FROM typed",
    "audit_rules": FOUND + " SELECT * FROM found",
    "rule_counts": FOUND + " SELECT severity, rule, count(*) AS rows_flagged FROM found GROUP BY 1, 2",
    "audit_missing_counts": "WITH " + DIRTY + " " + _MISSING,
    "audit_summary": FOUND + """, copied AS (SELECT *, count(*) OVER (PARTITION BY parsed_date) AS cs, max(parsed_date) OVER (ORDER BY source_row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM typed),
base AS (SELECT count(*) AS row_count, strftime(min(parsed_date), '%Y-%m-%d') AS date_min, strftime(max(parsed_date), '%Y-%m-%d') AS date_max, count(CASE WHEN parsed_date IS NULL THEN 1 END) AS date_parse_failures, count(CASE WHEN cs > 1 THEN 1 END) AS duplicate_dates, bool_and(coalesce(parsed_date >= earlier, true)) AS is_sorted_by_date FROM copied)
SELECT base.*, (SELECT count(*) FROM found) AS anomaly_rows, (SELECT count(*) FROM found WHERE severity = 'error') AS error_rows, (SELECT count(*) FROM found WHERE severity = 'warning') AS warning_rows FROM base""",
    "robust_z": "WITH " + BARS + ", c AS (SELECT median(close_price) AS c FROM bars), s AS (SELECT median(abs(close_price - c)) AS s FROM bars, c) SELECT trade_date, CASE WHEN s > 0 THEN round(CAST(0.6745 AS DOUBLE) * (close_price - c) / s, 5) END AS z FROM bars, c, s",
    "close_jumps": MEASURES + " SELECT source_row_number, round(close_change, 5) AS close_change, round(close_change_z, 5) AS close_change_z FROM measures",
    "volume_jumps": MEASURES + " SELECT source_row_number, round(volume_change, 5) AS volume_change, round(log_volume_change_z, 5) AS log_volume_change_z FROM measures",
    "intraday_range": MEASURES + " SELECT source_row_number, round(intraday_range, 5) AS intraday_range, round(intraday_range_z, 5) AS intraday_range_z FROM measures",
    "weekday_gaps": GAPS + " SELECT previous_date, parsed_date, weekdays_skipped FROM counted WHERE weekdays_skipped >= 1",
    "duplicate_dates": "WITH " + DIRTY + " SELECT parsed_date, source_row_number, copies, close FROM (SELECT *, count(*) OVER (PARTITION BY parsed_date) AS copies FROM typed WHERE parsed_date IS NOT NULL) WHERE copies > 1",
    "duplicate_summary": "WITH " + DIRTY + ", c AS (SELECT parsed_date, count(*) AS k FROM typed WHERE parsed_date IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT (SELECT count(*) FROM typed WHERE parsed_date IS NULL) AS parse_failures, count(*) AS distinct_duplicated_dates, CAST(coalesce(sum(k), 0) AS BIGINT) AS rows_involved FROM c",
    "sort_violations": "WITH " + DIRTY + " SELECT source_row_number, parsed_date, previous_row_date FROM (SELECT *, lag(parsed_date) OVER (ORDER BY source_row_number) AS previous_row_date FROM typed) WHERE parsed_date < previous_row_date",
    "gap_distribution": GAPS + " SELECT calendar_days, count(*) AS pairs FROM counted GROUP BY 1",
    "gap_listing": GAPS + " SELECT previous_date, parsed_date, calendar_days, weekdays_skipped FROM counted WHERE calendar_days > 4",
    "gap_summary": GAPS + " SELECT count(CASE WHEN weekdays_skipped >= 1 THEN 1 END) AS weekday_gaps, CAST(coalesce(sum(CASE WHEN weekdays_skipped >= 1 THEN weekdays_skipped END), 0) AS BIGINT) AS weekdays_skipped, count(CASE WHEN weekdays_skipped > 10 THEN 1 END) AS gaps_over_10 FROM counted",
    "zero_volume_days": "WITH " + DIRTY + ", z AS (SELECT *, lag(close_num) OVER w AS prev_close, lead(close_num) OVER w AS next_close FROM typed WINDOW w AS (ORDER BY source_row_number)) SELECT source_row_number, volume_kg, close_num, prev_close, coalesce(close_num = prev_close, false) AS stale, CASE WHEN close_num > 0 AND prev_close > 0 THEN round(ln(close_num / prev_close), 6) END AS log_return_day, CASE WHEN close_num > 0 AND next_close > 0 THEN round(ln(next_close / close_num), 6) END AS log_return_next_day FROM z WHERE volume_kg_num IS NULL OR volume_kg_num = 0",
    "range_percentiles": _RANGES + " " + " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS quantile, round(quantile_cont(r, {q}), 6) AS value, (SELECT strftime(parsed_date, '%Y-%m-%d') FROM ranged ORDER BY r DESC, source_row_number LIMIT 1) AS day_of_greatest FROM ranged" for q in (0.9, 0.95, 0.99, 0.995, 0.999)),
    "range_description": _RANGES + " " + _describe("ranged", "r"),
    "pending_review": FOUND + ", " + DECISIONS + " SELECT DISTINCT parsed_date AS date, rule, '' AS disposition, '' AS reason, '' AS reviewer, '' AS decided_on FROM found WHERE parsed_date IS NOT NULL AND parsed_date NOT IN (SELECT date FROM decisions)",
    "decision_orphans": DIRTY_VARS + ", " + DECISIONS + " SELECT date, rule FROM decisions WHERE date NOT IN (SELECT strftime(trade_date, '%Y-%m-%d') FROM vars WHERE trade_date IS NOT NULL)",
    "decision_validation": "WITH " + BARS + ", " + DECISIONS + " SELECT disposition, count(*) AS decisions FROM decisions WHERE disposition NOT IN ('exclude', 'keep', 'set_nan', 'not_applicable') GROUP BY 1",
    "excluded_counts": DIRTY_VARS + ", " + DECISIONS + " SELECT CAST(d.date AS DATE) AS trade_date, (SELECT count(*) FROM vars WHERE trade_date = CAST(d.date AS DATE)) AS rows_removed FROM (SELECT DISTINCT date FROM decisions WHERE disposition = 'exclude') d",
    "analysis_dataset": DIRTY_VARS + ", " + DECISIONS + " SELECT trade_date, source_row_number, round(close_price, 6) AS close_price, round(distance_to_level, 6) AS distance_to_level, side_near_5, near_5_lag1, round(log_return, 6) AS log_return, array_to_string(list_filter(string_split(variable_construction_flags, ';'), lambda x: x <> '' AND NOT contains(x, 'volume')), ';') AS variable_construction_flags FROM vars WHERE trade_date IS NULL OR strftime(trade_date, '%Y-%m-%d') NOT IN (SELECT date FROM decisions WHERE disposition = 'exclude')",
    "strip_flag_tokens": DIRTY_VARS + " SELECT source_row_number, array_to_string(list_filter(string_split(variable_construction_flags, ';'), lambda x: x <> '' AND NOT contains(x, 'volume')), ';') AS flags FROM vars",
    "quality_flags": DIRTY_VARS + " SELECT source_row_number, variable_construction_flags FROM vars",
    "flag_counts": DIRTY_VARS + " SELECT flag, count(*) AS rows_flagged FROM (SELECT unnest(string_split(variable_construction_flags, ';')) AS flag FROM vars) WHERE flag <> '' GROUP BY 1",
    "gate_report": "WITH " + DIRTY + """, c AS (SELECT *, count(*) OVER (PARTITION BY parsed_date) AS k FROM typed), o AS (SELECT parsed_date, lag(parsed_date) OVER (ORDER BY source_row_number) AS b FROM typed WHERE parsed_date IS NOT NULL)
SELECT 'duplicate_dates' AS gate, count(*) AS violations FROM c WHERE parsed_date IS NOT NULL AND k > 1 UNION ALL SELECT 'dates_not_ascending', count(*) FROM o WHERE parsed_date < b UNION ALL SELECT 'ohlc_bracket', count(*) FROM typed WHERE open_num IS NOT NULL AND high_num IS NOT NULL AND low_num IS NOT NULL AND close_num IS NOT NULL AND NOT (open_num BETWEEN low_num AND high_num AND close_num BETWEEN low_num AND high_num AND high_num >= low_num)""",
    "validations": _validations(),
    "manual_sample": _sample(),
    "manual_judgment": DIRTY_VARS + " SELECT 'potential_price_break_or_data_gap' AS issue, count(*) AS rows_flagged, 'abs(log_return) > 0.2' AS rule FROM vars WHERE abs_log_return > 0.2 HAVING count(*) > 0",
    "variable_dictionary": f"SELECT * FROM (VALUES {DICTIONARY}) AS v(variable, kind, missing_when)",
    "gate_offenders": "WITH " + DIRTY + """, o AS (SELECT *, last_value(parsed_date IGNORE NULLS) OVER (ORDER BY source_row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM typed)
SELECT 'duplicate_dates' AS gate, strftime(parsed_date, '%Y-%m-%d') AS parsed_date, CAST(NULL AS BIGINT) AS source_row_number FROM typed WHERE parsed_date IS NOT NULL GROUP BY parsed_date HAVING count(*) > 1
UNION ALL SELECT * FROM (SELECT 'dates_not_ascending', strftime(parsed_date, '%Y-%m-%d'), source_row_number FROM o WHERE parsed_date < b ORDER BY source_row_number LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'ohlc_bracket', strftime(parsed_date, '%Y-%m-%d'), source_row_number FROM typed WHERE open_num IS NOT NULL AND close_num IS NOT NULL AND (open_num < low_num OR open_num > high_num OR close_num < low_num OR close_num > high_num OR high_num < low_num) AND high_num IS NOT NULL AND low_num IS NOT NULL ORDER BY source_row_number LIMIT 20)""",
    "formula_walkthrough": CLEAN_VARS + ", one AS (SELECT * FROM vars WHERE log_return IS NOT NULL AND parkinson_variance IS NOT NULL AND abnormal_volume_20d IS NOT NULL AND nearest_level IS NOT NULL ORDER BY series_id, trading_index LIMIT 1) "
    + " UNION ALL ".join(f"SELECT trade_date, {i} AS place, '{v}' AS variable, '{f}' AS formula, round({v}, 6) AS value FROM one" for i, (v, f) in enumerate((("nearest_level", "step * floor(close / step + 0.5)"), ("signed_distance", "close - nearest_level"), ("distance_to_level", "abs(signed_distance)"), ("log_return", "ln(close / close before)"), ("parkinson_variance", "ln(high / low)^2 / (4 ln 2)"), ("log_volume", "ln(1 + volume)"), ("normal_log_volume_20d_lagged", "mean of log_volume over the 20 records before"), ("abnormal_volume_20d", "log_volume - normal_log_volume_20d_lagged")), 1)),
    "stage_checks": NULL_BAND + f""", aligned AS (SELECT t, lag(distance) OVER (ORDER BY t) AS prior, {D.format("lag(close_price) OVER (ORDER BY t)")} AS again, abs(ln(close_price) - ln(lag(close_price) OVER (ORDER BY t))) AS outcome FROM dist)
SELECT 'priors_match_outcomes' AS check_name, count(prior) = count(outcome) AS passed FROM aligned WHERE t > 0
UNION ALL SELECT 'first_prior_is_the_first_distance', (SELECT prior FROM aligned WHERE t = 1) = (SELECT distance FROM dist WHERE t = 0)
UNION ALL SELECT 'every_prior_is_yesterday_s', bool_and(abs(prior - again) <= 1e-8) FROM aligned WHERE t > 0
UNION ALL SELECT 'sensitivity_observes_the_main_result', abs((SELECT avg(CASE WHEN distance <= 5 THEN CAST(1 AS DOUBLE) ELSE 0 END) FROM dist) - (SELECT empirical FROM band WHERE statistic = 'prop_distance_le_5')) < 1e-6""",
    "bootstrap_draws": _SIM + " SELECT sim, t, round(step, 6) AS step FROM paths_draws",
    "bootstrap_paths": _SIM + " SELECT sim, t, round(price, 4) AS price FROM paths",
    "occupancy_null": _SIM + "," + null_stats() + " SELECT sim, statistic, round(value, 6) AS value FROM null_stats",
    "null_band": NULL_BAND + " SELECT *, CASE WHEN outside_band THEN 'outside the null band' ELSE 'inside the null band' END AS verdict FROM band",
    "bin_band": _SIM + f""", binned AS (SELECT sim, CAST(least(floor({D.format('price')}), 24) AS INTEGER) AS bin FROM paths), sizes AS (SELECT sim, count(*) AS n FROM binned GROUP BY 1), counts AS (SELECT sim, bin, count(*) AS k FROM binned GROUP BY 1, 2),
grid AS (SELECT s.sim, CAST(i AS INTEGER) AS bin, coalesce(k, 0) / CAST(n AS DOUBLE) AS value FROM sizes s CROSS JOIN range(25) AS r(i) LEFT JOIN counts c ON c.sim = s.sim AND c.bin = r.i),
seen AS (SELECT CAST(i AS INTEGER) AS bin, (SELECT count(*) FROM dist WHERE least(floor(distance), 24) = i) / CAST((SELECT count(*) FROM dist) AS DOUBLE) AS value FROM range(25) AS r(i)),""" + band("grid", "seen", "bin") + " SELECT bin, '[' || bin || ',' || (bin + 1) || ')' AS label, empirical, null_median, null_p2_5, null_p97_5, empirical < null_p2_5 AS below_band, empirical > null_p97_5 AS above_band FROM band",
    "near_far_effect": "WITH " + WALK + "," + effects("walk", "close_price", "", None, "seen") + " SELECT threshold, " + _rounded(_NEAR) + " FROM seen",
    "near_far_null": _SIM + "," + effects("paths", "price", "sim", None, "nulls") + " SELECT sim, threshold, round(value, 8) AS value FROM nulls",
    "near_far_band": _SIM + "," + effects("walk", "close_price", "", None, "seen") + "," + effects("paths", "price", "sim", None, "nulls") + "," + band("nulls", "seen", "threshold") + " SELECT threshold, days_near, round(mean_near, 6) AS mean_near, round(mean_far, 6) AS mean_far, empirical, null_median, null_p2_5, null_p97_5, empirical_percentile, two_sided_p, outside_band, n_valid FROM seen JOIN band USING (threshold)",
    "power_analysis": NULL_BAND + ", se AS (SELECT *, (null_p97_5 - null_p2_5) / CAST(3.92 AS DOUBLE) AS s FROM band) SELECT statistic, round(s, 6) AS standard_error, round((empirical - null_median) / s, 4) AS z, round(CAST(2.8 AS DOUBLE) * s, 6) AS least_effect, round(CAST(2.8 AS DOUBLE) * s / null_median * 100, 4) AS least_effect_percent, round(null_median - CAST(2.8 AS DOUBLE) * s, 6) AS detection_floor FROM se",
    "centre_table": NULL_BAND + """, m AS (SELECT *, (SELECT count(*) FROM dist) AS n, sqrt(CAST(625 AS DOUBLE) / 12 / (SELECT count(*) FROM dist)) AS iid, (null_p97_5 - null_p2_5) / CAST(3.92 AS DOUBLE) AS s FROM band WHERE statistic = 'mean_distance')
SELECT 'uniform iid benchmark' AS reference, round(CAST(12.5 AS DOUBLE), 4) AS centre, round(12.5 - CAST(1.96 AS DOUBLE) * iid, 4) AS lower_95, round(12.5 + CAST(1.96 AS DOUBLE) * iid, 4) AS upper_95, round(empirical - 12.5, 4) AS difference, round((empirical - 12.5) / iid, 4) AS z FROM m
UNION ALL SELECT 'bootstrap null', round(null_median, 4), round(null_p2_5, 4), round(null_p97_5, 4), round(empirical - null_median, 4), round((empirical - null_median) / s, 4) FROM m""",
    "parkinson_robustness": _robust_sample("as_is", "(t + 2) % 40 = 7 OR (t + 2) % 90 = 65") + " UNION ALL " + _robust_sample("extreme_dates_reinstated", "(t + 2) % 90 = 65 AND (t + 2) % 40 <> 7"),
    "sens_block_length": " UNION ALL ".join(_sens(f"block {b}", b) for b in (5, 20, 50, 100)),
    "sens_additive": _sens("additive", kind="absolute"),
    "sens_jitter": _sens("jittered start", start="(s.start_price + ((d.sim * 7919 + 12345) % 10007) / CAST(10007 AS DOUBLE) * 50)"),
    "terminal_prices": _SIM + ", e AS (SELECT sim, arg_max(price, t) AS f, max(price) AS g FROM paths GROUP BY sim) SELECT " + ", ".join(f"round(quantile_cont(f, {q}), 4) AS {n}" for q, n in ((0.025, "p2_5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.975, "p97_5"))) + ", round(avg(CASE WHEN g > 300 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share_over_limit FROM e",
    "terminal_corr": _SIM + f", e AS (SELECT sim, arg_max(price, t) AS f, avg(CASE WHEN {D.format('price')} <= 5 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s FROM paths GROUP BY sim) SELECT round(corr(s, ln(f)), 6) AS correlation FROM e",
}

"""SQL for the queries over files: what the files hold, built from the tables alone."""

from __future__ import annotations

from .oracle import BARS, DECISIONS, DIRTY, SQL

_NATIONS = """WITH n AS (SELECT n_nationkey, n_name, n_name || ', "' || n_regionkey || '"' AS quoted, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey END AS region, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation)"""
_CSV = _NATIONS + """, rows AS (SELECT 1 AS line, chr(65279) || 'n_nationkey,n_name,quoted,region' AS text
  UNION ALL SELECT place + 1, n_nationkey || ',' || n_name || ',"' || replace(quoted, '"', '""') || '",' || coalesce(CAST(region AS VARCHAR), '') FROM n)"""
_SUMMARY = ("row_count", "date_min", "date_max", "date_parse_failures", "duplicate_dates", "is_sorted_by_date", "anomaly_rows", "error_rows", "warning_rows")
#: The plot of a chart in pixels: left edge, width, lower edge and height.
_LEFT, _WIDTH, _LOW, _HIGH = 64, 686, 382, 342


def _double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


FILE_SQL = {
    "csv_raw_scan": "WITH " + DIRTY + " SELECT row_number() OVER (ORDER BY source_row_number) + 1 AS source_row_number, date, open, high, low, close, volume_kg FROM raw",
    "csv_typed_scan": "WITH " + DIRTY + " SELECT strftime(parsed_date, '%Y-%m') AS month, count(*) AS rows, count(parsed_date) AS date, count(open_num) AS open, count(high_num) AS high, count(low_num) AS low, count(close_num) AS close, count(volume_kg_num) AS volume_kg, round(sum(close_num), 4) AS closes FROM typed GROUP BY 1",
    "csv_decisions": "WITH " + BARS + ", " + DECISIONS + " SELECT date, rule, disposition, 'planted' AS reason, 'reviewer' AS reviewer, '2026-01-01' AS decided_on FROM decisions",
    "source_report": "SELECT * FROM (VALUES ('source', 'second'), ('notes', '1'), ('extra', 'note'), ('missing', 'volume_kg'), ('required', 'ValueError'), ('no source', 'FileNotFoundError')) AS v(kind, value)",
    "result_lookup": f"SELECT k AS threshold, actual_proportion FROM (VALUES (2), (5), (7)) AS v(k) LEFT JOIN ({SQL['threshold_summary']}) ON threshold = k",
    "file_manifest": _CSV + ", file AS (SELECT string_agg(text, chr(10) ORDER BY line) || chr(10) AS c FROM rows) SELECT true AS relative, sha256(c) AS sha256, CAST(strlen(c) AS BIGINT) AS bytes, (SELECT count(*) FROM n) AS n_rows, true AS agrees, true AS other_differs, 1 AS notes_without_manifest FROM file",
    "report_csv": _CSV + " SELECT CAST(line AS INTEGER) AS line, text FROM rows",
    "report_markdown": _NATIONS
    + """, t AS (SELECT place, '| ' || n_nationkey || ' | ' || replace(concat_ws('|', n_name, region), '|', '\\|') || ' | ' || coalesce(format('{:.6g}', CAST(region AS DOUBLE) / 7 * pow(CAST(10 AS DOUBLE), n_nationkey % 4)), '') || ' |' AS text FROM n),
parts AS (SELECT 1 AS part, place, text FROM t
  UNION ALL SELECT 0, i, ['# Nations', '', '## Rows', '', '| n_nationkey | name | share |', '| --- | --- | --- |'][i] FROM range(1, 7) AS r(i)
  UNION ALL SELECT 2, i, ['', '## Notes', '', 'One row for each nation.', ''][i] FROM range(1, 6) AS r(i))
SELECT CAST(row_number() OVER (ORDER BY part, place) AS INTEGER) AS line, text FROM parts""",
    "report_summary": f"WITH s AS MATERIALIZED ({SQL['audit_summary']}) " + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM s" for c in _SUMMARY),
    "report_narrative": f"""SELECT threshold, CASE WHEN empirical IS NULL THEN 'No day lies on both sides of the threshold ' || threshold || ': there is no comparison.' ELSE
  'After ' || days_near || ' days within ' || threshold || ' of a level, the outcome is ' || CASE WHEN empirical > 0 THEN 'higher' WHEN empirical < 0 THEN 'lower' ELSE 'the same' END || ', ' || CASE WHEN outside_band THEN 'more than the null allows' ELSE 'which the null allows' END || ': '
  || empirical || ' against a null median of ' || null_median || ' (95 % band ' || null_p2_5 || ' to ' || null_p97_5 || '), p = ' || two_sided_p || '.' END AS text FROM ({SQL['near_far_band']})""",
    "chart_histogram": f"""WITH b AS ({SQL['occupancy_bins']}), s AS (SELECT bin, {_double('observations')} AS v, max(observations) OVER () * {_double('1.05')} AS most, {_double(_WIDTH)} / count(*) OVER () AS step FROM b),
p AS (SELECT bin, {_LEFT} + step * (bin + {_double('0.5')}) - step * {_double('0.45')} AS x, {_LOW} - {_HIGH} * v / most AS y, step * {_double('0.9')} AS width FROM s)
SELECT CAST(bin AS INTEGER) AS bin, """ + ", ".join(f"CAST(format('{{:.1f}}', {v}) AS DOUBLE) AS {c}" for c, v in (("x", "x"), ("y", "y"), ("width", "width"), ("height", f"{_LOW} - y"))) + " FROM p",
    "relative_paths": """WITH p AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS place, lower(n_name) || '.csv' AS name FROM nation)
SELECT '/data/' || CASE WHEN n_nationkey % 2 = 1 THEN 'repo' ELSE 'other' END || '/' || name AS path, CASE WHEN n_nationkey % 2 = 1 THEN name ELSE '/data/other/' || name END AS below FROM p""",
    "gate_errors": f"SELECT gate, violations, CAST(least(20, named) AS INTEGER) AS named FROM ({SQL['gate_report']}) JOIN (SELECT gate, count(*) AS named FROM ({SQL['gate_offenders']}) GROUP BY gate) USING (gate) WHERE violations > 0",
}

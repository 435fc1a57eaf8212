"""Queries over files that they write first: scans, lookups, digests, manifests, reports and charts."""

from __future__ import annotations

import contextlib
import io
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, dataset, distribution, inference, narrative
from ..sources import bars, charts, files

_TYPED = "date date, open double, high double, low double, close double, volume_kg double"


def _lines(spark: SparkSession, text: str) -> DataFrame:
    """Lines of a report, numbered from 1."""
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line int, text string")


def _raw_file(spark, d) -> str:
    """The dirty bars as one CSV file in file order."""
    path = files.scratch(spark, "raw")
    raw = bars.dirty_raw(spark, d).select("source_row_number", *bars.RAW_COLUMNS)
    files.write_csv(raw.repartition(1).sortWithinPartitions("source_row_number").drop("source_row_number"), path)
    return path


def _nations(spark, d) -> DataFrame:
    n = bars.read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    quoted = F.concat("n_name", F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"'))
    return n.select("n_nationkey", "n_name", quoted.alias("quoted"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")).alias("region")).orderBy("n_nationkey")


def _written(spark, d) -> str:
    path = files.scratch(spark, "nations") + ".csv"
    files.write_report_csv(_nations(spark, d), path)
    return path


def csv_raw_scan(spark, d):
    """Raw text with its line; blanks, quotes and faults as they were written."""
    return files.read_text_csv(spark, _raw_file(spark, d)).select("source_row_number", *bars.RAW_COLUMNS)


def csv_typed_scan(spark, d):
    """The same file with types; what doesn't fit is NULL."""
    typed = files.read_typed_csv(spark, _raw_file(spark, d), _TYPED)
    return typed.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in bars.RAW_COLUMNS], F.round(F.sum("close"), 4).alias("closes"))


def csv_decisions(spark, d):
    """Decisions through their file."""
    path = files.scratch(spark, "decisions")
    files.write_csv(bars.decisions(spark, d), path)
    return dataset.load_decisions(spark, path)


def source_report(spark, d):
    """Which of the candidate files is read, and what its columns lack or have besides."""
    first, second = (files.scratch(spark, n) for n in ("first", "second"))
    rows = bars.dirty_raw(spark, d).select("date", "open", "high", "low", "close", F.lit("x").alias("note")).limit(5)
    files.write_csv(rows, second)
    path, notes = files.resolve_source(spark, None, [first, second])
    df = spark.read.option("header", True).csv(path)
    report = files.column_report(df)
    out = [("source", "second" if path == second else "first"), ("notes", str(len(notes)))]
    out += [(kind, c) for kind, columns in sorted(report.items()) for c in columns]
    for kind, check in (("required", lambda: files.require(df, bars.RAW_COLUMNS)), ("no source", lambda: files.resolve_source(spark, first, [second]))):
        try:
            check()
        except (ValueError, FileNotFoundError) as e:
            out.append((kind, type(e).__name__))
    files.remove(spark, second)
    return spark.createDataFrame(out, "kind string, value string")


def result_lookup(spark, d):
    """Single results out of a written table, one of them absent."""
    path = files.scratch(spark, "thresholds")
    files.write_csv(distribution.threshold_summary(distribution.with_distance(bars.walk_bars(spark, d))), path)
    table = spark.read.option("header", True).csv(path)
    found = [(k, files.point_lookup(table, "threshold", str(k))) for k in (2, 5, 7)]
    files.remove(spark, path)
    return spark.createDataFrame([(k, float(r["actual_proportion"]) if r else None) for k, r in found], "threshold int, actual_proportion double")


def file_manifest(spark, d):
    """A file's manifest, written as JSON and read back, and the gate that compares the two."""
    path = _written(spark, d)
    folder, name = path.rsplit("/", 1)
    note, other = f"{path}.json", f"{path}.other"
    files.write_json(spark, note, files.manifest(spark, path, _nations(spark, d).count(), folder))
    held = files.read_json(spark, note)
    files.write_bytes(spark, other, b"something else")
    try:
        differs = bool(files.check_manifest(spark, other, note))
    except ValueError:
        differs = True
    row = (held["path"] == name, held["sha256"], held["bytes"], held["n_rows"], files.check_manifest(spark, path, note) == [], differs, len(files.check_manifest(spark, path, f"{path}.none")))
    for p in (path, note, other):
        files.remove(spark, p)
    return spark.createDataFrame([row], "relative boolean, sha256 string, bytes long, n_rows long, agrees boolean, other_differs boolean, notes_without_manifest int")


def report_csv(spark, d):
    """Lines of a report file, byte order mark included."""
    path = _written(spark, d)
    text = spark.read.format("binaryFile").load(path).first().content.decode()
    files.remove(spark, path)
    return _lines(spark, text.removesuffix("\n"))


def report_markdown(spark, d):
    """Lines of a Markdown report: floats of six digits, bars and line breaks escaped, NULL empty."""
    rows = _nations(spark, d).select("n_nationkey", F.concat_ws("|", "n_name", "region").alias("name"), (F.col("region") / 7 * F.pow(F.lit(10.0), F.col("n_nationkey") % 4)).alias("share"))
    return _lines(spark, files.report("Nations", {"Rows": rows, "Notes": "One row for each nation."}))


def report_summary(spark, d):
    """The audit's summary as it is printed, key by key."""
    raw = bars.dirty_raw(spark, d)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        files.print_summary(audit.summary(raw, audit.anomalies(raw)).first().asDict())
    return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in json.loads(text.getvalue()).items()], "name string, value string")


def report_narrative(spark, d):
    """The verdict on volatility after near days, in words, for every threshold."""
    walk = bars.walk_bars(spark, d)
    bands = inference.near_far_band(walk, inference.simulate(walk))
    bands = spark.createDataFrame(bands.collect(), bands.schema)  # one row a threshold
    out = [(k, narrative.proximity(bands, k)) for k in (2, 3, 5, 10)]
    return spark.createDataFrame(out, "threshold int, text string")


def chart_histogram(spark, d):
    """The bars of the chart of distances: place, top and height in pixels."""
    svg = charts.histogram(distribution.distance_bins(distribution.with_distance(bars.walk_bars(spark, d))).orderBy("bin"), "label", "observations", "Distances")
    drawn = re.findall(r'<rect x="([\d.]+)" y="([\d.]+)" width="([\d.]+)" height="([\d.]+)"', svg)
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(drawn)], "bin int, x double, y double, width double, height double")


def relative_paths(spark, d):
    """Paths of nations' files below a root, with slashes."""
    paths = [f"/data/{'repo' if r.n_nationkey % 2 else 'other'}/{r.n_name.lower()}.csv" for r in _nations(spark, d).toLocalIterator()]
    return spark.createDataFrame([(p, files.relative_path(p.replace("/", "\\") if i % 3 == 0 else p, "/data/repo/")) for i, p in enumerate(paths)], "path string, below string")


def gate_errors(spark, d):
    """What a run that the gates stop says: the gate and how many offenders it names."""
    try:
        audit.check_gates(bars.dirty_raw(spark, d))
        text = ""
    except ValueError as e:
        text = str(e)
    found = re.findall(r"(\w+): (\d+), at ([^;]+)", text)
    return spark.createDataFrame([(gate, int(n), len(named.split(", "))) for gate, n, named in found], "gate string, violations long, named int")


FILE_QUERIES = {f.__name__: f for f in (csv_raw_scan, csv_typed_scan, csv_decisions, source_report, result_lookup, file_manifest, report_csv, report_markdown, report_summary, report_narrative, chart_histogram, relative_paths, gate_errors)}

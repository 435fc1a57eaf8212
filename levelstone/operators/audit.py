"""Audit of raw daily bars: typing, 27 declarative rules, counts, summary and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.stats import robust_z
from ..sources.bars import RAW_COLUMNS
from .dataset import series_of

PRICES = ("open", "high", "low", "close")
CLOSE_JUMP, VOLUME_JUMP, ROBUST_Z, RANGE, HOLIDAY_WEEKDAYS = 0.10, 5.0, 8.0, 0.10, 10
QUEUE_COLUMNS = ("date", "rule", "disposition", "reason", "reviewer", "decided_on")


def parse(raw: DataFrame) -> DataFrame:
    """Raw text with parsed_date and a double for every number; what can't be read is NULL."""
    numbers = {f"{c}_num": L.parse_number(F.col(c)) for c in (*PRICES, "volume_kg")}
    return raw.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in RAW_COLUMNS}).withColumn("parsed_date", L.parse_date(F.col("date"))).withColumns(numbers)


def typed_bars(raw: DataFrame) -> DataFrame:
    """Bars as the variable builders take them."""
    p = parse(raw)
    return p.select("series_id", F.col("parsed_date").alias("trade_date"), "source_row_number", *[F.col(f"{c}_num").alias(f"{c}_price") for c in PRICES], F.col("volume_kg_num").alias("volume_kg_raw"))


def in_file_order():
    return Window.partitionBy("series_id").orderBy("source_row_number")


def in_date_order():
    return Window.partitionBy("series_id").orderBy(F.col("parsed_date").asc_nulls_last(), "source_row_number")


def measures(typed: DataFrame) -> DataFrame:
    """Changes, gaps and ranges that the rules look at, one row for each raw row."""
    w = in_date_order()
    df = typed.withColumn("previous_in_file", F.lag("parsed_date").over(in_file_order())).withColumn("previous_date", F.lag("parsed_date").over(w))
    df = df.withColumn("weekdays_skipped", L.weekdays_between(F.col("previous_date"), F.col("parsed_date")))
    # a missing close stands for the last one before it, and its successor's change spans the hole
    filled = F.last("close_num", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_filled", filled).withColumn("_before", F.lag("_filled").over(w))
    change = F.when(F.col("_before") != 0, F.col("_filled") / F.col("_before") - 1).when(F.col("_filled") > 0, F.lit(float("inf"))).when(F.col("_filled") < 0, F.lit(float("-inf")))
    df = df.withColumn("close_change", F.when(F.col("_before").isNotNull(), change))
    v = F.col("volume_kg_num")
    df = df.withColumn("_volume", F.lag("volume_kg_num").over(w)).withColumn("volume_change", F.when(F.col("_volume") != 0, (v - F.col("_volume")) / F.col("_volume")))
    df = df.withColumn("log_volume_change", F.when((v > 0) & (F.col("_volume") > 0), F.ln(v) - F.ln("_volume")))
    df = df.withColumn("intraday_range", L.intraday_range(F.col("high_num"), F.col("low_num"), F.col("close_num")))
    df = df.withColumn("copies", F.count("parsed_date").over(Window.partitionBy("series_id", "parsed_date"))).drop("_filled", "_before", "_volume")
    for value in ("close_change", "log_volume_change", "intraday_range"):
        df = robust_z(df, value, f"{value}_z")
    return df


def _beyond(value: str, threshold: float, z: str) -> Column:
    return F.coalesce(F.abs(F.col(value)) > threshold, F.lit(False)) | F.coalesce(F.abs(F.col(z)) > ROBUST_Z, F.lit(False))


def rules() -> list[tuple[str, str, Column]]:
    """(rule, severity, condition); a condition that is NULL doesn't fire."""
    c = F.col
    out = [
        ("date_not_sorted", "error", c("parsed_date") < c("previous_in_file")),
        ("duplicate_date", "error", c("parsed_date").isNotNull() & (c("copies") > 1)),
        ("date_parse_failed", "error", c("parsed_date").isNull()),
        *[(f"missing_{k}", "error", L.is_blank(c(k))) for k in RAW_COLUMNS],
    ]
    for k in PRICES:
        out += [(f"non_numeric_{k}", "error", c(f"{k}_num").isNull() & ~L.is_blank(c(k))), (f"non_positive_{k}", "error", c(f"{k}_num") <= 0)]
    v, complete = c("volume_kg_num"), c("low_num").isNotNull() & c("high_num").isNotNull()
    return [
        *out,
        ("non_numeric_volume_kg", "error", v.isNull() & ~L.is_blank(c("volume_kg"))),
        ("zero_volume_kg", "warning", v == 0),
        ("negative_volume_kg", "error", v < 0),
        *[(f"{k}_outside_low_high", "error", complete & ~c(f"{k}_num").between(c("low_num"), c("high_num"))) for k in ("open", "close")],
        ("weekday_gap", "warning", c("weekdays_skipped") >= 1),
        ("large_unexplained_gap", "error", c("weekdays_skipped") > HOLIDAY_WEEKDAYS),
        ("large_close_change_warning", "warning", _beyond("close_change", CLOSE_JUMP, "close_change_z")),
        ("large_volume_change_warning", "warning", _beyond("volume_change", VOLUME_JUMP, "log_volume_change_z")),
        ("extreme_intraday_range", "warning", _beyond("intraday_range", RANGE, "intraday_range_z")),
    ]


def message(rule: Column) -> Column:
    """A sentence for a fired rule, with the figure it is about."""
    c = F.col
    return (
        F.when(rule.isin("weekday_gap", "large_unexplained_gap"), F.format_string("%d weekdays without a record since the one before", c("weekdays_skipped")))
        .when(rule == "large_close_change_warning", F.format_string("close changed by %.2f %%", c("close_change") * 100))
        .when(rule == "large_volume_change_warning", F.format_string("volume changed by %.2f %%", c("volume_change") * 100))
        .when(rule == "extreme_intraday_range", F.format_string("(high - low) / close is %.2f %%", c("intraday_range") * 100))
        .otherwise(F.replace(rule, F.lit("_"), F.lit(" ")))
    )


def anomalies(raw: DataFrame) -> DataFrame:
    """One row for each raw row and rule that it breaks, with the raw text."""
    m = measures(parse(raw))
    fired = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, cond in rules()]))
    rows = m.withColumn("fired", F.explode(fired))
    return rows.select("series_id", "source_row_number", F.col("date").alias("date_raw"), F.date_format("parsed_date", "yyyy-MM-dd").alias("parsed_date"), "fired.rule", "fired.severity", message(F.col("fired.rule")).alias("message"), *RAW_COLUMNS[1:])


def rule_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "rule").agg(F.count("*").alias("rows_flagged"))


def missing_counts(raw: DataFrame) -> DataFrame:
    """By column: blank, non-numeric and non-positive values."""
    p = parse(raw)
    numeric = (*PRICES, "volume_kg")
    counts = [F.count_if(L.is_blank(F.col(c))).alias(f"b_{c}") for c in RAW_COLUMNS]
    counts += [(F.count_if(F.col(f"{c}_num").isNull()) - F.count_if(L.is_blank(F.col(c)))).alias(f"t_{c}") for c in numeric]
    counts += [F.count_if(F.col(f"{c}_num") <= 0).alias(f"p_{c}") for c in numeric]
    pairs = ", ".join(f"'{c}', b_{c}, " + (f"t_{c}, p_{c}" if c in numeric else "cast(null as bigint), cast(null as bigint)") for c in RAW_COLUMNS)
    return p.agg(*counts).selectExpr(f"stack({len(RAW_COLUMNS)}, {pairs}) as (column_name, missing, non_numeric, non_positive)")


def summary(raw: DataFrame, found: DataFrame) -> DataFrame:
    """One row: size, days, order and totals. Rows without a day count as copies of each other here."""
    p = parse(raw)
    copies = F.count(F.lit(1)).over(Window.partitionBy("series_id", "parsed_date"))
    before = F.max("parsed_date").over(in_file_order().rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("_copies", copies).withColumn("_sorted", F.coalesce(F.col("parsed_date") >= before, F.lit(True)))
    one = p.agg(F.count("*").alias("row_count"), F.date_format(F.min("parsed_date"), "yyyy-MM-dd").alias("date_min"), F.date_format(F.max("parsed_date"), "yyyy-MM-dd").alias("date_max"), F.count_if(F.col("parsed_date").isNull()).alias("date_parse_failures"), F.count_if(F.col("_copies") > 1).alias("duplicate_dates"), F.bool_and("_sorted").alias("is_sorted_by_date"))
    totals = found.agg(F.count("*").alias("anomaly_rows"), F.count_if(F.col("severity") == "error").alias("error_rows"), F.count_if(F.col("severity") == "warning").alias("warning_rows"))
    return one.crossJoin(totals)  # one row each


def pending_review(found: DataFrame, decided: DataFrame) -> DataFrame:
    """Flags of days without a decision, one row for each day and rule. A decision settles its whole day, of its series
    where decisions have a column series_id."""
    by = [*series_of(decided), "date"]
    days = decided.select(by).where("date is not null").distinct()
    flagged = found.where("parsed_date is not null").withColumn("date", F.col("parsed_date")).select(*by, "rule").distinct()
    return flagged.join(days, by, "left_anti").withColumns({c: F.lit("") for c in QUEUE_COLUMNS[2:]}).orderBy(*by, "rule")


def _bracketed() -> tuple[Column, Column]:
    """(all four prices are there, open and close lie between low and high)."""
    c = F.col
    whole = c("open_num").isNotNull() & c("high_num").isNotNull() & c("low_num").isNotNull() & c("close_num").isNotNull()
    return whole, c("open_num").between(c("low_num"), c("high_num")) & c("close_num").between(c("low_num"), c("high_num")) & (c("high_num") >= c("low_num"))


def gate_offenders(raw: DataFrame, most: int = 20) -> DataFrame:
    """(gate, series_id, parsed_date, source_row_number): every duplicated day, and the first ``most`` rows of a series that
    go back in time or break the bracket of their prices."""
    p = parse(raw).withColumn("_before", F.last("parsed_date", ignorenulls=True).over(in_file_order().rowsBetween(Window.unboundedPreceding, -1)))
    whole, bracket = _bracketed()
    days = p.where("parsed_date is not null").groupBy("series_id", "parsed_date").agg(F.count("*").alias("copies")).where("copies > 1")
    days = days.select(F.lit("duplicate_dates").alias("gate"), "series_id", "parsed_date", F.lit(None).cast("long").alias("source_row_number"))
    rows = p.select("series_id", "parsed_date", "source_row_number", F.explode(F.array_compact(F.array(F.when(F.col("parsed_date") < F.col("_before"), F.lit("dates_not_ascending")), F.when(whole & ~bracket, F.lit("ohlc_bracket"))))).alias("gate"))
    place = F.row_number().over(Window.partitionBy("gate", "series_id").orderBy("source_row_number"))
    first = rows.withColumn("_place", place).where(F.col("_place") <= most)
    return days.unionByName(first.select(days.columns)).withColumn("parsed_date", F.date_format("parsed_date", "yyyy-MM-dd"))


def gate_report(raw: DataFrame) -> DataFrame:
    """(gate, violations): what stops a run before any variable is made."""
    p = parse(raw).withColumn("_copies", F.count("parsed_date").over(Window.partitionBy("series_id", "parsed_date")))
    dated = p.where("parsed_date is not null").withColumn("_before", F.lag("parsed_date").over(in_file_order()))
    c = F.col
    whole, bracket = _bracketed()
    one = p.agg(F.count_if(c("parsed_date").isNotNull() & (c("_copies") > 1)).alias("a"), F.count_if(whole & ~bracket).alias("b"))
    one = one.crossJoin(dated.agg(F.count_if(c("parsed_date") < c("_before")).alias("d")))  # one row each
    return one.selectExpr("stack(3, 'duplicate_dates', a, 'dates_not_ascending', d, 'ohlc_bracket', b) as (gate, violations)")


def check_gates(raw: DataFrame) -> None:
    """ValueError that names every gate with violations, and the first 20 days or rows that break each."""
    broken = {r.gate: r.violations for r in gate_report(raw).where("violations > 0").collect()}  # three rows at most
    if broken:
        shown = {g: [] for g in broken}
        place = F.row_number().over(Window.partitionBy("gate").orderBy("series_id", "source_row_number", "parsed_date"))
        for r in gate_offenders(raw).withColumn("_place", place).where(F.col("_place") <= 20).orderBy("gate", "_place").collect():
            shown.setdefault(r.gate, []).append(f"{r.parsed_date}" + (f" (row {r.source_row_number})" if r.source_row_number is not None else ""))
        raise ValueError("input gates failed: " + "; ".join(f"{g}: {n}, at {', '.join(shown[g])}" for g, n in broken.items()))

"""The time-series operators on hand-computed bars."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelstone.functions import levels as L
from levelstone.functions.stats import robust_z
from levelstone.operators import audit, bootstrap, dataset, diagnostics, distribution, inference, variables
from levelstone.sources import files

RAW = "series_id string, source_row_number long, date string, open string, high string, low string, close string, volume_kg string"


def day(n):
    d = dt.date(2019, 1, 1)
    while n:
        d += dt.timedelta(days=1)
        n -= d.weekday() < 5
    return d


def raw_rows(n=30, **changes):
    """``n`` clean weekday rows; changes maps a row number to other columns."""
    rng, rows = random.Random(1), []
    for i in range(n):
        price, volume = 100 + rng.uniform(-0.5, 0.5), rng.randint(50, 80)
        r = {"date": day(i).isoformat(), "open": "100", "high": "101", "low": "99", "close": f"{price:.2f}", "volume_kg": str(volume)} | changes.get(f"r{i}", {})
        rows.append(("s", i + 2, *(r[c] for c in ("date", "open", "high", "low", "close", "volume_kg"))))
    return rows


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def closes(spark, prices, series="s"):
    return spark.createDataFrame([(series, i, float(p)) for i, p in enumerate(prices)], "series_id string, t long, close_price double")


@pytest.mark.parametrize("price,level,signed,side", [(125.0, 150.0, -25.0, "below"), (124.99, 100.0, 24.99, "above"), (150.0, 150.0, 0.0, "at_level"), (155.0, 150.0, 5.0, "above")])
def test_levels(spark, price, level, signed, side):
    p = F.lit(price)
    r = spark.range(1).select(L.round_half_up_to_step(p), L.signed_distance(p), L.distance_to_level(p), L.side(L.signed_distance(p))).first()
    assert r[0] == level and r[1] == pytest.approx(signed) and r[2] == pytest.approx(abs(signed)) and r[3] == side


def test_near_is_inclusive_and_tri_state(spark):
    rows = spark.createDataFrame([(155.0,), (155.01,), (None,)], "p double").select(L.near(L.distance_to_level(F.col("p")), 5).alias("n")).collect()
    assert [r.n for r in rows] == [1, 0, None]


def test_weekdays_match_numpy(spark):
    rng = random.Random(0)
    pairs = [(d := dt.date(2000, 1, 1) + dt.timedelta(days=rng.randint(0, 9000)), d + dt.timedelta(days=rng.randint(0, 60))) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a date, b date").select(L.weekdays_between(F.col("a"), F.col("b"))).collect()]
    assert got == [int(np.busday_count(a, b)) - 1 for a, b in pairs]


def test_numbers_and_dates(spark):
    texts = [" 12 ", "1e3", "+5", "inf", "nan", "", "1d", "abc", None, "-.5"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(L.parse_number(F.col("x"))).collect()]
    assert got == [12.0, 1000.0, 5.0, math.inf, None, None, None, None, None, -0.5]
    days = [r[0] for r in spark.createDataFrame([("2003-01-02",), ("02/01/2003",), ("bad",), ("",)], "x string").select(L.parse_date(F.col("x"))).collect()]
    assert days == [dt.date(2003, 1, 2), dt.date(2003, 1, 2), None, None]


def test_parkinson_and_volume(spark):
    rows = [(101.0, 99.0, 0.0), (100.0, 100.0, 5.0), (99.0, 101.0, -1.0), (None, 1.0, None)]
    got = spark.createDataFrame(rows, "h double, l double, v double").select(L.parkinson_variance(F.col("h"), F.col("l")), L.log_volume(F.col("v"))).collect()
    assert got[0][0] == pytest.approx(math.log(101 / 99) ** 2 / (4 * math.log(2))) and got[1][0] == 0 and got[2][0] is None and got[3][0] is None
    assert [got[0][1], got[2][1], got[3][1]] == [None] * 3 and got[1][1] == pytest.approx(math.log(6))


def test_robust_z_edges(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("a", math.inf), ("b", 1.0), ("b", 1.0), ("c", None)]
    got = {(r.series_id, r.v): r.z for r in robust_z(spark.createDataFrame(rows, "series_id string, v double"), "v", "z").collect()}
    assert got["a", 100.0] == pytest.approx(0.6745 * 97) and got["a", math.inf] == math.inf and got["b", 1.0] is None and got["c", None] is None


def test_every_rule_fires(spark):
    rows = raw_rows(
        80,
        r3={"date": "bad"}, r5={"date": day(4).isoformat()}, r7={"date": day(2).isoformat()}, r9={"open": "", "close": "x"}, r10={"open": "0", "high": "-1"}, r11={"high": "", "low": "a"}, r12={"low": " ", "high": "b"}, r13={"low": "-5", "close": "0"},
        r14={"close": ""}, r15={"volume_kg": ""}, r16={"volume_kg": "abc"}, r17={"volume_kg": "0"}, r18={"volume_kg": "-3"}, r20={"open": "200"}, r21={"close": "150"}, r22={"open": "x"}, r23={"volume_kg": "5000"}, r24={"high": "140"}, r25={"date": ""},
    )
    rows = [r for r in rows if not (40 <= r[1] <= 43 or 50 <= r[1] <= 64)]
    found = audit.anomalies(raw(spark, rows)).collect()
    assert {r.rule for r in found} == {name for name, _, _ in audit.rules()} and len(audit.rules()) == 27
    assert {r.source_row_number for r in found if r.rule == "duplicate_date"} >= {6, 7}
    assert [r.source_row_number for r in found if r.rule == "large_unexplained_gap"] == [65]
    assert [r.source_row_number for r in found if r.rule == "zero_volume_kg"] == [19]


def test_clean_bars_break_nothing(spark):
    found = audit.anomalies(raw(spark, raw_rows()))
    assert found.count() == 0 and audit.gate_report(raw(spark, raw_rows())).agg(F.sum("violations")).first()[0] == 0
    audit.check_gates(raw(spark, raw_rows()))
    with pytest.raises(ValueError, match="duplicate_dates"):
        audit.check_gates(raw(spark, raw_rows(r5={"date": day(4).isoformat()})))
    s = audit.summary(raw(spark, raw_rows()), found).first()
    assert s.row_count == 30 and s.is_sorted_by_date and s.date_min == "2019-01-01"


def test_queue_matches_by_day(spark):
    found = audit.anomalies(raw(spark, raw_rows(r6={"volume_kg": "0"}, r8={"volume_kg": "0"})))
    decided = spark.createDataFrame([(day(6).isoformat(), "other", "keep", "", "", ""), (None, "x", "keep", "", "", "")], ", ".join(f"{c} string" for c in audit.QUEUE_COLUMNS))
    queue = audit.pending_review(found, decided).collect()
    assert {r.date for r in queue} == {day(8).isoformat()} and all(r.disposition == "" for r in queue)


def test_baseline_looks_back_only(spark):
    before = {r.trading_index: r for r in variables.construct_variables(audit.typed_bars(raw(spark, raw_rows()))).collect()}
    after = {r.trading_index: r for r in variables.construct_variables(audit.typed_bars(raw(spark, raw_rows(r25={"volume_kg": "900", "close": "77"})))).collect()}
    assert before[19].normal_log_volume_20d_lagged is None and before[20].normal_log_volume_20d_lagged == pytest.approx(np.mean([math.log1p(float(r[7])) for r in raw_rows()[:20]]))
    for i in range(25):
        assert before[i] == after[i]
    assert after[25].normal_log_volume_20d_lagged == before[25].normal_log_volume_20d_lagged
    assert after[26].near_5_lag1 == after[25].near_5 and after[0].side_lag1 is None
    hole = {r.trading_index: r for r in variables.construct_variables(audit.typed_bars(raw(spark, raw_rows(r10={"volume_kg": ""})))).collect()}
    assert hole[25].normal_log_volume_20d_lagged is None and hole[25].volume_history_count_20d_lagged == 19
    assert "insufficient_20d_lagged_volume_history" in hole[25].variable_construction_flags


def test_validations_hold_and_notice(spark):
    source = raw(spark, raw_rows(r9={"close": "x"}))
    v = variables.construct_variables(audit.typed_bars(source))
    far = v.withColumn("near_5", F.when(F.col("trading_index") == 3, F.lit(0)).otherwise(F.col("near_5")))
    assert all(r.passed for r in variables.validations(far, source).collect() if r.check_name not in ("near_threshold_nesting", "lagged_state_variables_from_previous_row"))
    bad = v.withColumn("side_lag1", F.lit("above")).withColumn("normal_log_volume_20d_lagged", F.col("normal_log_volume_20d_lagged") + 1)
    failed = {r.check_name for r in variables.validations(bad, source).collect() if not r.passed}
    assert {"lagged_state_variables_from_previous_row", "volume_20d_baseline_lagged_no_current_or_future"} <= failed


def test_dataset(spark):
    v = variables.construct_variables(audit.typed_bars(raw(spark, raw_rows(r6={"volume_kg": "0"}, r7={"date": "bad"}))))
    cols = ", ".join(f"{c} string" for c in dataset.DECISION_COLUMNS)
    good = spark.createDataFrame([(day(3).isoformat(), "r", "exclude", "", "", ""), (day(4).isoformat(), "r", "set_nan", "", "", "")], cols)
    dataset.validate(good, v)
    out = dataset.analysis_dataset(v, good)
    assert out.count() == 29 and not [c for c in out.columns if "volume" in c.lower()]
    assert out.where("trade_date is null").count() == 1
    assert not [r for r in out.collect() if "volume" in r.variable_construction_flags]
    for bad in ([("1999-01-01", "r", "keep", "", "", "")], [(day(3).isoformat(), "r", "perhaps", "", "", "")]):
        with pytest.raises(ValueError):
            dataset.validate(spark.createDataFrame(bad, cols), v)


def test_last_bin_convention(spark):
    sample = distribution.with_distance(closes(spark, [125, 175, 100, 124.5]))
    closed = {r.bin: r.observations for r in distribution.distance_bins(sample).collect()}
    opened = {r.bin: r.observations for r in distribution.distance_bins(sample, open_last=True).collect()}
    assert (closed[24], opened[24], closed[0], len(closed)) == (3, 1, 1, 25)


def test_manual_sample_falls_back(spark):
    v = variables.construct_variables(audit.typed_bars(raw(spark, raw_rows(4))).withColumn("close_price", F.lit(None).cast("double")).withColumn("high_price", F.lit(None).cast("double")))
    assert {r.sample_reason for r in variables.manual_sample(v).collect()} == {"fallback_first_rows"}


def test_numpy_starts_and_paths(spark):
    starts = bootstrap.numpy_starts(spark, 3663, 3663, 2000, 20)
    first = starts.where("sim = 0").first().starts
    assert first[:5] == [2547, 828, 2873, 1154, 744] and len(first) == 184
    rng = np.random.default_rng(0)
    prices = 300 * np.exp(np.cumsum(rng.normal(0, 0.02, 101)))
    steps = np.diff(np.log(prices))
    s = bootstrap.numpy_starts(spark, 100, 100, 30, 20)
    index = {r.sim: r.starts for r in s.collect()}
    got = {}
    for r in inference.simulate(closes(spark, prices), 30, 20, starts=s).collect():
        got.setdefault(r.sim, {})[r.t] = r.price
    for sim, starts in index.items():
        drawn = np.concatenate([steps[a : a + 20] for a in starts])[:100]
        want = np.exp(np.log(prices[0]) + np.concatenate(([0], np.cumsum(drawn))))
        assert np.allclose([got[sim][t] for t in range(101)], want, rtol=1e-9)


def test_band_and_p_value(spark):
    null = spark.createDataFrame([("x", float(i)) for i in range(1, 2001)], "statistic string, value double")
    r = inference.band(null, spark.createDataFrame([("x", 0.0)], "statistic string, value double"), "statistic").first()
    assert r.two_sided_p == pytest.approx(2 / 2001, abs=1e-6) and r.outside_band and r.null_median == pytest.approx(1000.5)


def test_near_far_uses_yesterday(spark):
    prices = [150, 160, 152, 175, 150, 150]
    got = {r.threshold: r for r in inference.near_far_effect(closes(spark, prices)).collect()}
    change = [abs(math.log(b / a)) for a, b in zip(prices, prices[1:])]
    near = [c for p, c in zip(prices, change) if min(p % 50, 50 - p % 50) <= 5]
    far = [c for p, c in zip(prices, change) if min(p % 50, 50 - p % 50) > 5]
    assert got[5].days_near == 3 and got[5].value == pytest.approx(np.mean(near) - np.mean(far))
    empty = inference.near_far_effect(closes(spark, [150, 150, 150])).where("threshold = 5").first()
    assert empty.value is None and empty.days_near == 2


def test_additive_paths_have_a_floor(spark):
    p = inference.simulate(closes(spark, [10, 4, 2, 1.5]), 20, 2, kind="absolute")
    assert p.agg(F.min("price")).first()[0] == 1.0 and p.where("t = 0").agg(F.max("price")).first()[0] == 10.0


def test_persistence_and_gaps(spark):
    r = distribution.persistence(distribution.with_distance(closes(spark, [101, 102, 103, 160, 161]))).first()
    assert r.level_changes == 1
    found = diagnostics.gap_summary(raw(spark, [r for r in raw_rows(30) if r[1] not in (10, 11)])).first()
    assert (found.weekday_gaps, found.weekdays_skipped, found.gaps_over_10) == (1, 2, 0)
    assert diagnostics.gap_listing(raw(spark, raw_rows(30))).count() == 0
    stale = diagnostics.zero_volume_days(raw(spark, raw_rows(r4={"volume_kg": "0", "close": "100.0"}, r3={"close": "100.0"}))).first()
    assert stale.stale and stale.log_return_day == 0


def test_files(spark, tmp_path):
    path = f"{tmp_path}/raw.csv"
    body = "﻿date,open,high,low,close,volume_kg\n2020-01-02,1,2,1,2,\n2020-01-03,,2,1,2,5\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(body)
    df = files.read_text_csv(spark, path)
    rows = df.orderBy("source_row_number").collect()
    assert [(r.source_row_number, r.date, r.open, r.volume_kg) for r in rows] == [(2, "2020-01-02", "1", ""), (3, "2020-01-03", "", "5")]
    assert files.column_report(df.drop("open"))["missing"] == ["open"]
    with pytest.raises(ValueError):
        files.require(df, ["price"])
    assert files.resolve_source(spark, None, [f"{tmp_path}/none.csv", path]) == (path, [f"used {path} in place of {tmp_path}/none.csv"])
    with pytest.raises(FileNotFoundError):
        files.resolve_source(spark, f"{tmp_path}/none.csv", [])
    m = files.manifest(spark, path, 2)
    import hashlib

    assert m["sha256"] == hashlib.sha256(open(path, "rb").read()).hexdigest() and m["bytes"] == len(body.encode())
    files.write_json(spark, f"{tmp_path}/m.json", m | {"note": "é"})
    assert files.read_json(spark, f"{tmp_path}/m.json")["note"] == "é" and files.check_manifest(spark, path, f"{tmp_path}/m.json") == []
    assert files.check_manifest(spark, path, f"{tmp_path}/no.json")
    files.write_json(spark, f"{tmp_path}/m.json", m | {"sha256": "0"})
    with pytest.raises(ValueError):
        files.check_manifest(spark, path, f"{tmp_path}/m.json")
    small = spark.createDataFrame([("a|b", 1.5), (None, None)], "k string, v double")
    assert "a\\|b" in files.markdown(small) and files.report("T", {"S": small}).startswith("# T")
    files.write_report_csv(small, f"{tmp_path}/r.csv")
    assert open(f"{tmp_path}/r.csv", "rb").read().startswith(b"\xef\xbb\xbfk,v\n")
    assert files.point_lookup(small, "k", "a|b") == {"k": "a|b", "v": 1.5} and files.point_lookup(small, "k", "z") is None


def test_streams(spark, tmp_path):
    from levelstone.streaming import levels as S

    t0 = dt.datetime(2020, 1, 1)
    for n in range(2):
        spark.createDataFrame([("s", t0 + dt.timedelta(hours=2 * n + i), 100.0 + 10 * (2 * n + i)) for i in range(2)], "series_id string, trade_time timestamp, close_price double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("series_id string, trade_time timestamp, close_price double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, df, mode in (("lv", S.stream_levels(stream), "append"), ("oc", S.stream_occupancy(stream), "complete"), ("rt", S.stream_returns(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("lv").count() == 4 and spark.table("oc").first().records == 4
    got = [r.log_return for r in spark.table("rt").orderBy("trade_time").collect()]
    assert got[0] is None and got[1:] == pytest.approx([math.log(110 / 100), math.log(120 / 110), math.log(130 / 120)])


def test_empty_series(spark):
    none = raw(spark, [])
    assert audit.anomalies(none).count() == 0 and variables.construct_variables(audit.typed_bars(none)).count() == 0
    assert audit.rule_counts(audit.anomalies(none)).count() == 0 and diagnostics.gap_distribution(none).count() == 0
    assert inference.simulate(closes(spark, []), 3).count() == 0


def test_gates_name_their_offenders(spark):
    from levelstone.operators import audit

    rows = [("a", i, f"2020-01-{d:02d}", "10", "12", "9", c, "5") for i, (d, c) in enumerate([(1, "10"), (2, "10"), (2, "11"), (1, "10"), (5, "30")], 2)]
    rows += [("b", 2, "2020-01-01", "10", "12", "9", "11", "5")]
    raw = spark.createDataFrame(rows, "series_id string, source_row_number long, date string, open string, high string, low string, close string, volume_kg string")
    got = sorted(tuple(r) for r in audit.gate_offenders(raw).collect() if r.source_row_number is not None)
    assert got == [("dates_not_ascending", "a", "2020-01-01", 5), ("ohlc_bracket", "a", "2020-01-05", 6)]
    assert {(r.series_id, r.parsed_date) for r in audit.gate_offenders(raw).where("gate = 'duplicate_dates'").collect()} == {("a", "2020-01-01"), ("a", "2020-01-02")}
    with pytest.raises(ValueError, match=r"2020-01-05 \(row 6\)"):
        audit.check_gates(raw)
    audit.check_gates(raw.where("series_id = 'b'"))


def test_decisions_of_one_series_leave_others(spark):
    from levelstone.operators import audit, dataset

    days = spark.createDataFrame([(s, d) for s in "ab" for d in ("2020-01-01", "2020-01-02")], "series_id string, day string").selectExpr("series_id", "to_date(day) as trade_date", "'x' as variable_construction_flags")
    one = spark.createDataFrame([("a", "2020-01-01", "r", "exclude"), ("b", "2020-01-09", "r", "keep")], "series_id string, date string, rule string, disposition string")
    kept = dataset.analysis_dataset(days, one).collect()
    assert sorted((r.series_id, str(r.trade_date)) for r in kept) == [("a", "2020-01-02"), ("b", "2020-01-01"), ("b", "2020-01-02")]
    assert dataset.analysis_dataset(days, one.drop("series_id")).count() == 2
    assert [tuple(r) for r in dataset.orphans(one, days).collect()] == [("b", "2020-01-09", "r")]
    assert [(r.series_id, r.rows_removed) for r in dataset.excluded_counts(one, days).collect()] == [("a", 1)]
    found = spark.createDataFrame([("a", "2020-01-01", "x"), ("b", "2020-01-01", "x")], "series_id string, parsed_date string, rule string")
    assert [(r.series_id, r.date) for r in audit.pending_review(found, one).collect()] == [("b", "2020-01-01")]


def test_alignment_notices_today_s_distance(spark):
    from levelstone.operators import inference

    closes = [("s", i, p) for i, p in enumerate([101.0, 126.0, 148.0, 160.0])]
    good = spark.createDataFrame(closes, "series_id string, t long, close_price double").selectExpr("*", "abs(close_price - 50 * floor(close_price / 50 + 0.5)) as distance")
    assert all(r.passed for r in inference.alignment(good).collect())
    shifted = good.selectExpr("series_id", "t", "close_price", "lead(distance) over (order by t) as distance")
    assert not all(r.passed for r in inference.alignment(shifted).collect())
    bands = spark.createDataFrame([("prop_distance_le_5", 0.25)], "statistic string, empirical double")
    assert [r.passed for r in inference.sensitivity_agrees(good, bands).collect()] == [False]
    assert [r.passed for r in inference.sensitivity_agrees(good, bands.withColumn("empirical", bands.empirical * 2)).collect()] == [True]


def test_reports_charts_and_paths(spark, tmp_path, capsys):
    import hashlib
    import json
    from xml.dom import minidom

    from levelstone.operators import dataset, narrative
    from levelstone.sources import charts, files

    big = tmp_path / "big.bin"
    big.write_bytes(bytes(range(256)) * 20_000)
    assert files.digest(spark, str(big)) == {"sha256": hashlib.sha256(big.read_bytes()).hexdigest(), "bytes": 5_120_000}
    assert files.relative_path("/a/b/c.csv", "/a/") == "b/c.csv" and files.relative_path("/x/c.csv", "/a") == "/x/c.csv"
    assert files.manifest(spark, str(big), 3, root=str(tmp_path.parent))["path"] == f"{tmp_path.name}/big.bin"
    files.print_summary({"rows": 3})
    assert json.loads(capsys.readouterr().out) == {"rows": 3}
    with pytest.raises(FileNotFoundError):
        dataset.load_decisions(spark, str(tmp_path / "none.csv"))
    (tmp_path / "some.csv").write_text("date,rule\n2020-01-01,x\n")
    with pytest.raises(ValueError):
        dataset.load_decisions(spark, str(tmp_path / "some.csv"))
    (tmp_path / "typed.csv").write_text("d,x\n2020-01-01,1.5\nbad,y\n")
    typed = files.read_typed_csv(spark, str(tmp_path / "typed.csv"), "d date, x double").collect()
    assert [(str(r.d), r.x) for r in typed] == [("2020-01-01", 1.5), ("None", None)]

    kinds = "double empirical, double null_median, double null_p2_5, double null_p97_5, double two_sided_p, boolean outside_band"
    kinds = ", ".join(f"{c.split()[1]} {c.split()[0]}" for c in kinds.split(", "))
    bands = spark.createDataFrame([("mean_distance", 12.0, 12.4, 10.4, 14.4, 0.69, False), ("prop_distance_le_5", 0.1, 0.2, 0.12, 0.29, 0.01, True)], "statistic string, " + kinds)
    bins = spark.createDataFrame([(i, f"[{i},{i + 1})", 0.04, 0.04, 0.01 * i, 0.06, i > 4) for i in range(25)], "bin int, label string, empirical double, null_median double, null_p2_5 double, null_p97_5 double, below_band boolean")
    text = narrative.occupancy(bands, bins)
    assert "prop_distance_le_5" in text and "0 lie under" in text and "p = 0.69" in text
    assert "inside the null" in narrative.occupancy(bands.where("not outside_band"), bins)
    near = spark.createDataFrame([(5, 7, 0.1, 0.2, 0.05, 0.3, 0.4, False)], "threshold int, days_near long, " + kinds)
    assert "lower" not in narrative.proximity(near) and "which the null allows" in narrative.proximity(near)
    variants = spark.createDataFrame([("block 5", 50.0), ("additive", 99.0)], "variant string, empirical_percentile double")
    assert "1 of 2 variants: additive" in narrative.sensitivity(variants)
    for svg in (charts.histogram(bins, "label", "empirical", "Distance <bins>", mark=3.0), charts.null_band(bins, "Band"), charts.histogram(bins.where("false"), "label", "empirical", "none")):
        assert minidom.parseString(svg).documentElement.tagName == "svg"


def test_offsets_come_after_the_starts(spark):
    from levelstone.operators import bootstrap

    plain = np.random.default_rng(7)
    starts = plain.integers(0, 100 - 20 + 1, size=(4, 5))
    got = sorted(bootstrap.numpy_starts(spark, 100, 100, 4, 20, 7, width=50.0).collect())
    assert [r.starts for r in got] == starts.tolist() and np.allclose([r.offset for r in got], plain.uniform(0, 50, 4))
    closes = spark.createDataFrame([("s", i, 300.0 + i % 7) for i in range(101)], "series_id string, t long, close_price double")
    drawn = bootstrap.draws(bootstrap.series_arrays(closes), 4, 20, bootstrap.numpy_starts(spark, 100, 100, 4, 20, 7, width=50.0))
    first = {r.sim: r.price for r in bootstrap.paths(drawn).where("t = 0").collect()}
    assert first == pytest.approx({r.sim: 300.0 + r.offset for r in got})


def test_csv_keeps_blanks_quotes_and_lines(spark, tmp_path):
    rows = [(" a ", 'say "x", y', ""), ("", "|", None)] * 3
    df = spark.createDataFrame(rows, "a string, b string, c string").coalesce(1)
    path = str(tmp_path / "t")
    files.write_csv(df, path)
    got = files.read_text_csv(spark, path, ["a", "b", "c"]).orderBy("source_row_number").collect()
    assert [(r.a, r.b, r.c) for r in got] == [(a, b, c or "") for a, b, c in rows]
    assert [r.source_row_number for r in got] == [2, 3, 4, 5, 6, 7]


def test_lines_of_a_file_read_in_blocks(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("n\n" + "".join(f"{i}\n" for i in range(2, 5002)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = files.read_text_csv(spark, str(path), ["n"])
        assert df.where("source_row_number <> cast(n as int)").count() == 0 and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gates_name_offenders_of_every_gate(spark):
    days = [(f"2020-01-{1 + i % 28:02d}", "1", "2", "0.5", "1.5" if i < 120 else "9", "1") for i in range(130)]
    raw = spark.createDataFrame([("s", i + 2, *r) for i, r in enumerate(days)], "series_id string, source_row_number long, date string, open string, high string, low string, close string, volume_kg string")
    with pytest.raises(ValueError) as e:
        audit.check_gates(raw)
    parts = dict(p.split(": ", 1) for p in str(e.value).removeprefix("input gates failed: ").split("; "))
    assert set(parts) == {"duplicate_dates", "dates_not_ascending", "ohlc_bracket"}
    assert len(parts["duplicate_dates"].split(", ")) == 21 and len(parts["ohlc_bracket"].split(", ")) == 11

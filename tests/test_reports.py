"""Texts, state files, caches, nearest rows, long histories and nulls on small hand-made inputs."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillpanel.config import LIVE
from quillpanel.functions import labels
from quillpanel.functions import rolling as R
from quillpanel.operators import archive, events, exits, monitor, rendering, resample, screener, separation, signals
from quillpanel.sources import state, tables
from quillpanel.streaming import alerts as streams

MATCH = "ticker string, category string, exchange string, price double, price_change_pct double, volume_ratio double, recent_dollar_vol_musd double, ttm_cfo_musd double, market_cap_busd double, streak int, span int"


def matches(spark):
    return spark.createDataFrame([("AAA", "a & b", "X", 10.0, 8.04, 1.9, 1234.4, None, None, 1, 1), ("BB", "c", "Y", 20.5, -3.0, 2.5, 10.0, 5.0, 3.25, 9, 14)], MATCH)


def test_alert_texts(spark):
    lines = rendering.alert_lines(matches(spark))
    subject, text, html = rendering.alert(lines, "2026-11-20", LIVE)
    assert subject == "Screen 2026-11-20: 2 match(es)" and text.index("BB") < text.index("AAA")
    assert "+8.0%  1.90x  $1,234M  first qualifying day" in text and "9 qualifying days in 14" in text
    assert "n/a" in html and "a &amp; b" in html and "strong" not in html and rendering.TINTS["strong"][0] in html
    assert rendering.deliver((subject, text, html), lambda *parts: len(parts) == 3) and not rendering.deliver((subject, text))

    def broken(*parts):
        raise OSError("no server")

    assert not rendering.deliver((subject, text), broken)


def test_failure_and_weekly_texts():
    subject, text = rendering.failure(ValueError("no rows"), "2026-11-20 22:00", "Traceback\n  line")
    assert subject == "Screen failed: ValueError" and "ValueError: no rows" in text and text.endswith("  line\n")
    summary = {"anchor": date(2026, 11, 20), "actual_runs": 4, "expected_runs": 5, "error_runs": 1, "stale_runs": 0, "lag_days": 5, "health": "ERRORS"}
    subject, text = rendering.weekly(summary, [("A", 2), ("B", 4)], [], ["2026-11-19"], [{"ticker": "C", "volume_ratio": 1.4, "price_change_pct": None}])
    assert subject == "Screen ERRORS: 4/5 runs, 2 matched"
    assert text.index("  B ") < text.index("  A ") and "Days without a run: 2026-11-19" in text and "have the runs stopped?" in text and "price n/a" in text and "14 days: none" in text


def test_state_files_are_json_without_nan_and_capped(spark, tmp_path):
    path = str(tmp_path / "log.json")
    log = []
    for i in range(5):
        log = state.append_run(log, {"date": f"2026-11-{10 + i}", "status": "ok", "x": float("nan"), "near": [{"r": float("inf")}]}, path, cap=3)
    got = json.load(open(path))
    assert [r["date"][-2:] for r in got] == ["12", "13", "14"] and got[0]["x"] is None and got[0]["near"] == [{"r": None}]
    state.write_json({"b": 1, "a": {"d": 2, "c": 3}}, path)
    assert open(path).read().index('"a"') < open(path).read().index('"b"')
    assert tables.run_log_json(spark, str(tmp_path / "none.json")).count() == 0


def test_fundamentals_cache_is_read_upserted_and_written_back(spark, tmp_path):
    path = str(tmp_path / "cache.json")
    assert state.cache_json(spark, path).count() == 0
    old = spark.createDataFrame([("A", 1.0, None, datetime(2026, 11, 1)), ("B", 2.0, 5.0, datetime(2026, 11, 2))], "ticker string, cash double, cap_busd double, fetched_at timestamp")
    state.write_cache(old, path)
    read = state.cache_json(spark, path)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, old.collect()))
    new = spark.createDataFrame([("B", 9.0, None, datetime(2026, 11, 9)), ("C", 3.0, 1.0, datetime(2026, 11, 9))], old.schema)
    state.write_cache(screener.upsert(read, new), path)
    assert {r.ticker: r.cash for r in state.cache_json(spark, path).collect()} == {"A": 1.0, "B": 9.0, "C": 3.0}
    (tmp_path / "cache.json").write_text("{not json")
    assert state.cache_json(spark, path).count() == 0


def test_tables_are_made_once(spark, tmp_path):
    path, calls = str(tmp_path / "bars"), []

    def make():
        calls.append(1)
        return spark.range(3)

    assert state.made_once(spark, path, make).count() == state.made_once(spark, path, make).count() == 3 and len(calls) == 1


def test_wide_bars_become_long(spark):
    wide = spark.createDataFrame([(date(2024, 1, 1), 1.0, 10.0, 2.0), (date(2024, 1, 2), None, None, 3.0)], "Date date, `Close|A` double, `Volume|A` double, `Close|B'C` double")
    got = sorted(map(tuple, state.long_bars(wide, "Date").collect()))
    assert got == [(date(2024, 1, 1), "A", 1.0, 10.0), (date(2024, 1, 1), "B'C", 2.0, None), (date(2024, 1, 2), "B'C", 3.0, None)]


def test_nan_goes_at_any_depth(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(nan, [1.0, nan], {"a": nan}, ([(nan, "x")],), "s")], "x double, a array<double>, m map<string, double>, n struct<l: array<struct<v: double, t: string>>>, s string")
    got = state.cleansed(rows).first()
    assert got.x is None and got.a == [1.0, None] and got.m == {"a": None} and got.n.l[0].v is None and got.n.l[0].t == "x" and got.s == "s"


def test_nearest_row_prefers_the_later_of_two(spark):
    rows = spark.createDataFrame([("A", date(2024, 1, d), float(d)) for d in (2, 4, 10)], "ticker string, session date, close double")
    wanted = spark.createDataFrame([("A", date(2024, 1, d)) for d in (1, 3, 4, 6, 8, 30)] + [("B", date(2024, 1, 1))], "ticker string, wanted date")
    got = {r.wanted.day: r.session.day for r in signals.nearest(rows, wanted).collect()}
    assert got == {1: 2, 3: 4, 4: 4, 6: 4, 8: 10, 30: 10}


def test_exponential_means_of_long_histories_equal_the_recursion(spark):
    n, rows = 14, 12_000
    x = [float(i * 7919 % 101) for i in range(rows)]
    frame = spark.createDataFrame([("A", date(1990, 1, 1) + timedelta(days=i), i + 1, v if i else None) for i, v in enumerate(x)], "ticker string, session date, rn bigint, x double")
    first, mean = R.smooth(F.col("x"), 2, n, ("own", "carried"))
    frame = frame.withColumn("own", first["own"]).withColumn("carried", first["carried"])
    got = [r[0] for r in frame.withColumn("y", mean).orderBy("rn").select("y").collect()]
    y = x[1]
    assert got[0] is None and got[1] == y
    for i in range(2, rows):
        y += (x[i] - y) / n
        assert got[i] == pytest.approx(y, rel=1e-9)


def test_session_clock_and_empty_log(spark):
    rows = spark.createDataFrame([("2026-11-20",), ("yesterday",), (None,)], "bar string")
    clock = F.lit("2026-11-25").cast("date")
    assert [str(r[0]) for r in rows.select(monitor.session_date(F.col("bar"), clock)).collect()] == ["2026-11-20", "2026-11-25", "2026-11-25"]
    log = spark.createDataFrame([], "position bigint, date date, status string")
    row = monitor.weekly_summary(log, clock).first()
    assert str(row.anchor) == "2026-11-25" and row.lag_days == 0 and row.actual_runs == 0 and row.expected_runs == 5 and row.health == "GAPS"


def test_missing_sessions_and_gaps(spark):
    days = [date(2026, 11, d) for d in (16, 17, 19, 20)]
    log = spark.createDataFrame([(i, d, "ok") for i, d in enumerate(days)], "position bigint, date date, status string")
    assert [r.date.day for r in monitor.missing_sessions(log).collect()] == [18]
    assert monitor.weekly_summary(log, F.lit("2026-11-20").cast("date")).first().health == "GAPS"


def test_p_value_survivors_and_ranking(spark):
    null = spark.createDataFrame([(i, h) for i, h in enumerate([0, 1, 2, 5])], "rep int, hits bigint")
    passing = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "metric string, passes boolean")
    row = separation.against_null(null, passing).first()
    assert (row.observed, row.reps, row.null_mean, row.p_value) == (2, 4, 2.0, 0.5)
    later = spark.createDataFrame([("a", False), ("c", True)], "metric string, passes boolean")
    assert {r.metric: r.survived for r in separation.survivors(passing, later).collect()} == {"a": False, "b": False}
    scores = spark.createDataFrame([("a", False, 6, 0.9), ("b", True, 4, 0.1), ("c", True, 5, 0.1), ("d", True, 5, 0.2)], "metric string, passes boolean, n_meaningful int, worst_abs double")
    assert [r.metric for r in separation.ranked(scores).collect()] == ["d", "c", "b", "a"]


def test_slots_count_through_the_keys(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 5), ("b", 1), ("c", 9), ("a", 4)], "ticker string, rn int")
    got = sorted((r.slot, r.ticker, r.rn, r.n) for r in resample._slotted(rows, "ticker", ["rn"]).collect())
    assert got == [(0, "a", 4, 5), (1, "a", 5, 5), (2, "b", 1, 5), (3, "b", 2, 5), (4, "c", 9, 5)]


def test_best_rules_and_curves(spark):
    done = spark.createDataFrame([("x", 1, 2.0, 0.5, 3.0), ("y", 0, 1.0, 0.9, 4.0)], "rule string, rule_order int, excess_pct double, median_excess_pct double, mean_hold double")
    row = exits.best(done).first()
    assert (row.best_mean, row.best_median, row.disagree) == ("x", "y", True)
    curve = spark.createDataFrame([("up", d, v) for d, v in ((-1, 1.0), (0, 9.0), (1, None), (2, 5.0))], "kind string, day bigint, rel_volume double")
    assert events.drawn(curve, 3).first().curve == "13.2"
    assert events.aligned(curve).orderBy("day").first().asDict() == {"day": -1, "up": 1.0, "down": None, "random": None}


def test_formatted_values_and_regimes(spark):
    rows = spark.createDataFrame([(1.25,), (None,)], "x double")
    assert [r[0] for r in rows.select(labels.formatted(F.col("x"), "%.1f", prefix="$", suffix="M")).collect()] == ["$1.3M", "n/a"]
    scores = spark.createDataFrame([(8.0,), (2.0,), (0.0,), (-2.0,), (-8.0,), (None,)], "x double")
    assert [r[0] for r in scores.select(labels.regime_label(F.col("x"))).collect()] == ["strong risk-on", "risk-on", "mixed", "risk-off", "strong risk-off", "?"]


def test_archive_as_gzip_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(date(2024, 1, 1), "A", 1.0), (date(2024, 1, 2), "A", 2.0)], "as_of date, ticker string, x double")
    archive.write(rows, str(tmp_path / "csv"), "csv")
    assert len(list((tmp_path / "csv").glob("as_of=*/*.csv.gz"))) == 2
    archive.write(rows.where("as_of = '2024-01-02'").withColumn("x", F.lit(9.0)), str(tmp_path / "csv"), "csv")
    assert sorted(r.x for r in spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True).collect()) == [1.0, 9.0]
    archive.report(rows, str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("*.csv"))) == 1


def test_late_sessions_are_archived_once(spark, tmp_path):
    schema = "as_of date, ticker string, x double"
    source = str(tmp_path / "in")
    spark.createDataFrame([(date(2024, 1, 8), "A", 1.0), (date(2024, 1, 8), "A", 1.0), (date(2024, 1, 9), "B", 2.0)], schema).write.parquet(source)
    for _ in range(2):
        streams.archive_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.ticker, r.x) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("A", 1.0), ("B", 2.0)]
    spark.createDataFrame([(date(2024, 1, 7), "C", 3.0), (date(2023, 1, 1), "D", 4.0)], schema).write.mode("append").parquet(source)
    streams.archive_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r.ticker for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"A", "B", "C"}


def test_registered_exit_rules_are_used(spark):
    exits.register("fixed_1", lambda spec: F.lit(0).cast("bigint"))
    try:
        closes = [100.0] * 60 + [100.0 * 1.02**i for i in range(1, 21)] + [150.0] * 60
        rows = [("A", date(2024, 1, 1) + timedelta(days=i), c, c, c, 1e6 if i < 60 or i > 80 else 9e6) for i, c in enumerate(closes)]
        bars = spark.createDataFrame(rows, "ticker string, session date, close double, high double, low double, volume double")
        got = exits.trades(signals.measured(bars, LIVE), LIVE)
        assert {r.hold_days for r in got.where("rule = 'fixed_1'").collect()} == {1}
    finally:
        del exits.RULES["fixed_1"]

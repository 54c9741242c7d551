"""Alert state, run log, archive and streams."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from quillpanel.operators import alerts, archive, monitor
from quillpanel.sources import tables
from quillpanel.streaming.alerts import alert_stream

D = date(2026, 3, 2)


def days(*offsets):
    return [D + timedelta(days=i) for i in offsets]


def replay(sessions, cooldown=1, least=8):
    state, out = alerts.State(), []
    for d in sessions:
        state, row = alerts.step(state, d, least, cooldown)
        out.append(row)
    return state, out


def test_streaks_ignore_malformed_dates_and_count_the_span():
    texts = [d.isoformat() for d in days(0, -3, -14, -15)] + ["not-a-date", ""]
    assert alerts.streak(texts, D) == (3, 15)
    assert alerts.streak([], D) == (0, 0)
    assert alerts.prune([*texts, (D - timedelta(days=91)).isoformat()], D) == sorted(d.isoformat() for d in days(0, -3, -14, -15))


def test_same_session_is_sent_once_and_consecutive_sessions_twice():
    _, out = replay(days(0, 0, 1))
    assert [r["emailed"] for r in out] == [True, False, True]


def test_crossing_overrides_the_cooldown_once():
    _, out = replay(days(*range(10)), cooldown=100)
    assert [r["emailed"] for r in out] == [True] + [False] * 6 + [True, False, False]
    assert [r["crossed"] for r in out].index(True) == 7


def test_crossing_flag_clears_on_the_way_down_so_a_second_crossing_is_sent():
    _, out = replay(days(*range(9), *range(60, 69)), cooldown=1000)
    assert sum(r["crossed"] for r in out) == 2


def test_batch_fold_and_stream_agree(spark, tmp_path):
    rows = [(t, d) for t, offs in (("A", range(0, 30)), ("B", range(0, 60, 3)), ("C", (1, 5))) for d in days(*offs)]
    frame = spark.createDataFrame(rows, "ticker string, session date")
    batch = sorted(map(tuple, alerts.fold(frame).collect()))
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    query = alert_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("alerts").collect())) == batch
    counted = {(r.ticker, r.session): (r.streak, r.span) for r in alerts.streaks(frame).collect()}
    assert all(counted[r[0], r[1]] == (r[2], r[3]) for r in batch)


def log(spark, rows):
    return spark.createDataFrame([(i, d, s) for i, (d, s) in enumerate(rows)], "position bigint, date date, status string")


def test_stale_runs_compare_with_any_entry_before(spark):
    rows = [(days(0)[0], "ok"), (days(0)[0], "ok"), (days(2)[0], "error"), (days(1)[0], "ok"), (days(3)[0], "ok")]
    assert [r.status for r in monitor.stale(log(spark, rows)).orderBy("position").collect()] == ["ok", "stale", "error", "stale", "ok"]
    assert monitor.stale(log(spark, rows), cap=2).count() == 2


def test_actual_and_missing_runs_add_up_to_the_expected(spark):
    rows = log(spark, [(d, "ok") for d in days(0, 0, 1, 3, 4)])
    r = monitor.weekly_summary(rows, F.lit(D + timedelta(days=5)).cast("date")).first()
    missing = [x.date for x in monitor.missing_sessions(rows).collect()]
    assert r.actual_runs + len(missing) == r.expected_runs == 5 and days(2)[0] in missing and r.health == "GAPS"
    assert monitor.weekly_summary(rows, F.lit(D + timedelta(days=21)).cast("date")).first().health == "STALLED"


def test_archive_overwrites_only_its_sessions_and_prunes(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([(d, t, float(i)) for i, d in enumerate(days(0, 1, 2)) for t in "AB"], "as_of date, ticker string, close double")
    archive.write(rows, path)
    archive.write(rows.where(F.col("as_of") == days(1)[0]).withColumn("close", F.lit(9.0)), path)
    got = archive.scan(spark, path, days(1)[0].isoformat(), days(2)[0].isoformat())
    assert [(r.as_of, r.ticker, r.close) for r in got.collect()] == [(days(1)[0], "A", 9.0), (days(1)[0], "B", 9.0), (days(2)[0], "A", 2.0), (days(2)[0], "B", 2.0)]
    again = archive.increment(rows.withColumnRenamed("as_of", "session"), rows.where(F.col("as_of") < days(2)[0]).select("as_of", "ticker"))
    assert {r.as_of for r in again.collect()} == {days(2)[0]}


def test_state_files_that_are_missing_or_corrupt_are_empty(spark, tmp_path):
    assert tables.run_log_json(spark, str(tmp_path / "none.json")).count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert tables.run_log_json(spark, str(bad)).count() == 0 and tables.history_json(spark, str(bad)).count() == 0
    good = tmp_path / "log.json"
    good.write_text('[{"date": "2026-03-02", "status": "ok", "matches": ["A"]}, {"date": "2026-03-03", "status": "error"}]')
    assert [(r.position, r.date, r.matches) for r in tables.run_log_json(spark, str(good)).collect()] == [(0, "2026-03-02", ["A"]), (1, "2026-03-03", None)]
    history = tmp_path / "history.json"
    history.write_text('{"A": {"qualifying_dates": ["2026-03-02", "x"], "first_seen": "2026-03-02"}}')
    assert [(r.ticker, r.qualifying_dates) for r in tables.history_json(spark, str(history)).collect()] == [("A", ["2026-03-02", "x"])]

"""Window semantics, gates and buckets on small hand-made panels."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quillpanel.config import LIVE, SignalSpec, env_flag
from quillpanel.functions import labels
from quillpanel.functions import rolling as R
from quillpanel.operators import screener, signals
from quillpanel.sources import tables

BAR = "ticker string, session date, close double, high double, low double, volume double"


def panel(spark, closes, volumes, ticker="A"):
    day = date(2024, 1, 1)
    rows = [(ticker, day + timedelta(days=i), c, c, c, v) for i, (c, v) in enumerate(zip(closes, volumes))]
    return spark.createDataFrame(rows, BAR)


def newest(spark, closes, volumes):
    return screener.newest(tables.clean(panel(spark, closes, volumes)), LIVE).collect()


def test_flat_history_has_ratio_one(spark):
    row = newest(spark, [100.0] * 100, [1e6] * 100)[0]
    assert row.volume_ratio == pytest.approx(1) and row.price_change == pytest.approx(0)


def test_recent_volume_doubled_is_two_because_the_baseline_is_separate(spark):
    assert newest(spark, [100.0] * 100, [1e6] * 90 + [2e6] * 10)[0].volume_ratio == pytest.approx(2)


def test_only_endpoints_count_and_changes_can_be_negative(spark):
    closes = [100.0] * 95 + [500.0] + [100.0] * 3 + [110.0]
    assert newest(spark, closes, [1.0] * 100)[0].price_change == pytest.approx(0.10)
    assert newest(spark, [100.0] * 99 + [80.0], [1.0] * 100)[0].price_change == pytest.approx(-0.20)


def test_short_history_and_zero_volume_give_nothing(spark):
    assert newest(spark, [100.0] * 25, [1.0] * 25) == []
    assert newest(spark, [100.0] * 100, [0.0] * 100) == []


def test_trailing_bar_without_a_close_is_dropped(spark):
    rows = newest(spark, [100.0] * 59 + [float("nan")], [1.0] * 60)
    assert rows[0].session == date(2024, 1, 1) + timedelta(days=58)


def test_no_look_ahead(spark):
    closes, volumes = [100.0 + i % 7 for i in range(120)], [1e6 + 1000 * (i % 11) for i in range(120)]
    full = signals.measured(panel(spark, closes, volumes), SignalSpec(), (5,)).select("session", "volume_ratio", "price_change")
    cut = signals.measured(panel(spark, closes[:100], volumes[:100]), SignalSpec(), (5,)).select("session", "volume_ratio", "price_change")
    assert cut.exceptAll(full).count() == 0


def test_overlapping_ratio_is_capped(spark):
    rows = panel(spark, [1.0] * 80, [1.0] * 70 + [1e9] * 10).withColumn("dv", F.col("close") * F.col("volume"))
    top = rows.select(R.ratio("dv", 10, 63, False).alias("r")).agg(F.max("r")).first()[0]
    assert top <= 6.3 + 1e-9


def test_spacing_measures_from_the_last_kept_row(spark):
    hits = [1, 5, 11, 12, 20, 21, 22, 40]
    rows = spark.createDataFrame([("A", i) for i in hits] + [("B", 3)], "ticker string, rn bigint")
    kept = sorted(tuple(r) for r in signals.spaced(rows, 10, ["ticker"]).collect())
    assert kept == [("A", 1), ("A", 11), ("A", 21), ("A", 40), ("B", 3)]


def cash(spark, rows):
    frame = spark.createDataFrame([("T", label, date(2024 - k // 4, 12 - 3 * (k % 4), 1), v) for label, vs in rows for k, v in enumerate(vs)], "ticker string, label string, quarter date, value double")
    got = screener.trailing_cash(frame, ["first", "second"]).collect()
    return got[0].cash if got else None


def test_trailing_cash_flow(spark):
    assert cash(spark, [("first", [100.0, 200.0, 300.0, 400.0])]) == 1000
    assert cash(spark, [("first", [1.0, 2.0, 3.0, 4.0, 500.0])]) == 10
    assert cash(spark, [("first", [1.0, 2.0])]) is None
    assert cash(spark, [("first", [1.0]), ("second", [1.0, 1.0, 1.0, 1.0])]) is None
    assert cash(spark, [("second", [-1.0, -1.0, -1.0, -1.0])]) == -4
    assert cash(spark, [("other", [1.0])]) is None


def test_resolved_cap_takes_the_first_usable_key(spark):
    rows = spark.createDataFrame([({"marketCap": 5.0},), ({"marketCap": 0.0, "market_cap": 7.0},), ({"shares": 2.0, "lastPrice": 3.0},), ({},)], "info map<string, double>")
    assert [r[0] for r in rows.select(labels.resolved_cap(F.col("info"))).collect()] == [5.0, 7.0, 6.0, None]


def test_near_misses_ignore_matches_missing_changes_and_failed_cash(spark):
    rows = spark.createDataFrame(
        [("AAA", 1.47, 6.8, True, False), ("BBB", 0.55, -12.0, True, False), ("CCC", 2.0, 9.0, True, True), ("DDD", 1.7, 6.9, False, False), ("EEE", 1.0, None, True, False)],
        "ticker string, volume_ratio double, price_change_pct double, pass_cfo boolean, is_match boolean",
    )
    assert [r.ticker for r in screener.near_misses(rows, LIVE).collect()] == ["AAA", "BBB"]


@pytest.mark.parametrize("text,expected", [("1", True), (" YES ", True), ("on", True), ("0", False), ("Off", False), ("no", False), ("ture", True), ("", True), (None, True)])
def test_env_flag_keeps_its_default_on_typos(text, expected):
    assert env_flag(text, True) is expected

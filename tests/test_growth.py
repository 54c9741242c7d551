"""Steps whose cost once grew faster than their input, on small hand-made inputs."""

from __future__ import annotations

import contextlib
import hashlib
import io
import random
import statistics
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from quillpanel.config import LIVE, LOOSE
from quillpanel.operators import events, exits, histories, md5, metrics, resample, separation, signals, sweep
from quillpanel.sources import tables


def plan(frame) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        frame.explain()
    return out.getvalue()


def test_md5_of_many_texts_equals_hashlib():
    for tails in (md5.numbers(0, 20_000), np.array([b"x" * k for k in range(70)]), np.array([b"S000001", "é".encode(), b""])):
        for head in (b"", b"9:", b"299:2001H1:"):
            want = [int(hashlib.md5(head + t).hexdigest()[:7], 16) for t in tails.tolist()]
            assert md5.Tails(tails).draws(head).tolist() == want


def test_replicates_are_added_up_without_rows_for_draws(spark):
    n, reps = 3000, 30
    values = np.arange(n) % 17 - 8.25
    items = spark.createDataFrame([(i, float(v) if i % 10 else None, 1 + i % 3, n) for i, v in enumerate(values)], "slot bigint, s double, c bigint, n bigint").repartition(7)
    s, c = np.where(np.arange(n) % 10 > 0, values, 0), 1 + np.arange(n) % 3
    for block in (1024, resample.BLOCK):
        means = resample._replicates(items, reps, block)
        assert "Generate" not in plan(means)
        got = {r.rep: r.m for r in means.collect()}
        for rep in range(reps):
            drawn = [int(hashlib.md5(f"{rep}:{i}".encode()).hexdigest()[:7], 16) % n for i in range(n)]
            assert abs(got[rep] - s[drawn].sum() / c[drawn].sum()) < 1e-12
    assert len(got) == reps and resample._replicates(items.limit(0), reps).count() == 0


def test_draws_of_both_engines_are_one(spark):
    rows = spark.createDataFrame([(3, "a"), (12, "bb")], "rep int, name string")
    got = [r[0] for r in rows.select(resample.draw(F.col("rep"), F.col("name"))).collect()]
    assert got == [int(md5.Tails(np.array([t])).draws(h)[0]) for h, t in ((b"3:", b"a"), (b"12:", b"bb"))]


BARS = "ticker string, session date, close double, high double, low double, volume double"


def bars(spark, tickers=3, days=300, start=date(1998, 1, 1)):
    draw = random.Random(7)
    rows = [(f"T{k}", start + timedelta(days=i), draw.uniform(5, 9), draw.uniform(9, 10), draw.uniform(4, 5), float(draw.randrange(1, 99))) for k in range(tickers) for i in range(days)]
    return spark.createDataFrame(rows, BARS)


def test_bars_and_metrics_take_one_exchange_and_no_sliding_windows(spark):
    lines = spark.createDataFrame([(1, date(2024, 1, 1), 5.0, 2.0)], "l_suppkey bigint, l_shipdate date, l_extendedprice double, l_quantity double")
    text = plan(metrics.library(tables.bars_from_lines(lines)))
    assert text.count("Exchange hashpartitioning") == 1 and "specifiedwindowframe(RowFrame, -62" not in text


def test_metrics_of_chosen_rows_are_those_of_all_rows(spark):
    panel = bars(spark)
    whole = {(r.ticker, r.session): r for r in metrics.library(panel).collect()}
    got = separation.cross_section(panel).collect()
    assert sorted((r.period, r.ticker) for r in got) == [("1998H2", f"T{k}") for k in range(3)]
    for r in got:
        first = min(s for t, s in whole if t == r.ticker and s >= date(1998, 7, 1))
        for m in metrics.METRICS:
            a, b = r[m], whole[r.ticker, first][m]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9 * max(1, abs(b))), m


def test_histories_are_whole_where_rows_are_handed_on_in_parts(spark):
    panel, old = bars(spark, 7, 40), histories.ROWS
    try:
        histories.ROWS = 90
        kernel = lambda p: {"ticker": p.table["ticker"], "n": np.repeat(p.counts, p.counts).astype(float), "mean": p.mean(p["close"], 40)}
        got = histories.apply(panel.repartition(1), ["close"], kernel, "ticker string, n double, mean double").collect()
    finally:
        histories.ROWS = old
    assert len(got) == 280 and {r.n for r in got} == {40.0} and sum(r["mean"] is not None for r in got) == 7


def test_shuffled_labels_equal_a_plain_count(spark):
    draw, names = random.Random(3), ("vol_ratio_10_63", "gap_freq_21", "rsi_14")
    rows = [(p, f"S{k:03d}", k % 3 == 0, draw.gauss(k % 5, 2), 0.1, draw.gauss(0, 1) if k % 4 else None) for p, n in (("1998H2", 40), ("1999H2", 57), ("2000H1", 20)) for k in range(n)]
    section = spark.createDataFrame(rows, "period string, ticker string, rose boolean, " + ", ".join(f"{m} double" for m in names)).repartition(3)
    shuffled = separation._shuffled(section, 60)
    assert "Generate" not in plan(shuffled)
    got = {(r.rep, r.period, r.metric): r.sep for r in shuffled.collect()}
    want = {}
    for rep in range(60):
        for p in ("1998H2", "1999H2"):
            here = sorted((r for r in rows if r[0] == p), key=lambda r: (int(hashlib.md5(f"{rep}:{p}:{r[1]}".encode()).hexdigest()[:7], 16), r[1]))
            n1 = sum(r[2] for r in here)
            for j, m in enumerate(names):
                a, b = ([r[3 + j] for r in part if r[3 + j] is not None] for part in (here[:n1], here[n1:]))
                pooled = ((statistics.variance(a) + statistics.variance(b)) / 2) ** 0.5 if min(len(a), len(b)) >= 8 else None
                want[rep, p, m] = None if pooled is None else (statistics.mean(a) - statistics.mean(b)) / pooled if pooled else 0.0
    assert got.keys() == want.keys()
    assert not [(k, got[k], v) for k, v in want.items() if (got[k] is None) != (v is None) or v is not None and abs(got[k] - v) > 1e-9]


def test_spacing_in_arrays_is_that_of_rows(spark):
    draw = random.Random(5)
    rows = [(f"T{k}", date(2024, 1, 1) + timedelta(days=i), i + 1, float(draw.random() < 0.3)) for k in range(9) for i in range(60)]
    frame = spark.createDataFrame(rows, "ticker string, session date, rn bigint, hit double")
    kernel = lambda p: (lambda at: {"ticker": p.table["ticker"].take(at), "rn": p.rn[at].astype(np.int64)})(p.spaced(p["hit"] > 0, 10))
    ours = histories.apply(frame, ["hit"], kernel, "ticker string, rn bigint").collect()
    assert sorted(map(tuple, ours)) == sorted((r.ticker, r.rn) for r in signals.spaced(frame.where("hit > 0"), 10, ["ticker"]).collect())


def test_baselines_of_exits_are_summed_by_span_without_rows_for_tickers(spark):
    draw = random.Random(11)
    rows = []
    for k in range(7):
        days = sorted(draw.sample(range(400), 150))
        closes = [draw.uniform(5, 9) for _ in days]
        rows += [(f"T{k}", date(2024, 1, 1) + timedelta(days=d), c, c, c, draw.choice([1.0, 1.0, 9.0]) * (k < 6)) for d, c in zip(days, closes)]
    measured = signals.measured(spark.createDataFrame(rows, BARS), LIVE)
    done = exits.trades(measured, LIVE)
    assert plan(done).count("Join") <= 2 and "CartesianProduct" not in plan(done)
    got = done.collect()
    close = {(r[0], r[1]): r[2] for r in rows}
    with_signals = {r.ticker for r in signals.spaced(measured.where(signals.fires(LIVE)), LIVE.gap, ["ticker"]).collect()}
    assert got and "T6" not in with_signals
    for r in got:
        moves = [close[t, r.exit] / close[t, r.entry] - 1 for t in with_signals if (t, r.entry) in close and (t, r.exit) in close]
        assert abs(r.baseline_pct - 100 * statistics.fmean(moves)) < 1e-5 and abs(r.excess_pct - r.return_pct + r.baseline_pct) < 1e-5


def test_sweeps_and_curves_are_counted_within_the_panel(spark):
    panel = bars(spark, 4, 320, date(1998, 6, 1))
    for frame in (sweep.window_sweep(panel), sweep.validation(panel), sweep.stability(panel), events.curves(panel)):
        text = plan(frame)
        assert "Generate" not in text and "Join" not in text and text.count("Exchange") <= 3
    n = {r["sum(n_rise)"] + r["sum(n_fall)"] + r["sum(n_flat)"] for r in sweep.counts(panel, [(10, 30, True, 1.2)], "recent").groupBy().sum().collect()}
    # rows with ten more after them, in the periods, and with 40 before
    assert n == {4 * sum(date(1998, 7, 10) <= date(1998, 6, 1) + timedelta(days=i) for i in range(310))}
    got = {(r.kind, r.day): r.n for r in events.curves(panel).collect()}
    assert got["random", 0] == 12 and len({n for (kind, _), n in got.items() if kind == "up"}) == 1


def test_backtest_takes_one_pass_over_the_bars(spark):
    panel = bars(spark, 12, 200).withColumn("volume", F.pow("volume", 2))
    universe = spark.createDataFrame([("T1", "x", True, 3.0)], "ticker string, category string, in_original boolean, cap_busd double")
    got = {(r.ticker, r.rn): r for r in signals.backtest(panel, universe, LOOSE, window=14).collect()}
    text = plan(signals._events_and_sums(panel, LOOSE, (5, 20), 14))
    assert text.count("Exchange") == 1 and "Join" not in text and text.count("RowNumber") + text.count("row_number") <= 2
    rows = signals.qualifying_days(signals.measured(panel, LOOSE), LOOSE, 14)
    base = {r.session: r.base_20d for r in signals.baseline(rows, (20,)).collect()}
    want = {(r.ticker, r.rn): r for r in signals.spaced(rows.where(signals.fires(LOOSE)), LOOSE.gap, ["ticker"]).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    for k, r in got.items():
        assert r.days == want[k].days and r.session == want[k].session
        excess = None if want[k].fwd_20d is None else 100 * (want[k].fwd_20d - base[r.session])
        assert (r.excess_20d_pct is None) == (excess is None) and (excess is None or abs(r.excess_20d_pct - excess) < 0.00501)
    assert {r.category for k, r in got.items() if k[0] == "T1"} == {"x"}

"""The registered queries of the panel library over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LEGACY, LIVE, LOOSE, PERIODS
from ..functions import labels
from ..operators import alerts, archive, events, exits, metrics, monitor, regime, resample, screener, separation, signals, study, sweep
from ..sources import tables as T

#: Draws of the bootstraps; shuffles over two and over all periods.
REPS, SHUFFLES_TWO, SHUFFLES_ALL = 10_000, 500, 300
#: Rounding rule for halves: within this of a half in the seventh decimal a value rounds up, since
#: engines that add in another order differ in the last bit of it.  Other values round as usual.
TIE = 3.3e-10


def r6(name: str, x: F.Column | None = None) -> F.Column:
    """Six decimals; a negative zero becomes zero."""
    return (F.round(F.col(name) if x is None else x, 6) + 0.0).alias(name)


def universe_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.pick(T.universe(spark, d), ["NASDAQ"], 50).select("ticker", "category", "exchange")


def bars_clean(spark: SparkSession, d: str) -> DataFrame:
    out = T.with_history(T.bars(spark, d), 41)
    return out.select("ticker", "session", r6("close"), r6("high"), r6("low"), r6("volume"), "rn", "n_bars")


def _ratio(spec, spark: SparkSession, d: str) -> DataFrame:
    rows = signals.measured(T.bars(spark, d), spec)
    out = rows.where("volume_ratio is not null").select("ticker", "session", r6("volume_ratio"))
    return out if spec.separate else out.withColumn("ceiling", F.lit(float(spec.base) / spec.recent))


def _screened(spark: SparkSession, d: str) -> DataFrame:
    cash = screener.trailing_cash(T.statements(spark, d), ["N", "A", "R"])
    return screener.screen(T.bars(spark, d), T.universe(spark, d), cash, LIVE)


def screen_latest(spark: SparkSession, d: str) -> DataFrame:
    return _screened(spark, d)


def ttm_cash_flow(spark: SparkSession, d: str) -> DataFrame:
    return screener.trailing_cash(T.statements(spark, d), ["N", "A", "R"]).select("ticker", F.round("cash", 4).alias("cash"))


def near_misses(spark: SparkSession, d: str) -> DataFrame:
    return screener.near_misses(_screened(spark, d), LIVE)


def data_quality_guard(spark: SparkSession, d: str) -> DataFrame:
    return screener.quality_guard(_screened(spark, d))


def modal_session(spark: SparkSession, d: str) -> DataFrame:
    return screener.modal_session(_screened(spark, d))


def fundamentals_cache(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    wanted = T.universe(spark, d).select("ticker", "cap_busd", F.col("position").cast("double").alias("cash"), "position")
    cache = wanted.where("position % 2 = 0").select("ticker", (F.col("cash") * 2).alias("cash"), F.lit(1.0).alias("cap_busd"), (now - F.make_dt_interval((F.col("position") % 14).cast("int"))).alias("fetched_at"))
    out = screener.fresh_or_new(wanted.drop("position"), cache, now)
    return out.select("ticker", "cash", "cap_busd", F.col("fetched_at").cast("date").alias("fetched"), "reused")


def _metrics(names: tuple[str, ...], spark: SparkSession, d: str) -> DataFrame:
    return metrics.library(T.bars(spark, d), names).select("ticker", "session", *(r6(m, F.col(m) + TIE) for m in names))


def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.measured(T.bars(spark, d), LIVE)
    return rows.select("ticker", "session", *(r6(f"fwd_{h}d") for h in (5, 10, 20, 30)))


def _signals(spec, spaced: bool, spark: SparkSession, d: str) -> DataFrame:
    rows = signals.measured(T.bars(spark, d), spec).where(signals.fires(spec))
    rows = signals.spaced(rows, spec.gap, ["ticker"]) if spaced else rows
    return rows.select("ticker", "session", "rn", r6("volume_ratio"), r6("price_change"))


def date_matched_baseline(spark: SparkSession, d: str) -> DataFrame:
    return signals.baseline(signals.measured(T.bars(spark, d), LIVE)).select("session", *(r6(f"base_{h}d") for h in (5, 10, 20, 30)))


def _trades(spark: SparkSession, d: str, spec=LIVE) -> DataFrame:
    return signals.backtest(T.bars(spark, d), T.universe(spark, d), spec)


def backtest_signals(spark: SparkSession, d: str) -> DataFrame:
    return _trades(spark, d).drop("rn", "in_original", "cap_busd")


def horizon_summary(spark: SparkSession, d: str) -> DataFrame:
    return study.horizon_summary(_trades(spark, d))


def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return study.by_category(_trades(spark, d))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return study.sweep_thresholds(signals.measured(T.bars(spark, d), LIVE), LIVE)


def size_summary(spark: SparkSession, d: str) -> DataFrame:
    return study.by_size(_trades(spark, d))


def _lasting(spark: SparkSession, d: str, window: int = 14) -> DataFrame:
    return signals.backtest(T.bars(spark, d), T.universe(spark, d), LOOSE, window=window)


def persistence_summary(spark: SparkSession, d: str) -> DataFrame:
    return study.by_persistence(_lasting(spark, d))


def size_x_persistence(spark: SparkSession, d: str) -> DataFrame:
    return study.size_by_persistence(_lasting(spark, d))


def top_contributors_excluded(spark: SparkSession, d: str) -> DataFrame:
    return study.without_top(_trades(spark, d))


def persistence_sweep(spark: SparkSession, d: str) -> DataFrame:
    return study.persistence_sweep(_lasting(spark, d))


def universe_bias(spark: SparkSession, d: str) -> DataFrame:
    return study.universe_bias(_lasting(spark, d, 10))


def _excess(spark: SparkSession, d: str) -> DataFrame:
    return _trades(spark, d).where("excess_20d_pct is not null").select("ticker", "rn", F.col("excess_20d_pct").alias("x"))


def bootstrap_clustered(spark: SparkSession, d: str) -> DataFrame:
    return resample.clustered(_excess(spark, d), REPS)


def bootstrap_naive(spark: SparkSession, d: str) -> DataFrame:
    return resample.naive(_excess(spark, d), REPS, "ticker", ["rn"])


def bootstrap_width_ratio(spark: SparkSession, d: str) -> DataFrame:
    x = T.kept(_excess(spark, d))
    return resample.width_ratio(resample.clustered(x, REPS), resample.naive(x, REPS, "ticker", ["rn"]))


def bootstrap_persistent(spark: SparkSession, d: str) -> DataFrame:
    lasting = _lasting(spark, d).where("days >= 3 and excess_20d_pct is not null")
    return resample.clustered(lasting.select("ticker", F.col("excess_20d_pct").alias("x")), REPS)


def best_persistence_gap(spark: SparkSession, d: str) -> DataFrame:
    return study.best_gap(persistence_sweep(spark, d))


def market_cap_estimate(spark: SparkSession, d: str) -> DataFrame:
    shares = T.universe(spark, d).select("ticker", ((F.col("position") % 5) * 1_000_000).alias("shares"))
    out = study.estimated_cap(_trades(spark, d), shares)
    return out.select("ticker", "session", r6("est_cap_busd"), labels.size_bucket(F.col("est_cap_busd") * 100).alias("bucket"))


def nearest_session(spark: SparkSession, d: str) -> DataFrame:
    wanted = _trades(spark, d).select("ticker", F.date_add("session", 45).alias("wanted"))
    return signals.nearest(T.bars(spark, d).select("ticker", "session", "close"), wanted).select("ticker", "wanted", "session", r6("close"))


def screen_matches(spark: SparkSession, d: str) -> DataFrame:
    cash = screener.trailing_cash(T.statements(spark, d), ["N", "A", "R"])
    return screener.matches(screener.screen(T.bars(spark, d), T.universe(spark, d), cash, LOOSE, cash_required=False)).select("ticker", "volume_ratio", "price_change_pct")


def category_ranking(spark: SparkSession, d: str) -> DataFrame:
    return study.ranked(category_summary(spark, d), "excess_pct", "category")


def threshold_sweep_top(spark: SparkSession, d: str) -> DataFrame:
    return study.ranked(threshold_sweep(spark, d), "excess_pct", "vol_thr", "price_thr", n=15)


def window_sweep_top(spark: SparkSession, d: str) -> DataFrame:
    return study.ranked(window_sweep(spark, d), "edge", "recent", "base", "trigger", n=12)


def exit_trades(spark: SparkSession, d: str) -> DataFrame:
    return exits.trades(T.bars(spark, d), LIVE)


def exit_summary(spark: SparkSession, d: str) -> DataFrame:
    return exits.summary(exit_trades(spark, d)).orderBy("rule_order")


def exit_summary_persistent(spark: SparkSession, d: str) -> DataFrame:
    return exits.summary(exits.trades(T.bars(spark, d), LOOSE, 3)).orderBy("rule_order")


def best_exit_rules(spark: SparkSession, d: str) -> DataFrame:
    return exits.best(exit_summary(spark, d))


def _section(spark: SparkSession, d: str, names: tuple[str, ...] = metrics.METRICS) -> DataFrame:
    return separation.cross_section(T.bars(spark, d), names)


def period_cross_section(spark: SparkSession, d: str) -> DataFrame:
    return _section(spark, d).select("period", "ticker", "period_return_pct", "rose", "fell", *(r6(m) for m in metrics.METRICS))


def _separated(section: DataFrame, label: str = "rose") -> DataFrame:
    return separation.separations(separation.unpivoted(section, "period", "ticker", label), label, "period")


def _separations(spark: SparkSession, d: str) -> DataFrame:
    return _separated(_section(spark, d))


def separations(spark: SparkSession, d: str) -> DataFrame:
    return _separations(spark, d).select("period", "metric", r6("sep"))


def _two_passed(seps: DataFrame) -> DataFrame:
    two = seps.where(F.col("period").isin(PERIODS[0][0], PERIODS[2][0]))
    return separation.passes(two).select("metric", "n", r6("min_abs"), "passes").orderBy(F.col("min_abs").desc_nulls_last(), "metric")


def two_period_pass(spark: SparkSession, d: str) -> DataFrame:
    return _two_passed(_separations(spark, d))


def _scored(seps: DataFrame) -> DataFrame:
    return separation.ranked(separation.score(seps, len(PERIODS)))


def multi_period_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_separations(spark, d))


def metric_survivors(spark: SparkSession, d: str) -> DataFrame:
    seps = T.kept(_separations(spark, d))
    return separation.survivors(_two_passed(seps), _scored(seps))


def seasonality(spark: SparkSession, d: str) -> DataFrame:
    return separation.seasonality(_separations(spark, d), [p for p, *_ in PERIODS if p.endswith("H2")])


def mirror_test(spark: SparkSession, d: str) -> DataFrame:
    return separation.mirror(_section(spark, d))


def _null(section: DataFrame) -> DataFrame:
    return separation.permutation(section.where(F.col("period").isin(PERIODS[0][0], PERIODS[2][0])), SHUFFLES_TWO)


def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    return _null(_section(spark, d))


def permutation_null_periods(spark: SparkSession, d: str) -> DataFrame:
    return separation.permutation_by_score(_section(spark, d), SHUFFLES_ALL, len(PERIODS))


def permutation_test(spark: SparkSession, d: str) -> DataFrame:
    section = T.kept(_section(spark, d))
    return separation.against_null(_null(section), _two_passed(_separated(section)))


def permutation_test_periods(spark: SparkSession, d: str) -> DataFrame:
    section = T.kept(_section(spark, d))
    return separation.against_null(separation.permutation_by_score(section, SHUFFLES_ALL, len(PERIODS)), _scored(_separated(section)))


def event_curves(spark: SparkSession, d: str) -> DataFrame:
    return events.curves(T.bars(spark, d))


def event_curves_aligned(spark: SparkSession, d: str) -> DataFrame:
    return events.aligned(event_curves(spark, d))


def event_window_summary(spark: SparkSession, d: str) -> DataFrame:
    return events.windows(event_curves(spark, d))


def window_sweep(spark: SparkSession, d: str) -> DataFrame:
    return sweep.window_sweep(T.bars(spark, d))


def window_sweep_pivot(spark: SparkSession, d: str) -> DataFrame:
    return sweep.sweep_pivot(window_sweep(spark, d))


def window_sweep_best(spark: SparkSession, d: str) -> DataFrame:
    return sweep.best(window_sweep(spark, d))


def volume_validation(spark: SparkSession, d: str) -> DataFrame:
    return sweep.validation(T.bars(spark, d))


def quarter_stability(spark: SparkSession, d: str) -> DataFrame:
    return sweep.stability(T.bars(spark, d))


def _assets(spark: SparkSession, d: str) -> DataFrame:
    lines, part = T.read(spark, d, "lineitem"), T.read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    rows = lines.join(part, lines.l_partkey == part.p_partkey)
    names = regime.RISK_ON + regime.RISK_OFF + regime.OTHER
    return rows.where(F.col("asset").isin(*names)).groupBy("asset", F.col("l_shipdate").cast("date").alias("session")).agg(F.avg("l_extendedprice").alias("close"))


def asset_period_returns(spark: SparkSession, d: str) -> DataFrame:
    return regime.period_returns(_assets(spark, d))


def regime_scores(spark: SparkSession, d: str) -> DataFrame:
    return regime.scores(asset_period_returns(spark, d), regime.RISK_ON, regime.RISK_OFF)


def _base_rates(section: DataFrame) -> DataFrame:
    return section.groupBy("period").agg(F.round(F.avg(F.col("rose").cast("double")) * 100, 6).alias("base_rate"))


def base_rates(spark: SparkSession, d: str) -> DataFrame:
    return _base_rates(_section(spark, d, ()))


def regime_correlation(spark: SparkSession, d: str) -> DataFrame:
    section = T.kept(_section(spark, d, ("vol_ratio_10_63",)))
    sep = _separated(section).select("period", F.round("sep", 6).alias("vol_sep"))
    rows = regime_scores(spark, d).join(_base_rates(section), "period").join(sep, "period", "left")
    return regime.correlations(rows, [("score", "vol_sep"), ("score", "base_rate"), ("base_rate", "vol_sep")])


def regime_against_screen(spark: SparkSession, d: str) -> DataFrame:
    return regime.against(regime_scores(spark, d), _base_rates(_section(spark, d, ())))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").where("event_type <> 'error'")
    return e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.col("ts").cast("date").alias("session")).distinct()


def alert_state(spark: SparkSession, d: str) -> DataFrame:
    from .. import runtime

    return alerts.fold(_sessions(runtime.ship(spark), d))


def streak_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = alerts.streaks(_sessions(spark, d))
    text, level = labels.streak_label(F.col("streak"), F.col("span"), 8)
    return rows.select("ticker", "session", "streak", F.col("span").cast("bigint").alias("span"), level.alias("level"), text.alias("label"))


def runlog_stale(spark: SparkSession, d: str) -> DataFrame:
    log = T.event_runs(spark, d)
    again = log.where("position % 7 = 3").select((F.col("position") + 1000).alias("position"), "date", F.lit("ok").alias("status"))
    return monitor.stale(log.unionByName(again)).select("position", "date", "status")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return T.event_runs(spark, d)


def weekly_summary(spark: SparkSession, d: str) -> DataFrame:
    return monitor.weekly_summary(_log(spark, d), F.lit("2024-02-01").cast("date"), 28)


def missing_sessions(spark: SparkSession, d: str) -> DataFrame:
    return monitor.missing_sessions(_log(spark, d), 28)


def match_days(spark: SparkSession, d: str) -> DataFrame:
    return monitor.match_days(_log(spark, d), _sessions(spark, d).select("ticker", F.col("session").alias("date")), 28)


def persistent_names(spark: SparkSession, d: str) -> DataFrame:
    return monitor.persistent_names(_sessions(spark, d))


def _archived(spark: SparkSession, d: str) -> DataFrame:
    rows = T.with_history(T.bars(spark, d), 41)
    return rows.where("rn <= n_bars - 2 or ticker < 'S000003'").select(F.col("session").alias("as_of"), "ticker")


def archive_increment(spark: SparkSession, d: str) -> DataFrame:
    rows = T.with_history(T.bars(spark, d), 41).select("ticker", "session", r6("close"), r6("volume"))
    return archive.increment(rows, _archived(spark, d))


def archive_coverage(spark: SparkSession, d: str) -> DataFrame:
    return archive.coverage(_archived(spark, d), 3)


_PLAIN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "universe_filter": universe_filter, "bars_clean": bars_clean, "dollar_volume_ratio_separate": partial(_ratio, LIVE), "dollar_volume_ratio_overlapping": partial(_ratio, LEGACY),
    "screen_latest": screen_latest, "ttm_cash_flow": ttm_cash_flow, "near_misses": near_misses, "fundamentals_cache": fundamentals_cache,
    **{f"metrics_{k}": partial(_metrics, names) for k, names in metrics.FAMILIES.items()},
    "forward_returns": forward_returns, "signals_raw": partial(_signals, LIVE, False), "signals_raw_legacy": partial(_signals, LEGACY, False), "signals_dedup": partial(_signals, LIVE, True), "signals_dedup_legacy": partial(_signals, LEGACY, True),
    **{f.__name__: f for f in (
        date_matched_baseline, backtest_signals, horizon_summary, category_summary, threshold_sweep, size_summary, persistence_summary, size_x_persistence, top_contributors_excluded,
        persistence_sweep, universe_bias, bootstrap_clustered, bootstrap_naive, bootstrap_width_ratio, bootstrap_persistent, best_persistence_gap, market_cap_estimate, nearest_session, screen_matches,
        category_ranking, threshold_sweep_top, window_sweep_top, exit_trades, exit_summary, exit_summary_persistent, best_exit_rules, period_cross_section, separations, two_period_pass, multi_period_score, metric_survivors,
        seasonality, mirror_test, permutation_null, permutation_null_periods, permutation_test, permutation_test_periods, event_curves, event_curves_aligned, event_window_summary, window_sweep, window_sweep_pivot, window_sweep_best, volume_validation, quarter_stability,
        asset_period_returns, regime_scores, base_rates, regime_correlation, regime_against_screen, alert_state, streak_counts, match_days, persistent_names, runlog_stale, weekly_summary, missing_sessions,
        archive_increment, archive_coverage, data_quality_guard, modal_session,
    )},
}


def _dated(query: Callable[[SparkSession, str], DataFrame], spark: SparkSession, d: str) -> DataFrame:
    """Dates as ISO text, which every engine compares alike."""
    out = query(spark, d)
    return out.select(*(F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in out.dtypes))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: partial(_dated, q) for k, q in _PLAIN.items()}

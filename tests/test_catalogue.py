"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillpanel.plans import catalogue, oracle

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
NAMES = ("screen_latest", "dollar_volume_ratio_separate", "metrics_volume", "metrics_shape", "signals_dedup", "backtest_signals", "threshold_sweep", "exit_trades", "event_curves", "volume_validation", "regime_scores", "streak_counts", "weekly_summary", "archive_increment", "bootstrap_clustered", "bootstrap_naive", "match_days", "persistent_names", "nearest_session", "market_cap_estimate", "window_sweep_top", "exit_summary_persistent")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if v != v or v is None else round(float(v), 9) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, db, name):
    ours, theirs = catalogue.QUERIES[name](spark, DIR).toPandas(), db.sql(oracle.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_other_query_has_sql():
    assert set(catalogue.QUERIES) - set(oracle.ORACLE) == {"alert_state"}


def test_alert_state_follows_every_user(spark, db):
    pairs = db.sql("select distinct 'U' || user_id, cast(ts as date)::varchar from events where event_type <> 'error'").fetchall()
    got = catalogue.QUERIES["alert_state"](spark, DIR).collect()
    assert sorted((r[0], str(r[1])) for r in got) == sorted(pairs)

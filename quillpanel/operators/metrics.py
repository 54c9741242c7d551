"""The library of 31 rolling metrics, worked out on arrays of whole histories, for all rows or for chosen ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import histories
from .histories import Panel, divide

METRICS = (
    "vol_ratio_10_63", "vol_ratio_5_21", "vol_ratio_21_126", "dollar_vol_musd", "share_vol_ratio", "up_volume_share", "obv_slope_21", "ad_slope_21",
    "return_5d_pct", "return_10d_pct", "return_21d_pct", "return_63d_pct", "return_126d_pct", "momentum_accel", "pct_off_52w_high", "pct_above_52w_low",
    "pct_vs_ma50", "pct_vs_ma200", "ma50_vs_ma200", "close_in_21d_range", "volatility_20d_pct", "volatility_60d_pct", "vol_of_vol", "atr_pct",
    "bollinger_width_pct", "rsi_14", "pct_up_days_21", "max_dd_63d_pct", "return_skew_63", "trend_r2_63", "gap_freq_21",
)
FAMILIES = {"volume": METRICS[:8], "returns": METRICS[8:14], "levels": METRICS[14:20], "volatility": METRICS[20:25], "shape": METRICS[25:]}
MIN_BARS = 260


BARS = ["close", "high", "low", "volume"]


def _percent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (divide(a, b) - 1) * 100


def values(p: Panel, names: tuple[str, ...], rows: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The named metrics of all rows or of the chosen ones."""
    c, h, low, v = (p[x] for x in BARS)
    at = (lambda x: x) if rows is None else (lambda x: x[rows])
    dv = p.once("dv", lambda: c * v)
    before = p.once("before", lambda: p.shift(c, 1))
    ret = p.once("ret", lambda: divide(c, before) - 1)
    up = p.once("up", lambda: (ret > 0).astype(float))
    mean = lambda x, n: p.mean(x, n, rows)
    change = lambda n: p.change(c, n, rows)
    s20, s60 = (lambda: p.deviation(ret, 20, rows)), (lambda: p.deviation(ret, 60, rows))
    low21 = lambda: p.lowest(low, 21, rows)

    def true_range():
        return np.fmax(np.fmax(h - low, np.abs(h - before)), np.abs(low - before))

    def slope(flow):
        return np.where(at(p.rn) > 21, p.total(flow, 21, rows), np.nan)

    def obv():
        return np.nan_to_num(np.sign(ret) * v, nan=0.0)

    def flow():
        return np.nan_to_num(divide((c - low) - (h - c), h - low), nan=0.0) * v

    def rsi():
        step = c - before
        return at(100 - divide(100.0, 1 + divide(p.smooth(np.maximum(step, 0.0), 14), p.smooth(np.maximum(-step, 0.0), 14))))

    make = {
        "vol_ratio_10_63": lambda: p.ratio(dv, 10, 63, False, rows), "vol_ratio_5_21": lambda: p.ratio(dv, 5, 21, False, rows), "vol_ratio_21_126": lambda: p.ratio(dv, 21, 126, False, rows),
        "dollar_vol_musd": lambda: mean(dv, 10) / 1e6, "share_vol_ratio": lambda: p.ratio(v, 10, 63, False, rows),
        "up_volume_share": lambda: divide(p.total(np.where(up > 0, dv, 0.0), 21, rows), p.total(dv, 21, rows)),
        "obv_slope_21": lambda: divide(slope(obv()), mean(dv, 21)), "ad_slope_21": lambda: divide(slope(flow()), mean(v, 21)),
        **{f"return_{n}d_pct": lambda n=n: change(n) * 100 for n in (5, 10, 21, 63, 126)},
        "momentum_accel": lambda: (change(10) - change(21)) * 100,
        "pct_off_52w_high": lambda: _percent(at(c), p.extreme(c, 252, 60, np.maximum, rows)), "pct_above_52w_low": lambda: _percent(at(c), p.extreme(c, 252, 60, np.minimum, rows)),
        "pct_vs_ma50": lambda: _percent(at(c), mean(c, 50)), "pct_vs_ma200": lambda: _percent(at(c), mean(c, 200)), "ma50_vs_ma200": lambda: _percent(mean(c, 50), mean(c, 200)),
        "close_in_21d_range": lambda: divide(at(c) - low21(), p.highest(h, 21, rows) - low21()),
        "volatility_20d_pct": lambda: s20() * (252**0.5 * 100), "volatility_60d_pct": lambda: s60() * (252**0.5 * 100), "vol_of_vol": lambda: divide(s20(), s60()),
        "atr_pct": lambda: divide(mean(true_range(), 14), at(c)) * 100, "bollinger_width_pct": lambda: s20() * 400,
        "rsi_14": rsi, "pct_up_days_21": lambda: mean(up, 21) * 100, "max_dd_63d_pct": lambda: _percent(at(c), p.highest(c, 63, rows)),
        "return_skew_63": lambda: p.windows(ret, 63, histories.skew, rows), "trend_r2_63": lambda: p.windows(np.where(c > 0, np.log(c), np.nan), 63, histories.fit, rows),
        "gap_freq_21": lambda: mean((np.abs(ret) > 0.05).astype(float), 21) * 100,
    }
    return {m: make[m]() for m in names}


def library(bars: DataFrame, names: tuple[str, ...] = METRICS, least: int = MIN_BARS) -> DataFrame:
    """ticker, session, rn, close, volume and the named metrics, for tickers with enough bars."""

    def kernel(p: Panel) -> dict:
        return {"ticker": p.table["ticker"], "session": p.table["session"], "rn": p.rn.astype(np.int64), "close": p["close"], "volume": p["volume"], **values(p, names)}

    schema = "ticker string, session date, rn bigint, close double, volume double" + "".join(f", {m} double" for m in names)
    return histories.apply(bars, BARS, kernel, schema, least)

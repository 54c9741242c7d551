"""Texts of alerts, failures and weekly summaries; lines are columns, the letter around them is put together on the driver.

Sending is a hook of the caller: a callable that takes subject, text and HTML.
Without one, or when it fails, nothing is sent and nothing is raised.
"""

from __future__ import annotations

from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STREAK_DAYS, STREAK_MIN, SignalSpec
from ..functions.labels import formatted, streak_label

Send = Callable[[str, str, str | None], bool]
#: level -> (background, text colour) of its tag
TINTS = {"new": ("#dde9f9", "#204a87"), "building": ("#fbeecb", "#8a5a00"), "strong": ("#dcefdc", "#1e6b2b")}


def _values() -> dict[str, F.Column]:
    return {
        "price": formatted(F.col("price"), "%.2f", prefix="$"), "move": formatted(F.col("price_change_pct"), "%+.1f", suffix="%%"), "ratio": formatted(F.col("volume_ratio"), "%.2f", suffix="x"),
        "flow": formatted(F.col("recent_dollar_vol_musd"), "%,.0f", prefix="$", suffix="M"), "cap": formatted(F.col("market_cap_busd"), "%.2f", prefix="$", suffix="B"), "cash": formatted(F.col("ttm_cfo_musd"), "%,.0f", prefix="$", suffix="M"),
    }


def alert_lines(matches: DataFrame, least: int = STREAK_MIN) -> DataFrame:
    """ticker, level, one plain-text line and one HTML row, the largest volume ratio first; missing values read n/a."""
    text, level = streak_label(F.col("streak"), F.col("span"), least)
    v = _values()
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tint = lambda k: F.element_at(F.create_map(*(F.lit(x) for name, colours in TINTS.items() for x in (name, colours[k]))), F.col("level"))
    tag = F.concat(F.lit('<span style="background:'), tint(0), F.lit(";color:"), tint(1), F.lit('">'), F.col("text"), F.lit("</span>"))
    cell = lambda *parts: F.concat(F.lit("<td>"), F.concat_ws("<br>", *parts), F.lit("</td>"))
    rows = matches.withColumn("level", level).withColumn("text", text)
    head = F.concat(F.lit("<b>"), safe("ticker"), F.lit("</b>"))
    html = F.concat(F.lit("<tr>"), cell(head, F.concat_ws(", ", safe("category"), safe("exchange")), tag), cell(v["price"], v["move"]), cell(v["ratio"], v["flow"]), cell(v["cap"], v["cash"]), F.lit("</tr>"))
    line = F.concat_ws("  ", F.rpad("ticker", 6, " "), v["move"], v["ratio"], v["flow"], F.col("text"))
    return rows.orderBy(F.col("volume_ratio").desc(), "ticker").select("ticker", "level", line.alias("line"), html.alias("html"))


def alert(lines: DataFrame, session: str, spec: SignalSpec) -> tuple[str, str, str]:
    """(subject, text, HTML) of a daily alert; its rows are the matches of one session."""
    rows = lines.collect()
    terms = f"dollar volume at least {spec.volume}x its {spec.base}-day mean before the last {spec.recent} days, price up {spec.price:.0%} or more over {spec.recent} days, positive trailing cash flow"
    text = "\n".join([f"{len(rows)} match(es) for {session}", "", *(r.line for r in rows), "", f"Terms: {terms}."])
    heads = "".join(f"<th>{h}</th>" for h in ("Name", f"Price, {spec.recent} days", "Dollar volume", "Size, cash flow"))
    html = f"<html><body><h2>{len(rows)} match(es) for {escape(session)}</h2><table><tr>{heads}</tr>{''.join(r.html for r in rows)}</table><p>Terms: {escape(terms)}.</p></body></html>"
    return f"Screen {session}: {len(rows)} match(es)", text, html


def failure(error: BaseException, when: str, trace: str = "") -> tuple[str, str]:
    """(subject, text) of a run that broke off."""
    kind = type(error).__name__
    return f"Screen failed: {kind}", "\n".join([f"The run of {when} broke off and sent no alert.", f"{kind}: {error}", "", trace.rstrip()]).rstrip() + "\n"


def weekly(summary: dict, matched: list[tuple[str, int]], lasting: list[tuple[str, int]], missing: list[str], near: list[dict], most_lag: int = 3) -> tuple[str, str]:
    """(subject, text) of a weekly summary; summary is a row of ``monitor.weekly_summary``."""
    lines = [f"Week to {summary['anchor']}", f"Runs: {summary['actual_runs']} of {summary['expected_runs']} weekdays"]
    lines += [f"Runs with errors: {summary['error_runs']}"] * bool(summary["error_runs"])
    lines += [f"Runs without a new bar: {summary['stale_runs']}"] * bool(summary["stale_runs"])
    lines += [f"Days without a run: {', '.join(missing)}"] * bool(missing)
    lines.append(f"Newest session is {summary['lag_days']} day(s) old" + (f" - more than {most_lag}: have the runs stopped?" if summary["lag_days"] > most_lag else ""))
    listed = lambda title, rows, unit: ["", f"{title}:" if rows else f"{title}: none", *(f"  {t:<6} {n} {unit}" for t, n in sorted(rows, key=lambda x: (-x[1], x[0])))]
    lines += listed("Matched", matched, "day(s)") + listed(f"Qualifying on {STREAK_MIN} or more of {STREAK_DAYS} days", lasting, "days")
    if near:
        lines += ["", "Nearest to a match:"]
        lines += [f"  {x['ticker']:<6} volume {x['volume_ratio']}x, price " + ("n/a" if x.get("price_change_pct") is None else f"{x['price_change_pct']:+.1f}%") for x in near]
    return f"Screen {summary['health']}: {summary['actual_runs']}/{summary['expected_runs']} runs, {len(matched)} matched", "\n".join(lines) + "\n"


def deliver(message: tuple, send: Send | None = None) -> bool:
    """Hand (subject, text[, HTML]) to ``send``; without one, or on its failure, False."""
    try:
        return bool(send and send(message[0], message[1], message[2] if len(message) > 2 else None))
    except OSError:
        return False

"""The registered queries once more, as SQL for another engine (used only to check results)."""

from __future__ import annotations

from ..config import LEGACY, LIVE, LOOSE, PERIODS, PREREGISTERED, PRICE_GRID, TRIGGERS, VOLUME_GRID, WINDOW_GRID, SignalSpec
from ..operators import metrics, regime
from .catalogue import REPS, SHUFFLES_ALL, SHUFFLES_TWO, TIE

BARS = """bars as (select 'S' || lpad(cast(l_suppkey as varchar), 6, '0') as ticker, cast(l_shipdate as date) as session, cast(sum(cast(l_extendedprice as decimal(15,2))) as double) / count(*) as close,
  max(l_extendedprice) as high, min(l_extendedprice) as low, sum(l_quantity) as volume from lineitem group by 1, 2)"""
UNIVERSE = """uni as (select 'S' || lpad(cast(s_suppkey as varchar), 6, '0') as ticker, r_name as category, case when s_suppkey % 2 = 0 then 'NASDAQ' else 'NYSE' end as exchange,
  s_suppkey % 3 = 0 as in_original, case when s_acctbal > 0 then s_acctbal / 100 end as cap_busd, s_suppkey as position
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def panel(least: int) -> str:
    return f"""{BARS}, p as (select * from (select *, close * volume as dv, row_number() over (partition by ticker order by session) as rn, count(*) over (partition by ticker) as n_bars from bars) where n_bars >= {least})"""


def agg(f: str, x: str, n: int, least: int | None = None, shift: int = 0) -> str:
    w = f"over (partition by ticker order by session rows between {n - 1 + shift} preceding and {f'{shift} preceding' if shift else 'current row'})"
    return f"case when count({x}) {w} >= {least or n} then {f}({x}) {w} end"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) over (partition by ticker order by session)"


def change(x: str, n: int) -> str:
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def ahead(n: int) -> str:
    return f"(lead(close, {n}) over (partition by ticker order by session) / nullif(close, 0) - 1)"


def ratio(r: int, b: int, separate: bool, x: str = "dv") -> str:
    return f"(({agg('avg', x, r)}) / nullif({agg('avg', x, b, shift=r if separate else 0)}, 0))"


def measured(s: SignalSpec) -> str:
    return f"""{panel(s.base + 40)}, m as (select *, {ratio(s.recent, s.base, s.separate)} as vr, {change('close', s.recent)} as pc, {ahead(5)} as f5, {ahead(10)} as f10, {ahead(20)} as f20, {ahead(30)} as f30 from p),
b as (select session, avg(f5) as b5, avg(f10) as b10, avg(f20) as b20, avg(f30) as b30 from m group by session),
fire as (select *, row_number() over (partition by ticker order by rn) as k from m where vr >= {s.volume} and pc >= {s.price})"""


def spaced(source: str, keys: str, gap: int, name: str = "kept") -> str:
    """Greedy spacing by recursion: the next row at least gap after the last kept one."""
    on = " and ".join(f"c.{k} = k.{k}" for k in keys.split(", "))
    return f"""{name}_c as (select distinct {keys}, rn from {source}),
{name} as (select {keys}, min(rn) as rn from {name}_c group by {keys}
  union all select {', '.join('k.' + k for k in keys.split(', '))}, (select min(c.rn) from {name}_c c where {on} and c.rn >= k.rn + {gap}) as rn from {name} k where exists (select 1 from {name}_c c where {on} and c.rn >= k.rn + {gap}))"""


def trades(s: SignalSpec) -> str:
    cols = ", ".join(f"round(f{h} * 100, 2) as fwd_{h}d_pct, round(b{h} * 100, 2) as base_{h}d_pct, round((f{h} - b{h}) * 100, 2) as excess_{h}d_pct" for h in (5, 10, 20, 30))
    return f"""{measured(s)}, {spaced('fire', 'ticker', s.gap)}, {UNIVERSE},
t as (select m.ticker, coalesce(category, '') as category, in_original, cap_busd, m.session, m.rn, round(close + 1e-7, 2) as price, round(vr, 2) as volume_ratio, round(pc * 100, 1) as price_change_pct, {cols}
  from kept join m on kept.ticker = m.ticker and kept.rn = m.rn left join b on b.session = m.session left join uni on uni.ticker = m.ticker)"""


SIZE = "case when cap_busd is null then 'unknown' when cap_busd < 2 then 'small (<2B)' when cap_busd < 10 then 'mid (2-10B)' when cap_busd < 50 then 'large (10-50B)' else 'mega (50B+)' end"
LASTING = "case when days is null then 'unknown' when days <= 2 then '1-2 days' when days <= 5 then '3-5 days' when days <= 9 then '6-9 days' else '10+ days' end"


def lasting(window: int) -> str:
    s = LOOSE
    return f"""{trades(s)}, q as (select ticker, session, cast(sum(case when vr >= {s.volume} and pc >= {s.price} then 1 else 0 end) over (partition by ticker order by session rows between {window - 1} preceding and current row) as bigint) as days from m),
l as (select t.*, q.days, excess_20d_pct as x from t join q on q.ticker = t.ticker and q.session = t.session where excess_20d_pct is not null)"""


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0::double as {name}"


def library() -> str:
    c = "close"
    up = "case when coalesce(ret > 0, false) then {} else {} end".format
    one = f"""{panel(metrics.MIN_BARS)}, one as (select *, close / nullif({lag(c, 1)}, 0) - 1 as ret, close - {lag(c, 1)} as step, greatest(high - low, abs(high - {lag(c, 1)}), abs(low - {lag(c, 1)})) as tr,
  coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume as flow from p)"""
    pre = f"""pre as (select *, case when coalesce(ret > 0, false) then dv else 0.0 end as updv, coalesce(sign(ret) * volume, 0) as obvs, {up('1.0', '0.0')} as isup,
  case when coalesce(abs(ret) > 0.05, false) then 1.0 else 0.0 end as isgap, ln(close) as lnc,
  case when step is not null then greatest(step, 0) end * (case when rn = 2 then 1 else 1.0/14 end) * pow(13.0/14, -(rn - 2)) as g, case when step is not null then greatest(-step, 0) end * (case when rn = 2 then 1 else 1.0/14 end) * pow(13.0/14, -(rn - 2)) as l from one)"""
    run = "over (partition by ticker order by session rows unbounded preceding)"
    w63 = "over (partition by ticker order by session rows between 62 preceding and current row)"
    pct = lambda b: f"(close / nullif({b}, 0) - 1) * 100"
    two = {
        "vol_ratio_10_63": ratio(10, 63, False), "vol_ratio_5_21": ratio(5, 21, False), "vol_ratio_21_126": ratio(21, 126, False), "dollar_vol_musd": f"({agg('avg', 'dv', 10)}) / 1e6",
        "share_vol_ratio": ratio(10, 63, False, "volume"), "up_volume_share": f"({agg('sum', 'updv', 21)}) / nullif({agg('sum', 'dv', 21)}, 0)",
        "obv": f"sum(obvs) {run}", "ad": f"sum(flow) {run}", "m21dv": agg("avg", "dv", 21), "m21v": agg("avg", "volume", 21),
        **{f"return_{n}d_pct": f"{change(c, n)} * 100" for n in (5, 10, 21, 63, 126)}, "momentum_accel": f"({change(c, 10)} - {change(c, 21)}) * 100",
        "pct_off_52w_high": pct(agg("max", c, 252, 60)), "pct_above_52w_low": pct(agg("min", c, 252, 60)), "pct_vs_ma50": pct(agg("avg", c, 50)), "pct_vs_ma200": pct(agg("avg", c, 200)),
        "ma50_vs_ma200": f"(({agg('avg', c, 50)}) / nullif({agg('avg', c, 200)}, 0) - 1) * 100",
        "close_in_21d_range": f"(close - ({agg('min', 'low', 21)})) / nullif(({agg('max', 'high', 21)}) - ({agg('min', 'low', 21)}), 0)",
        "volatility_20d_pct": f"({agg('stddev_samp', 'ret', 20)}) * sqrt(252) * 100", "volatility_60d_pct": f"({agg('stddev_samp', 'ret', 60)}) * sqrt(252) * 100",
        "vol_of_vol": f"({agg('stddev_samp', 'ret', 20)}) / nullif({agg('stddev_samp', 'ret', 60)}, 0)", "atr_pct": f"({agg('avg', 'tr', 14)}) / nullif(close, 0) * 100",
        "bollinger_width_pct": f"({agg('stddev_samp', 'ret', 20)}) * 400", "gains": f"case when rn >= 2 then sum(g) {run} end", "losses": f"case when rn >= 2 then sum(l) {run} end",
        "pct_up_days_21": f"({agg('avg', 'isup', 21)}) * 100", "max_dd_63d_pct": pct(agg("max", c, 63)), "return_skew_63": agg("skewness", "ret", 63),
        "trend_r2_63": f"case when count(lnc) {w63} = 63 and var_pop(lnc) {w63} > 0 then regr_r2(lnc, rn) {w63} end", "gap_freq_21": f"({agg('avg', 'isgap', 21)}) * 100",
    }
    two_sql = ", ".join(f"{v} as {k}" for k, v in two.items())
    return f"""{one}, {pre}, two as (select *, {two_sql} from pre),
lib as (select *, (obv - {lag('obv', 21)}) / nullif(m21dv, 0) as obv_slope_21, (ad - {lag('ad', 21)}) / nullif(m21v, 0) as ad_slope_21, 100 - 100 / (1 + gains / nullif(losses, 0)) as rsi_14 from two)"""


PER = "per as (select * from (values " + ", ".join(f"('{a}', date '{b}', date '{c}')" for a, b, c in PERIODS) + ") as v(period, first, last))"


def section() -> str:
    picks = ", ".join(f"max(case when k = 1 then {m} end) as {m}" for m in metrics.METRICS)
    return f"""{library()}, {PER}, sx as (select per.period, lib.*, row_number() over (partition by per.period, ticker order by session) as k, row_number() over (partition by per.period, ticker order by session desc) as kd from lib join per on session between first and last),
sy as (select period, ticker, count(*) as n, max(case when kd = 1 then close end) / max(case when k = 1 then close end) - 1 as move, {picks} from sx group by 1, 2 having count(*) >= 20),
sec as (select *, move >= 0.1 as rose, move <= -0.1 as fell from sy)"""


def long_section(extra: str = "") -> str:
    names = ", ".join(metrics.METRICS)
    return f"{section()}, sl as (select * from (select period, ticker, rose, fell{extra}, {names} from sec) unpivot include nulls (value for metric in ({names})))"


def seps(label: str, name: str, source: str = "sl", keys: str = "period") -> str:
    a, b = f"filter (where {label})", f"filter (where not {label})"
    pooled = f"sqrt((var_samp(value) {a} + var_samp(value) {b}) / 2)"
    return f"""{name} as (select {keys}, metric, case when count(value) {a} >= 8 and count(value) {b} >= 8 then case when {pooled} > 0 then (avg(value) {a} - avg(value) {b}) / {pooled} else 0 end end as sep
  from {source} group by {keys}, metric having count(*) {a} >= 8 and count(*) {b} >= 8)"""


def draw(x: str) -> str:
    return f"cast('0x' || substr(md5({x}), 1, 7) as bigint)"


def bootstrap(items: str) -> str:
    return f"""with recursive {trades(LIVE)}, e as (select ticker, rn, excess_20d_pct as x from t where excess_20d_pct is not null), i as ({items}),
d as (select rep, slot, {draw("cast(rep as varchar) || ':' || cast(slot as varchar)")} % n as pick from i, (select unnest(range({REPS})) as rep)),
m2 as (select rep, sum(s) / sum(c) as m from d join (select slot as pick, s, c from i) j on j.pick = d.pick group by rep)
select a.*, o.*, case when low > 0 then 'above zero' when high < 0 then 'below zero' else 'includes zero' end as verdict
from (select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, round(avg(case when m <= 0 then 1.0 else 0.0 end), 6) as share_le_0, count(*) as reps from m2) a,
 (select round(avg(x), 6) as observed, count(x) as n from e) o"""


def sweeping(combos: list[tuple[int, int, bool]]) -> str:
    cells = ", ".join(f"{ratio(r, b, s)} as c{i}" for i, (r, b, s) in enumerate(combos))
    rows = " union all ".join(f"select period, oc, {r} as recent, {b} as base, {str(s).lower()} as separate, c{i} as ratio from w2" for i, (r, b, s) in enumerate(combos))
    return f"""{panel(150)}, {PER}, w1 as (select *, {ahead(10)} as move, {cells} from p),
w2 as (select *, case when move >= 0.1 then 'rise' when move <= -0.1 then 'fall' else 'flat' end as oc from w1 join per on session between first and last where move is not null),
w3 as (select * from ({rows}) where ratio is not null)"""


def counted(keys: str, source: str) -> str:
    n = ", ".join(f"count(*) filter (where oc = '{k}') as n_{k}, count(*) filter (where oc = '{k}' and ratio >= trigger) as fired_{k}" for k in ("rise", "fall", "flat"))
    return f"select {keys}, {n} from {source} group by {keys}"


SWEEP = f"""with {sweeping([(r, b, True) for r, b in WINDOW_GRID])}, g as (select unnest([{', '.join(f'{t}::double' for t in TRIGGERS)}]) as trigger),
c as ({counted('recent, base, trigger', 'w3, g')}), d as (select *, fired_rise + fired_fall + fired_flat as f, n_rise + n_fall + n_flat as n from c where n_rise > 0 and n_fall > 0),
sw as (select recent, base, trigger, f as n_fired, {r6('fired_rise * 100.0 / nullif(n_rise, 0)', 'rate_rise')}, {r6('fired_fall * 100.0 / nullif(n_fall, 0)', 'rate_fall')}, {r6('fired_flat * 100.0 / nullif(n_flat, 0)', 'rate_flat')},
 {r6('f * 100.0 / n', 'fire_rate')}, {r6('fired_rise * 100.0 / nullif(f, 0)', 'precision')}, {r6('n_rise * 100.0 / n', 'base_rate')}, {r6('fired_rise * 100.0 / nullif(f, 0) - n_rise * 100.0 / n', 'edge')} from d)"""


def both_sided(keys: str, separate: list[bool]) -> str:
    combos = sorted({(r, b, s) for r, b, _ in PREREGISTERED for s in separate})
    cells = ", ".join(f"({r}, {b}, {t}::double)" for r, b, t in PREREGISTERED)
    return f"""with {sweeping(combos)}, g as (select * from (values {cells}) as v(recent, base, trigger)), w4 as (select w3.*, trigger from w3 join g on g.recent = w3.recent and g.base = w3.base),
c as ({counted(keys, 'w4')}), d as (select *, fired_rise + fired_fall + fired_flat as f, n_rise + n_fall + n_flat as n from c where fired_rise + fired_fall + fired_flat > 0),
bs as (select {keys}, f as n_fired, round(f * 100.0 / n, 2) as fire_rate_pct, round(fired_rise * 100.0 / f, 2) as rise_prec_pct, round(n_rise * 100.0 / n, 2) as rise_base_pct, round(fired_rise * 100.0 / f - n_rise * 100.0 / n, 2) as rise_edge_pp,
 round(fired_fall * 100.0 / f, 2) as fall_prec_pct, round(n_fall * 100.0 / n, 2) as fall_base_pct, round(fired_fall * 100.0 / f - n_fall * 100.0 / n, 2) as fall_edge_pp,
 round(fired_rise * 100.0 / nullif(fired_rise + fired_fall, 0), 2) as cond_rise_share_pct, round(n_rise * 100.0 / nullif(n_rise + n_fall, 0), 2) as cond_base_share_pct,
 round(fired_rise * 100.0 / nullif(fired_rise + fired_fall, 0) - n_rise * 100.0 / nullif(n_rise + n_fall, 0), 2) as direction_edge_pp from d)"""


def events() -> str:
    inside = "m.rn > 40 and m.rn - 1 + 30 < n_bars"
    base = "avg(dv) filter (where day between -40 and -22)"
    return f"""with recursive {panel(200)}, m as (select *, {ratio(10, 63, False)} as ratio, {ahead(10)} as fwd from p), u0 as (select * from m where fwd >= 0.1), d0 as (select * from m where fwd <= -0.1),
{spaced('u0', 'ticker', 30, 'ku')}, {spaced('d0', 'ticker', 30, 'kd')},
ev as (select 'up' as kind, m.ticker, m.rn as at0 from ku join m on ku.ticker = m.ticker and ku.rn = m.rn where {inside} union all select 'down', m.ticker, m.rn from kd join m on kd.ticker = m.ticker and kd.rn = m.rn where {inside}
 union all select 'random', ticker, 41 + {draw("ticker || ':' || cast(slot as varchar)")} % (n_bars - 70) from (select distinct ticker, n_bars from m where n_bars > 70), (select unnest(range(3)) as slot)),
e2 as (select *, row_number() over (order by kind, ticker, at0) as id from ev), near as (select id, kind, rn - at0 as day, dv, ratio from e2 join m on m.ticker = e2.ticker and m.rn between at0 - 40 and at0 + 20),
bb as (select id, {base} as base from near group by id having {base} > 0),
cu as (select kind, day, {r6('avg(dv / base)', 'rel_volume')}, {r6('avg(ratio)', 'ratio')}, count(*) as n from near join bb on bb.id = near.id where day >= -20 group by kind, day)"""


def exit_rows(s: SignalSpec = LIVE, least: int = 0) -> str:
    first = lambda cond: f"coalesce(min(case when {cond} then off end), max(off))"
    rules = {
        **{f"fixed_{n}": f"least({n}, max(off))" for n in (10, 20, 30, 60)}, "volume_decay": first("vr < 1.0"), "signal_death": first(f"not coalesce(vr >= {s.volume} and pc >= {s.price}, false)"),
        **{f"trailing_{p}": first(f"c <= peak * (1 - {p} / 100.0::double)") for p in (10, 15, 20)}, "ma20_break": first("c < ma20"),
    }
    offs = ", ".join(f"{v} as {k}" for k, v in rules.items())
    stack = " union all ".join(f"select ticker, at0, entry, c0, '{k}' as rule, {i} as rule_order, {k} as off from offs" for i, k in enumerate(rules))
    w = "over (partition by ticker, at0 order by off rows unbounded preceding)"
    days = f"(select *, sum(case when vr >= {s.volume} and pc >= {s.price} then 1 else 0 end) over (partition by ticker order by session rows between 13 preceding and current row) as days from m)"
    return f"""with recursive {measured(s)}, {spaced('fire', 'ticker', s.gap)}, mm as (select *, {agg('avg', 'close', 20)} as ma20 from m),
en as (select m.ticker, m.rn as at0, m.session as entry, m.close as c0 from kept join {days} m on kept.ticker = m.ticker and kept.rn = m.rn where days >= {least}),
f1 as (select en.*, rn - at0 - 1 as off, mm.session as exit, mm.close as c, vr, pc, ma20 from en join mm on mm.ticker = en.ticker and rn between at0 + 1 and at0 + 90),
f2 as (select *, max(c) {w} as peak, greatest(max(c) {w}, c0) as high from f1), f3 as (select *, least(min(c / high - 1) {w}, 0) as worst from f2),
offs as (select ticker, at0, entry, c0, {offs} from f3 group by 1, 2, 3, 4 having count(*) >= 5), ex as ({stack}),
dn as (select ex.*, f3.exit, f3.c, f3.worst from ex join f3 on f3.ticker = ex.ticker and f3.at0 = ex.at0 and f3.off = ex.off),
pn as (select ticker, session, close from m where ticker in (select ticker from en)), ow as (select s.entry, s.exit, avg(q.close / p0.close - 1) as base from (select distinct entry, exit from dn) s join pn p0 on p0.session = s.entry join pn q on q.session = s.exit and q.ticker = p0.ticker group by 1, 2),
tr as (select rule, rule_order, dn.ticker, dn.entry, dn.exit, off + 1 as hold_days, {r6('(c / c0 - 1) * 100', 'return_pct')}, {r6('base * 100', 'baseline_pct')}, {r6('((c / c0 - 1) - base) * 100', 'excess_pct')}, {r6('worst * 100', 'max_drawdown_pct')} from dn left join ow on ow.entry = dn.entry and ow.exit = dn.exit)"""


CASH = """st as (select 'S' || lpad(cast(l_suppkey as varchar), 6, '0') as ticker, l_returnflag as label, date_trunc('quarter', cast(l_shipdate as date)) as quarter, sum(l_extendedprice * (1 - l_discount) * (case when l_returnflag = 'R' then -1.0 else 1.0 end)) as value from lineitem group by 1, 2, 3),
sr as (select *, row_number() over (partition by ticker, label order by quarter desc) as k, count(*) over (partition by ticker, label) as n, case label when 'N' then 0 when 'A' then 1 else 2 end as pr from st),
sp as (select ticker, pr, max(n) as n, sum(value) filter (where k <= 4) as v, row_number() over (partition by ticker order by pr) as o from sr group by ticker, pr), cash as (select ticker, case when n >= 4 then v end as cash from sp where o = 1)"""
SCREEN = f"""{panel(41)}, {UNIVERSE}, {CASH}, n0 as (select *, {agg('avg', 'dv', 10)} as r, {agg('avg', 'dv', 30, shift=10)} as bs, {change('close', 10)} as pc from p),
n1 as (select n0.*, r / bs as vr, category, exchange, cap_busd, cash from n0 left join uni on uni.ticker = n0.ticker left join cash on cash.ticker = n0.ticker where rn = n_bars and bs > 0),
n2 as (select *, coalesce(vr >= {LIVE.volume}, false) as pass_volume, coalesce(pc >= {LIVE.price}, false) as pass_price, coalesce(cash > 0, false) as pass_cfo, coalesce(cap_busd, 0) >= 0 as pass_cap from n1),
scr as (select ticker, coalesce(category, '') as category, coalesce(exchange, '') as exchange, round(close + 1e-7, 2) as price, round(pc * 100, 1) as price_change_pct, round(vr, 2) as volume_ratio, round(r / 1e6, 1) as recent_dollar_vol_musd, round(cash / 1e6, 1) as ttm_cfo_musd,
 round(cap_busd, 2) as market_cap_busd, pass_volume, pass_price, pass_cfo, pass_cap, pass_volume and pass_price and pass_cfo and pass_cap as is_match, session as bar_date from n2)"""


def raw(s: SignalSpec) -> str:
    return f"with {measured(s)} select ticker, session, rn, {r6('vr', 'volume_ratio')}, {r6('pc', 'price_change')} from fire"


def dedup(s: SignalSpec) -> str:
    return f"with recursive {measured(s)}, {spaced('fire', 'ticker', s.gap)} select fire.ticker, session, fire.rn, {r6('vr', 'volume_ratio')}, {r6('pc', 'price_change')} from fire join kept on kept.ticker = fire.ticker and kept.rn = fire.rn"


def bucketed(bucket: str, source: str, extremes: bool) -> str:
    more = f", max(fwd_20d_pct) as max_pct, min(fwd_20d_pct) as min_pct, {r6('median(excess_20d_pct)', 'median_excess_pct')}" if extremes else ""
    return f"select {bucket} as bucket, count(*) as n, {r6('avg(fwd_20d_pct)', 'mean_pct')}, {r6('median(fwd_20d_pct)', 'median_pct')}, {r6('avg(excess_20d_pct)', 'excess_pct')}, {r6('avg(case when excess_20d_pct > 0 then 1.0 else 0.0 end) * 100', 'beat_pct')}{more} from {source} where excess_20d_pct is not null group by 1"


_hit = "avg(case when {0} is null then null when {0} > 0 then 1.0 else 0.0 end) * 100".format
_horizons = " union all ".join(f"select {h} as horizon, fwd_{h}d_pct as fwd, base_{h}d_pct as base, excess_{h}d_pct as excess from t" for h in (5, 10, 20, 30))
_grid = ", ".join(f"({v}::double, {p}::double)" for v in VOLUME_GRID for p in PRICE_GRID)
_wide = ", ".join(f"{r6(f'''avg(x) filter (where b = '{k}')''', f'{n}_mean')}, count(x) filter (where b = '{k}') as {n}_n" for k, n in (("1-2 days", "d1_2"), ("3-5 days", "d3_5"), ("6-9 days", "d6_9"), ("10+ days", "d10")))
_beat = "avg(case when x > 0 then 1.0 else 0.0 end) * 100"
_brands = ", ".join(f"'{b}'" for b in regime.RISK_ON + regime.RISK_OFF + regime.OTHER)
_in = lambda names: ", ".join(f"'{b}'" for b in names)
ASSETS = f"""px as (select p_brand as asset, cast(l_shipdate as date) as session, avg(l_extendedprice) as close from lineitem join part on l_partkey = p_partkey where p_brand in ({_brands}) group by 1, 2), {PER},
ar as (select period, asset, round((arg_max(close, session) / arg_min(close, session) - 1) * 100, 2) as return_pct from px join per on session between first and last group by 1, 2 having count(*) >= 20),
rs as (select period, round(avg(return_pct) filter (where asset in ({_in(regime.RISK_ON)})) - avg(return_pct) filter (where asset in ({_in(regime.RISK_OFF)})), 2) as score from ar group by period),
rg as (select period, score, case when score is null then '?' when score >= 8 then 'strong risk-on' when score >= 2 then 'risk-on' when score > -2 then 'mixed' when score > -8 then 'risk-off' else 'strong risk-off' end as regime, coalesce(score < 0, false) as rotation from rs)"""
LOG = """lg as (select row_number() over (order by day) as position, day as date, case when errors * 5 > n then 'error' else 'ok' end as status from (select cast(ts as date) as day, sum(case when event_type = 'error' then 1 else 0 end) as errors, count(*) as n from events group by 1)),
lo as (select * from lg), an as (select max(date) as anchor from lo), wn as (select lo.* from lo, an where date between anchor - 27 and anchor and isodow(date) < 6)"""
SESSIONS = "se as (select distinct 'U' || cast(user_id as varchar) as ticker, cast(ts as date) as session from events where event_type <> 'error')"
ARCHIVED = f"{panel(41)}, ad as (select session as as_of, ticker from p where rn <= n_bars - 2 or ticker < 'S000003')"
TWO = f"('{PERIODS[0][0]}', '{PERIODS[2][0]}')"
H2 = _in(p for p, *_ in PERIODS if p.endswith("H2"))
_pass = "case when count(distinct sign(sep)) = 1 and count(sep) = count(*) and min(abs(sep)) >= 0.3 then true else false end"

_SQL: dict[str, str] = {
    "universe_filter": f"with {UNIVERSE} select ticker, category, exchange from uni where exchange = 'NASDAQ' order by position limit 50",
    "bars_clean": f"with {panel(41)} select ticker, session, {r6('close', 'close')}, {r6('high', 'high')}, {r6('low', 'low')}, {r6('volume', 'volume')}, rn, n_bars from p",
    "dollar_volume_ratio_separate": f"with {measured(LIVE)} select ticker, session, {r6('vr', 'volume_ratio')} from m where vr is not null",
    "dollar_volume_ratio_overlapping": f"with {measured(LEGACY)} select ticker, session, {r6('vr', 'volume_ratio')}, 6.3::double as ceiling from m where vr is not null",
    "screen_latest": f"with {SCREEN} select * from scr",
    "ttm_cash_flow": f"with {CASH} select ticker, round(cash, 4) as cash from cash",
    "near_misses": f"with {SCREEN} select ticker, volume_ratio, price_change_pct, round(greatest(({LIVE.volume}::double - volume_ratio) / {LIVE.volume}, 0) + greatest(({LIVE.price * 100!r}::double - price_change_pct) / {LIVE.price * 100!r}, 0), 6) as distance from scr where not is_match and pass_cfo and price_change_pct is not null order by distance, ticker limit 3",
    "data_quality_guard": f"with {SCREEN} select count(*) as n, count(*) filter (where price_change_pct is null) as missing, count(*) filter (where price_change_pct is null) <= count(*) * 0.1 as acceptable from scr",
    "modal_session": f"with {SCREEN} select bar_date, count(*) as n from scr group by 1 order by n desc, bar_date limit 1",
    "fundamentals_cache": f"""with {UNIVERSE} select ticker, case when position % 2 = 0 and position % 14 < 7 then position * 2.0::double else position::double end as cash, case when position % 2 = 0 and position % 14 < 7 then 1.0::double else cap_busd end as cap_busd,
      date '2024-01-30' - cast(case when position % 2 = 0 and position % 14 < 7 then position % 14 else 0 end as integer) as fetched, position % 2 = 0 and position % 14 < 7 as reused from uni""",
    **{f"metrics_{k}": f"with {library()} select ticker, session, {', '.join(r6(f'{m} + {TIE}', m) for m in names)} from lib" for k, names in metrics.FAMILIES.items()},
    "forward_returns": f"with {measured(LIVE)} select ticker, session, {', '.join(r6(f'f{h}', f'fwd_{h}d') for h in (5, 10, 20, 30))} from m",
    "signals_raw": raw(LIVE), "signals_raw_legacy": raw(LEGACY), "signals_dedup": dedup(LIVE), "signals_dedup_legacy": dedup(LEGACY),
    "date_matched_baseline": f"with {measured(LIVE)} select session, {', '.join(r6(f'b{h}', f'base_{h}d') for h in (5, 10, 20, 30))} from b",
    "backtest_signals": f"with recursive {trades(LIVE)} select * exclude (rn, in_original, cap_busd) from t",
    "horizon_summary": f"with recursive {trades(LIVE)}, h as ({_horizons}) select horizon, count(fwd) as n, {r6('avg(fwd)', 'mean_pct')}, {r6('median(fwd)', 'median_pct')}, {r6('avg(base)', 'base_pct')}, {r6('avg(excess)', 'excess_pct')}, {r6(_hit('fwd'), 'hit_pct')}, {r6(_hit('excess'), 'beat_pct')}, max(fwd) as max_pct, min(fwd) as min_pct from h group by horizon",
    "category_summary": f"with recursive {trades(LIVE)} select category, count(*) as n, {r6('avg(fwd_20d_pct)', 'mean_pct')}, {r6('avg(excess_20d_pct)', 'excess_pct')}, {r6('avg(case when fwd_20d_pct > 0 then 1.0 else 0.0 end) * 100', 'hit_pct')} from t group by 1",
    "threshold_sweep": f"""with recursive {measured(LIVE)}, g as (select * from (values {_grid}) as v(vol_thr, price_thr)), ht as (select m.*, vol_thr, price_thr from m join g on vr >= vol_thr and pc >= price_thr), {spaced('ht', 'ticker, vol_thr, price_thr', 10)},
      k as (select vol_thr, price_thr, round(f20 * 100, 2) as fwd, round((f20 - b20) * 100, 2) as x from kept join m on kept.ticker = m.ticker and kept.rn = m.rn left join b on b.session = m.session)
      select vol_thr, price_thr, count(*) as n, {r6('avg(fwd)', 'mean_pct')}, {r6('avg(x)', 'excess_pct')}, {r6(_beat, 'beat_pct')} from k where x is not null group by 1, 2 having count(*) >= 10""",
    "size_summary": f"with recursive {trades(LIVE)} {bucketed(SIZE, 't', True)}",
    "persistence_summary": f"with recursive {lasting(14)} {bucketed(LASTING, 'l', False)}",
    "size_x_persistence": f"with recursive {lasting(14)}, b2 as (select {SIZE} as size, {LASTING} as b, x from l) select size, {_wide} from b2 group by size",
    "top_contributors_excluded": f"with recursive {trades(LIVE)}, e as (select ticker, excess_20d_pct as x from t where excess_20d_pct is not null), tp as (select ticker from e group by ticker order by round(sum(x), 6) desc, ticker limit 3) select 'all' as subset, count(*) as n, {r6('avg(x)', 'excess_pct')}, {r6(_beat, 'beat_pct')} from e union all select 'without_top_3', count(*), round(avg(x), 6), round({_beat}, 6) from e where ticker not in (select ticker from tp)",
    "persistence_sweep": f"""with recursive {lasting(14)} select k::integer as k, count(x) filter (where days >= k) as n_above, count(x) filter (where days < k) as n_below, {r6('avg(x) filter (where days >= k)', 'mean_above')}, {r6('avg(x) filter (where days < k)', 'mean_below')},
      {r6('avg(x) filter (where days >= k) - avg(x) filter (where days < k)', 'gap')}, {r6('avg(case when x > 0 then 1.0 else 0.0 end) filter (where days >= k) * 100', 'beat_above')}, {r6('median(x) filter (where days >= k)', 'median_above')} from l, (select unnest(range(2, 15)) as k) group by 1 having count(x) filter (where days >= k) >= 25 and count(x) filter (where days < k) >= 25""",
    "universe_bias": f"""with recursive {lasting(10)}, g as (select *, 'all' as grp from l union all select *, case when in_original then 'original' else 'added' end from l) select grp, count(*) as n, count(distinct ticker) as tickers, {r6('avg(x)', 'mean')}, {r6('median(x)', 'median')}, {r6(_beat, 'beat_pct')},
      case when count(x) filter (where days >= 8) >= 10 and count(x) filter (where days < 8) >= 10 then round(avg(x) filter (where days >= 8) - avg(x) filter (where days < 8), 6) end as persistent_gap from g group by grp""",
    "bootstrap_clustered": bootstrap("select row_number() over (order by ticker) - 1 as slot, count(*) over () as n, sum(x) as s, count(x) as c from e group by ticker"),
    "bootstrap_naive": bootstrap("select row_number() over (order by ticker, rn) - 1 as slot, count(*) over () as n, x as s, 1 as c from e"),
    "exit_trades": f"{exit_rows()} select * exclude (rule_order) from tr",
    "exit_summary": f"{exit_rows()} select rule, rule_order, count(*) as n, {r6('avg(hold_days)', 'mean_hold')}, {r6('avg(return_pct)', 'mean_pct')}, {r6('median(return_pct)', 'median_pct')}, {r6('avg(excess_pct)', 'excess_pct')}, {r6('median(excess_pct)', 'median_excess_pct')}, {r6('avg(case when excess_pct > 0 then 1.0 else 0.0 end) * 100', 'beat_pct')}, {r6('avg(max_drawdown_pct)', 'mean_drawdown_pct')}, min(max_drawdown_pct) as worst_pct from tr group by 1, 2",
    "period_cross_section": f"with {section()} select period, ticker, round(move * 100, 2) + 0.0::double as period_return_pct, rose, fell, {', '.join(r6(m, m) for m in metrics.METRICS)} from sec",
    "base_rates": f"with {section()} select period, round(avg(case when rose then 1.0 else 0.0 end) * 100, 6) as base_rate from sec group by period",
    "separations": f"with {long_section()}, {seps('rose', 'sp2')} select period, metric, {r6('sep', 'sep')} from sp2",
    "two_period_pass": f"with {long_section()}, {seps('rose', 'sp2')} select metric, count(*) as n, {r6('min(abs(sep))', 'min_abs')}, {_pass} as passes from sp2 where period in {TWO} group by metric",
    "multi_period_score": f"with {long_section()}, {seps('rose', 'sp2')}, a as (select metric, count(distinct sign(sep)) = 1 as same_direction, count(*) filter (where abs(sep) >= 0.3) as n_meaningful, {r6('avg(sep)', 'mean_sep')}, {r6('min(abs(sep))', 'worst_abs')} from sp2 group by metric) select *, same_direction and n_meaningful >= 4 as passes from a",
    "seasonality": f"with {long_section()}, {seps('rose', 'sp2')}, a as (select metric, round(avg(sep) filter (where period in ({H2})), 2) + 0.0::double as chosen, round(avg(sep) filter (where period not in ({H2})), 2) + 0.0::double as other from sp2 group by metric) select *, round(chosen - other, 2) + 0.0::double as gap, coalesce(abs(chosen) >= 0.3 and abs(other) < 0.15, false) as chosen_only from a",
    "mirror_test": f"with {long_section()}, {seps('rose', 'su')}, {seps('fell', 'sd')}, a as (select metric, avg(sep) as up from su group by metric), b2 as (select metric, avg(sep) as down from sd group by metric) select a.metric, {r6('up', 'up')}, {r6('down', 'down')}, case when sign(up) = sign(down) and abs(down) >= 0.2 then 'MAGNITUDE' else 'direction' end as kind from a join b2 on a.metric = b2.metric",
    "permutation_null": f"""with {long_section()}, mk as (select period, ticker, sum(case when rose then 1 else 0 end) over (partition by period) as n1 from sec where period in {TWO}), rp as (select unnest(range({SHUFFLES_TWO})) as rep),
      dl as (select rep, period, ticker, row_number() over (partition by rep, period order by {draw("cast(rep as varchar) || ':' || period || ':' || ticker")}, ticker) <= n1 as lucky from mk, rp), pl as (select dl.rep, sl.period, sl.metric, sl.value, dl.lucky from dl join sl on sl.period = dl.period and sl.ticker = dl.ticker),
      {seps('lucky', 'sq', 'pl', 'rep, period')}, ps as (select rep, metric, {_pass} as passes from sq group by rep, metric having count(*) = 2) select rep::integer as rep, count(*) filter (where passes) as hits from ps group by rep""",
    "event_curves": f"{events()} select * from cu",
    "event_window_summary": f"""{events()}, ew as (select kind, avg(rel_volume) filter (where day between -10 and -1) as b0, avg(rel_volume) filter (where day between 0 and 2) as a0, avg(rel_volume) filter (where day between 3 and 12) as f0 from cu group by kind)
      select e.kind, {r6('e.b0', '"before"')}, {r6('e.a0', '"at"')}, {r6('e.f0', '"after"')}, {r6('e.b0 - r.b0', 'net_before')}, {r6('e.a0 - r.a0', 'net_at')}, {r6('e.f0 - r.f0', 'net_after')}, case when e.b0 - r.b0 > e.f0 - r.f0 then 'leads' else 'lags' end as verdict from ew e, ew r where e.kind <> 'random' and r.kind = 'random'""",
    "window_sweep": f"{SWEEP} select * from sw",
    "window_sweep_pivot": f"{SWEEP} select recent, base, {', '.join(f'max(fire_rate) filter (where trigger = {t}) as t{int(round(t * 100))}' for t in TRIGGERS)} from sw group by 1, 2",
    "window_sweep_best": f"{SWEEP} select * from sw order by edge desc, recent, base, trigger limit 1",
    "volume_validation": f"{both_sided('recent, base, trigger, separate', [False, True])} select *, case when not separate then round(base / recent::double, 6) end as ceiling from bs",
    "quarter_stability": f"{both_sided('recent, base, trigger, period', [True])}, s2 as (select recent, base, trigger, count(*) filter (where rise_edge_pp > 0) as positive, count(rise_edge_pp) as n, min(rise_edge_pp) as worst from bs group by 1, 2, 3) select *, positive >= 5 and worst > 0 as passes from s2",
    "asset_period_returns": f"with {ASSETS} select * from ar",
    "regime_scores": f"with {ASSETS} select * from rg",
    "regime_correlation": f"""with {long_section()}, {seps('rose', 'sp2')}, {ASSETS.replace(PER + ',', '')}, br as (select period, round(avg(case when rose then 1.0 else 0.0 end) * 100, 6) as base_rate from sec group by period),
      rc as (select score, base_rate, round(sep, 6) as vol_sep from rg join br on br.period = rg.period left join sp2 on sp2.period = rg.period and metric = 'vol_ratio_10_63')
      select {', '.join(f'case when count(*) filter (where {a} is not null and {b} is not null) >= 4 then round(corr({a}, {b}), 6) end as corr_{a}_{b}' for a, b in (('score', 'vol_sep'), ('score', 'base_rate'), ('base_rate', 'vol_sep')))} from rc""",
    "streak_counts": f"""with {SESSIONS}, k as (select a.ticker, a.session, count(*) as streak, date_diff('day', min(b.session), a.session) + 1 as span from se a join se b on a.ticker = b.ticker and b.session between a.session - 14 and a.session group by 1, 2)
      select ticker, session, streak, span, case when streak <= 1 then 'new' when streak >= 8 then 'strong' else 'building' end as level, case when streak <= 1 then 'first qualifying day' else streak || ' qualifying days in ' || span end as label from k""",
    "runlog_stale": f"with {LOG}, al as (select * from lg union all select position + 1000, date, 'ok' from lg where position % 7 = 3), st2 as (select *, lag(date) over (order by position) as pd from al) select position, date, case when status = 'ok' and coalesce(date <= pd, false) then 'stale' else status end as status from st2 order by position desc limit 400",
    "weekly_summary": f"""with {LOG}, ag as (select count(distinct date) as actual_runs, count(*) filter (where status = 'ok') as ok_runs, count(*) filter (where status = 'error') as error_runs, count(*) filter (where status = 'stale') as stale_runs from wn),
      ex2 as (select anchor, cast(date_diff('day', anchor, date '2024-02-01') as integer) as lag_days, (select cast(count(*) as integer) from (select unnest(range(28)) as i) where isodow(anchor - cast(i as integer)) < 6) as expected_runs from an)
      select ex2.*, ag.*, expected_runs - actual_runs as missing_runs, case when error_runs > 0 then 'ERRORS' when lag_days > 3 then 'STALLED' when expected_runs - actual_runs > 0 then 'GAPS' else 'OK' end as health from ex2, ag""",
    "missing_sessions": f"with {LOG}, ds as (select anchor - cast(i as integer) as date from an, (select unnest(range(28)) as i)) select date from ds where isodow(date) < 6 and date not in (select date from lo)",
    "match_days": f"with {LOG}, {SESSIONS} select ticker, count(distinct session) as days from se where session in (select date from wn where status = 'ok') group by ticker",
    "persistent_names": f"with {SESSIONS} select ticker, count(distinct session) as days from se where session >= (select max(session) from se) - 14 group by ticker having count(distinct session) >= 8",
    "archive_increment": f"""with {ARCHIVED}, tk as (select count(distinct ticker) as e, max(session) as newest from p), dn as (select as_of from ad, tk group by as_of, e having count(*) >= e * 0.9), rc as (select *, row_number() over (partition by ticker order by session desc) as back from p)
      select ticker, session as as_of, {r6('close', 'close')}, {r6('volume', 'volume')}, session <> newest as backfilled from rc, tk where back <= 5 and session not in (select as_of from dn)""",
    "archive_coverage": f"with {ARCHIVED} select as_of, count(*) as n, count(*) >= 3 * 0.9 as complete from ad group by as_of",
}


def _null_of(sql: str, passing: str) -> str:
    return f"""with nl as ({sql}), fd as (select count(*) filter (where passes) as observed from ({passing}))
      select observed, count(*) as reps, round(avg(hits), 6) as null_mean, round(quantile_cont(hits, 0.95), 6) as null_p95, round(avg(case when hits >= observed then 1.0 else 0.0 end), 6) as p_value from nl, fd group by observed"""


_many = _SQL["permutation_null"].replace(f" where period in {TWO}", "").replace(f"range({SHUFFLES_TWO})", f"range({SHUFFLES_ALL})")
_many = _many[: _many.index("ps as (")] + "ps as (select rep, metric, count(distinct sign(sep)) = 1 and count(*) filter (where abs(sep) >= 0.3) >= 4 as passes from sq group by rep, metric) select rep::integer as rep, count(*) filter (where passes) as hits from ps group by rep"
_SQL |= {
    "bootstrap_width_ratio": f"select round(a.high - a.low, 6) as clustered, round(b.high - b.low, 6) as naive, round((a.high - a.low) / nullif(b.high - b.low, 0), 6) as ratio from ({_SQL['bootstrap_clustered']}) a, ({_SQL['bootstrap_naive']}) b",
    "bootstrap_persistent": _SQL["bootstrap_clustered"].replace(trades(LIVE), lasting(14)).replace("e as (select ticker, rn, excess_20d_pct as x from t where excess_20d_pct is not null)", "e as (select ticker, x from l where days >= 3)"),
    "best_persistence_gap": f"select * from ({_SQL['persistence_sweep']}) order by gap desc nulls last, k limit 1",
    "market_cap_estimate": f"""with recursive {trades(LIVE)}, ec as (select t.ticker, session, price * nullif(position % 5 * 1000000, 0) / 1e9 as est from t left join uni on uni.ticker = t.ticker)
      select ticker, session, {r6('est', 'est_cap_busd')}, {SIZE.replace('cap_busd', 'est * 100')} as bucket from ec""",
    "nearest_session": f"""with recursive {trades(LIVE)}, wq as (select distinct ticker, session + 45 as wanted from t), nr as (select wq.ticker, wanted, b.session, b.close, row_number() over (partition by wq.ticker, wanted order by abs(date_diff('day', b.session, wanted)), b.session desc) as k from wq join bars b on b.ticker = wq.ticker)
      select ticker, wanted, session, {r6('close', 'close')} from nr where k = 1""",
    "screen_matches": f"with {SCREEN} select ticker, volume_ratio, price_change_pct from scr where pass_volume and pass_price and pass_cap".replace(f"vr >= {LIVE.volume}", f"vr >= {LOOSE.volume}").replace(f"pc >= {LIVE.price}", f"pc >= {LOOSE.price}"),
    "category_ranking": _SQL["category_summary"],
    "threshold_sweep_top": f"select * from ({_SQL['threshold_sweep']}) order by excess_pct desc, vol_thr, price_thr limit 15",
    "window_sweep_top": f"select * from ({_SQL['window_sweep']}) order by edge desc, recent, base, trigger limit 12",
    "exit_summary_persistent": _SQL["exit_summary"].replace(exit_rows(), exit_rows(LOOSE, 3)),
    "best_exit_rules": f"""with es as ({_SQL['exit_summary']}), a as (select rule, excess_pct, mean_hold from es order by excess_pct desc, rule_order limit 1), b as (select rule, median_excess_pct from es order by median_excess_pct desc, rule_order limit 1)
      select a.rule as best_mean, excess_pct as mean_excess_pct, mean_hold, b.rule as best_median, median_excess_pct, a.rule <> b.rule as disagree from a, b""",
    "metric_survivors": f"select a.metric, coalesce(b.passes, false) as survived from ({_SQL['two_period_pass']}) a left join ({_SQL['multi_period_score']}) b on a.metric = b.metric where a.passes",
    "permutation_null_periods": _many,
    "permutation_test": _null_of(_SQL["permutation_null"], _SQL["two_period_pass"]),
    "permutation_test_periods": _null_of(_many, _SQL["multi_period_score"]),
    "event_curves_aligned": f"select day, max(rel_volume) filter (where kind = 'up') as up, max(rel_volume) filter (where kind = 'down') as down, max(rel_volume) filter (where kind = 'random') as random from ({_SQL['event_curves']}) group by day",
    "regime_against_screen": f"select a.*, b.base_rate from ({_SQL['regime_scores']}) a join ({_SQL['base_rates']}) b on a.period = b.period",
}

#: Columns that are compared as ISO text.
DATES = {
    **dict.fromkeys(("bars_clean", "dollar_volume_ratio_separate", "dollar_volume_ratio_overlapping", "forward_returns", "signals_raw", "signals_raw_legacy", "signals_dedup", "signals_dedup_legacy", "date_matched_baseline", "backtest_signals", "streak_counts", "market_cap_estimate"), ("session",)),
    **{f"metrics_{k}": ("session",) for k in metrics.FAMILIES},
    "nearest_session": ("wanted", "session"), "screen_latest": ("bar_date",), "modal_session": ("bar_date",), "fundamentals_cache": ("fetched",), "exit_trades": ("entry", "exit"), "runlog_stale": ("date",), "missing_sessions": ("date",),
    "weekly_summary": ("anchor",), "archive_increment": ("as_of",), "archive_coverage": ("as_of",),
}
ORACLE = {k: f"select * replace ({', '.join(f'cast({c} as varchar) as {c}' for c in DATES[k])}) from ({q}) as dated" if k in DATES else q for k, q in _SQL.items()}

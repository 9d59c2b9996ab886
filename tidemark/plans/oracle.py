"""DuckDB twins of the catalogue's queries, composed from common table expressions."""

from __future__ import annotations

W = "(PARTITION BY symbol ORDER BY time)"


def _rows(a: int, b: int) -> str:
    side = lambda n: "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"
    return f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {side(a)} AND {side(b)})"


UPTO = "(PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = "(PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

BARS = """bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar FROM (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS tick_volume FROM events GROUP BY 1, 2))"""
TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM bars)"
ATR = f"atr AS (SELECT *, CASE WHEN count(tr) OVER {_rows(-13, 0)} = 14 THEN avg(tr) OVER {_rows(-13, 0)} END AS atr FROM tr)"


def _pivot(column: str, n: int) -> str:
    agg = "max" if column == "high" else "min"
    return f"coalesce(lag({column}, {n}) OVER {W} = {agg}({column}) OVER {_rows(-2 * n, 0)} AND count({column}) OVER {_rows(-2 * n, 0)} = {2 * n + 1}, false)"


def _swing(prefix: str, n: int) -> str:
    return f"""{prefix}p AS (SELECT *, {_pivot('high', n)} AS {prefix}_ph, {_pivot('low', n)} AS {prefix}_pl, lag(atr, {n}) OVER {W} AS {prefix}_atr,
  lag(high, {n}) OVER {W} AS {prefix}_lh, lag(low, {n}) OVER {W} AS {prefix}_ll FROM {{source}}),
{prefix}s AS (SELECT *, CASE WHEN {prefix}_ph THEN {prefix}_lh END AS {prefix}_sh, CASE WHEN {prefix}_pl THEN {prefix}_ll END AS {prefix}_sl FROM {prefix}p),
{prefix}b AS (SELECT *, last_value({prefix}_sh IGNORE NULLS) OVER {BEFORE} AS {prefix}_bh, last_value({prefix}_sl IGNORE NULLS) OVER {BEFORE} AS {prefix}_bl FROM {prefix}s),
{prefix}l AS (SELECT *,
  CASE WHEN {prefix}_ph AND {prefix}_bh IS NOT NULL AND {prefix}_atr IS NOT NULL THEN CASE WHEN abs({prefix}_sh - {prefix}_bh) <= {prefix}_atr * CAST(0.1 AS DOUBLE) THEN 'EQH' WHEN {prefix}_sh > {prefix}_bh THEN 'HH' ELSE 'LH' END END AS {prefix}_hlab,
  CASE WHEN {prefix}_pl AND {prefix}_bl IS NOT NULL AND {prefix}_atr IS NOT NULL THEN CASE WHEN abs({prefix}_sl - {prefix}_bl) <= {prefix}_atr * CAST(0.1 AS DOUBLE) THEN 'EQL' WHEN {prefix}_sl > {prefix}_bl THEN 'HL' ELSE 'LL' END END AS {prefix}_llab FROM {prefix}b)"""


STRUCT = ",\n".join([
    BARS, TR, ATR, _swing("e", 8).format(source="atr"), _swing("n", 3).format(source="el"),
    f"""st AS (SELECT *, last_value(e_sh IGNORE NULLS) OVER {UPTO} AS sh, last_value(e_sl IGNORE NULLS) OVER {UPTO} AS sl,
  last_value(CASE WHEN e_ph THEN coalesce(e_hlab, '') END IGNORE NULLS) OVER {UPTO} AS hl, last_value(CASE WHEN e_pl THEN coalesce(e_llab, '') END IGNORE NULLS) OVER {UPTO} AS ll,
  last_value(CASE WHEN e_ph THEN bar END IGNORE NULLS) OVER {UPTO} AS hs, last_value(CASE WHEN e_pl THEN bar END IGNORE NULLS) OVER {UPTO} AS ls FROM nl)""",
    f"""sb AS (SELECT *, last_value(CASE WHEN close > sh THEN bar END IGNORE NULLS) OVER {BEFORE} AS hb, last_value(CASE WHEN close < sl THEN bar END IGNORE NULLS) OVER {BEFORE} AS lb FROM st)""",
    """sf AS (SELECT *, coalesce(close > sh, false) AND NOT coalesce(hb >= hs, false) AS up, coalesce(close < sl, false) AND NOT coalesce(lb >= ls, false) AS dn,
  coalesce(high > sh AND close <= sh, false) AND NOT coalesce(hb >= hs, false) AS sweep_high, coalesce(low < sl AND close >= sl, false) AND NOT coalesce(lb >= ls, false) AS sweep_low,
  CASE WHEN hl = 'HH' AND ll = 'HL' THEN 1 WHEN hl = 'LH' AND ll = 'LL' THEN -1 ELSE 0 END AS inf FROM sb)""",
    f"""t1 AS (SELECT *, coalesce(last_value(CASE WHEN dn THEN -1 WHEN up THEN 1 WHEN inf <> 0 THEN inf END IGNORE NULLS) OVER {UPTO}, 0) AS trend FROM sf)""",
    f"""t2 AS (SELECT *, CASE WHEN inf <> 0 THEN inf ELSE coalesce(lag(trend) OVER {W}, 0) END AS pre FROM t1)""",
    """stc AS (SELECT *, up AND pre >= 0 AS bos_up, up AND pre < 0 AS choch_up, dn AND (CASE WHEN up THEN 1 ELSE pre END) <= 0 AS bos_down, dn AND (CASE WHEN up THEN 1 ELSE pre END) > 0 AS choch_down,
  coalesce(abs(close - open) >= atr, false) AS pushed FROM t2)""",
])

PIP = "CAST(25.0 AS DOUBLE)"
_D = lambda x: f"CAST({x} AS DOUBLE)"
ZIN = f"""zin AS (SELECT *, {_pivot('high', 3)} AS ph, {_pivot('low', 3)} AS pl, high - low AS rng,
  coalesce(close > open AND abs(close - open) >= {_D(0.45)} * atr AND high - low >= {_D(0.75)} * atr AND (close - low) / nullif(high - low, 0) >= {_D(0.6)}, false) AS bull,
  coalesce(close < open AND abs(close - open) >= {_D(0.45)} * atr AND high - low >= {_D(0.75)} * atr AND (high - close) / nullif(high - low, 0) >= {_D(0.6)}, false) AS bear FROM atr)"""
ZCAND = f"""zb AS (SELECT *, lag(atr, 1) OVER {W} AS zatr, sum(rng) OVER {_rows(-3, 0)} / (least(2, bar - 1) + 2) AS mean, greatest(bar - 3, 0) AS bstart,
  max(high) OVER {_rows(-3, 0)} AS hi, min(low) OVER {_rows(-3, 0)} AS lo,
  last_value(CASE WHEN close < open THEN {{'o': open, 'h': high, 'l': low, 'c': close}} END IGNORE NULLS) OVER {_rows(-3, 0)} AS cb,
  last_value(CASE WHEN close > open THEN {{'o': open, 'h': high, 'l': low, 'c': close}} END IGNORE NULLS) OVER {_rows(-3, 0)} AS cs,
  lead(pl, 2) OVER {W} AS cpl, lead(ph, 2) OVER {W} AS cph,
  min(CASE WHEN bull THEN bar END) OVER {_rows(1, 5)} AS bd, min(CASE WHEN bear THEN bar END) OVER {_rows(1, 5)} AS sd FROM zin),
zq AS (SELECT * FROM zb WHERE zatr > 0 AND mean <= {_D(1.2)} * zatr AND bar >= 1),
zx AS (SELECT symbol, 'demand' AS side, greatest(bar + 2, bd) AS created, bar - 1 AS pivot_bar, bstart AS base_start, bar AS base_end, bd AS departure, zatr,
    CASE WHEN cb IS NOT NULL THEN greatest(cb.o, cb.c) ELSE greatest(open, close) END AS top, CASE WHEN cb IS NOT NULL THEN cb.l ELSE lo END AS bottom FROM zq WHERE cpl AND bd IS NOT NULL
  UNION ALL SELECT symbol, 'supply', greatest(bar + 2, sd), bar - 1, bstart, bar, sd, zatr,
    CASE WHEN cs IS NOT NULL THEN cs.h ELSE hi END, CASE WHEN cs IS NOT NULL THEN least(cs.o, cs.c) ELSE least(open, close) END FROM zq WHERE cph AND sd IS NOT NULL),
zy AS (SELECT *, CASE WHEN side = 'demand' THEN top ELSE bottom END AS entry, greatest({_D(0.03)} * zatr, {_D(12.5)}) AS buf FROM zx),
zz AS (SELECT *, CASE WHEN side = 'demand' THEN bottom - buf ELSE top + buf END AS stop, (top - bottom) / {PIP} AS width_pips FROM zy),
cand AS (SELECT *, abs(entry - stop) / {PIP} AS stop_pips FROM zz WHERE top > bottom AND width_pips <= 10 AND top - bottom >= zatr * {_D(0.03)} AND top - bottom <= zatr * {_D(1.5)} AND abs(entry - stop) / {PIP} <= 10)"""
ZACC = """num AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY created, pivot_bar) AS k FROM cand),
walk AS (SELECT symbol, side, k, created AS last, true AS ok FROM num WHERE k = 1
  UNION ALL SELECT n.symbol, n.side, n.k, CASE WHEN n.created - w.last >= 8 THEN n.created ELSE w.last END, n.created - w.last >= 8 FROM walk w JOIN num n ON n.symbol = w.symbol AND n.side = w.side AND n.k = w.k + 1),
acc AS (SELECT n.*, row_number() OVER (PARTITION BY n.symbol, n.side ORDER BY n.created, n.pivot_bar) AS zone_id FROM num n JOIN walk w USING (symbol, side, k) WHERE w.ok)"""
ZLIFE = f"""lf AS (SELECT z.symbol, z.side, z.zone_id, z.created, z.top, z.bottom, z.entry, z.stop, z.width_pips, z.stop_pips, b.bar, b.close, b.bar - z.created AS age, b.high >= z.bottom AND b.low <= z.top AS inside, coalesce(b.atr > 0, false) AS known,
  CASE WHEN z.side = 'demand' THEN b.close < z.bottom - {_D(0.05)} * b.atr ELSE b.close > z.top + {_D(0.05)} * b.atr END AS broke FROM acc z JOIN zin b ON b.symbol = z.symbol AND b.bar BETWEEN z.created AND z.created + 60),
lg AS (SELECT *, coalesce(last_value(CASE WHEN known THEN inside END IGNORE NULLS) OVER (PARTITION BY symbol, side, zone_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was FROM lf),
lr AS (SELECT *, CAST(sum(CASE WHEN known AND inside AND NOT was AND bar > created THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, side, zone_id ORDER BY bar) AS INTEGER) AS retests FROM lg),
life AS (SELECT *, max(CASE WHEN retests > 1 OR (known AND coalesce(broke, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, side, zone_id ORDER BY bar) = 0 AS alive, age > 0 AND inside AS touched FROM lr)"""
ZNEAR = """nz AS (SELECT * FROM life WHERE alive QUALIFY row_number() OVER (PARTITION BY symbol, bar, side ORDER BY abs(close - entry), created, zone_id) = 1)"""
ZCOLS = """zoned AS (SELECT b.*, d.entry AS d_entry, d.stop AS d_stop, d.top AS d_top, d.bottom AS d_bottom, d.retests AS d_ret, d.age AS d_age, s.entry AS s_entry, s.stop AS s_stop, s.top AS s_top, s.bottom AS s_bottom, s.retests AS s_ret, s.age AS s_age,
  coalesce(d.stop_pips <= 10 AND d.retests <= 1 AND d.age >= 1, false) AS d_valid, coalesce(s.stop_pips <= 10 AND s.retests <= 1 AND s.age >= 1, false) AS s_valid, coalesce(d.touched, false) AS d_touch, coalesce(s.touched, false) AS s_touch
  FROM zin b LEFT JOIN nz d ON d.symbol = b.symbol AND d.bar = b.bar AND d.side = 'demand' LEFT JOIN nz s ON s.symbol = b.symbol AND s.bar = b.bar AND s.side = 'supply')"""
_ZCHAIN = [BARS, TR, ATR, ZIN, ZCAND, ZACC, ZLIFE, ZNEAR, ZCOLS]


def _with(*parts: str) -> str:
    flat = ",\n".join(parts)
    return f"WITH {'RECURSIVE ' if 'walk AS' in flat or 'ewm AS' in flat else ''}{flat}\n"


def _z(upto: int) -> str:
    return _with(*_ZCHAIN[:upto])


def _session(time: str) -> str:
    return f"CASE WHEN hour({time}) < 8 THEN 'Asia' WHEN hour({time}) < 13 THEN 'London' WHEN hour({time}) < 22 THEN 'NewYork' END"


def _blocks(source: str) -> str:
    return f"""s0 AS (SELECT *, {_session('time')} AS session_name FROM {source}),
s1 AS (SELECT *, CASE WHEN lag(bar) OVER {W} IS NULL OR session_name IS DISTINCT FROM lag(session_name) OVER {W} OR date_trunc('day', time) <> lag(date_trunc('day', time)) OVER {W} THEN 1 ELSE 0 END AS fresh FROM s0),
s2 AS (SELECT *, sum(fresh) OVER {W} AS session_block FROM s1),
blk AS (SELECT symbol, session_block, any_value(session_name) AS session_name, max(high) AS block_high, min(low) AS block_low, min(bar) AS first_bar, max(bar) AS last_bar FROM s2 GROUP BY symbol, session_block)"""


_BEFORE_BLOCK = "(PARTITION BY symbol ORDER BY session_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LEVELS = "lv AS (SELECT symbol, session_block, " + ", ".join(f"last_value(CASE WHEN session_name = '{s}' THEN block_{e} END IGNORE NULLS) OVER {_BEFORE_BLOCK} AS prev_{s.lower()}_{e}" for s in ("Asia", "London", "NewYork") for e in ("high", "low")) + " FROM blk),\nsl AS (SELECT s2.*, lv.* EXCLUDE (symbol, session_block) FROM s2 JOIN lv USING (symbol, session_block))"

_EWM = """numbered AS (SELECT symbol, bar, tr FROM tr),
ewm AS (SELECT symbol, bar, tr AS y FROM numbered WHERE bar = 0 UNION ALL SELECT n.symbol, n.bar, (1 - {a}) * e.y + {a} * n.tr FROM ewm e JOIN numbered n ON n.symbol = e.symbol AND n.bar = e.bar + 1)"""


def _ewm(alpha: str) -> str:
    return _with(BARS, TR, _EWM.format(a=alpha)) + "SELECT symbol, bar, round(y, 6) AS atr_feature FROM ewm"


_PROFILE = f"""p0 AS (SELECT *, round((high + low + close) / 3.0, 0) AS price FROM s2),
p1 AS (SELECT symbol, session_block, price, sum(tick_volume) AS v FROM p0 GROUP BY ALL),
p2 AS (SELECT symbol, session_block, arg_max(price, (v, price)) AS poc FROM p1 GROUP BY ALL),
p3 AS (SELECT b.symbol, b.session_block, last_value(CASE WHEN b.session_name IS NOT NULL THEN b.session_name END IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.session_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref,
  last_value(CASE WHEN b.session_name IS NOT NULL THEN poc END IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.session_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS poc FROM blk b JOIN p2 USING (symbol, session_block))"""

_GAPS = f"""gp AS (SELECT *, lag(high, 2) OVER {W} AS h2, lag(low, 2) OVER {W} AS l2 FROM {{source}})"""


def _fill(source: str, p: str, z: str, gap: str, low: str, high: str, beyond: str) -> str:
    """Gap fills of one side; p: prefix of the expressions, z: of the zone's columns."""
    e = f"(PARTITION BY symbol, {p}ep ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{p}k AS (SELECT *, CASE WHEN {z}_valid THEN (bar - {z}_age)::VARCHAR || '|' || {z}_bottom || '|' || {z}_top END AS {p}key FROM {source}),
{p}f AS (SELECT *, CASE WHEN lag(bar) OVER {W} IS NULL OR {p}key IS DISTINCT FROM lag({p}key) OVER {W} THEN 1 ELSE 0 END AS {p}fresh FROM {p}k),
{p}e AS (SELECT *, sum({p}fresh) OVER {W} AS {p}ep, {low} AS {p}low, {high} AS {p}high, {p}key IS NOT NULL AND coalesce({gap} > 0, false) AND NOT {z}_touch AND {z}_age >= 0 AND {beyond} AS {p}gap FROM {p}f),
{p}l AS (SELECT g.symbol, g.{p}ep, min(b.bar) AS {p}fill FROM {p}e g JOIN {p}e b ON b.symbol = g.symbol AND b.{p}ep = g.{p}ep AND b.{p}key IS NOT NULL AND b.bar BETWEEN g.bar + 1 AND g.bar + 120 AND b.high >= g.{p}low AND b.low <= g.{p}high WHERE g.{p}gap GROUP BY ALL),
{p}g AS (SELECT f.symbol, f.{p}ep, f.{p}fill, arg_max(g.{p}low, g.bar) AS {p}glow, arg_max(g.{p}high, g.bar) AS {p}ghigh FROM {p}l f JOIN {p}e b ON b.symbol = f.symbol AND b.bar = f.{p}fill JOIN {p}e g ON g.symbol = f.symbol AND g.{p}ep = f.{p}ep AND g.{p}gap AND f.{p}fill BETWEEN g.bar + 1 AND g.bar + 120 AND b.high >= g.{p}low AND b.low <= g.{p}high GROUP BY ALL),
{p}a AS (SELECT *, last_value(CASE WHEN {p}gap THEN bar END IGNORE NULLS) OVER {e} AS {p}lastg, last_value(CASE WHEN {p}gap THEN {p}low END IGNORE NULLS) OVER {e} AS {p}lastlow, last_value(CASE WHEN {p}gap THEN {p}high END IGNORE NULLS) OVER {e} AS {p}lasthigh FROM {p}e),
{p}z AS (SELECT a.*, {p}key IS NOT NULL AND coalesce(bar = {p}fill, false) AS {p}filled, CASE WHEN {p}key IS NOT NULL AND bar >= {p}fill THEN {p}glow WHEN {p}key IS NOT NULL AND bar - {p}lastg <= 120 THEN {p}lastlow END AS {p}alow,
  CASE WHEN {p}key IS NOT NULL AND bar >= {p}fill THEN {p}ghigh WHEN {p}key IS NOT NULL AND bar - {p}lastg <= 120 THEN {p}lasthigh END AS {p}ahigh, {p}key IS NOT NULL AND coalesce(bar >= {p}fill, false) AS {p}valid FROM {p}a a LEFT JOIN {p}g g ON g.symbol = a.symbol AND g.{p}ep = a.{p}ep)"""


_SLACK = f"greatest(0, CASE WHEN atr > 0 THEN {_D(0.1)} * atr ELSE 0 END)"
_FILL = _fill("gp", "g", "d", "low - h2", "h2", "low", f"low >= d_entry - {_SLACK}") + ",\n" + _fill("gz", "h", "s", "l2 - high", "high", "l2", f"high <= s_entry + {_SLACK}")

_LEGS = f"""fb AS (SELECT *, last_value(e_sh IGNORE NULLS) OVER {BEFORE} AS h, last_value(e_sl IGNORE NULLS) OVER {UPTO} AS l, last_value(CASE WHEN e_sl IS NOT NULL THEN bar END IGNORE NULLS) OVER {UPTO} AS lb0 FROM el),
fc AS (SELECT *, CASE WHEN e_sl IS NOT NULL AND h - e_sl >= 0 THEN {{'lo': e_sl, 'hi': h}} END AS fall, CASE WHEN e_sh IS NOT NULL AND lb0 < bar AND e_sh - l >= 0 THEN {{'lo': l, 'hi': e_sh}} END AS rise FROM fb),
fd AS (SELECT *, last_value(fall IGNORE NULLS) OVER {UPTO} AS bear, last_value(rise IGNORE NULLS) OVER {UPTO} AS bull FROM fc)"""

_BANDS = """fz AS (SELECT z.*, fd.bull.lo AS bl, fd.bull.lo + 0.5 * (fd.bull.hi - fd.bull.lo) AS bh, fd.bear.hi - 0.5 * (fd.bear.hi - fd.bear.lo) AS sl0, fd.bear.hi AS sh0 FROM zoned z JOIN fd USING (symbol, bar)),
bands AS (SELECT *, coalesce(d_entry BETWEEN bl AND bh, false) OR coalesce(d_top >= bl AND d_bottom <= bh, false) AS fib_long, coalesce(s_entry BETWEEN sl0 AND sh0, false) OR coalesce(s_top >= sl0 AND s_bottom <= sh0, false) AS fib_short FROM fz)"""

# clusters of one window as a fold: finished means, running mean, count
_CLUSTER = """list_reduce({levels}, lambda acc, x: CASE WHEN acc.n > 0 AND abs(x - acc.m) <= {tol} THEN {{'d': acc.d, 'm': (acc.m * acc.n + x) / (acc.n + 1), 'n': acc.n + 1}}
  WHEN acc.n = 0 THEN {{'d': acc.d, 'm': x, 'n': 1}} ELSE {{'d': list_append(acc.d, acc.m), 'm': x, 'n': 1}} END, {{'d': []::DOUBLE[], 'm': CAST(0 AS DOUBLE), 'n': 0}})"""
_SR = f"""r0 AS (SELECT *, list_sort(list(CASE WHEN ph THEN high END) FILTER (WHERE ph) OVER {_rows(-250, 0)}) AS hs, list_sort(list(CASE WHEN pl THEN low END) FILTER (WHERE pl) OVER {_rows(-250, 0)}) AS ls, CASE WHEN atr > 0 THEN atr END AS a FROM zoned),
r1 AS (SELECT *, greatest(a * {_D(0.35)}, {_D(1e-8)}) AS tol, coalesce(hs, []::DOUBLE[]) AS h1, coalesce(ls, []::DOUBLE[]) AS l1 FROM r0),
r2 AS (SELECT *, {_CLUSTER.format(levels='h1', tol='tol')} AS hc, {_CLUSTER.format(levels='l1', tol='tol')} AS lc FROM r1),
r3 AS (SELECT *, CASE WHEN a IS NULL THEN NULL WHEN hc.n > 0 THEN list_append(hc.d, hc.m) ELSE hc.d END AS hl, CASE WHEN a IS NULL THEN NULL WHEN lc.n > 0 THEN list_append(lc.d, lc.m) ELSE lc.d END AS ll, CASE WHEN d_entry - d_stop > 0 THEN d_entry - d_stop END AS dr, CASE WHEN s_stop - s_entry > 0 THEN s_stop - s_entry END AS sr FROM r2),
r4 AS (SELECT *, list_min(list_filter(hl, lambda v: v > close)) AS res, list_max(list_filter(ll, lambda v: v < close)) AS sup,
  list_min(list_filter(hl, lambda v: v > d_entry + 2.0 * dr)) AS lref, list_max(list_filter(ll, lambda v: v < s_entry - 2.0 * sr)) AS sref FROM r3),
r5 AS (SELECT *, lref - a * {_D(0.05)} AS lt, sref + a * {_D(0.05)} AS stg FROM r4),
r6 AS (SELECT *, (lt - d_entry) / dr AS lrr, (s_entry - stg) / sr AS srr FROM r5)"""

_ORDER = "l_shipdate, l_orderkey, l_returnflag, l_linestatus, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
TRADES = f"""t AS (SELECT row_number() OVER (ORDER BY {_ORDER}) AS row_id, l_returnflag AS symbol, l_returnflag AS fold, l_linestatus AS timeframe, CASE WHEN l_linenumber % 2 = 0 THEN 'Long' ELSE 'Short' END AS position, l_shipdate AS trade_date, l_orderkey AS entry_bar,
  (l_quantity - 25) * 10 AS pnl_cash, (l_quantity - 25) / 10 AS pnl_r, l_partkey % 2 = 0 AS session_valid, l_suppkey % 2 = 0 AS profile_valid, l_partkey % 3 = 0 AS gap_valid, l_suppkey % 3 = 0 AS fib_valid, l_partkey % 5 = 0 AS pool_valid, l_suppkey % 5 = 0 AS level_valid,
  CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label, l_extendedprice AS score, CASE WHEN l_quantity > 25 THEN 'Win' WHEN l_quantity < 25 THEN 'Loss' ELSE 'Breakeven' END AS outcome FROM lineitem)"""
FLAGS = ("session", "profile", "gap", "fib", "pool", "level")
_LONG = "c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS confluence, '{f}_valid' AS feature, {f}_valid AS active, outcome, pnl_r, pnl_cash, row_id FROM t" for f in FLAGS) + ")"
_KEPT = "k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, row_id) AS rk, count(*) OVER (PARTITION BY fold) AS n FROM t)"
_TOP = f"s AS (SELECT * FROM k WHERE rk <= greatest(1, ceil(n * {_D(0.35)})))"
_CM = "sum(CASE WHEN label = 1 AND sel THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN label <> 1 AND sel THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN label = 1 AND NOT sel THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN label <> 1 AND NOT sel THEN 1 ELSE 0 END)::BIGINT AS tn, count(*) AS rows"
_RATES = "tp / nullif(tp + fp, 0)::DOUBLE AS p0, tp / nullif(tp + fn, 0)::DOUBLE AS r0"


def _t(*more: str) -> str:
    return _with(TRADES, *more)


def _conf(keys: str) -> str:
    return f"""m AS (SELECT *, rk <= greatest(1, ceil(n * {_D(0.35)})) AS sel, timeframe AS split FROM k), cm AS (SELECT {keys}, {_CM} FROM m GROUP BY {keys}),
cr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, (tp + tn) / rows::DOUBLE AS accuracy, (tp + fp) / rows::DOUBLE AS selected_rate, (tp + fn) / rows::DOUBLE AS positive_rate FROM cm),
cf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM cr)"""


def _subset(test: str) -> tuple[str, str, str, str]:
    return (f"count(*) FILTER (WHERE {test})", f"coalesce(avg(CASE WHEN outcome = 'Win' THEN 1.0 ELSE 0.0 END) FILTER (WHERE {test}) * 100.0, 0)", f"coalesce(avg(pnl_r) FILTER (WHERE {test}), 0)", f"coalesce(sum(pnl_cash) FILTER (WHERE {test}), 0)")


_ACT, _INACT = _subset("active"), _subset("NOT active")
_SET = "list_filter([" + ", ".join(f"CASE WHEN {f}_valid THEN '{f}' END" for f in FLAGS) + "], lambda x: x IS NOT NULL)"
_RUNS = """n AS (SELECT DISTINCT 'SYM' || o_orderstatus AS symbol, 'H' || (o_custkey % 3) AS timeframe, strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS d, strftime(o_orderdate, '%Y%m%d') || 'T' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS stamp FROM orders),
r AS (SELECT *, symbol || '_' || timeframe || '_' || d || '_' || d || '_' || stamp || 'Z' AS name FROM n)"""
_FOLDS = """u AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS rk FROM (SELECT DISTINCT trade_date FROM t)), nn AS (SELECT count(*) AS n FROM u),
b0 AS (SELECT n, least(greatest(1, floor(n * CAST(0.7 AS DOUBLE))::BIGINT), n - 2) AS f0 FROM nn), b1 AS (SELECT *, least(3, greatest(1, (n - f0) // 2)) AS cnt FROM b0), b2 AS (SELECT *, greatest(1, (n - f0) // (cnt * 2)) AS w FROM b1),
b3 AS (SELECT f + 1 AS fold_no, f0 + 2 * f * w AS a, f0 + 2 * f * w + w AS b, CASE WHEN f = cnt - 1 OR f0 + 2 * f * w + 2 * w > n THEN n ELSE f0 + 2 * f * w + 2 * w END AS c FROM b2, unnest(range(cnt)) AS x(f))"""
_QF = [("long", "d_entry", "d_stop", 1, "res"), ("short", "s_entry", "s_stop", -1, "sup")]
_MOMENTS = f"""g AS (SELECT {{keys}}, count(*)::DOUBLE AS n, avg(pnl_cash / 10000) AS mean, stddev_samp(pnl_cash / 10000) AS deviation, skewness(pnl_cash / 10000) AS skew, kurtosis(pnl_cash / 10000) AS kurtosis FROM t GROUP BY {{keys}})"""

SQL: dict[str, str] = {
    "bars_h1": _with(BARS) + "SELECT * FROM bars",
    "bar_coverage": _with(BARS) + "SELECT symbol, min(time) AS first_time, max(time) AS last_time, count(*) AS bars FROM bars GROUP BY symbol",
    "bars_latest": _with(BARS) + "SELECT symbol, time, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 100",
    "true_range": _with(BARS, TR) + "SELECT symbol, bar, round(tr, 6) AS tr FROM tr",
    "atr_sma": _with(BARS, TR, ATR) + "SELECT symbol, bar, round(atr, 6) AS atr_feature FROM atr",
    "atr_rma": _ewm("(1.0::DOUBLE / 14)"),
    "atr_ema": _ewm("(2.0::DOUBLE / 15)"),
    "pivots": _with(BARS) + "SELECT symbol, bar, " + ", ".join(f"{_pivot(c, n)} AS pivot_{c}_{n}" for n in (3, 8) for c in ("high", "low")) + " FROM bars",
    "swing_labels": f"WITH {STRUCT} SELECT symbol, bar, e_sh AS ext_swing_high, e_sl AS ext_swing_low, e_hlab AS ext_high_label, e_llab AS ext_low_label, n_hlab AS int_high_label, n_llab AS int_low_label, sh AS ext_structure_high, sl AS ext_structure_low FROM stc",
    "trend_state": f"WITH {STRUCT} SELECT symbol, bar, CAST(trend AS INTEGER) AS trend_state, trend = 1 AS bullish_bias, trend = -1 AS bearish_bias FROM stc",
    "structure_breaks": f"WITH {STRUCT} SELECT symbol, bar, bos_up, bos_down, choch_up, choch_down, choch_up AND pushed AS mss_up, choch_down AND pushed AS mss_down, sweep_high, sweep_low, CASE WHEN up THEN sh END AS last_broken_high, CASE WHEN dn THEN sl END AS last_broken_low FROM stc",
    "last_opposing": _with(BARS) + f"SELECT symbol, bar, coalesce(last_value(CASE WHEN close < open THEN bar END IGNORE NULLS) OVER {UPTO}, -1) AS last_bearish, coalesce(last_value(CASE WHEN close > open THEN bar END IGNORE NULLS) OVER {UPTO}, -1) AS last_bullish FROM bars",
    "departures": _z(4) + "SELECT symbol, bar, bull AS bull_departure, bear AS bear_departure, ph AS pivot_high, pl AS pivot_low FROM zin",
    "zone_candidates": _z(5) + "SELECT symbol, side, created, pivot_bar, base_start, base_end, departure, top, bottom, entry, round(stop, 6) AS stop, round(width_pips, 6) AS width_pips, round(stop_pips, 6) AS stop_pips FROM cand",
    "zones_accepted": _z(6) + "SELECT symbol, side, created, pivot_bar, base_start, base_end, departure, top, bottom, entry, round(stop, 6) AS stop, round(width_pips, 6) AS width_pips, round(stop_pips, 6) AS stop_pips, CAST(zone_id AS INTEGER) AS zone_id FROM acc",
    "zone_lifecycle": _z(7) + "SELECT symbol, side, CAST(zone_id AS INTEGER) AS zone_id, bar, age, retests, touched FROM life WHERE alive",
    "nearest_zone": _z(9) + "SELECT symbol, bar, d_entry AS demand_zone_entry, d_ret AS demand_zone_retests, d_age AS demand_zone_age, s_entry AS supply_zone_entry, s_ret AS supply_zone_retests, s_age AS supply_zone_age, d_valid AS sd_demand_valid, s_valid AS sd_supply_valid, d_touch AS sd_demand_touched, s_touch AS sd_supply_touched, d_valid AND d_touch AS long_entry_signal, s_valid AND s_touch AS short_entry_signal FROM zoned",
    "session_blocks": _with(BARS, _blocks("bars")) + "SELECT symbol, CAST(session_block AS BIGINT) AS session_block, session_name, block_high, block_low, first_bar, last_bar FROM blk",
    "session_levels": _with(BARS, _blocks("bars"), _LEVELS) + "SELECT symbol, bar, session_name, prev_asia_high, prev_asia_low, prev_london_high, prev_london_low, prev_newyork_high, prev_newyork_low FROM sl",
    "session_sweeps": _with(*_ZCHAIN, _blocks("zoned"), _LEVELS)[:-1] + f""",
sw AS (SELECT *, {' OR '.join(f"coalesce(low < prev_{s}_low AND close >= prev_{s}_low, false)" for s in ('asia', 'london', 'newyork'))} AS dl, {' OR '.join(f"coalesce(high > prev_{s}_high AND close <= prev_{s}_high, false)" for s in ('asia', 'london', 'newyork'))} AS dh FROM sl),
sx AS (SELECT *, coalesce(bar - last_value(CASE WHEN dl OR dh THEN bar END IGNORE NULLS) OVER {UPTO} <= 24, false) AS recent FROM sw)
SELECT symbol, bar, dl AS session_low_swept, dh AS session_high_swept, recent AND d_valid AS session_liquidity_long_valid, recent AND s_valid AS session_liquidity_short_valid, recent AND (d_valid OR s_valid) AS Session_Liquidity_Valid FROM sx""",
    "volume_profile_poc": _with(*_ZCHAIN, _blocks("zoned"), _PROFILE) + """SELECT s2.symbol, bar, session_name AS vp_session_name, ref AS vp_reference_session_name, poc AS vp_reference_poc,
coalesce(abs(d_entry - poc) <= 5, false) OR coalesce(d_bottom - 5 <= poc AND poc <= d_top + 5, false) AS volume_profile_long_valid, coalesce(abs(s_entry - poc) <= 5, false) OR coalesce(s_bottom - 5 <= poc AND poc <= s_top + 5, false) AS volume_profile_short_valid FROM s2 JOIN p3 USING (symbol, session_block)""",
    "fvg_gaps": _with(BARS, _GAPS.format(source="bars")) + """SELECT symbol, bar, coalesce(low - h2 > 0, false) AS bullish_imbalance_created, coalesce(l2 - high > 0, false) AS bearish_imbalance_created, CASE WHEN low - h2 > 0 THEN h2 END AS bullish_imbalance_zone_low, CASE WHEN low - h2 > 0 THEN low END AS bullish_imbalance_zone_high, CASE WHEN l2 - high > 0 THEN high END AS bearish_imbalance_zone_low, CASE WHEN l2 - high > 0 THEN l2 END AS bearish_imbalance_zone_high FROM gp""",
    "fvg_fill": _with(*_ZCHAIN, _GAPS.format(source="zoned"), _FILL) + "SELECT symbol, bar, gfilled AS bullish_imbalance_filled, galow AS active_bullish_imbalance_low, gahigh AS active_bullish_imbalance_high, gvalid AS imbalance_long_valid, hfilled AS bearish_imbalance_filled, halow AS active_bearish_imbalance_low, hahigh AS active_bearish_imbalance_high, hvalid AS imbalance_short_valid, gvalid OR hvalid AS Imbalance_Valid FROM hz",
    "fib_valid": f"WITH RECURSIVE {STRUCT},\n" + ",\n".join(_ZCHAIN[3:]) + ",\n" + _LEGS + ",\n" + _BANDS + "\nSELECT symbol, bar, fib_long AS fibonacci_long_valid, fib_short AS fibonacci_short_valid, fib_long OR fib_short AS Fibonacci_Valid FROM bands",
    "fib_legs": _with(BARS, TR, ATR, _swing("e", 8).format(source="atr"), _LEGS) + "SELECT symbol, bar, bull.lo AS fib_bull_impulse_low, bull.hi AS fib_bull_impulse_high, bear.lo AS fib_bear_impulse_low, bear.hi AS fib_bear_impulse_high, round(bull.lo + 0.5 * (bull.hi - bull.lo), 6) AS fib_long_band_high, round(bear.hi - 0.5 * (bear.hi - bear.lo), 6) AS fib_short_band_low FROM fd",
    "sr_levels": _with(*_ZCHAIN, _SR) + "SELECT symbol, bar, ph AS sr_pivot_high, pl AS sr_pivot_low, round(res, 9) AS sr_nearest_resistance, round(sup, 9) AS sr_nearest_support FROM r6",
    "sr_targets": _with(*_ZCHAIN, _SR) + f"""SELECT symbol, bar, round(lref, 9) AS sr_long_reference_level, round(lt, 9) AS sr_long_target, round(lrr, 9) AS sr_long_target_rr, round(sref, 9) AS sr_short_reference_level, round(stg, 9) AS sr_short_target, round(srr, 9) AS sr_short_target_rr,
coalesce(lrr BETWEEN {_D(2.3)} AND 4, false) AS support_resistance_long_valid, coalesce(srr BETWEEN {_D(2.3)} AND 4, false) AS support_resistance_short_valid FROM r6""",
    "signals_all": "WITH RECURSIVE " + STRUCT + ",\n" + ",\n".join(_ZCHAIN[3:]) + f""",
rb AS (SELECT symbol, bar, trend, coalesce(max(CASE WHEN choch_up OR bos_up THEN 1 ELSE 0 END) OVER {_rows(-19, 0)} = 1, false) AS ub, coalesce(max(CASE WHEN choch_down OR bos_down THEN 1 ELSE 0 END) OVER {_rows(-19, 0)} = 1, false) AS db FROM stc)
SELECT z.symbol, z.bar, trend = 1 AND ub AS market_structure_long_valid, trend = -1 AND db AS market_structure_short_valid,
d_valid AND trend = 1 AND ub AND d_touch AND coalesce(close >= d_entry, false) AND close > open AS long_signal, s_valid AND trend = -1 AND db AND s_touch AND coalesce(close <= s_entry, false) AND close < open AS short_signal FROM zoned z JOIN rb USING (symbol, bar)""",
    "exec_costs": _with(BARS, TR, ATR) + f""", m AS (SELECT symbol, median(atr) AS base FROM atr WHERE atr > 0 GROUP BY symbol),
c AS (SELECT atr.*, base, CASE WHEN hour(time) >= 8 AND hour(time) < 22 THEN 1.0 WHEN hour(time) < 8 THEN 1.25 ELSE 1.0 END::DOUBLE AS sf, CASE WHEN atr > 0 AND atr / base >= {_D(1.5)} THEN 1.7 WHEN atr > 0 AND atr / base >= {_D(1.2)} THEN 1.2 ELSE 1.0 END::DOUBLE AS vf FROM atr LEFT JOIN m USING (symbol)),
x AS (SELECT *, {_D(0.02)} * sf * vf AS sp, greatest({_D(0.0075)}, least({_D(0.01)} * sf * vf, {_D(0.025)})) AS sl FROM c)
SELECT symbol, bar, sf AS session_factor, vf AS volatility_factor, round(sp, 6) AS spread_pips, round(sl, 6) AS slippage_pips, round(sp * 25 / 2 + sl * 25, 6) AS fill_cost, round(base, 6) AS baseline_atr FROM x""".replace(")\n, m AS", "),\nm AS"),
    "sizing": _z(6) + f"SELECT symbol, side, CAST(zone_id AS INTEGER) AS zone_id, CASE WHEN least(floor(100 / abs(entry - stop) / {_D(0.01)}) * {_D(0.01)}, 100) >= {_D(0.01)} THEN round(least(floor(100 / abs(entry - stop) / {_D(0.01)}) * {_D(0.01)}, 100), 2) ELSE 0 END AS lots FROM acc",
    "drawdown": _t() + ", e AS (SELECT row_id, sum(pnl_cash) OVER (ORDER BY row_id) AS cum FROM t), f AS (SELECT cum, max(cum) OVER (ORDER BY row_id) AS peak FROM e) SELECT max(peak - cum) AS max_drawdown FROM f",
    "running_equity": _t() + ", e AS (SELECT row_id, sum(pnl_cash) OVER (ORDER BY row_id) AS cum FROM t) SELECT row_id, cum, max(cum) OVER (ORDER BY row_id) AS peak FROM e",
    "trade_stats": _t() + """SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE pnl_cash > 0) AS wins, count(*) FILTER (WHERE pnl_cash < 0) AS losses, count(*) FILTER (WHERE pnl_cash = 0) AS breakevens, sum(pnl_cash) AS net_pnl, round(sum(pnl_cash) / 10000 * 100.0, 6) AS roi_pct, coalesce(sum(pnl_cash) FILTER (WHERE pnl_cash > 0), 0) AS gross_profit, abs(coalesce(sum(pnl_cash) FILTER (WHERE pnl_cash < 0), 0)) AS gross_loss,
round(avg(pnl_cash) FILTER (WHERE pnl_cash > 0), 6) AS avg_win, round(avg(pnl_cash) FILTER (WHERE pnl_cash < 0), 6) AS avg_loss, round(avg(pnl_cash), 6) AS avg_pnl_per_trade, round(avg(pnl_r), 6) AS avg_rr_per_trade, max(pnl_cash) AS largest_win, min(pnl_cash) AS largest_loss, CAST(0 AS DOUBLE) AS avg_bars_in_trade FROM t GROUP BY symbol""",
    "engine_summary": _t() + """SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE pnl_cash > 0) AS wins, count(*) FILTER (WHERE pnl_cash < 0) AS losses, count(*) FILTER (WHERE pnl_cash = 0) AS breakevens, round(count(*) FILTER (WHERE pnl_cash > 0) / count(*) FILTER (WHERE pnl_cash <> 0)::DOUBLE * 100.0, 6) AS win_rate, round(avg(pnl_r), 6) AS expectancy_r,
round(sum(pnl_cash) FILTER (WHERE pnl_cash > 0) / abs(sum(pnl_cash) FILTER (WHERE pnl_cash < 0)), 6) AS profit_factor, sum(pnl_cash) FILTER (WHERE pnl_cash > 0) AS gross_profit, abs(sum(pnl_cash) FILTER (WHERE pnl_cash < 0)) AS gross_loss, 10000 + sum(pnl_cash) AS balance FROM t GROUP BY symbol""",
    "account_info": _t() + """, e AS (SELECT row_id, 10000 + sum(pnl_cash) OVER (ORDER BY row_id) AS eq FROM t), f AS (SELECT *, greatest(10000, max(eq) OVER (ORDER BY row_id)) AS peak FROM e)
SELECT CAST(10000 AS DOUBLE) AS initial_balance, arg_max(eq, row_id) AS ending_balance, max(peak - eq) AS max_drawdown, round(max((peak - eq) / peak * 100), 6) AS max_drawdown_pct, max(greatest(10000 - eq, 0)) AS initial_drawdown, round(max(greatest(10000 - eq, 0)) / 10000 * 100, 6) AS initial_drawdown_pct FROM f""",
    "trading_metrics": _t() + """, e AS (SELECT row_id, sum(pnl_cash) OVER w AS c, sum(CAST(pnl_r AS DECIMAL(18,2))) OVER w AS r FROM t WINDOW w AS (ORDER BY row_id)), f AS (SELECT max(c) OVER w - c AS dc, max(r) OVER w - r AS dr FROM e WINDOW w AS (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), d AS (SELECT max(dc) AS dc, max(dr) AS dr FROM (SELECT e.row_id, max(c) OVER w - c AS dc, max(r) OVER w - r AS dr FROM e WINDOW w AS (ORDER BY row_id)))
SELECT count(*)::DOUBLE AS trades, sum(pnl_cash) AS pnl, round(sum(pnl_r), 6) AS pnl_r, round(avg(pnl_cash), 6) AS expectancy, round(avg(pnl_r), 6) AS expectancy_r, round(avg(CASE WHEN pnl_cash > 1e-6 THEN 1.0 ELSE 0.0 END) * 100, 6) AS win_rate, round(sum(pnl_cash) FILTER (WHERE pnl_cash > 1e-6) / abs(sum(pnl_cash) FILTER (WHERE pnl_cash < -1e-6)), 6) AS profit_factor, max(d.dc) AS max_drawdown, round(max(d.dr)::DOUBLE, 6) AS max_drawdown_r FROM t, d""",
    "sharpe_moments": _t(_MOMENTS.format(keys="symbol")) + "SELECT symbol, n, round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(mean / deviation, 6) AS sharpe_per_trade, round(mean / deviation * sqrt(n), 6) AS sharpe FROM g",
    "outcome_groups": _t() + "SELECT symbol, outcome AS outcome_group, count(*) AS n, sum(pnl_cash) AS pnl FROM t GROUP BY ALL",
    "confluence_summary": _t(_LONG) + f"SELECT confluence, {_ACT[0]} AS active_trade_count, round({_ACT[1]}, 6) AS win_rate_when_active, round({_ACT[2]}, 6) AS avg_r_when_active, {_ACT[3]} AS pnl_when_active, count(*) - {_ACT[0]} AS inactive_trade_count, round({_ACT[0]} / count(*) * 100.0, 6) AS active_rate_pct FROM c GROUP BY confluence",
    "confluence_impact": _t(_LONG) + f"""SELECT confluence, {_ACT[0]} AS trades_with, round({_ACT[1]}, 6) AS win_rate_with, round({_ACT[2]}, 6) AS expectancy_with, {_ACT[3]} AS pnl_with, {_INACT[0]} AS trades_without, round({_INACT[1]}, 6) AS win_rate_without, round({_INACT[2]}, 6) AS expectancy_without, {_INACT[3]} AS pnl_without,
round({_ACT[1]} - {_INACT[1]}, 6) AS win_rate_delta_pp, round({_ACT[2]} - {_INACT[2]}, 6) AS expectancy_delta_r FROM c GROUP BY confluence""",
    "confluence_sets": _t() + f""", z AS (SELECT {_SET} AS st, outcome, pnl_r, pnl_cash FROM t)
SELECT array_to_string(st, ', ') AS confluence_set, CAST(len(st) AS INTEGER) AS set_size, count(*) FILTER (WHERE outcome <> 'Breakeven') AS trade_count, round(coalesce(avg(CASE WHEN outcome = 'Win' THEN 1.0 ELSE 0.0 END) FILTER (WHERE outcome <> 'Breakeven') * 100.0, 0), 6) AS win_rate, round(coalesce(avg(pnl_r) FILTER (WHERE outcome <> 'Breakeven'), 0), 6) AS expectancy_r, coalesce(sum(pnl_cash) FILTER (WHERE outcome <> 'Breakeven'), 0) AS pnl_cash
FROM z WHERE len(st) > 0 GROUP BY st HAVING bool_or(outcome = 'Win' OR pnl_r > 0 OR pnl_cash > 0)""",
    "confluence_counts": _t(_LONG) + "SELECT feature AS condition, count(*) FILTER (WHERE active) AS trades FROM c GROUP BY feature",
    "mean_confluences": _t() + "SELECT round(avg(" + " + ".join(f"{f}_valid::INT" for f in FLAGS) + "), 6) AS mean_active FROM t",
    "filter_trades": _t() + "SELECT row_id, trade_date, pnl_r FROM t WHERE symbol = 'A' AND outcome = 'Win' AND trade_date >= '1994-01-01' AND trade_date < '1997-01-01' AND gap_valid AND pnl_r >= 1.0",
    "run_labels": _with(_RUNS) + ", v AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, d ORDER BY stamp, name) AS version FROM r) SELECT name, stamp, CAST(version AS INTEGER) AS version, symbol || ' ' || timeframe || ' ' || d || ' ' || d || ' v' || version AS label FROM v",
    "latest_runs": _with(_RUNS) + "SELECT symbol, timeframe, arg_max(name, (stamp, name)) AS name, max(stamp) AS stamp FROM r GROUP BY symbol, timeframe",
    "pip_sizes": """WITH r AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 4 = 0 THEN 'USDJPY' WHEN p_partkey % 4 = 1 THEN 'XAUUSD' ELSE 'EURUSD' END AS symbol, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 6 END AS digits, CASE WHEN p_partkey % 3 <> 0 THEN 0.001::DOUBLE END AS point FROM part)
SELECT part, symbol, round(CASE WHEN symbol = 'XAUUSD' THEN 0.1 WHEN point IS NULL THEN CASE WHEN symbol = 'USDJPY' THEN 0.01 ELSE 0.0001 END WHEN digits IN (3, 5) THEN 10 * point WHEN digits IS NOT NULL THEN point ELSE 0.25 END, 6) AS pip_size, CASE WHEN symbol = 'XAUUSD' THEN 'override' WHEN point IS NOT NULL THEN 'broker' ELSE 'fallback' END AS source FROM r""",
    "join_enrich": _t() + """, g AS (SELECT symbol, timeframe, trade_date, entry_bar, position, sum(pnl_cash) AS pnl_cash FROM t GROUP BY ALL) SELECT symbol, true AS matched, count(*) AS n, sum(pnl_cash) AS pnl FROM g GROUP BY symbol""",
    "walk_forward_folds": _t(_FOLDS) + "SELECT CAST(fold_no AS INTEGER) AS fold, CASE WHEN rk <= a THEN 'train' WHEN rk <= b THEN 'valid' ELSE 'test' END AS split, count(*) AS rows, min(t.trade_date) AS start, max(t.trade_date) AS \"end\" FROM t JOIN u USING (trade_date) JOIN b3 ON rk <= c GROUP BY ALL",
    "trade_quality_features": _with(*_ZCHAIN, _SR) + "SELECT symbol, bar, " + ", ".join(f"round(({e} - {s}) * {g}, 6) AS feat_{n}_risk_price, round(({e} - {s}) * {g} / nullif(atr, 0), 6) AS feat_{n}_risk_atr, round(({lv} - {e}) * {g} / nullif(({e} - {s}) * {g}, 0), 6) AS feat_{n}_rr_to_sr" for n, e, s, g, lv in _QF) + " FROM r6",
    "sample_weights": _t() + "SELECT row_id, round(1 + least(abs(pnl_r), 5), 6) AS weight FROM t",
    "rank_pct": _t(_KEPT) + "SELECT row_id, fold, round(rk / n, 9) AS rank_pct FROM k",
    "top_fraction": _t(_KEPT, _TOP) + "SELECT row_id, fold FROM s",
    "keep_ratio_sweep": _t(_KEPT) + f""", q AS (SELECT i, {_D(0.35)} + i * (({_D(0.35)} + {_D(0.05)}) - {_D(0.35)}) AS ratio FROM range(14) AS x(i)), s AS (SELECT q.ratio, k.* FROM q, k WHERE rk <= greatest(1, ceil(n * ratio))),
e AS (SELECT ratio, row_id, sum(pnl_cash) OVER (PARTITION BY ratio ORDER BY row_id) AS c FROM s), f AS (SELECT ratio, max(c) OVER (PARTITION BY ratio ORDER BY row_id) - c AS d FROM e), dd AS (SELECT ratio, max(d) AS d FROM f GROUP BY ratio),
cu AS (SELECT ratio, median(c) AS cut FROM (SELECT ratio, fold, min(score) AS c FROM s GROUP BY ALL) GROUP BY ratio), base AS (SELECT sum(pnl_cash) AS b FROM t)
SELECT round(s.ratio, 6) AS keep_ratio, count(*)::DOUBLE AS trades, sum(pnl_cash) AS pnl, round(any_value(dd.d), 6) AS max_drawdown, any_value(cu.cut) AS cutoff_score, round(avg(pnl_cash), 6) AS expectancy, round(CASE WHEN any_value(b) > 0 THEN sum(pnl_cash) / any_value(b) END, 6) AS pnl_retention FROM s JOIN dd USING (ratio) JOIN cu USING (ratio), base GROUP BY s.ratio""",
    "confluence_lift": _t(_KEPT, _TOP, _LONG) + """, b AS (SELECT feature, avg(active::INT) AS bf FROM c GROUP BY feature), a AS (SELECT feature, avg(active::INT) AS af FROM c WHERE row_id IN (SELECT row_id FROM s) GROUP BY feature)
SELECT feature, round(bf * 100, 6) AS baseline_freq, round(af * 100, 6) AS accepted_freq, round(CASE WHEN bf > 0 THEN af / bf ELSE 0 END, 6) AS lift FROM b JOIN a USING (feature) WHERE abs(af - bf) * 100 > 1e-12""",
    "confusion_metrics": _t(_KEPT, _conf("fold")) + "SELECT fold, tp, fp, fn, tn, rows, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "accuracy", "selected_rate", "positive_rate", "f1")) + " FROM cf",
    "roc_auc": _t() + ", r AS (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS ar FROM t), g AS (SELECT fold, sum(ar) FILTER (WHERE label = 1) AS sr, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM r GROUP BY fold) SELECT fold, round((sr - p * (p + 1) / 2.0) / (p * q::DOUBLE), 6) AS roc_auc FROM g",
    "average_precision": _t() + ", r AS (SELECT fold, label, row_number() OVER w AS rk, sum(label) OVER (PARTITION BY fold ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING) AS hits FROM t WINDOW w AS (PARTITION BY fold ORDER BY score DESC, row_id)) SELECT fold, round(coalesce(avg(hits / rk) FILTER (WHERE label = 1), 0), 6) AS average_precision FROM r GROUP BY fold",
    "roc_points": _t() + ", g AS (SELECT fold, score, sum(label) AS p, count(*) - sum(label) AS q FROM t GROUP BY ALL) SELECT fold, score AS threshold, round(sum(q) OVER (PARTITION BY fold ORDER BY score DESC) / sum(q) OVER (PARTITION BY fold), 6) AS fpr, round(sum(p) OVER (PARTITION BY fold ORDER BY score DESC) / sum(p) OVER (PARTITION BY fold), 6) AS tpr FROM g",
    "pooled_metrics": _t(_KEPT, _conf("fold, split")) + """SELECT split, 'AGGREGATE' AS run, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, sum(rows)::BIGINT AS rows, round(sum(tp) / sum(tp + fp)::DOUBLE, 6) AS precision, round(sum(tp) / sum(tp + fn)::DOUBLE, 6) AS recall,
round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(accuracy), 6) AS mean_accuracy, round(avg(f1), 6) AS mean_f1 FROM cf GROUP BY split""",
    "dataset_overview": _t() + "SELECT symbol, timeframe, label, count(*) AS rows, min(trade_date) AS first_date, max(trade_date) AS last_date FROM t GROUP BY ALL",
}

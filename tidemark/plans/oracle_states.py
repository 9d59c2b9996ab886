"""DuckDB twins of the stateful queries: recursive common table expressions that step from bar to bar.

The steps are written from the rules, one bar at a time, while the engine searches
arrays; both must give the same trades and pools.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from tidemark.plans.oracle import _SR, _ZCHAIN, STRUCT, TRADES, _D, _rows

_POOL = "STRUCT(p DOUBLE, c BIGINT, t BIGINT, n BIGINT)[]"


def _pool_side(s: str, swing: str, key: str, beyond: str) -> dict[str, str]:
    """Expressions of one side at each level of a step; state columns are {s}p (pools), {s}k (zone) and {s}w (sweep bar)."""
    return {
        "near": f"list_sort(list_filter(list_transform({s}p, lambda x, i: {{'d': abs({swing} - x.p), 'i': i}}), lambda y: y.d <= 10))[1].i AS {s}i",
        "pools": f"""CASE WHEN {swing} IS NULL THEN {s}p WHEN {s}i IS NULL THEN list_append({s}p, {{'p': {swing}, 'c': bar, 't': bar, 'n': 1}})
    ELSE list_transform({s}p, lambda x, i: CASE WHEN i = {s}i THEN {{'p': (x.p * x.n + {swing}) / (x.n + 1), 'c': x.c, 't': bar, 'n': x.n + 1}} ELSE x END) END AS {s}q, CASE WHEN {key} IS DISTINCT FROM {s}k THEN NULL ELSE {s}w END AS {s}v""",
        "pick": f"CASE WHEN {key} IS NOT NULL THEN list_reverse_sort(list_filter(list_transform({s}q, lambda x, i: {{'t': x.t, 'c': x.c, 'p': x.p, 'i': i}}), lambda y: y.p >= {key}.l - tol AND y.p <= {key}.h + tol))[1] END AS {s}j",
        "hit": f"coalesce({beyond.format(p=f'{s}j.p')} AND high >= {key}.l - tol AND low <= {key}.h + tol, false) AS {s}hit",
        "out": f"CASE WHEN {s}hit THEN list_filter({s}q, lambda x, i: i <> {s}j.i) ELSE {s}q END, {key}, CASE WHEN {s}hit THEN bar ELSE {s}v END, {s}j.p, coalesce({key} IS NOT NULL AND bar - CASE WHEN {s}hit THEN bar ELSE {s}v END <= 20, false)",
    }


_LOW = _pool_side("a", "e_sl", "dk", "low < {p} AND {p} <= close")
_HIGH = _pool_side("b", "e_sh", "sk", "high > {p} AND {p} >= close")
POOLS = f"""pin AS (SELECT z.symbol, z.bar, z.high, z.low, z.close, s.e_sh, s.e_sl, greatest({_D(10)}, CASE WHEN z.atr > 0 THEN {_D(0.5)} * z.atr ELSE 0 END) AS tol,
  CASE WHEN d_valid THEN {{'b': z.bar - d_age, 'l': d_bottom, 'h': d_top}} END AS dk, CASE WHEN s_valid THEN {{'b': z.bar - s_age, 'l': s_bottom, 'h': s_top}} END AS sk FROM zoned z JOIN stc s USING (symbol, bar)),
pw(symbol, bar, ap, ak, aw, aprice, avalid, bp, bk, bw, bprice, bvalid) AS (
  SELECT symbol, CAST(-1 AS BIGINT), []::{_POOL}, any_value(dk) FILTER (WHERE false), NULL::BIGINT, NULL::DOUBLE, false, []::{_POOL}, any_value(sk) FILTER (WHERE false), NULL::BIGINT, NULL::DOUBLE, false FROM pin GROUP BY symbol
  UNION ALL SELECT symbol, bar, {_LOW['out']}, {_HIGH['out']} FROM (SELECT *, {_LOW['hit']}, {_HIGH['hit']} FROM (SELECT *, {_LOW['pick']}, {_HIGH['pick']} FROM (SELECT *, {_LOW['pools']}, {_HIGH['pools']} FROM (SELECT *, {_LOW['near']}, {_HIGH['near']} FROM (
    SELECT i.*, w.ap, w.ak, w.aw, w.bp, w.bk, w.bw FROM pw w JOIN pin i ON i.symbol = w.symbol AND i.bar = w.bar + 1))))))"""

#: Bars with costs, signals and plans, and the simulation: pos is 0 (none), 1 (open) or 2 (runner); prices are signed so that every trade is a long.
_BREAKS = f"rb AS (SELECT symbol, bar, trend, coalesce(max(CASE WHEN choch_up OR bos_up THEN 1 ELSE 0 END) OVER {_rows(-19, 0)} = 1, false) AS ub, coalesce(max(CASE WHEN choch_down OR bos_down THEN 1 ELSE 0 END) OVER {_rows(-19, 0)} = 1, false) AS db FROM stc)"
_COSTS = f"""cm AS (SELECT symbol, median(atr) AS base FROM atr WHERE atr > 0 GROUP BY symbol),
cf AS (SELECT a.symbol, a.bar, CASE WHEN hour(time) < 8 THEN 1.25 ELSE 1.0 END::DOUBLE AS sf, CASE WHEN atr > 0 AND atr / base >= {_D(1.5)} THEN 1.7 WHEN atr > 0 AND atr / base >= {_D(1.2)} THEN 1.2 ELSE 1.0 END::DOUBLE AS vf FROM atr a LEFT JOIN cm USING (symbol)),
cc AS (SELECT *, greatest({_D(0.02)} * (sf * vf), 0) AS spread, greatest({_D(0.01)} * {_D(0.75)}, least({_D(0.01)} * (sf * vf), {_D(0.01)} * {_D(2.5)})) AS slip FROM cf),
cp AS (SELECT *, spread * 25 / 2.0::DOUBLE + slip * 25 AS fc FROM cc)"""
_INPUT = f"""tin AS (SELECT r.symbol, r.bar, r.time, r.high, r.low, r.close, fc, lag(r.close) OVER (PARTITION BY r.symbol ORDER BY r.bar) AS pc, lag(r.atr) OVER (PARTITION BY r.symbol ORDER BY r.bar) AS pa, max(r.bar) OVER (PARTITION BY r.symbol) AS last,
  d_valid AND trend = 1 AND ub AND d_touch AND coalesce(r.close >= d_entry, false) AND r.close > r.open AS ls, s_valid AND trend = -1 AND db AND s_touch AND coalesce(r.close <= s_entry, false) AND r.close < r.open AS ss,
  d_entry, d_stop, s_entry, s_stop, CASE WHEN lrr BETWEEN {_D(2.3)} AND 4 THEN lt END AS lrun, CASE WHEN srr BETWEEN {_D(2.3)} AND 4 THEN stg END AS srun FROM r6 r JOIN rb USING (symbol, bar) JOIN cp USING (symbol, bar))"""
_STATE = "pos, bal, no, sgn, eb, en, rs, es, lvl, be, risk, size, tg, et, run, pb, pp, tr"
_OPEN = ("sgn", "eb", "en", "rs", "es", "lvl", "risk", "size", "tg", "et", "run")
_NEW = {"sgn": "ns", "eb": "bar", "en": "n_en", "rs": "n_rs", "es": "n_es", "lvl": "n_rs", "risk": "n_risk", "size": "n_size", "tg": "n_tg", "et": "n_et", "run": "n_run"}
_CURRENT = ", ".join(f"CASE WHEN go THEN {_NEW[c]} ELSE {'lvl1' if c == 'lvl' else c} END AS c_{c}" for c in _OPEN)
_OUT = """CASE WHEN done THEN {'no': no + 1, 'side': CASE WHEN c_sgn = 1 THEN 'long' ELSE 'short' END, 'entry_bar': c_eb, 'exit_bar': bar, 'entry': c_sgn * c_en, 'exit': c_sgn * price, 'initial_stop': c_sgn * c_rs, 'final_stop': c_sgn * c_lvl, 'target': c_sgn * c_tg, 'executed_stop': c_sgn * c_es, 'executed_target': c_sgn * c_et,
    'risk_price': c_risk, 'size': c_size, 'pnl_cash': pnl, 'pnl_r': pnl / greatest(c_risk * c_size, 1e-12), 'outcome': CASE WHEN c_be AND c_pb IS NULL AND abs(raw - c_lvl) < 1e-12 THEN 'Breakeven' WHEN pnl > 0 THEN 'Win' ELSE 'Loss' END, 'be_moved': c_be, 'partial_bar': c_pb, 'partial_price': c_sgn * c_pp,
    'runner_qualified': c_run IS NOT NULL, 'runner_active': active, 'runner_target': c_sgn * c_run, 'runner_stop': CASE WHEN active AND NOT x_rtgt THEN c_sgn * c_tr WHEN x_rtgt THEN c_sgn * tr1 END, 'runner_exit_reason': CASE WHEN x_rstop THEN 'atr_trail_stop' WHEN x_rtgt THEN 'sr_target' WHEN x_reach AND c_run IS NULL THEN 'no_valid_sr_runner' WHEN active THEN 'end_of_data' ELSE '' END,
    'exit_type': CASE WHEN x_stop THEN 'stop_before_2r' WHEN x_rstop THEN 'runner_stop' WHEN x_rtgt THEN 'runner_target' WHEN x_reach AND c_run IS NULL THEN 'close_rest_at_2r' ELSE 'end_of_data' END, 'commission': paid + rest, 'balance_after': bal + pnl} END"""
SIMULATED = f"""sw(symbol, bar, {_STATE}, trade) AS (
  SELECT DISTINCT symbol, CAST(-1 AS BIGINT), 0, {_D(10000)}, 0, 1, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, false, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE,
    NULL::STRUCT(no INTEGER, side VARCHAR, entry_bar BIGINT, exit_bar BIGINT, entry DOUBLE, exit DOUBLE, initial_stop DOUBLE, final_stop DOUBLE, target DOUBLE, executed_stop DOUBLE, executed_target DOUBLE, risk_price DOUBLE, size DOUBLE, pnl_cash DOUBLE, pnl_r DOUBLE, outcome VARCHAR, be_moved BOOLEAN, partial_bar BIGINT, partial_price DOUBLE,
      runner_qualified BOOLEAN, runner_active BOOLEAN, runner_target DOUBLE, runner_stop DOUBLE, runner_exit_reason VARCHAR, exit_type VARCHAR, commission DOUBLE, balance_after DOUBLE) FROM tin
  UNION ALL
  SELECT symbol, bar, CASE WHEN done THEN 0 WHEN go THEN 1 WHEN x_reach THEN 2 ELSE pos END, CASE WHEN done THEN bal + pnl ELSE bal END, CASE WHEN done THEN no + 1 ELSE no END, c_sgn, c_eb, c_en, c_rs, c_es, c_lvl, c_be, c_risk, c_size, c_tg, c_et, c_run, c_pb, c_pp, c_tr, {_OUT}
  FROM (SELECT *, p1 + ((price - c_en) * c_left - rest) AS pnl FROM (
   SELECT *, raw - fc AS price, greatest(6 * c_size - paid, 0) AS rest FROM (
    SELECT *, CASE WHEN c_pb IS NULL THEN 0 ELSE (c_pp - c_en) * (c_size * {_D(0.3)}) - 6 * (c_size * {_D(0.3)}) END AS p1, CASE WHEN c_pb IS NULL THEN 0 ELSE 6 * (c_size * {_D(0.3)}) END AS paid, CASE WHEN c_pb IS NULL THEN c_size ELSE greatest(c_size - c_size * {_D(0.3)}, 0) END AS c_left,
      CASE WHEN x_stop THEN lvl1 WHEN x_reach AND c_run IS NULL THEN c_tg WHEN x_rstop THEN tr1 WHEN x_rtgt THEN c_run ELSE c_sgn * close END AS raw,
      x_stop OR x_rstop OR x_rtgt OR (x_reach AND c_run IS NULL) OR (bar = last AND (pos > 0 OR go)) AS done, pos = 2 OR (x_reach AND c_run IS NOT NULL) AS active FROM (
     SELECT *, {_CURRENT}, NOT go AND be1 AS c_be, CASE WHEN go THEN NULL WHEN x_reach THEN bar ELSE pb END AS c_pb, CASE WHEN go THEN NULL WHEN x_reach THEN tg - fc ELSE pp END AS c_pp, CASE WHEN x_reach THEN lvl1 WHEN pos = 2 THEN tr1 END AS c_tr FROM (
      SELECT *, enter AND coalesce(n_size > 0 AND n_risk > 0, false) AS go FROM (
       SELECT *, n_en + n_risk * 2 AS n_et, n_en + n_risk * 2 + fc AS n_tg, CASE WHEN n_lots >= {_D(0.01)} THEN round(n_lots, 2) ELSE 0 END AS n_size FROM (
        SELECT *, least(floor(bal * {_D(0.01)} / abs(n_risk) / {_D(0.01)}) * {_D(0.01)}, 100) AS n_lots FROM (
         SELECT *, n_en - n_es AS n_risk FROM (
          SELECT *, n_rs - fc AS n_es, ns * CASE WHEN ns = 1 THEN d_entry ELSE s_entry END + fc AS n_en FROM (
           SELECT *, ns * CASE WHEN ns = 1 THEN d_stop ELSE s_stop END AS n_rs, ns * CASE WHEN ns = 1 THEN lrun ELSE srun END AS n_run FROM (
            SELECT *, pos = 1 AND NOT x_stop AND best >= tg AS x_reach, pos = 2 AND NOT x_rstop AND best >= run AS x_rtgt, pos = 0 AND (ls OR ss) AS enter, CASE WHEN ls THEN 1 ELSE -1 END AS ns FROM (
             SELECT *, pos = 1 AND worst <= lvl1 AS x_stop, pos = 2 AND worst <= tr1 AS x_rstop FROM (
              SELECT *, be OR (pos = 1 AND coalesce((best - en) / risk >= 1, false)) AS be1, CASE WHEN pos = 1 AND NOT be AND (best - en) / risk >= 1 THEN en + 6 + fc ELSE lvl END AS lvl1, CASE WHEN pos = 2 THEN greatest(tr, CASE WHEN pa > 0 THEN sgn * pc - pa END) END AS tr1 FROM (
               SELECT i.*, {', '.join('w.' + c.strip() for c in _STATE.split(','))}, CASE WHEN w.sgn = 1 THEN i.high ELSE -i.low END AS best, CASE WHEN w.sgn = 1 THEN i.low ELSE -i.high END AS worst FROM sw w JOIN tin i ON i.symbol = w.symbol AND i.bar = w.bar + 1)))))))))))))))"""
#: Runners that keep their stop, and trades without a runner.
FIXED_STOP = SIMULATED.replace("greatest(tr, CASE WHEN pa > 0 THEN sgn * pc - pa END)", "tr").replace("'atr_trail_stop'", "'initial_stop_after_partial'")
NO_RUNNER = SIMULATED.replace("x_reach AND c_run IS NOT NULL", "false").replace("x_reach AND c_run IS NULL", "x_reach").replace("'close_rest_at_2r'", "'full_close_at_2r'").replace("'no_valid_sr_runner'", "'runner_disabled'").replace("CASE WHEN go THEN NULL WHEN x_reach THEN bar ELSE pb END", "NULL::BIGINT").replace("CASE WHEN go THEN NULL WHEN x_reach THEN tg - fc ELSE pp END", "NULL::DOUBLE").replace("WHEN x_reach THEN 2 ELSE pos", "ELSE pos")
_CHAIN = "WITH RECURSIVE " + ",\n".join([STRUCT, *_ZCHAIN[3:]])


def _simulation(rules: str) -> str:
    return ",\n".join([_CHAIN, _SR, _BREAKS, _COSTS, _INPUT, rules, "td AS (SELECT symbol, 'H1' AS timeframe, trade.* FROM sw WHERE trade IS NOT NULL)"])


_TRADED = _simulation(SIMULATED)
_ROUNDED = ("entry", "exit", "initial_stop", "final_stop", "target", "executed_stop", "executed_target", "risk_price", "size", "pnl_cash", "pnl_r", "partial_price", "runner_target", "runner_stop", "commission", "balance_after")

SHOWN = ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED) + ", outcome, be_moved, partial_bar, runner_qualified, runner_active, runner_exit_reason, exit_type"
_LISTED = "\nSELECT symbol, timeframe, no AS trade_no, side, entry_bar, exit_bar, " + SHOWN + " FROM td"

_MOMENTS = "g AS (SELECT symbol, timeframe, count(*)::DOUBLE AS n, avg(pnl_cash / 10000) / stddev_samp(pnl_cash / 10000) AS s, coalesce(skewness(pnl_cash / 10000), 0) AS skew, coalesce(kurtosis(pnl_cash / 10000), 0) AS kurt FROM t GROUP BY ALL)"
#: The normal distribution function by its series around 0.
_PHI = """z AS (SELECT *, s * sqrt(n - 1) / sqrt(1 - skew * s + (kurt + 2) / 4 * s * s) AS z FROM g),
ph AS (SELECT symbol, timeframe, z, 0 AS k, z AS term, z AS total FROM z UNION ALL SELECT symbol, timeframe, z, k + 1, term * z * z / (2 * k + 3), total + term * z * z / (2 * k + 3) FROM ph WHERE k < 200)"""

#: Trials of a symbol are its years; quantiles of the normal distribution for up to 40 trials.
_QUANTILES = ", ".join(f"({n}, {NormalDist().inv_cdf(1 - 1 / n)!r}::DOUBLE, {NormalDist().inv_cdf(1 - 1 / (n * math.e))!r}::DOUBLE)" for n in range(2, 41))
_TRIALS = f"""y AS (SELECT symbol, count(*) AS trials, var_samp(s) AS v FROM (SELECT symbol, avg(pnl_cash / 10000) / nullif(stddev_samp(pnl_cash / 10000), 0) AS s FROM t GROUP BY symbol, year(trade_date)) GROUP BY symbol),
th AS (SELECT symbol, trials, CASE WHEN trials > 1 AND v > 0 THEN sqrt(v) * ((1 - 0.5772156649015329::DOUBLE) * qa + 0.5772156649015329::DOUBLE * qb) ELSE 0 END AS threshold FROM y LEFT JOIN (VALUES {_QUANTILES}) AS q(k, qa, qb) ON k = trials)"""

SQL: dict[str, str] = {
    "liquidity_pools": _CHAIN + ",\n" + POOLS + "\nSELECT symbol, bar, round(aprice, 6) AS liquidity_pool_low, round(bprice, 6) AS liquidity_pool_high, avalid AS liquidity_long_valid, bvalid AS liquidity_short_valid FROM pw WHERE bar >= 0",
    "trades": _TRADED + _LISTED,
    "trades_with_fixed_stop": _simulation(FIXED_STOP) + _LISTED,
    "trades_without_runner": _simulation(NO_RUNNER) + _LISTED,
    "equity_curve": _TRADED + f""", bl AS (SELECT symbol, max(bar) AS last FROM tin GROUP BY symbol), lx AS (SELECT symbol, max(exit_bar) AS done, arg_max(balance_after, no) AS equity FROM td GROUP BY symbol),
pt AS (SELECT symbol, 0 AS k, 0 AS bar, {_D(10000)} AS equity FROM bl UNION ALL SELECT symbol, no, exit_bar, balance_after FROM td UNION ALL SELECT symbol, 1000000, last, coalesce(equity, {_D(10000)}) FROM bl LEFT JOIN lx USING (symbol) WHERE coalesce(done, 0) <> last)
SELECT p.symbol, 'H1' AS timeframe, CAST(row_number() OVER (PARTITION BY p.symbol ORDER BY k) - 1 AS INTEGER) AS seq, CAST(p.bar AS BIGINT) AS bar, i.time, round(equity, 6) AS equity FROM pt p LEFT JOIN tin i ON i.symbol = p.symbol AND i.bar = p.bar""",
    "deflated_sharpe_trials": f"WITH RECURSIVE {TRADES},\n{_MOMENTS.replace('symbol, timeframe,', 'symbol, 1 AS timeframe,')},\n{_TRIALS},\n{_PHI.replace('(s * ', '((s - threshold) * ').replace('s * sqrt(n - 1)', '(s - threshold) * sqrt(n - 1)').replace('FROM g)', 'FROM g JOIN th USING (symbol))')}\nSELECT z.symbol, round(s * sqrt(n), 6) AS sharpe, round(0.5 + total * exp(-z.z * z.z / 2) / sqrt(2 * pi()), 6) AS deflated_sharpe_ratio, round(threshold, 6) AS deflated_sharpe_threshold, CAST(trials AS INTEGER) AS deflated_sharpe_trials, 'multiple_testing_adjusted' AS deflated_sharpe_mode FROM z JOIN ph USING (symbol, timeframe) WHERE k = 200",
    "deflated_sharpe": f"WITH RECURSIVE {TRADES},\n{_MOMENTS},\n{_PHI}\nSELECT z.symbol, z.timeframe, round(s * sqrt(n), 6) AS sharpe, round(0.5 + total * exp(-z.z * z.z / 2) / sqrt(2 * pi()), 6) AS deflated_sharpe_ratio, 'single_trial_psr_equivalent' AS deflated_sharpe_mode FROM z JOIN ph USING (symbol, timeframe) WHERE k = 200",
}

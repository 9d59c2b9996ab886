"""DuckDB twins of the queries over sources, sinks, stored runs and training tables."""

from __future__ import annotations

from tidemark.plans.oracle import SQL as _PLAIN_SQL
from tidemark.plans.oracle import _BANDS, _FILL, _GAPS, _KEPT, _LEGS, _LEVELS, _PROFILE, _SR, ATR, BARS, PIP, TR, UPTO, ZCAND, ZIN, _blocks, _D, _t, _with
from tidemark.plans.oracle_states import _BREAKS, _CHAIN, _COSTS, _INPUT, POOLS, SHOWN, SIMULATED

_RANGE = "min(time) AS a, max(time) AS b FROM bars GROUP BY symbol"
_REQUESTS = "(VALUES (0, DATE '2023-11-01', DATE '2024-01-10'), (1, DATE '2024-01-12', DATE '2024-03-01'), (2, DATE '2025-01-01', DATE '2025-02-01'), (3, DATE '2020-01-01', DATE '2020-02-01'), (4, DATE '2024-01-09', DATE '2024-01-09')) AS q(request, s, e)"
_OWN_PIP = "(CASE symbol WHEN 'error' THEN 20.0 WHEN 'view' THEN 30.0 ELSE 25.0 END)::DOUBLE"

_SWEEPS = _PLAIN_SQL["session_sweeps"]

# all layers side by side, one row for each bar
_SESSION = _blocks("zoned") + ",\n" + _LEVELS + f""",
sw0 AS (SELECT *, {' OR '.join(f"coalesce(low < prev_{s}_low AND close >= prev_{s}_low, false)" for s in ('asia', 'london', 'newyork'))} AS dl, {' OR '.join(f"coalesce(high > prev_{s}_high AND close <= prev_{s}_high, false)" for s in ('asia', 'london', 'newyork'))} AS dh FROM sl),
ses AS (SELECT *, coalesce(bar - last_value(CASE WHEN dl OR dh THEN bar END IGNORE NULLS) OVER {UPTO} <= 24, false) AS recent FROM sw0),
prof AS (SELECT s2.symbol, bar, coalesce(abs(d_entry - poc) <= 5, false) OR coalesce(d_bottom - 5 <= poc AND poc <= d_top + 5, false) AS vl, coalesce(abs(s_entry - poc) <= 5, false) OR coalesce(s_bottom - 5 <= poc AND poc <= s_top + 5, false) AS vs FROM s2 JOIN p3 USING (symbol, session_block))"""
_SESSION = _SESSION.replace("ses AS (", _PROFILE + ",\nses AS (", 1)
_LAYERS = ",\n".join([_CHAIN, _LEGS, _BANDS, _GAPS.format(source="zoned"), _FILL, POOLS, _SR, _BREAKS, _SESSION]) + f""",
lay AS (SELECT z.symbol, z.bar, ses.session_name, ses.recent AND z.d_valid AS session_liquidity_long_valid, ses.recent AND z.s_valid AS session_liquidity_short_valid, vl AS volume_profile_long_valid, vs AS volume_profile_short_valid, h.gvalid AS imbalance_long_valid, h.hvalid AS imbalance_short_valid,
  fib_long AS fibonacci_long_valid, fib_short AS fibonacci_short_valid, avalid AS liquidity_long_valid, bvalid AS liquidity_short_valid, coalesce(lrr BETWEEN {_D(2.3)} AND 4, false) AS support_resistance_long_valid, coalesce(srr BETWEEN {_D(2.3)} AND 4, false) AS support_resistance_short_valid,
  rb.trend = 1 AND ub AS market_structure_long_valid, rb.trend = -1 AND db AS market_structure_short_valid, z.d_valid AS supply_demand_long_valid, z.s_valid AS supply_demand_short_valid,
  z.d_valid AND rb.trend = 1 AND ub AND z.d_touch AND coalesce(z.close >= z.d_entry, false) AND z.close > z.open AS long_signal, z.s_valid AND rb.trend = -1 AND db AND z.s_touch AND coalesce(z.close <= z.s_entry, false) AND z.close < z.open AS short_signal,
  r.lref, r.sref, r.lrr, r.srr
  FROM zoned z JOIN ses USING (symbol, bar) JOIN prof USING (symbol, bar) JOIN hz h USING (symbol, bar) JOIN bands USING (symbol, bar) JOIN pw USING (symbol, bar) JOIN r6 r USING (symbol, bar) JOIN rb USING (symbol, bar))"""
_NAMES = ("session_liquidity", "volume_profile", "imbalance", "fibonacci", "liquidity", "support_resistance", "market_structure", "supply_demand")
_TRADED = ",\n".join([_LAYERS, _COSTS, _INPUT, SIMULATED, "td AS (SELECT symbol, 'H1' AS timeframe, trade.* FROM sw WHERE trade IS NOT NULL)"])
_COUNT = " + ".join(f"coalesce(CASE WHEN side = 'long' THEN {n}_long_valid ELSE {n}_short_valid END, false)::INT" for n in _NAMES) + " + 1"
_SIDE = lambda n: f"CASE WHEN side = 'long' THEN {n}_long_valid ELSE {n}_short_valid END AS {n}_valid"

_PRED = f"""pr AS (SELECT symbol AS run, CASE WHEN timeframe = 'F' THEN 'test' ELSE 'validation' END AS split, label, CASE WHEN rk <= greatest(1, ceil(n * {_D(0.35)})) THEN 1 ELSE 0 END AS sel, 1.0::DOUBLE - rk / n AS s, row_id FROM k)"""


def _metrics(keys: str, name: str) -> str:
    part = f"PARTITION BY {keys}"
    return f"""{name}c AS (SELECT {keys}, count(*) FILTER (WHERE label = 1 AND sel = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND sel = 1) AS fp, count(*) FILTER (WHERE label = 1 AND sel <> 1) AS fn, count(*) FILTER (WHERE label <> 1 AND sel <> 1) AS tn, count(*) AS rows FROM pr GROUP BY {keys}),
{name}r AS (SELECT {keys}, label, rank() OVER ({part} ORDER BY s) + (count(*) OVER (PARTITION BY {keys}, s) - 1) / 2.0 AS ar, row_number() OVER ({part} ORDER BY s DESC, row_id) AS rk, sum(label) OVER ({part} ORDER BY s DESC, row_id ROWS UNBOUNDED PRECEDING) AS hits FROM pr),
{name}a AS (SELECT {keys}, (sum(ar) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 0))::DOUBLE) AS roc_auc, avg(hits / rk) FILTER (WHERE label = 1) AS average_precision FROM {name}r GROUP BY {keys}),
{name} AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, (tp + tn) / rows::DOUBLE AS accuracy, (tp + fp) / rows::DOUBLE AS selected_rate, (tp + fn) / rows::DOUBLE AS positive_rate FROM {name}c JOIN {name}a USING ({keys})))"""


_NUMBERS = ("roc_auc", "average_precision", "precision", "recall", "f1", "accuracy", "selected_rate", "positive_rate")
_MEANS = tuple(n for n in _NUMBERS if n != "accuracy")
_SHOW = ", ".join(f"round({n}, 6) AS {n}" for n in _NUMBERS)
_PF = "sum(pnl_cash) FILTER (WHERE pnl_cash > 1e-6 AND {w}) / abs(sum(pnl_cash) FILTER (WHERE pnl_cash < -1e-6 AND {w}))"
_EFFECT = ", ".join(f"round(sum(pnl_cash) FILTER (WHERE {w}), 6) AS {k}_pnl, round(avg(pnl_r) FILTER (WHERE {w}), 6) AS {k}_expectancy_r, round(avg(CASE WHEN pnl_cash > 1e-6 THEN 1.0 ELSE 0.0 END) FILTER (WHERE {w}) * 100, 6) AS {k}_win_rate, round({_PF.format(w=w)}, 6) AS {k}_profit_factor" for k, w in (("baseline", "true"), ("filtered", "sel")))
_LOG = {
    "direction": "side", "entry_time": "i.time", "exit_time": "x.time", "open_bar": "entry_bar", "close_bar": "exit_bar", "entry": "entry", "stop": "final_stop", "initial_stop": "initial_stop", "target": "target", "exit_price": "exit", "size": "size", "remaining_size": "0.0", "risk": "risk_price", "breakeven_moved": "be_moved", "is_breakeven_exit": "outcome = 'Breakeven'",
    "partial_taken": "partial_bar IS NOT NULL", "partial_price": "partial_price", "partial_bar": "partial_bar", "runner_qualified": "runner_qualified", "runner_active": "runner_active", "runner_reference_level": "CASE WHEN runner_qualified THEN CASE WHEN side = 'long' THEN lref ELSE sref END END", "runner_target_price": "runner_target", "runner_target_rr": "CASE WHEN runner_qualified THEN CASE WHEN side = 'long' THEN l.lrr ELSE l.srr END END",
    "runner_stop_price": "runner_stop", "runner_exit_reason": "runner_exit_reason", "final_exit_type": "exit_type", "result_r": "pnl_r", "pnl": "pnl_cash", "commission_paid": "commission", "balance_after": "balance_after", "entry_slippage_pips": "c.slip", "entry_spread_pips": "c.spread",
}
_PLAIN = {"direction", "entry_time", "exit_time", "open_bar", "close_bar", "breakeven_moved", "is_breakeven_exit", "partial_taken", "partial_bar", "runner_qualified", "runner_active", "runner_exit_reason", "final_exit_type"}
_AT = "FROM td JOIN tin i ON i.symbol = td.symbol AND i.bar = entry_bar JOIN tin x ON x.symbol = td.symbol AND x.bar = exit_bar JOIN cp c ON c.symbol = td.symbol AND c.bar = entry_bar JOIN cp e ON e.symbol = td.symbol AND e.bar = exit_bar JOIN lay l ON l.symbol = td.symbol AND l.bar = entry_bar"

SQL: dict[str, str] = {
    "bars_stored": _with(BARS) + "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar, time, open, close FROM bars WHERE symbol IN ('click', 'view') AND time BETWEEN '2024-01-05 06:00:00' AND '2024-01-20 18:00:00'",
    "bars_standardised": "SELECT event_type AS symbol, date_trunc('minute', ts) AS time, min(value) AS close FROM events WHERE event_id % 50 <> 0 GROUP BY ALL",
    "bars_zoned": "SELECT event_type AS symbol, date_trunc('minute', ts) AS time, min(value) AS close FROM events GROUP BY ALL",
    "bars_chunked": _with(BARS) + "SELECT symbol, 'H1' AS timeframe, row_number() OVER (ORDER BY time) - 1 AS bar, time, open, high, low, close, tick_volume FROM bars WHERE symbol = 'purchase' AND time BETWEEN '2024-01-03 00:00:00' AND '2024-01-25 12:00:00'",
    "bars_fetched": _with(BARS) + "SELECT symbol, 'H1' AS timeframe, time, open, high, low, close, tick_volume FROM bars WHERE symbol IN ('view', 'error') AND time >= '2024-01-12 03:00:00' AND time < '2024-01-21 00:00:00'",
    "symbols_listed": """SELECT CASE p_partkey % 3 WHEN 0 THEN 'USDJPY' WHEN 1 THEN 'XAUUSD' ELSE 'EURUSD' END || '.' || p_partkey AS symbol, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 6)::INT END AS digits, CASE WHEN p_partkey % 4 <> 0 THEN 0.001::DOUBLE END AS point, 0.25::DOUBLE AS tick_size, 100.0::DOUBLE AS contract_size, true AS unknown FROM part""",
    "features_cached": _LAYERS + "\nSELECT symbol, bar, " + ", ".join(f"{n}_{s}_valid" for n in _NAMES for s in ("long", "short")) + ", long_signal, short_signal FROM lay",
    "cache_covers": _with(BARS) + "SELECT symbol, min(time) AS first_time, max(time) AS last_time, min(time) >= '2024-01-01 00:00:00' AND max(time) <= '2024-01-30 22:00:00' AS usable FROM bars GROUP BY symbol",
    "date_ranges": _with(BARS) + f""", r AS (SELECT symbol, {_RANGE}), d AS (SELECT symbol, request, a::DATE AS lo, b::DATE AS hi, greatest(a::DATE, least(s, b::DATE)) AS s1, greatest(a::DATE, least(e, b::DATE)) AS e1 FROM r, {_REQUESTS})
SELECT symbol, request, CASE WHEN s1 < e1 THEN s1 WHEN e1 <= lo THEN lo ELSE greatest(lo, e1 - 1) END AS start, CASE WHEN s1 < e1 THEN e1 WHEN e1 <= lo THEN least(hi, lo + 1) ELSE e1 END AS "end" FROM d""",
    "unordered_times": "SELECT event_type, count(*) AS rows FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY value, event_id) AS before FROM events) WHERE ts < before GROUP BY event_type",
    "symbols_resolved": """WITH w AS (SELECT DISTINCT upper(string_split(p_name, ' ')[-1]) AS symbol FROM part UNION SELECT upper(trim(x)) FROM (VALUES (' red '), ('small ring'), ('none')) AS v(x)), c AS (SELECT DISTINCT p_name AS name, upper(p_name) AS up FROM part),
b AS (SELECT symbol, name, row_number() OVER (PARTITION BY symbol ORDER BY up <> symbol, NOT starts_with(up, symbol), levenshtein(up, symbol), name) AS k, count(*) OVER (PARTITION BY symbol) AS candidates FROM w JOIN c ON contains(up, symbol)) SELECT w.symbol, name AS broker_symbol, candidates FROM w LEFT JOIN b ON b.symbol = w.symbol AND k = 1""",
    "symbols_tradable": """WITH n AS (SELECT upper(['EURUSD.m', 'XAUUSDpro', 'US500', 'gbpjpy', 'SILVERx', 'Gold.spot', 'USDCAD_i', 'BTCUSD'][p_partkey % 8 + 1] || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2' END) AS u FROM part)
SELECT DISTINCT CASE WHEN u LIKE '%XAU%' OR u LIKE '%GOLD%' THEN 'XAUUSD' WHEN u LIKE '%XAG%' OR u LIKE '%SILVER%' THEN 'XAGUSD' WHEN regexp_matches(u, '^[A-Z]{6}') THEN u[1:6] ELSE u END AS symbol FROM n WHERE regexp_matches(u, '^(EUR|GBP|AUD|NZD|USD|CAD|CHF|JPY){2}') OR regexp_matches(u, 'XAU|XAG|GOLD|SILVER')""",
    "zones_by_spec": _with(BARS, TR, ATR, ZIN, ZCAND.replace(PIP, _OWN_PIP).replace(_D(12.5), f"(0.5::DOUBLE * {_OWN_PIP})")) + "SELECT symbol, side, created, pivot_bar, entry, round(stop, 6) AS stop, round(width_pips, 6) AS width_pips, round(stop_pips, 6) AS stop_pips FROM cand",
    "training_rows": """WITH g AS (SELECT l_returnflag AS symbol, l_linestatus AS timeframe, l_shipdate AS trade_date, l_orderkey AS entry_bar, CASE WHEN l_linenumber % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS position, sum(l_quantity) AS q, max(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT row_number() OVER (ORDER BY trade_date, symbol, timeframe, entry_bar, position) AS row_id, symbol, timeframe, trade_date, entry_bar, position, CASE WHEN q > 25 THEN 1 ELSE 0 END AS label_positive FROM g WHERE p % 7 <> 0 AND p % 100 <> 0""",
    "safe_rows": _t() + "SELECT symbol, timeframe, trade_date, entry_bar, position, 1 AS schema_version, session_valid::INT AS session_valid, CASE WHEN pnl_r BETWEEN -2 AND 2 THEN pnl_r END AS risk, pnl_cash, outcome, 1 AS label_positive, 0 AS label_hit_target, 0 AS label_runner FROM t",
    "normalised_trades": """WITH w AS (SELECT *, l_partkey + l_linenumber AS k FROM lineitem), v AS (SELECT *, CASE WHEN k % 5 <> 0 THEN l_quantity END AS c, k % 8 IN (0, 1, 2) AS gap_valid, k % 7 IN (0, 1, 2) AS runner_active FROM w)
SELECT gap_valid, runner_active, CASE WHEN coalesce(c, 0) > 0 THEN 'Win' WHEN c < 0 THEN 'Loss' ELSE 'Breakeven' END AS outcome_group, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS lots, count(*) AS rows, sum(c) AS pnl, count(*) FILTER (WHERE k % 9 <> 0) AS dated, max(l_shipdate) FILTER (WHERE k % 9 <> 0) AS "last" FROM v GROUP BY ALL""",
    "trade_details": _t() + 'SELECT row_id, pnl_cash AS "result.pnl_cash", pnl_r AS "result.pnl_r", session_valid AS "conditions.session_valid", gap_valid AS "conditions.gap_valid" FROM t',
    "equity_rebuilt": _t() + """, a AS (SELECT row_number() OVER (ORDER BY row_id) AS step, trade_date AS time, last_value(CASE WHEN row_id % 3 = 0 THEN row_id * 1.5::DOUBLE END IGNORE NULLS) OVER (ORDER BY row_id) AS equity, true AS stored FROM t WHERE row_id > 2),
b AS (SELECT row_id AS step, trade_date AS time, 10000 + sum(pnl_cash) OVER (ORDER BY row_id) AS equity, false AS stored FROM t) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT 0, min(time), 10000, stored FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY stored""",
    "run_stats": _t() + "SELECT symbol, count(*) AS trades, round_even(sum(pnl_cash), 2) AS net_pnl, round_even(sum(pnl_cash) / 10000 * 100.0, 2) AS roi_pct, round_even(avg(pnl_cash) FILTER (WHERE pnl_cash > 0), 4) AS avg_win, round_even(avg(pnl_cash) FILTER (WHERE pnl_cash < 0), 2) AS avg_loss, round_even(avg(pnl_r), 4) AS avg_rr_per_trade FROM t GROUP BY symbol",
    "run_trades_stored": _t() + 'SELECT symbol, gap_valid, outcome AS outcome_group, count(*) AS rows, sum(pnl_cash) AS pnl, max(trade_date) AS "last", 0::BIGINT AS missing_rows FROM t GROUP BY ALL',
    "trade_log": _TRADED + "\nSELECT td.symbol, td.timeframe, " + ", ".join(f"{x} AS {n}" if n in _PLAIN else f"round({x}, 6) AS {n}" for n, x in _LOG.items()) + f" {_AT}",
    "trade_report": _TRADED + f"""
SELECT td.symbol, td.timeframe, td.no AS trade_no, side, entry_bar, exit_bar, {SHOWN}, i.time AS trade_date, x.time AS exit_time, l.session_name, {_COUNT} AS confluence_count, exit_bar - entry_bar AS duration_bars, round(risk_price / 25, 6) AS risk_pips,
round(c.spread, 6) AS entry_spread_pips, round(c.slip, 6) AS entry_slippage_pips, round(e.spread, 6) AS exit_spread_pips, round(e.slip, 6) AS exit_slippage_pips, e.sf AS exit_session_factor, e.vf AS exit_volatility_factor,
round(CASE WHEN runner_qualified THEN CASE WHEN side = 'long' THEN lref ELSE sref END END, 6) AS sr_reference_level, round(CASE WHEN runner_qualified THEN CASE WHEN side = 'long' THEN lrr ELSE srr END END, 6) AS sr_target_rr,
(pnl_cash > 0)::INT AS label_positive, (partial_bar IS NOT NULL)::INT AS label_hit_target, runner_active::INT AS label_runner, {', '.join(_SIDE(n) for n in _NAMES)} {_AT}""",
    "streamed_sweeps": _SWEEPS + " WHERE time < (SELECT max(time) FROM bars) - INTERVAL 90 MINUTE",
    "layer_flags": _LAYERS + "\nSELECT symbol, bar, " + ", ".join(f"{n}_{s}_valid" for n in _NAMES for s in ("long", "short")) + ", long_signal, short_signal FROM lay",
    "lean_features": _with(BARS) + "SELECT symbol, count(*) AS bars, 0::BIGINT AS flags, 0::BIGINT AS known FROM bars GROUP BY symbol",
    "dataset_summaries": _t() + "SELECT symbol || '_X1' AS dataset, count(*) AS rows, symbol, min(trade_date) AS first_date, max(trade_date) AS last_date FROM t GROUP BY symbol",
    "runs_deleted": """WITH y AS (SELECT 'SYM' || o_orderstatus || '_H' || o_custkey % 3 AS series, year(o_orderdate) AS y, count(*) AS n, max(o_orderdate) AS d FROM orders GROUP BY ALL),
r AS (SELECT series, series || '_' || y || '0101_' || y || '1231_' || strftime(d, '%Y%m%d') || 'T' || lpad(n::VARCHAR, 6, '0') || 'Z' AS name, n % 2 = 0 AND series NOT LIKE 'SYMP%' AS stays FROM y)
SELECT 'run' AS kind, name FROM r WHERE stays UNION ALL SELECT DISTINCT 'dataset', series FROM r WHERE stays""",
    "orphaned_datasets": "SELECT DISTINCT p_brand || '_' || p_type AS dataset FROM part WHERE p_brand || '_' || p_type NOT IN (SELECT p_brand || '_' || p_type FROM part WHERE p_size > 10)",
    "selection_effect": _t(_KEPT) + f", m AS (SELECT *, rk <= greatest(1, ceil(n * {_D(0.35)})) AS sel FROM k) SELECT timeframe, count(*) AS rows, count(*) FILTER (WHERE sel) AS kept, count(DISTINCT fold) AS folds, {_EFFECT} FROM m GROUP BY timeframe",
    "classification_runs": _t(_KEPT, _PRED, _metrics("run, split", "one"), _metrics("split", "pool")) + f""", mn AS (SELECT split, {', '.join(f'avg({n}) AS mean_{n}' for n in _MEANS)} FROM one GROUP BY split)
SELECT run, split, tp, fp, fn, tn, rows, {_SHOW}, {', '.join(f'NULL::DOUBLE AS mean_{n}' for n in _MEANS)} FROM one UNION ALL SELECT 'AGGREGATE', split, tp, fp, fn, tn, rows, {_SHOW}, {', '.join(f'round(mean_{n}, 6)' for n in _MEANS)} FROM pool JOIN mn USING (split)""",
    "keep_ratio_choice": _t(_KEPT) + f""", q AS (SELECT {_D(0.35)} + i * (({_D(0.35)} + {_D(0.05)}) - {_D(0.35)}) AS ratio FROM range(14) AS x(i)), s AS (SELECT q.ratio, k.* FROM q, k WHERE rk <= greatest(1, ceil(n * ratio)) UNION ALL SELECT -1, k.* FROM k),
e AS (SELECT ratio, row_id, sum(pnl_r) OVER (PARTITION BY ratio ORDER BY row_id) AS c FROM s), f AS (SELECT ratio, max(c) OVER (PARTITION BY ratio ORDER BY row_id) - c AS d FROM e), dd AS (SELECT ratio, max(d) AS d FROM f GROUP BY ratio),
a AS (SELECT ratio, count(*)::DOUBLE AS trades, sum(pnl_cash) AS pnl, avg(pnl_r) AS er, least(sum(pnl_cash) FILTER (WHERE pnl_cash > 1e-6) / abs(sum(pnl_cash) FILTER (WHERE pnl_cash < -1e-6)), 5) AS pf FROM s GROUP BY ratio), b AS (SELECT pnl AS bp, d AS bd FROM a JOIN dd USING (ratio) WHERE ratio < 0),
o AS (SELECT a.*, d, CASE WHEN bp > 0 THEN pnl / bp END AS ret, 4 * coalesce(CASE WHEN bp > 0 THEN pnl / bp END, 1) + 2 * er + CASE WHEN bd > 0 THEN (bd - d) / bd ELSE 0 END + 0.5 * pf - {_D(0.05)} * ratio AS obj FROM a JOIN dd USING (ratio), b WHERE ratio > 0), p AS (SELECT *, trades >= 12 AND coalesce(ret >= {_D(0.95)}, true) AS ok FROM o), r AS (SELECT *, bool_or(ok) OVER () AS anyone FROM p)
SELECT round(ratio, 6) AS keep_ratio, trades, pnl, round(d, 4) AS max_drawdown_r, round(obj, 4) AS objective_score, ok AS eligible FROM r WHERE ok OR NOT anyone ORDER BY CASE WHEN NOT anyone THEN obj END DESC NULLS LAST, pnl DESC, er DESC, pf DESC, d, ratio LIMIT 1""",
    "streamed_bars": _with(BARS) + "SELECT symbol, time, open, high, low, close, tick_volume FROM bars WHERE time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "latest_rows": _t() + "SELECT symbol, max(row_id) AS row_id, arg_max(pnl_cash, row_id) AS pnl_cash FROM t GROUP BY symbol",
    "rows_in_blocks": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS place FROM lineitem)
SELECT l_returnflag, count(*) AS rows, count(*) AS places, count(*) AS "last", count(*) AS "of", round(sum(l_extendedprice) FILTER (WHERE place <= 100), 2) AS top FROM k GROUP BY l_returnflag""",
    "encoded_features": _t() + """SELECT feature, round(total, 4) AS total FROM (
  SELECT 'l_discount' AS feature, sum(CASE WHEN row_id % 4 <> 0 THEN d ELSE 0 END) AS total FROM te UNION ALL SELECT 'gap_valid', sum(gap_valid::INT) FROM te UNION ALL SELECT 'symbol_v_' || CASE WHEN symbol = 'R' THEN '__unknown' ELSE symbol END, count(*) FROM te GROUP BY ALL
  UNION ALL SELECT 'timeframe_v_' || timeframe, count(*) FROM te GROUP BY ALL UNION ALL SELECT 'position_v_' || position, count(*) FROM te GROUP BY ALL UNION ALL SELECT 'timeframe_v___unknown', 0 UNION ALL SELECT 'position_v___unknown', 0)""",
}
SQL["encoded_features"] = SQL["encoded_features"].replace("l_extendedprice AS score", "l_extendedprice AS score, l_discount AS d", 1).replace("SELECT feature, round(total", "\n, te AS (SELECT * FROM t)\nSELECT feature, round(total", 1)

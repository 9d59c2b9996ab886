"""Simulated execution of signals: adaptive costs, sizing, staged exits, compounding balance.

A trade's path does not depend on the balance, only its size does, and not on
other trades either. So the exits of all possible entries are found first, over
blocks of bars in parallel; signed by its direction, a path is a few searches for
the first bar that reaches a level. One position is open at a time: which entries
are taken, and how large, is a fold with a state of a few numbers.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.folds import fold_in_chunks
from tidemark.functions.quantiles import exact_medians
from tidemark.functions.series import KEYS, first_existing, is_true
from tidemark.functions.tables import materialise, renewed
from tidemark.plans.config import ExecutionConfig
from tidemark.sources.specs import SPEC, pip_of

#: Bars of a block, blocks of a group, and trades of one block that one task follows.
BLOCK, GROUP, PART = 1024, 1024, 4096


def with_costs(df: DataFrame, cfg: ExecutionConfig) -> DataFrame:
    """Add the session and volatility factors, adaptive spread and slippage in pips, and the cost of one fill as a price.

    Volatility is measured against the median of all positive ATR values of the series.
    """
    atr = first_existing(df, "atr_feature", "atr")
    flag = lambda c: is_true(F.col(c).cast("boolean")) if c in df.columns else F.lit(False)
    liquid, neutral, thin = cfg.session_factors
    session = F.when(flag("is_london_newyork_overlap"), F.lit(liquid)).when(flag("is_london_session") | flag("is_newyork_session"), F.lit(neutral)).when(flag("is_asia_session"), F.lit(thin)).otherwise(F.lit(neutral))
    if atr is None:
        df = df.withColumn("baseline_atr", F.lit(None).cast("double"))
        atr = F.lit(None).cast("double")
    else:
        base = exact_medians(df, F.when(atr > 0, atr), [*KEYS], "baseline_atr")
        df = df.join(base, [*KEYS], "left")
    ratio = F.when((atr > 0) & (F.col("baseline_atr") > 0), atr / F.col("baseline_atr"))
    medium, high = cfg.volatility_levels
    volatility = F.when(ratio >= high, F.lit(cfg.volatility_factors[1])).when(ratio >= medium, F.lit(cfg.volatility_factors[0])).otherwise(F.lit(1.0))
    df = df.withColumns({"session_factor": session, "volatility_factor": volatility})
    both = F.col("session_factor") * F.col("volatility_factor")
    low, top = (F.lit(cfg.slippage_pips * b) for b in cfg.slippage_bounds)
    df = df.withColumns({"spread_pips": F.greatest(F.lit(cfg.spread_pips) * both, F.lit(0.0)), "slippage_pips": F.greatest(low, F.least(F.lit(cfg.slippage_pips) * both, top))})
    pip = pip_of(df, cfg.pip)
    return df.withColumn("fill_cost", F.col("spread_pips") * pip / 2.0 + F.col("slippage_pips") * pip)


def lots_for(balance: float, risk: float, distance: float, cfg: ExecutionConfig) -> float:
    """Lots that risk a share of the balance over a distance, rounded down to the volume step; 0 below the minimum."""
    if distance <= 0:
        return 0.0
    lots = balance * risk / (distance * cfg.cash_per_unit)
    if lots <= 0:
        return 0.0
    if cfg.volume_step > 0:
        lots = math.floor(lots / cfg.volume_step) * cfg.volume_step
    if cfg.volume_max > 0:
        lots = min(lots, cfg.volume_max)
    if cfg.volume_min > 0 and lots < cfg.volume_min:
        return 0.0
    places = len(f"{cfg.volume_step:.10f}".rstrip("0").partition(".")[2]) if cfg.volume_step > 0 else 6
    return round(lots, places)


def lots_column(balance: Column, distance: Column, cfg: ExecutionConfig) -> Column:
    """``lots_for`` as a Column."""
    raw = F.try_divide(balance * (cfg.risk_percent / 100), distance * cfg.cash_per_unit)
    stepped = F.floor(raw / cfg.volume_step) * F.lit(cfg.volume_step) if cfg.volume_step > 0 else raw
    capped = F.least(stepped, F.lit(cfg.volume_max)) if cfg.volume_max > 0 else stepped
    places = len(f"{cfg.volume_step:.10f}".rstrip("0").partition(".")[2]) if cfg.volume_step > 0 else 6
    return F.when((distance > 0) & (raw > 0) & (capped >= cfg.volume_min), F.round(capped, places)).otherwise(F.lit(0.0))


class Block:
    """Arrays of consecutive bars of one series, signed so that every trade is a long."""

    def __init__(self, rows: pd.DataFrame, sign: int, cfg: ExecutionConfig):
        high, low = (rows["high"], rows["low"]) if sign > 0 else (rows["low"], rows["high"])
        self.start, self.n = int(rows["bar"].iat[0]), len(rows)
        self.best, self.worst = sign * high.to_numpy(float), sign * low.to_numpy(float)
        self.close, self.cost = sign * rows["close"].to_numpy(float), rows["fill_cost"].to_numpy(float)
        before, atr = sign * rows["close_before"].to_numpy(float), rows["atr_before"].to_numpy(float)
        self.trail = np.where(atr > 0, before - cfg.trail_atr * atr, -np.inf) if cfg.runner == "sr_atr_trail" else np.full(self.n, -np.inf)

    @staticmethod
    def first(hit: np.ndarray, start: int) -> int:
        """First place from ``start`` on that passes; the length if none does."""
        k = int(np.argmax(hit[start:])) + start if start < len(hit) else len(hit)
        return k if k < len(hit) and hit[k] else len(hit)


def follow(t: dict, b: Block, ends: bool, cfg: ExecutionConfig) -> None:
    """Take an open trade through the bars of one block; ``ends``: it is the last one of the series.

    The trade's stage is 0 up to the partial exit and 1 for a runner. It either
    gets its exit or waits for the next block.
    """
    at, n = t["next_bar"] - b.start, b.n

    def done(k: int, raw: float, kind: str, reason: str = "") -> None:
        t.update(exit_bar=b.start + k, raw=float(raw), exit_cost=float(b.cost[k]), exit_type=kind, reason=reason, open=False)

    if t["stage"] == 0:
        stopped, reached = b.first(b.worst <= t["level"], at), b.first(b.best >= t["target"], at)
        if not t["be"]:
            moved = b.first((b.best - t["entry"]) / t["risk"] >= 1.0, at)
            if moved < n and moved <= stopped and moved <= reached:
                t["be"], t["level"] = True, t["entry"] + cfg.commission_per_lot / cfg.cash_per_unit + float(b.cost[moved])
                stopped = b.first(b.worst <= t["level"], moved)
        if stopped < n and stopped <= reached:
            return done(stopped, t["level"], "stop_before_2r")
        if reached < n:
            if cfg.runner == "none":
                return done(reached, t["target"], "full_close_at_2r", "runner_disabled")
            t.update(partial_bar=b.start + reached, partial_cost=float(b.cost[reached]))
            if t["runner"] is None:
                return done(reached, t["target"], "close_rest_at_2r", "no_valid_sr_runner")
            t.update(stage=1, trail=t["level"])
            at = reached + 1
        elif ends:
            return done(n - 1, b.close[-1], "end_of_data")
    if t["stage"] == 1:
        if at < n:
            stops = np.maximum(t["trail"], np.maximum.accumulate(b.trail[at:]))
            k = b.first((b.worst[at:] <= stops) | (b.best[at:] >= t["runner"]), 0)
            t["trail"] = float(stops[min(k, len(stops) - 1)])
            if at + k < n:
                t["runner_stop"] = t["trail"]
                if b.worst[at + k] <= t["trail"]:
                    return done(at + k, t["trail"], "runner_stop", "atr_trail_stop" if cfg.runner == "sr_atr_trail" else "initial_stop_after_partial")
                return done(at + k, t["runner"], "runner_target", "sr_target")
        if ends:
            t["runner_stop"] = t["trail"]
            return done(n - 1, b.close[-1], "end_of_data", "end_of_data")
    t["next_bar"] = b.start + n


_STATE = "stage int, level double, be boolean, partial_bar long, partial_cost double, trail double, next_bar long, open boolean, exit_bar long, raw double, exit_cost double, exit_type string, reason string, runner_stop double"
PATH = f"symbol string, timeframe string, bar long, side string, entry double, raw_stop double, risk double, target double, runner double, entry_cost double, {_STATE}"
_PATH_COLUMNS = [c.split()[0] for c in PATH.split(", ")]


def own_config(rows: pd.DataFrame, cfg: ExecutionConfig) -> ExecutionConfig:
    """Settings with the spec that the bars of one series carry in place of those of the settings."""
    first = rows.iloc[0]
    known = {c: float(first[c]) for c in SPEC if c in rows.columns and pd.notna(first[c])}
    return replace(cfg, **{"pip" if c == "pip_size" else c: v for c, v in known.items()})


def follow_block(trades: pd.DataFrame, bars: pd.DataFrame, cfg: ExecutionConfig) -> pd.DataFrame:
    """Take all open trades of a block through its bars."""
    cfg, bars = own_config(bars, cfg), bars.sort_values("bar")
    blocks, ends = {"long": Block(bars, 1, cfg), "short": Block(bars, -1, cfg)}, bool(bars["bar"].iat[-1] == bars["last_bar"].iat[-1])
    rows = trades.astype(object).where(trades.notna(), None).to_dict("records")
    for t in rows:
        follow(t, blocks[t["side"]], ends, cfg)
    return pd.DataFrame(rows, columns=trades.columns).astype({"partial_bar": "Int64", "exit_bar": "Int64"})


def entries(rows: DataFrame, cfg: ExecutionConfig) -> DataFrame:
    """Every signal of either side as a trade that waits for its first bar (prices signed); without a positive risk it opens nothing."""
    sides = []
    for side, sign in (("long", 1.0), ("short", -1.0)):
        own = lambda c: F.lit(sign) * F.col(f"{side}_{c}")  # noqa: B023, E731
        cost = F.col("fill_cost")
        sides.append(F.when(is_true(F.col(f"{side}_signal")), F.struct(F.lit(side).alias("side"), (own("entry") + cost).alias("entry"), own("stop").alias("raw_stop"), ((own("entry") + cost) - (own("stop") - cost)).alias("risk"), own("runner").alias("runner"))))
    found = rows.select(*KEYS, "bar", F.col("fill_cost").alias("entry_cost"), *[c for c in SPEC if c in rows.columns], F.explode(F.array(*sides)).alias("t")).where("t is not null")
    found = found.select(*KEYS, "bar", "entry_cost", *[c for c in SPEC if c in rows.columns], "t.*")
    risk = F.col("risk")
    start = {"target": F.col("entry") + risk * cfg.target_rr + F.col("entry_cost"), "stage": F.lit(0), "level": F.col("raw_stop"), "be": F.lit(False), "next_bar": F.col("bar") + 1, "open": is_true((risk > 0) & ~F.isnan(risk))}
    kinds = dict(c.split() for c in PATH.split(", "))
    return found.withColumns(start | {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in (*found.columns, *start)})


def with_blocks(rows: DataFrame, cfg: ExecutionConfig) -> DataFrame:
    """Add what a block of bars needs of the bar before it and of its series."""
    whole = Window.partitionBy(*KEYS)
    before = whole.orderBy("bar")
    return rows.withColumns({"close_before": F.lag("close").over(before), "atr_before": F.lag("atr").over(before), "last_bar": F.max("bar").over(whole)})


def block_extremes(rows: DataFrame, cfg: ExecutionConfig) -> DataFrame:
    """What decides whether a block of bars can end a trade or move its stop, one row for each block.

    Highest and lowest price, the furthest trailing stop of either side, and
    whether a stop that is trailed inside the block alone is hit there.
    """
    inside = Window.partitionBy(*KEYS, "block").orderBy("bar")
    known = (F.col("atr_before") > 0) & F.lit(cfg.runner == "sr_atr_trail")
    trail = {"t_long": F.when(known, F.col("close_before") - cfg.trail_atr * F.col("atr_before")), "t_short": F.when(known, F.col("close_before") + cfg.trail_atr * F.col("atr_before"))}
    work = rows.withColumn("block", F.floor(F.col("bar") / BLOCK)).withColumns(trail)
    work = work.withColumns({"h_long": is_true(F.col("low") <= F.max("t_long").over(inside)), "h_short": is_true(F.col("high") >= F.min("t_short").over(inside))})
    ends = F.max("block").over(Window.partitionBy(*KEYS))
    cells = [F.max("high").alias("high"), F.min("low").alias("low"), F.max("t_long").alias("t_long"), F.min("t_short").alias("t_short"), F.max("h_long").alias("h_long"), F.max("h_short").alias("h_short")]
    return work.groupBy(*KEYS, "block").agg(*cells).withColumn("ends", F.col("block") == ends)


def next_blocks(trades: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Send open trades to the first block of a group that can change them, or to the next group.

    The last block of a series can always. Trailing stops move on over the blocks between.
    """
    blocks = blocks.sort_values("block")
    number, ends = blocks["block"].to_numpy(), blocks["ends"].to_numpy(bool)
    out = trades.copy()
    for k, t in enumerate(trades.astype(object).where(trades.notna(), None).to_dict("records")):
        long = t["side"] == "long"
        best, worst = (blocks["high"].to_numpy(float), blocks["low"].to_numpy(float)) if long else (-blocks["low"].to_numpy(float), -blocks["high"].to_numpy(float))
        at = int(np.searchsorted(number, t["block"]))
        if t["stage"] == 0:
            hit = (worst <= t["level"]) | (best >= t["target"])
            if not t["be"]:
                hit |= (best - t["entry"]) / t["risk"] >= 1.0
            stops = None
        else:
            own = blocks["t_long"].to_numpy(float) if long else -blocks["t_short"].to_numpy(float)
            stops = np.maximum.accumulate(np.concatenate([[t["trail"]], np.where(np.isnan(own), -np.inf, own)[at:]]))
            hit = blocks["h_long" if long else "h_short"].to_numpy(bool) | (best >= t["runner"])
            hit[at:] |= worst[at:] <= stops[:-1]
        go = Block.first(hit | ends, at)
        found = go < len(number)
        if stops is not None:
            out.iat[k, out.columns.get_loc("trail")] = float(stops[go - at])
        out.iat[k, out.columns.get_loc("block")] = int(number[go]) if found else int(number[-1]) + 1
        out.iat[k, out.columns.get_loc("ready")] = found
    return out


def exits(trades: DataFrame, bars: DataFrame, cfg: ExecutionConfig) -> DataFrame:
    """Exits of all trades, whether they are taken or not: what follows an entry doesn't depend on other trades.

    Bars are cut into blocks. A round takes all open trades through the block that
    they wait for, side by side over time and series; those that stay open look up,
    in the extremes of groups of blocks, the next block that can change them. So a
    task sees one block, and a trade costs a few rounds however long it lasts.
    """
    spec = [c for c in SPEC if c in trades.columns]
    kinds = dict(trades.dtypes)
    schema = ", ".join([PATH, *[f"{c} {kinds[c]}" for c in spec], "block long, ready boolean"])
    names = [*_PATH_COLUMNS, *spec, "block", "ready"]
    blocks = None
    blocked = bars.withColumn("block", F.floor(F.col("bar") / BLOCK))
    state = trades.withColumns({"block": F.floor(F.col("next_bar") / BLOCK), "ready": F.lit(True)})
    last = F.col("bar") == F.col("last_bar")
    # an entry on the last bar ends there
    state = state.join(bars.where(last).select(*KEYS, F.col("last_bar").alias("tm_last")), [*KEYS])
    state = state.withColumn("block", F.least("block", F.floor(F.col("tm_last") / BLOCK))).select(*names)
    done = state.where("not open")
    state = state.where("open")
    while True:
        # many trades can wait for one block: parts of them get their own copy of it
        part = F.floor((F.row_number().over(Window.partitionBy(*KEYS, "block").orderBy("bar")) - 1) / PART)
        waiting = state.where("ready").withColumn("part", part)
        here = renewed(blocked.join(waiting.select(*KEYS, "block", "part").distinct(), [*KEYS, "block"]))

        def through(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if own.empty or rows.empty:
                return pd.DataFrame(columns=names)
            out = follow_block(own.drop(columns="part"), rows, cfg)
            out["block"] = own["block"].to_numpy() + 1
            return out[names]

        moved = waiting.groupBy(*KEYS, "block", "part").cogroup(here.groupBy(*KEYS, "block", "part")).applyInPandas(through, schema)
        moved = materialise(moved.unionByName(state.where("not ready")))
        done = done.unionByName(moved.where("not open"))
        state = moved.where("open")
        if state.isEmpty():
            return done.drop("block", "ready")
        blocks = materialise(block_extremes(bars, cfg)) if blocks is None else blocks
        group = F.floor(F.col("block") / GROUP)
        state = state.withColumns({"tm_group": group, "part": F.floor((F.row_number().over(Window.partitionBy(*KEYS, group).orderBy("bar")) - 1) / PART)})
        near = renewed(blocks.withColumn("tm_group", group).join(state.select(*KEYS, "tm_group", "part").distinct(), [*KEYS, "tm_group"]))

        def search(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            return next_blocks(own[names], rows) if len(own) and len(rows) else pd.DataFrame(columns=names)

        by = [*KEYS, "tm_group", "part"]
        state = state.groupBy(*by).cogroup(near.groupBy(*by)).applyInPandas(search, schema)
        step = materialise(state)
        state = step.withColumn("next_bar", F.greatest(F.col("next_bar"), F.col("block") * BLOCK))


TRADES = (
    "symbol string, timeframe string, trade_no int, side string, entry_bar long, exit_bar long, entry double, exit double, initial_stop double, final_stop double, target double, executed_stop double, executed_target double, risk_price double, size double, pnl_cash double, pnl_r double, outcome string, be_moved boolean, partial_bar long, partial_price double, "
    "runner_qualified boolean, runner_active boolean, runner_target double, runner_stop double, runner_exit_reason string, exit_type string, commission double, balance_after double"
)


def take_trades(paths: pd.DataFrame, state: dict | None, cfg: ExecutionConfig) -> tuple[pd.DataFrame, dict]:
    """Take the entries of one series, with their exits known, in order: one position at a time, sized by the balance."""
    cfg = own_config(paths, cfg)
    cash, commission = cfg.cash_per_unit, max(cfg.commission_per_lot, 0.0)
    state = state or {"balance": cfg.balance, "free_from": 0, "long": -1, "short": -1, "no": 0}  # of the sides: last bar of the cooldown
    rows = paths.astype(object).where(paths.notna(), None).sort_values(["bar", "side"]).to_dict("records")
    out, seen = [], None
    for t in rows:
        i, side = t["bar"], t["side"]
        if i < state["free_from"] or i == seen or i <= state[side]:
            continue
        seen = i  # the first side that may enter decides; the other one isn't tried on this bar
        sign, risk = (1 if side == "long" else -1), t["risk"]
        size = lots_for(state["balance"], cfg.risk_percent / 100, abs(risk), cfg) if risk is not None and risk == risk else 0.0
        if not (size > 0 and risk > 0):
            continue
        entry, cost, x, pnl, paid, left, partial_price = t["entry"], t["entry_cost"], t["exit_bar"], 0.0, 0.0, size, None
        executed_target = entry + risk * cfg.target_rr
        if t["partial_bar"] is not None:
            part = size * cfg.partial
            partial_price = executed_target + cost - t["partial_cost"]
            pnl, paid, left = (partial_price - entry) * part * cash - cfg.commission_per_lot * part, cfg.commission_per_lot * part, max(size - part, 0.0)
        price = t["raw"] - t["exit_cost"]
        rest = max(commission * size - paid, 0.0)
        pnl += (price - entry) * left * cash - rest
        even = t["be"] and t["partial_bar"] is None and abs(t["raw"] - t["level"]) < 1e-12
        state["balance"] += pnl
        state["no"] += 1
        outcome = "Breakeven" if even else "Win" if pnl > 0 else "Loss"
        flip = lambda v: None if v is None else sign * v  # noqa: B023, E731
        out.append((t["symbol"], t["timeframe"], state["no"], side, int(i), int(x), sign * entry, sign * price, sign * t["raw_stop"], sign * t["level"], sign * (executed_target + cost), sign * (t["raw_stop"] - cost), sign * executed_target, risk, size, pnl, pnl / max(risk * size * cash, 1e-12), outcome, t["be"], None if t["partial_bar"] is None else int(t["partial_bar"]), flip(partial_price), t["runner"] is not None, t["stage"] == 1, flip(t["runner"]), flip(t["runner_stop"]), t["reason"], t["exit_type"], paid + rest, state["balance"]))
        # an exit frees the next bar, and its side after the cooldown; end of data leaves none
        state["free_from"], state[side] = int(x) + 1, int(x) + cfg.cooldown
    return pd.DataFrame(out, columns=[c.split()[0] for c in TRADES.split(", ")]).astype({"partial_bar": "Int64"}), state


def run_trades(features: DataFrame, cfg: ExecutionConfig | None = None) -> DataFrame:
    """Simulate every series on its own: one row for each trade.

    Exits are found in blocks of bars, in parallel; what remains in order is to
    take entries while no position is open and to size them by the balance, a few
    numbers handed on from chunk to chunk.
    """
    cfg = cfg or ExecutionConfig()
    costed = with_costs(features, cfg)
    none = F.lit(None).cast("double")
    atr = first_existing(features, "atr_feature", "atr")
    plan = {}
    for side in ("long", "short"):
        cols = (f"support_resistance_{side}_valid", f"sr_{side}_target", f"sr_{side}_target_rr")
        plan[side] = F.when(is_true(F.col(cols[0])) & F.col(cols[2]).isNotNull(), F.col(cols[1])) if all(c in features.columns for c in cols) else none
    rows = costed.select(
        *KEYS, "bar", "high", "low", "close", "fill_cost", (none if atr is None else atr).alias("atr"), "long_signal", "short_signal",
        F.col("demand_zone_entry").alias("long_entry"), F.col("demand_zone_stop").alias("long_stop"), F.col("supply_zone_entry").alias("short_entry"), F.col("supply_zone_stop").alias("short_stop"),
        plan["long"].alias("long_runner"), plan["short"].alias("short_runner"), *[c for c in SPEC if c in features.columns],
    )
    return simulate(rows, cfg)


def simulate(rows: DataFrame, cfg: ExecutionConfig) -> DataFrame:
    """Trades of all series, from bars with costs, signals and the plans of both sides."""
    rows = materialise(with_blocks(rows, cfg))
    paths = exits(entries(rows, cfg), rows, cfg)
    return fold_in_chunks(paths, [*KEYS], F.col("bar"), lambda own, state: take_trades(own, state, cfg), TRADES)


#: Flags and numbers of the entry bar that a trade report keeps where the features have them (fixed names).
SNAPSHOT = ("session_name", "trend_state", "atr_feature", "Session_Liquidity_Valid", "Volume_Profile_Valid", "Imbalance_Valid", "Fibonacci_Valid", "Liquidity_Valid", "Support_Resistance_Valid")


def trade_report(trades: DataFrame, features: DataFrame, cfg: ExecutionConfig) -> DataFrame:
    """Trades joined to their entry and exit bars: times, adaptive costs, direction-dependent flags and labels."""
    costed = with_costs(features, cfg)
    have = [c for c in (*SNAPSHOT, *[f"sr_{s}_{c}" for s in ("long", "short") for c in ("reference_level", "target_rr")]) if c in features.columns]
    entry = costed.select(*KEYS, F.col("bar").alias("entry_bar"), F.col("time").alias("trade_date"), F.col("spread_pips").alias("entry_spread_pips"), F.col("slippage_pips").alias("entry_slippage_pips"), pip_of(costed, cfg.pip).alias("tm_pip"), *have, *[c for c in costed.columns if c.endswith(("_long_valid", "_short_valid"))])
    exit_ = costed.select(*KEYS, F.col("bar").alias("exit_bar"), F.col("time").alias("exit_time"), F.col("spread_pips").alias("exit_spread_pips"), F.col("slippage_pips").alias("exit_slippage_pips"), F.col("session_factor").alias("exit_session_factor"), F.col("volatility_factor").alias("exit_volatility_factor"))
    out = trades.join(entry, [*KEYS, "entry_bar"], "left").join(exit_, [*KEYS, "exit_bar"], "left")
    for c in ("reference_level", "target_rr"):
        if f"sr_long_{c}" in out.columns and f"sr_short_{c}" in out.columns:
            out = out.withColumn(f"sr_{c}", F.when(F.col("runner_qualified"), F.when(F.col("side") == "long", F.col(f"sr_long_{c}")).otherwise(F.col(f"sr_short_{c}")))).drop(f"sr_long_{c}", f"sr_short_{c}")
    names = sorted({c.removesuffix("_long_valid") for c in out.columns if c.endswith("_long_valid")})
    own = {f"{n}_valid": F.when(F.col("side") == "long", F.col(f"{n}_long_valid")).otherwise(F.col(f"{n}_short_valid")) for n in names if f"{n}_short_valid" in out.columns}
    count = sum((is_true(c).cast("int") for c in own.values()), F.lit(0))
    out = out.withColumns(own | {"confluence_count": count, "duration_bars": F.col("exit_bar") - F.col("entry_bar"), "risk_pips": F.col("risk_price") / F.col("tm_pip"), "label_positive": (F.col("pnl_cash") > 0).cast("int"), "label_hit_target": F.col("partial_bar").isNotNull().cast("int"), "label_runner": F.col("runner_active").cast("int")})
    return out.drop("tm_pip", *[c for c in out.columns if c.endswith(("_long_valid", "_short_valid"))])


def equity_curve(trades: DataFrame, bars: DataFrame, balance: float) -> DataFrame:
    """Equity at bar 0, at every exit and at the last bar: symbol, timeframe, seq, bar, time, equity."""
    ends = bars.groupBy(*KEYS).agg(F.max("bar").alias("last"))
    exits = trades.select(*KEYS, F.col("exit_bar").alias("bar"), F.col("trade_no").alias("no"), F.col("balance_after").alias("equity"))
    first = ends.select(*KEYS, F.lit(0).cast("long").alias("bar"), F.lit(0).alias("no"), F.lit(float(balance)).alias("equity"))
    done = exits.groupBy(*KEYS).agg(F.max("bar").alias("done"), F.max_by("equity", "no").alias("equity"))
    tail = ends.join(done, [*KEYS], "left").where(~(F.coalesce("done", F.lit(0)) == F.col("last"))).select(*KEYS, F.col("last").alias("bar"), F.lit(2**31 - 1).alias("no"), F.coalesce("equity", F.lit(float(balance))).alias("equity"))
    points = first.unionByName(exits).unionByName(tail)
    seq = F.row_number().over(Window.partitionBy(*KEYS).orderBy("no")) - 1
    return points.withColumn("seq", seq).join(bars.select(*KEYS, "bar", "time"), [*KEYS, "bar"], "left").select(*KEYS, "seq", "bar", "time", "equity")

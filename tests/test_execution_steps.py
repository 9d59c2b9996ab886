"""The array-search simulation against a bar-by-bar statement of its rules, on random series."""

import random

import pandas as pd
import pytest

from tidemark.functions import folds
from tidemark.operators import execution
from tidemark.plans.config import ExecutionConfig

from tests.test_execution import simulated


def series(n, seed):
    r = random.Random(seed)
    price, rows = 100.0, []
    for k in range(n):
        close = price + r.uniform(-1.5, 1.5)
        high, low = max(price, close) + r.random(), min(price, close) - r.random()
        long_entry, short_entry = close - r.uniform(-0.2, 0.6), close + r.uniform(-0.2, 0.6)
        rows.append({
            "symbol": "X", "timeframe": "H1", "bar": k, "high": high, "low": low, "close": close, "fill_cost": r.choice([0.0, 0.01, 0.03]), "atr": r.choice([None, 0.4, 0.8]),
            "long_signal": r.random() < 0.2, "short_signal": r.random() < 0.2, "long_entry": long_entry, "long_stop": long_entry - r.uniform(-0.05, 1.0), "short_entry": short_entry, "short_stop": short_entry + r.uniform(-0.05, 1.0),
            "long_runner": long_entry + r.uniform(2, 5) if r.random() < 0.5 else None, "short_runner": short_entry - r.uniform(2, 5) if r.random() < 0.5 else None,
        })
        price = close
    return pd.DataFrame(rows)


def quiet(n, seed):
    """A slow drift: trades stay open over many blocks, some to the end."""
    r = random.Random(seed)
    rows = series(n, seed)
    for c in ("high", "low", "close"):
        rows[c] = [100 + 0.002 * k + {"high": 0.01, "low": -0.01, "close": 0.0}[c] * r.random() for k in range(n)]
    for s, sign in (("long", 1), ("short", -1)):
        rows[f"{s}_entry"] = rows["close"]
        rows[f"{s}_stop"] = rows["close"] - sign * 0.06
        rows[f"{s}_runner"] = [p + sign * 0.25 if k % 2 else None for k, p in enumerate(rows["close"])]
    rows["fill_cost"], rows["atr"] = 0.0, 0.05
    return rows


def by_steps(rows, cfg):
    """One open position; stops before targets; management from the bar after the entry."""
    done, trade, balance = [], None, cfg.balance
    ready = {"long": -1, "short": -1}
    bars = rows.to_dict("records")
    fee, cash = cfg.commission_per_lot, cfg.cash_per_unit

    def close_at(raw, bar, kind):
        nonlocal trade, balance
        t, s = trade, trade["sign"]
        price = raw - s * bars[bar]["fill_cost"]
        pnl = t["pnl"] + s * (price - t["entry"]) * t["left"] * cash - max(fee * t["size"] - t["paid"], 0)
        balance += pnl
        done.append((t["side"], t["bar"], bar, round(price, 9), kind, round(pnl, 6)))
        ready[t["side"]] = bar + cfg.cooldown
        trade = None

    for i, b in enumerate(bars):
        if trade is not None:
            s, t = trade["sign"], trade
            best, worst = (b["high"], b["low"]) if s > 0 else (b["low"], b["high"])
            if not t["partial"]:
                if not t["moved"] and s * (best - t["entry"]) / t["risk"] >= 1:
                    t["stop"], t["moved"] = t["entry"] + s * (fee / cash + b["fill_cost"]), True
                if s * (worst - t["stop"]) <= 0:
                    close_at(t["stop"], i, "stop_before_2r")
                    continue
                if s * (best - t["target"]) >= 0:
                    if cfg.runner == "none":
                        close_at(t["target"], i, "full_close_at_2r")
                        continue
                    part = t["size"] * cfg.partial
                    t["pnl"] = s * (t["target"] - s * b["fill_cost"] - t["entry"]) * part * cash - fee * part
                    t["paid"], t["left"], t["partial"], t["trail"] = fee * part, t["size"] - part, True, t["stop"]
                    if t["runner"] is None:
                        close_at(t["target"], i, "close_rest_at_2r")
                        continue
            else:
                before = bars[i - 1]
                if cfg.runner == "sr_atr_trail" and before["atr"] == before["atr"] and before["atr"] is not None:
                    candidate = before["close"] - s * cfg.trail_atr * before["atr"]
                    t["trail"] = max(t["trail"], candidate) if s > 0 else min(t["trail"], candidate)
                stop = t["trail"] if cfg.runner == "sr_atr_trail" else t["stop"]
                if s * (worst - stop) <= 0:
                    close_at(stop, i, "runner_stop")
                    continue
                if s * (best - t["runner"]) >= 0:
                    close_at(t["runner"], i, "runner_target")
                    continue
        if trade is None:
            for side, s in (("long", 1), ("short", -1)):
                if b[f"{side}_signal"] and i > ready[side]:
                    entry = b[f"{side}_entry"] + s * b["fill_cost"]
                    risk = s * (entry - (b[f"{side}_stop"] - s * b["fill_cost"]))
                    size = execution.lots_for(balance, cfg.risk_percent / 100, abs(risk), cfg)
                    if size > 0 and risk > 0:
                        plan = b[f"{side}_runner"]
                        trade = {"side": side, "sign": s, "bar": i, "entry": entry, "risk": risk, "size": size, "left": size, "stop": b[f"{side}_stop"], "target": entry + s * risk * cfg.target_rr + s * b["fill_cost"], "moved": False, "partial": False, "pnl": 0.0, "paid": 0.0, "runner": None if plan is None or plan != plan else plan}
                    break
    if trade is not None:
        close_at(bars[-1]["close"], len(bars) - 1, "end_of_data")
    return done


#: Bars of a block, blocks of a group, trades of a part, bars of a chunk.
WHOLE, SMALL = (1024, 1024, 4096, 1 << 16), (16, 3, 5, 40)


@pytest.mark.parametrize(("sizes", "runner", "cooldown"), [(WHOLE, "sr_atr_trail", 3), (SMALL, "none", 3), (SMALL, "sr_only", 0), (SMALL, "sr_atr_trail", 0)])
def test_blocks_equal_steps(spark, monkeypatch, sizes, runner, cooldown):
    """A series in one block and chunk, and in many small ones."""
    for where, name, value in zip((execution, execution, execution, folds), ("BLOCK", "GROUP", "PART", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(where, name, value)
    cfg = ExecutionConfig(runner=runner, cooldown=cooldown, commission_per_lot=4.0, contract_size=100.0)
    every = [series(160 if k else 1, k).assign(symbol=f"S{k}") for k in range(12)] + [quiet(160, k).assign(symbol=f"Q{k}") for k in range(3)]
    got = simulated(pd.concat(every), cfg)
    kinds = set()
    for rows in every:
        own = got[got.symbol == rows.symbol.iat[0]]
        want = by_steps(rows, cfg)
        assert [(t.side, t.entry_bar, t.exit_bar, round(t.exit, 9), t.exit_type, round(t.pnl_cash, 6)) for t in own.itertuples()] == want, rows.symbol.iat[0]
        kinds |= {w[4] for w in want}
    assert {"stop_before_2r", "end_of_data"} <= kinds and len(kinds) >= 3


def test_a_series_is_cut_over_time(spark, monkeypatch):
    """Exits of one series are found by many tasks, none of which sees more than a block of bars."""
    monkeypatch.setattr(execution, "BLOCK", 50)
    seen = spark.sparkContext.accumulator(0)
    real = execution.follow_block

    def watched(trades, bars, cfg):
        assert len(bars) <= 50
        seen.add(1)
        return real(trades, bars, cfg)

    monkeypatch.setattr(execution, "follow_block", watched)
    assert len(simulated(series(600, 3), ExecutionConfig(contract_size=100.0))) > 5
    assert seen.value >= 8


def test_a_ruined_account_takes_nothing_more(spark):
    """Sizes of zero depend on the balance: the entries after them are still looked at."""
    cfg = ExecutionConfig(contract_size=100.0, balance=150.0, risk_percent=30.0, commission_per_lot=40.0, volume_min=0.05)
    rows = series(400, 11)
    got, want = simulated(rows, cfg), by_steps(rows, cfg)
    assert [(t.entry_bar, round(t.pnl_cash, 6)) for t in got.itertuples()] == [(w[1], w[5]) for w in want]

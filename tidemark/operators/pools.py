"""Liquidity pools of swing prices, their sweeps into a zone, and validity after a sweep.

Pool prices are running means that depend on order, and a sweep removes its
pool, so a series is a fold over its bars. Only bars that change the state or
read it enter the fold, and what it knows (open pools, zone, last sweep) is handed
on from chunk to chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.folds import fold_in_chunks
from tidemark.functions.series import KEYS, effective_tolerance, first_existing, is_true, lag
from tidemark.functions.tables import materialise
from tidemark.operators.gaps import zone_key
from tidemark.plans.config import PoolConfig


@dataclass
class Side:
    """Pools of one side: rows of [price, created, last touch, touches]; and its last sweep."""

    sign: int  # 1: pools of lows under a demand zone, -1: of highs over a supply zone
    cfg: PoolConfig
    pools: list[list] = field(default_factory=list)
    key: tuple | None = None
    sweep: int | None = None

    def saved(self) -> dict:
        """What the next chunk needs."""
        return {"pools": self.pools, "key": self.key, "sweep": self.sweep}

    def restored(self, state: dict) -> Side:
        self.pools, self.sweep = state["pools"], state["sweep"]
        self.key = None if state["key"] is None else tuple(state["key"])
        return self

    def add(self, price: float, bar: int) -> None:
        """Give a swing to the nearest pool within the tolerance, or open one."""
        near = [(abs(price - p[0]), k) for k, p in enumerate(self.pools) if abs(price - p[0]) <= self.cfg.tolerance]
        if near:
            pool = self.pools[min(near)[1]]
            pool[0] = (pool[0] * pool[3] + price) / (pool[3] + 1)
            pool[2], pool[3] = bar, pool[3] + 1
        else:
            self.pools.append([price, bar, bar, 1])

    def step(self, bar: int, swing: float | None, key: tuple | None, high: float, low: float, close: float, tolerance: float) -> tuple[float | None, bool]:
        """Advance by one bar; returns (price of the relevant pool, valid)."""
        if swing is not None:
            self.add(swing, bar)
        if key != self.key:
            self.key, self.sweep = key, None
        if key is None:
            return None, False
        _, bottom, top = key
        least = 2 if self.cfg.two_touches else 1
        fitting = [p for p in self.pools if p[3] >= least and bottom - tolerance <= p[0] <= top + tolerance]
        price = None
        if fitting:
            pool = max(fitting, key=lambda p: (p[2], p[1], p[0]))
            price = pool[0]
            beyond = low < price <= close if self.sign > 0 else high > price >= close
            if beyond and high >= bottom - tolerance and low <= top + tolerance:
                self.sweep = bar
                self.pools = [p for p in self.pools if p is not pool]
        return price, self.sweep is not None and bar - self.sweep <= self.cfg.sweep_bars


OUT = "symbol string, timeframe string, bar long, liquidity_pool_low double, liquidity_pool_high double, liquidity_long_valid boolean, liquidity_short_valid boolean"


def _value(x):
    return None if x is None or x != x else x


def fold_rows(rows: pd.DataFrame, sides: tuple[Side, Side]) -> pd.DataFrame:
    """Advance both sides over the bars of one series in order."""
    out = []
    for r in rows.itertuples(index=False):
        got = []
        for side, swing, born, a, b in ((sides[0], r.sl, r.d_born, r.d_low, r.d_high), (sides[1], r.sh, r.s_born, r.s_low, r.s_high)):
            key = None if _value(born) is None else (int(born), float(a), float(b))
            got.append(side.step(int(r.bar), _value(swing), key, r.high, r.low, r.close, r.tol))
        out.append((r.symbol, r.timeframe, r.bar, got[0][0], got[1][0], got[0][1], got[1][1]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def add_pools(df: DataFrame, config: PoolConfig | None = None, source: DataFrame | None = None) -> DataFrame:
    """Add the liquidity layer. ``source``: a materialised table of the same bars to find the pools in."""
    cfg, bars = config or PoolConfig(), df
    df = df if source is None else source
    high, low = first_existing(df, "ext_swing_high", "int_swing_high"), first_existing(df, "ext_swing_low", "int_swing_low")
    if high is None or low is None:
        none = {c: F.lit(None).cast("double") for c in ("liquidity_pool_high", "liquidity_pool_low")}
        return bars.withColumns(none | {c: F.lit(False) for c in ("liquidity_long_valid", "liquidity_short_valid", "Liquidity_Valid")})
    atr = first_existing(df, "atr_feature", "atr")
    tolerance = effective_tolerance(cfg.tolerance, cfg.proximity_atr, atr if atr is not None else F.lit(None).cast("double"))
    keyed = df.withColumns({"tm_d": zone_key(df, "demand"), "tm_s": zone_key(df, "supply")})
    # the first bar without a zone ends its episode; further bars without zone and swing change nothing
    keyed = keyed.withColumn("tm_live", high.isNotNull() | low.isNotNull() | F.col("tm_d").isNotNull() | F.col("tm_s").isNotNull() | lag("tm_d").isNotNull() | lag("tm_s").isNotNull())
    rows = keyed.where("tm_live").select(*KEYS, "bar", "high", "low", "close", high.alias("sh"), low.alias("sl"), tolerance.alias("tol"), *[F.col(f"tm_{s}.{c}").alias(f"{s}_{c}") for s in "ds" for c in ("born", "low", "high")])

    def run(group: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, list]:
        sides = [Side(1, cfg), Side(-1, cfg)]
        if state:
            sides = [side.restored(own) for side, own in zip(sides, state, strict=True)]
        return fold_rows(group.sort_values("bar"), tuple(sides)), [side.saved() for side in sides]

    found = fold_in_chunks(materialise(rows), [*KEYS], F.col("bar"), run, OUT)
    out = bars.join(found, [*KEYS, "bar"], "left")
    out = out.withColumns({c: is_true(F.col(c)) for c in ("liquidity_long_valid", "liquidity_short_valid")})
    return out.withColumn("Liquidity_Valid", F.col("liquidity_long_valid") | F.col("liquidity_short_valid"))

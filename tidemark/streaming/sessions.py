"""Session levels and sweeps of a stream of bars, with state that survives restarts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.series import KEYS, first_existing, is_true
from tidemark.operators.sessions import session_name
from tidemark.plans.config import SessionConfig

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "at long, session string, day int, high double, low double, close double, long_zone boolean, short_zone boolean"
_FIELDS = [c.split()[0] for c in _ROW.split(", ")]


class Levels:
    """What a series knows between two bars: the open block, the levels of completed sessions, and the last sweep."""

    def __init__(self, cfg: SessionConfig, state: dict | None = None):
        self.cfg, self.names = cfg, [s for s, _, _ in cfg.sessions]
        state = state or {"bar": -1, "seen": None, "timer": None, "block": None, "high": None, "low": None, "levels": {s: [None, None] for s in self.names}, "sweep": None}
        self.__dict__.update(state)

    def saved(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cfg", "names")}

    def _swept(self, level: float | None, r, below: bool) -> bool:
        if level is None:
            return False
        wick = r.low < level if below else r.high > level
        back = r.close >= level if below else r.close <= level
        return bool(wick and (back if self.cfg.close_back else self.cfg.wick_sweeps))

    def step(self, r) -> tuple:
        """Advance by one bar; returns its result row."""
        self.bar, self.seen = self.bar + 1, int(r.at)
        session = None if pd.isna(r.session) else r.session
        if self.block != [session, int(r.day)]:
            if self.block is not None and self.block[0] in self.levels:
                self.levels[self.block[0]] = [self.high, self.low]
            self.block, self.high, self.low = [session, int(r.day)], float(r.high), float(r.low)
        else:
            self.high, self.low = max(self.high, float(r.high)), min(self.low, float(r.low))
        low, high = (any(self._swept(self.levels[s][k], r, k == 1) for s in self.names) for k in (1, 0))
        if low or high:
            self.sweep = self.bar
        recent = self.sweep is not None and self.bar - self.sweep <= self.cfg.sweep_bars
        long, short = recent and bool(r.long_zone), recent and bool(r.short_zone)
        return (int(r.at), self.bar, session, *[x for s in self.names for x in self.levels[s]], low, high, long, short, long or short)


class SessionProcessor(StatefulProcessor):
    """Holds the bars of a series until the watermark has passed them, then takes them in time order.

    A timer stands at the earliest bar that waits, so a series costs one timer
    however many bars wait. Bars at or before one that was taken are dropped.
    """

    def __init__(self, cfg: SessionConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("levels", "json string")
        self.waiting = handle.getListState("waiting", _ROW)

    def _levels(self) -> Levels:
        return Levels(self.cfg, json.loads(self.state.get()[0]) if self.state.exists() else None)

    def _wait(self, levels: Levels, rows: pd.DataFrame) -> None:
        """Keep what waits, and see that a timer stands at its first bar."""
        if rows.empty:
            self.waiting.clear()
        else:
            self.waiting.put(list(rows[_FIELDS].itertuples(index=False, name=None)))
            first = int(rows["at"].min()) // 1000
            if levels.timer is None or first < levels.timer:
                self.handle.registerTimer(first)
                levels.timer = first
        self.state.update((json.dumps(levels.saved()),))

    def _kept(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=_FIELDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        levels = self._levels()
        new = pd.concat([r[_FIELDS] for r in rows])
        if levels.seen is not None:
            new = new[new["at"] > levels.seen]
        old = self._kept()
        self._wait(levels, pd.concat([old, new]).drop_duplicates("at", keep="last") if len(old) else new.drop_duplicates("at", keep="last"))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        levels, kept = self._levels(), self._kept()
        if levels.timer is not None and expiredTimerInfo.getExpiryTimeInMs() >= levels.timer:
            levels.timer = None
        due = kept["at"] // 1000 <= timerValues.getCurrentWatermarkInMs()
        out = [(*key, *levels.step(r)) for r in kept[due].sort_values("at").itertuples(index=False)]
        self._wait(levels, kept[~due])
        if out:
            yield pd.DataFrame(out, columns=[*KEYS, *_columns(self.cfg)]).astype(object)

    def close(self) -> None:
        pass


def _columns(cfg: SessionConfig) -> list[str]:
    levels = [f"prev_{s.lower()}_{e}" for s, _, _ in cfg.sessions for e in ("high", "low")]
    return ["at", "bar", "session_name", *levels, "session_low_swept", "session_high_swept", "session_liquidity_long_valid", "session_liquidity_short_valid", "Session_Liquidity_Valid"]


def streaming_sessions(bars: DataFrame, config: SessionConfig | None = None, lateness: str = "1 hour") -> DataFrame:
    """The session-liquidity layer of a stream of bars: a row for each bar that the watermark has passed.

    ``bars`` is a stream of symbol, timeframe, time (timestamp), high, low and close,
    with the validity flags of zones where there are any. Results equal those of
    ``add_sessions`` over the same bars: numbers, levels, sweeps and their recency are
    kept in the state store, which has to be RocksDB (set here if the session has
    another one). Bars that come later than ``lateness`` are dropped.
    """
    cfg, spark = config or SessionConfig(), bars.sparkSession
    if not spark.conf.get(STORE).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)
    demand, supply = (first_existing(bars, f"sd_{z}_valid", f"{z}_zone_active") for z in ("demand", "supply"))
    flag = lambda x: F.lit(False) if x is None else is_true(x)
    rows = bars.withWatermark("time", lateness).select(
        *KEYS, "time", F.unix_micros("time").alias("at"), session_name(F.col("time"), cfg.sessions).alias("session"), F.unix_date(F.to_date("time")).alias("day"),
        *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")], flag(demand).alias("long_zone"), flag(supply).alias("short_zone"),
    )
    kinds = {"at": "long", "bar": "long", "session_name": "string"} | {c: "double" for c in _columns(cfg) if c.startswith("prev_")}
    schema = "symbol string, timeframe string, " + ", ".join(f"{c} {kinds.get(c, 'boolean')}" for c in _columns(cfg))
    out = rows.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=SessionProcessor(cfg), outputStructType=schema, outputMode="append", timeMode="EventTime")
    return out.select(*KEYS, F.timestamp_micros("at").alias("time"), *_columns(cfg)[1:])

"""Supply and demand zones: birth at confirmed pivots, lifecycle over bars, nearest zone of every bar."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.folds import fold_in_chunks
from tidemark.functions.series import KEYS, confirmed_pivot, interval_join, is_true, lag, require, rolling_mean, series, true_range
from tidemark.functions.tables import materialise
from tidemark.plans.config import ZoneConfig

ZONE = ("top", "bottom", "entry", "stop", "width_pips", "stop_pips")


def departures(df: DataFrame, cfg: ZoneConfig) -> DataFrame:
    """Add candle measures and the departure flags of both directions."""
    span = F.col("high") - F.col("low")
    share = lambda x: F.try_divide(x, F.when(span != 0, span))
    strong = (F.abs(F.col("close") - F.col("open")) >= F.lit(cfg.body_atr) * F.col("atr")) & (span >= F.lit(cfg.range_atr) * F.col("atr"))
    return df.withColumns({
        "candle_range": span,
        "bull_departure": is_true((F.col("close") > F.col("open")) & strong & (share(F.col("close") - F.col("low")) >= cfg.close_share)),
        "bear_departure": is_true((F.col("close") < F.col("open")) & strong & (share(F.col("high") - F.col("close")) >= cfg.close_share)),
    })


def with_zone_inputs(df: DataFrame, cfg: ZoneConfig | None = None, atr: str | None = None) -> DataFrame:
    """Add ATR, pivots and departures that zones are made of."""
    cfg = cfg or ZoneConfig()
    require(df, "open", "high", "low", "close", "bar")
    if atr is not None and atr in df.columns:
        df = df.withColumn("atr", F.col(atr))
    else:
        df = df.withColumn("tm_tr", true_range()).withColumn("atr", rolling_mean(F.col("tm_tr"), cfg.atr_period)).drop("tm_tr")
    pivots = {"pivot_high": confirmed_pivot("high", cfg.swing, cfg.swing, True), "pivot_low": confirmed_pivot("low", cfg.swing, cfg.swing, False)}
    return departures(df, cfg).withColumns(pivots)


def zone_candidates(df: DataFrame, pip: float | Column, cfg: ZoneConfig | None = None) -> DataFrame:
    """Buildable zones before spacing, one row for each: side, created and pivot bar, box, entry and stop.

    Everything refers to the bar where the base ends, so all values come from
    fixed frames around it; the base is cut at the ends of the series. ``pip`` is
    a size for all series or a column of the bars.
    """
    cfg = cfg or ZoneConfig()
    left, right, ahead = cfg.base_left, cfg.base_right, cfg.departure_ahead
    if right > cfg.swing:
        raise ValueError("the base must end before the pivot is confirmed")
    # rows stand for the last bar of a base; its pivot lies ``right`` bars earlier and is confirmed ``swing - right`` bars later
    base, later = series(-(left + right)), cfg.swing - right
    confirm = lambda c: F.lead(c, later, False).over(Window.partitionBy(*KEYS).orderBy("time"))
    next_true = lambda c: F.min(F.when(F.col(c), F.col("bar"))).over(series(1, ahead))
    pivot_atr = lag("atr", right)
    base_bars = F.least(F.lit(left), F.col("bar") - right) + (right + 1)
    rows = df.withColumns({
        "tm_pip": pip if isinstance(pip, Column) else F.lit(float(pip)),
        "tm_atr": pivot_atr,
        "tm_mean": F.sum("candle_range").over(base) / base_bars,
        "tm_start": F.greatest(F.col("bar") - (left + right), F.lit(0)),
        "tm_hi": F.max("high").over(base),
        "tm_lo": F.min("low").over(base),
        "tm_bear": F.last(F.when(F.col("close") < F.col("open"), F.struct("bar", "open", "high", "low", "close")), ignorenulls=True).over(base),
        "tm_bull": F.last(F.when(F.col("close") > F.col("open"), F.struct("bar", "open", "high", "low", "close")), ignorenulls=True).over(base),
        "tm_pl": confirm("pivot_low"),
        "tm_ph": confirm("pivot_high"),
        "tm_bd": next_true("bull_departure"),
        "tm_sd": next_true("bear_departure"),
    })
    quiet = is_true((F.col("tm_atr") > 0) & (F.col("tm_mean") <= F.lit(cfg.base_range_atr) * F.col("tm_atr")) & (F.col("bar") >= right))
    sides = []
    for side, pivot, departure, candle in (("demand", "tm_pl", "tm_bd", "tm_bear"), ("supply", "tm_ph", "tm_sd", "tm_bull")):
        o, c = F.col(candle)["open"], F.col(candle)["close"]
        own = F.col(candle).isNotNull() & F.lit(cfg.use_last_opposing)
        body_top, body_bottom = F.greatest("open", "close"), F.least("open", "close")
        if side == "demand":
            top = F.when(own, F.greatest(o, c)).otherwise(body_top)
            bottom = F.when(own, F.col(candle)["low"]).otherwise(F.col("tm_lo"))
        else:
            top = F.when(own, F.col(candle)["high"]).otherwise(F.col("tm_hi"))
            bottom = F.when(own, F.least(o, c)).otherwise(body_bottom)
        created = F.greatest(F.col("bar") + later, F.col(departure))
        hit = rows.where(quiet & F.col(pivot) & F.col(departure).isNotNull())
        sides.append(hit.select(*KEYS, F.lit(side).alias("side"), created.alias("created"), (F.col("bar") - right).alias("pivot_bar"), F.col("tm_start").alias("base_start"), F.col("bar").alias("base_end"), F.col(departure).alias("departure"), F.col("tm_atr").alias("zone_atr"), top.alias("top"), bottom.alias("bottom"), F.col("tm_pip").alias("tm_pip")))
    both = sides[0].unionByName(sides[1])
    demand, width = F.col("side") == "demand", F.col("top") - F.col("bottom")
    buffer = F.greatest(F.lit(cfg.stop_buffer_atr) * F.col("zone_atr"), F.lit(cfg.stop_buffer_pips) * F.col("tm_pip"))
    both = both.withColumns({"entry": F.when(demand, F.col("top")).otherwise(F.col("bottom")), "stop": F.when(demand, F.col("bottom") - buffer).otherwise(F.col("top") + buffer), "width_pips": width / F.col("tm_pip")})
    both = both.withColumn("stop_pips", F.abs(F.col("entry") - F.col("stop")) / F.col("tm_pip")).drop("tm_pip")
    fits = (width > 0) & (F.col("width_pips") <= cfg.max_width_pips) & (width >= F.col("zone_atr") * cfg.width_atr[0]) & (width <= F.col("zone_atr") * cfg.width_atr[1])
    return both.where(fits & (F.col("stop_pips") <= cfg.max_stop_pips))


def accepted_zones(candidates: DataFrame, cfg: ZoneConfig | None = None) -> DataFrame:
    """Candidates that keep their distance from the zone accepted before them on the same side.

    The greedy choice is a fold whose state is the last accepted bar, handed on
    from chunk to chunk. Accepted ones get a ``zone_id`` in order of birth.
    """
    cfg = cfg or ZoneConfig()
    fields = ["created", "pivot_bar", "base_start", "base_end", "departure", "zone_atr", *ZONE]
    keys, kinds = [*KEYS, "side"], dict(candidates.dtypes)

    def choose(own: pd.DataFrame, last: int | None) -> tuple[pd.DataFrame, int | None]:
        own = own.sort_values(["created", "pivot_bar"])
        kept = np.zeros(len(own), bool)
        for k, created in enumerate(own["created"].tolist()):
            if last is None or created - last >= cfg.spacing:
                kept[k], last = True, created
        return own[kept], last

    rows = materialise(candidates.select(*keys, *fields))
    rows = fold_in_chunks(rows, keys, F.col("created"), choose, ", ".join(f"{c} {kinds[c]}" for c in (*keys, *fields)))
    order = Window.partitionBy(*keys).orderBy("created", "pivot_bar")
    return rows.withColumn("zone_id", F.row_number().over(order))


def zone_lifecycle(df: DataFrame, zones: DataFrame, cfg: ZoneConfig | None = None) -> DataFrame:
    """One row for each zone and bar of its life: age, overlap, retests and whether it is alive.

    A zone meets at most ``max_age + 1`` bars, so zones and bars are joined by
    stretches of that many bars, of which a zone touches two at most.
    """
    cfg = cfg or ZoneConfig()
    end = F.col("created") + cfg.max_age
    bars = df.select(*KEYS, "bar", "high", "low", "close", "atr")
    rows = interval_join(bars, zones, [*KEYS], F.col("created"), end, cfg.max_age + 1)
    life = Window.partitionBy(*KEYS, "side", "zone_id").orderBy("bar")
    known = is_true(F.col("atr") > 0)
    inside = (F.col("high") >= F.col("bottom")) & (F.col("low") <= F.col("top"))
    before = F.coalesce(F.last(F.when(known, inside), ignorenulls=True).over(life.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumns({"age": F.col("bar") - F.col("created"), "overlap": inside, "tm_edge": known & inside & ~before & (F.col("bar") > F.col("created"))})
    upto = life.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("retests", F.sum(F.col("tm_edge").cast("int")).over(upto).cast("int"))
    slack = F.lit(cfg.penetration_atr) * F.col("atr")
    low, high = ("close", "close") if cfg.invalidation == "close" else ("low", "high")
    broken = F.when(F.col("side") == "demand", F.col(low) < F.col("bottom") - slack).otherwise(F.col(high) > F.col("top") + slack)
    dead = (F.col("retests") > cfg.max_retests) | (known & is_true(broken))
    rows = rows.withColumn("alive", F.max(dead.cast("int")).over(upto) == 0)
    return rows.withColumn("touched", (F.col("age") > 0) & F.col("overlap")).drop("tm_edge", "high", "low", "atr", "overlap")


def nearest_zones(life: DataFrame, cfg: ZoneConfig | None = None) -> DataFrame:
    """The alive zone of each bar and side whose entry is nearest to the close (older zone first)."""
    cfg = cfg or ZoneConfig()
    distance = F.abs(F.col("close") - F.col("entry")) if cfg.nearest else F.lit(0)
    w = Window.partitionBy(*KEYS, "bar", "side").orderBy(distance, "created", "zone_id")
    return life.where("alive").withColumn("tm_k", F.row_number().over(w)).where("tm_k = 1").drop("tm_k", "close", "alive")


def attach_zones(df: DataFrame, nearest: DataFrame, cfg: ZoneConfig | None = None) -> DataFrame:
    """Add zone columns and validity flags of both sides to the bars."""
    cfg = cfg or ZoneConfig()
    out = df
    for side in ("demand", "supply"):
        names = {c: f"{side}_zone_{c}" for c in (*ZONE, "retests", "age")}
        own = nearest.where(F.col("side") == side).select(*KEYS, "bar", *[F.col(c).alias(n) for c, n in names.items()], F.col("touched").alias(f"{side}_touched"), F.lit(True).alias(f"{side}_zone_active"))
        out = out.join(own, [*KEYS, "bar"], "left")
    flags = {}
    for side, entry in (("demand", "long"), ("supply", "short")):
        active, touched = is_true(F.col(f"{side}_zone_active")), is_true(F.col(f"{side}_touched"))
        valid = active & is_true((F.col(f"{side}_zone_stop_pips") <= cfg.max_stop_pips) & (F.col(f"{side}_zone_retests") <= cfg.max_retests) & (F.col(f"{side}_zone_age") >= 1))
        flags |= {f"{side}_zone_active": active, f"{side}_touched": touched, f"sd_{side}_valid": valid, f"sd_{side}_touched": touched, f"{entry}_entry_signal": valid & touched}
    return out.withColumns(flags)


def add_zones(df: DataFrame, pip: float | Column, config: ZoneConfig | None = None, atr: str | None = None) -> DataFrame:
    """Add the supply-and-demand layer."""
    cfg = config or ZoneConfig()
    df = with_zone_inputs(df, cfg, atr)
    zones = accepted_zones(zone_candidates(df, pip, cfg), cfg)
    return attach_zones(df, nearest_zones(zone_lifecycle(df, zones, cfg), cfg), cfg)

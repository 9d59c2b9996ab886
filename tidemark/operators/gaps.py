"""Three-candle gaps left on the way out of a zone, and their first fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import KEYS, effective_tolerance, first_existing, interval_join, is_true, lag, require, runs, zone_overlaps
from tidemark.plans.config import GapConfig


def zone_key(df: DataFrame, zone: str) -> Column:
    """Identity of the valid zone of a side: (birth bar, bottom, top); NULL without one."""
    valid = first_existing(df, f"sd_{zone}_valid", f"{zone}_zone_active")
    low, high = first_existing(df, f"{zone}_zone_bottom", f"{zone}_zone_low"), first_existing(df, f"{zone}_zone_top", f"{zone}_zone_high")
    age = first_existing(df, f"{zone}_zone_age")
    if any(x is None for x in (valid, low, high, age)):
        return F.lit(None).cast("struct<born:bigint,low:double,high:double>")
    ok = is_true(valid) & low.isNotNull() & high.isNotNull() & age.isNotNull()
    return F.when(ok, F.struct((F.col("bar") - age).cast("long").alias("born"), low.alias("low"), high.alias("high")))


def detect_gaps(df: DataFrame, min_gap: float = 0.0) -> DataFrame:
    """Add creation flags and boxes of bullish and bearish gaps."""
    require(df, "high", "low")
    up, down = F.col("low") - lag("high", 2), lag("low", 2) - F.col("high")
    bull, bear = is_true(up > min_gap), is_true(down > min_gap)
    return df.withColumns({
        "bullish_imbalance_created": bull,
        "bearish_imbalance_created": bear,
        "bullish_imbalance_zone_low": F.when(bull, lag("high", 2)),
        "bullish_imbalance_zone_high": F.when(bull, F.col("low")),
        "bearish_imbalance_zone_low": F.when(bear, F.col("high")),
        "bearish_imbalance_zone_high": F.when(bear, lag("low", 2)),
    })


def first_fills(df: DataFrame, cfg: GapConfig) -> DataFrame:
    """First filled gap of each episode: (series, tm_ep, fill_bar, gap_bar, gap_low, gap_high).

    A gap meets the at most ``max_age`` bars after it, so gaps and bars are joined
    by stretches of that many bars, of which a gap touches two at most.
    """
    gaps = df.where("tm_gap").select(*KEYS, "tm_ep", F.col("bar").alias("gap_bar"), F.col("tm_low").alias("gap_low"), F.col("tm_high").alias("gap_high"))
    bars = df.where("tm_key is not null").select(*KEYS, "bar", "tm_ep", "high", "low", "tm_latest")
    meets = zone_overlaps(F.col("low"), F.col("high"), F.col("gap_low"), F.col("gap_high"), cfg.fill_tolerance)
    hit = interval_join(bars, gaps, [*KEYS, "tm_ep"], F.col("gap_bar") + 1, F.col("gap_bar") + cfg.max_age, cfg.max_age).where(meets)
    if cfg.only_latest:
        hit = hit.where(F.col("tm_latest") == F.col("gap_bar"))
    return hit.groupBy(*KEYS, "tm_ep").agg(F.min(F.struct(F.col("bar"), -F.col("gap_bar"), "gap_low", "gap_high")).alias("f")).select(*KEYS, "tm_ep", F.col("f.bar").alias("fill_bar"), F.col("f.gap_low").alias("gap_low"), F.col("f.gap_high").alias("gap_high"))


def _marked(df: DataFrame, zone: str, side: str, kind: str, cfg: GapConfig) -> DataFrame:
    """Add the zone episode of each bar, whether it leaves a gap on the way out of the zone, and the last one of the episode."""
    atr = first_existing(df, "atr_feature", "atr")
    tolerance = effective_tolerance(cfg.tolerance, cfg.relevance_atr, atr if atr is not None else F.lit(None).cast("double"))
    touched, entry = first_existing(df, f"sd_{zone}_touched", f"{zone}_touched"), first_existing(df, f"{zone}_zone_entry", f"{side}_entry_price", f"{side}_entry")
    work = df.withColumn("tm_key", zone_key(df, zone)).withColumn("tm_ep", runs(F.col("tm_key")))
    low, high = F.col(f"{kind}_imbalance_zone_low"), F.col(f"{kind}_imbalance_zone_high")
    entry = entry if entry is not None else F.lit(None).cast("double")
    beyond = high >= entry - tolerance if zone == "demand" else low <= entry + tolerance
    gap = F.col("tm_key").isNotNull() & F.col(f"{kind}_imbalance_created") & ~(is_true(touched) if touched is not None else F.lit(False)) & is_true(F.col("bar") >= F.col("tm_key.born")) & is_true(beyond)
    work = work.withColumns({"tm_gap": gap, "tm_low": low, "tm_high": high})
    episode = Window.partitionBy(*KEYS, "tm_ep").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return work.withColumn("tm_last", F.last(F.when(F.col("tm_gap"), F.struct("bar", "tm_low", "tm_high")), ignorenulls=True).over(episode)).withColumn("tm_latest", F.col("tm_last.bar"))


def add_gaps(df: DataFrame, config: GapConfig | None = None, source: DataFrame | None = None) -> DataFrame:
    """Add the imbalance layer: gaps of the current zone episode, their first fill, and validity after it.

    ``source`` is a table of the same bars that fills are looked for in: a
    materialised one that ``df`` was made from saves making ``df`` once more.
    """
    cfg = config or GapConfig()
    df = detect_gaps(df, cfg.min_gap)
    found = df if source is None else detect_gaps(source, cfg.min_gap)
    for zone, side, kind in (("demand", "long", "bullish"), ("supply", "short", "bearish")):
        work = _marked(df, zone, side, kind, cfg)
        fills = first_fills(work if source is None else _marked(found, zone, side, kind, cfg), cfg)
        work = work.join(fills, [*KEYS, "tm_ep"], "left")
        filled = F.col("tm_key").isNotNull() & is_true(F.col("bar") >= F.col("fill_bar"))
        young = F.col("tm_key").isNotNull() & is_true(F.col("bar") - F.col("tm_latest") <= cfg.max_age)
        df = work.withColumns({
            f"{kind}_imbalance_filled": filled & is_true(F.col("bar") == F.col("fill_bar")),
            f"active_{kind}_imbalance_low": F.when(filled, F.col("gap_low")).when(young, F.col("tm_last.tm_low")),
            f"active_{kind}_imbalance_high": F.when(filled, F.col("gap_high")).when(young, F.col("tm_last.tm_high")),
            f"imbalance_{side}_valid": filled,
        }).drop("tm_key", "tm_ep", "tm_gap", "tm_low", "tm_high", "tm_last", "tm_latest", "fill_bar", "gap_low", "gap_high")
    return df.withColumn("Imbalance_Valid", F.col("imbalance_long_valid") | F.col("imbalance_short_valid"))

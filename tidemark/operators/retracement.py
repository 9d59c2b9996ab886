"""Retracement bands of the latest confirmed legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import first_existing, is_true, last_bar, series, zone_overlaps
from tidemark.plans.config import RetracementConfig


def add_retracement(df: DataFrame, config: RetracementConfig | None = None) -> DataFrame:
    """Add the layer of legs and their 0 to 0.5 bands.

    A confirmed low ends a falling leg from the last high; a confirmed high ends
    a rising leg from the last low, unless that low is confirmed on the same bar.
    Legs shorter than ``min_leg`` leave the one before in place.
    """
    cfg = config or RetracementConfig()
    high, low = first_existing(df, "ext_swing_high", "int_swing_high"), first_existing(df, "ext_swing_low", "int_swing_low")
    if high is None or low is None:
        names = [f"fib_{b}_impulse_{s}" for b in ("bull", "bear") for s in ("low", "high")] + [f"fib_{b}_band_{s}" for b in ("long", "short") for s in ("low", "high")]
        return df.withColumns({n: F.lit(None).cast("double") for n in names} | {n: F.lit(False) for n in ("fibonacci_long_valid", "fibonacci_short_valid", "Fibonacci_Valid")})
    df = df.withColumns({
        "tm_h": F.last(high, ignorenulls=True).over(series(last=-1)),
        "tm_l": F.last(low, ignorenulls=True).over(series()),
        "tm_lb": last_bar(low.isNotNull()),
    })
    fall = F.when(low.isNotNull() & (F.col("tm_h") - low >= cfg.min_leg), F.struct(low.alias("low"), F.col("tm_h").alias("high")))
    rise = F.when(high.isNotNull() & (F.col("tm_lb") < F.col("bar")) & (high - F.col("tm_l") >= cfg.min_leg), F.struct(F.col("tm_l").alias("low"), high.alias("high")))
    df = df.withColumns({"tm_bear": F.last(fall, ignorenulls=True).over(series()), "tm_bull": F.last(rise, ignorenulls=True).over(series())})
    bull, bear = F.col("tm_bull"), F.col("tm_bear")
    df = df.withColumns({
        "fib_bull_impulse_low": bull["low"],
        "fib_bull_impulse_high": bull["high"],
        "fib_bear_impulse_low": bear["low"],
        "fib_bear_impulse_high": bear["high"],
        "fib_long_band_low": bull["low"],
        "fib_long_band_high": bull["low"] + 0.5 * (bull["high"] - bull["low"]),
        "fib_short_band_low": bear["high"] - 0.5 * (bear["high"] - bear["low"]),
        "fib_short_band_high": bear["high"],
    })
    flags = {}
    for side, zone in (("long", "demand"), ("short", "supply")):
        a, b = F.col(f"fib_{side}_band_low"), F.col(f"fib_{side}_band_high")
        entry = first_existing(df, f"{zone}_zone_entry", f"{side}_entry_price", f"{side}_entry")
        z_low, z_high = first_existing(df, f"{zone}_zone_bottom", f"{zone}_zone_low"), first_existing(df, f"{zone}_zone_top", f"{zone}_zone_high")
        inside = F.lit(False) if entry is None else is_true(entry.between(a - cfg.tolerance, b + cfg.tolerance))
        meets = F.lit(False) if z_low is None or z_high is None else is_true(zone_overlaps(z_low, z_high, a, b, cfg.tolerance))
        flags[f"fibonacci_{side}_valid"] = inside | meets
    df = df.withColumns(flags).withColumn("Fibonacci_Valid", F.col("fibonacci_long_valid") | F.col("fibonacci_short_valid"))
    return df.drop("tm_h", "tm_l", "tm_lb", "tm_bear", "tm_bull")

"""Support and resistance: clustered recent pivot prices and runner targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import confirmed_pivot, first_existing, is_true, require, series
from tidemark.plans.config import LevelConfig


def cluster(levels: Column, tolerance: Column, min_touches: int) -> Column:
    """Means of one-dimensional clusters of sorted prices.

    A price joins the last cluster if it lies within the tolerance of its running
    mean. The arrays hold the pivots of one recency window, a bounded number.
    """
    item = "struct<mean:double,n:int>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast("double").alias("mean"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        joins = (a["n"] > 0) & (F.abs(x - a["mean"]) <= tolerance)
        mean = F.when(joins, (a["mean"] * a["n"] + x) / (a["n"] + 1)).otherwise(x)
        done = F.when(joins | (a["n"] == 0), a["done"]).otherwise(F.array_append(a["done"], F.struct(a["mean"].alias("mean"), a["n"].alias("n"))))
        return F.struct(done.alias("done"), mean.alias("mean"), F.when(joins, a["n"] + 1).otherwise(F.lit(1)).alias("n"))

    def finish(a: Column) -> Column:
        whole = F.when(a["n"] > 0, F.array_append(a["done"], F.struct(a["mean"].alias("mean"), a["n"].alias("n")))).otherwise(a["done"])
        return F.transform(F.filter(whole, lambda c: c["n"] >= min_touches), lambda c: c["mean"])

    return F.aggregate(levels, start, step, finish)


def pick_atr(df: DataFrame, preferred: str | None = None) -> Column:
    """ATR column: the preferred one, atr_feature, atr, or any whose name holds ``atr``."""
    names = [preferred, "atr_feature", "atr", *[c for c in df.columns if "atr" in c.lower()]]
    found = first_existing(df, *[n for n in names if n])
    if found is None:
        raise ValueError("no ATR column")
    return found


def add_levels(df: DataFrame, config: LevelConfig | None = None, atr: str | None = None) -> DataFrame:
    """Add the support-and-resistance layer. Prices are those of the bar that confirms a pivot."""
    cfg = config or LevelConfig()
    require(df, "high", "low", "close")
    a = pick_atr(df, atr)
    n = max(1, cfg.pivot)
    df = df.withColumns({"sr_pivot_high": confirmed_pivot("high", n, n, True), "sr_pivot_low": confirmed_pivot("low", n, n, False)})
    recent = series(-cfg.recency)
    # prices are kept in ascending order; a running mean only grows while its cluster does
    df = df.withColumns({"tm_hs": F.sort_array(F.collect_list(F.when(F.col("sr_pivot_high"), F.col("high"))).over(recent)), "tm_ls": F.sort_array(F.collect_list(F.when(F.col("sr_pivot_low"), F.col("low"))).over(recent)), "tm_atr": F.when(a > 0, a)})
    tolerance = F.greatest(F.col("tm_atr") * cfg.cluster_atr, F.lit(1e-8))
    known = F.col("tm_atr").isNotNull()
    df = df.withColumns({"tm_hc": F.when(known, cluster(F.col("tm_hs"), tolerance, cfg.min_touches)), "tm_lc": F.when(known, cluster(F.col("tm_ls"), tolerance, cfg.min_touches))})
    above = lambda x: F.array_min(F.filter("tm_hc", lambda v: v > x))
    below = lambda x: F.array_max(F.filter("tm_lc", lambda v: v < x))
    df = df.withColumns({"sr_nearest_resistance": above(F.col("close")), "sr_nearest_support": below(F.col("close"))})
    buffer = F.col("tm_atr") * cfg.buffer_atr
    none = F.lit(None).cast("double")
    for side, zone, sign in (("long", "demand", 1), ("short", "supply", -1)):
        entry, stop = first_existing(df, f"{zone}_zone_entry"), first_existing(df, f"{zone}_zone_stop")
        if entry is None or stop is None:
            df = df.withColumns({f"sr_{side}_{c}": none for c in ("reference_level", "target", "target_rr")} | {f"support_resistance_{side}_valid": F.lit(False)})
            continue
        risk = F.when((entry - stop) * sign > 0, (entry - stop) * sign)
        reference = above(entry + 2.0 * risk) if side == "long" else below(entry - 2.0 * risk)
        df = df.withColumn("tm_risk", risk).withColumn(f"sr_{side}_reference_level", F.when(F.col("tm_risk").isNotNull(), reference))
        df = df.withColumn(f"sr_{side}_target", F.col(f"sr_{side}_reference_level") - sign * buffer)
        rr = (F.col(f"sr_{side}_target") - entry) * sign / F.col("tm_risk")
        df = df.withColumn(f"sr_{side}_target_rr", rr).withColumn(f"support_resistance_{side}_valid", is_true(F.col(f"sr_{side}_target_rr").between(*map(F.lit, cfg.runner_rr)))).drop("tm_risk")
    df = df.withColumn("Support_Resistance_Valid", F.col("support_resistance_long_valid") | F.col("support_resistance_short_valid"))
    return df.drop("tm_hs", "tm_ls", "tm_atr", "tm_hc", "tm_lc")



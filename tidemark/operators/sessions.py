"""Trading sessions: blocks, levels of completed sessions, sweeps, and session volume profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import KEYS, changed, first_existing, is_true, lag, last_bar, require, runs, series
from tidemark.plans.config import ProfileConfig, SessionConfig


def session_name(time: Column, sessions) -> Column:
    """Session of an hour; NULL outside all."""
    hour, out = F.hour(time), None
    for name, a, b in sessions:
        test = (hour >= a) & (hour < b)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def with_blocks(df: DataFrame, sessions, name: str = "session_name") -> DataFrame:
    """Add the session and the number of its block: a run of bars of one session on one day."""
    require(df, "time")
    df = df.withColumn(name, session_name(F.col("time"), sessions))
    return df.withColumn("session_block", runs(F.struct(F.col(name), F.date_trunc("day", "time"))))


def session_levels(df: DataFrame) -> DataFrame:
    """Blocks with their extremes: series, session_block, session_name, block_high, block_low, first and last bar."""
    return df.groupBy(*KEYS, "session_block").agg(F.first("session_name").alias("session_name"), F.max("high").alias("block_high"), F.min("low").alias("block_low"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


def add_sessions(df: DataFrame, config: SessionConfig | None = None) -> DataFrame:
    """Add the session-liquidity layer.

    A completed block sets the level of its session from the next block's first
    bar on. A sweep of any level, in either direction, validates both sides for a
    number of bars, given a valid zone.
    """
    cfg = config or SessionConfig()
    df = with_blocks(df, cfg.sessions)
    inside = Window.partitionBy(*KEYS, "session_block").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"tm_hi": F.max("high").over(inside), "tm_lo": F.min("low").over(inside), "tm_new": changed(F.col("session_block"))})
    df = df.withColumns({"tm_ph": F.when(F.col("tm_new"), lag("tm_hi")), "tm_pl": F.when(F.col("tm_new"), lag("tm_lo")), "tm_ps": F.when(F.col("tm_new"), lag("session_name"))})
    names = [s for s, _, _ in cfg.sessions]
    for side, col in (("high", "tm_ph"), ("low", "tm_pl")):
        df = df.withColumns({f"prev_{s.lower()}_{side}": F.last(F.when(F.col("tm_ps") == s, F.col(col)), ignorenulls=True).over(series()) for s in names})

    def swept(level: Column, below: bool) -> Column:
        wick = F.col("low") < level if below else F.col("high") > level
        back = F.col("close") >= level if below else F.col("close") <= level
        return is_true(wick & (back if cfg.close_back else F.lit(cfg.wick_sweeps)))

    any_of = lambda parts: F.greatest(*parts) if len(parts) > 1 else parts[0]
    df = df.withColumns({"session_low_swept": any_of([swept(F.col(f"prev_{s.lower()}_low"), True) for s in names]), "session_high_swept": any_of([swept(F.col(f"prev_{s.lower()}_high"), False) for s in names])})
    recent = is_true(F.col("bar") - last_bar(F.col("session_low_swept") | F.col("session_high_swept")) <= cfg.sweep_bars)
    demand = first_existing(df, "sd_demand_valid", "demand_zone_active")
    supply = first_existing(df, "sd_supply_valid", "supply_zone_active")
    long, short = (recent & is_true(x) if x is not None else F.lit(False) for x in (demand, supply))
    df = df.withColumns({"session_liquidity_long_valid": long, "session_liquidity_short_valid": short, "Session_Liquidity_Valid": long | short})
    flags = {f"is_{s.lower()}_session": F.col("session_name").eqNullSafe(F.lit(s)) for s in names}
    return df.withColumns(flags | {"is_london_newyork_overlap": F.lit(False)}).drop("tm_hi", "tm_lo", "tm_new", "tm_ph", "tm_pl", "tm_ps", "session_block")


def volume_column(df: DataFrame) -> Column:
    """Volume of a bar, not negative; 1 where the table has none."""
    x = first_existing(df, "tick_volume", "volume", "real_volume")
    return F.lit(1.0) if x is None else F.greatest(F.coalesce(x.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def block_profiles(df: DataFrame, decimals: int) -> DataFrame:
    """Point of control of each session block: the price with most volume, the higher one of equals."""
    price = F.round((F.col("high") + F.col("low") + F.col("close")) / 3.0, decimals)
    each = df.select(*KEYS, "session_block", F.col("vp_session_name"), price.alias("price"), volume_column(df).alias("volume"))
    cells = each.groupBy(*KEYS, "session_block", "price").agg(F.sum("volume").alias("volume"), F.first("vp_session_name").alias("session"))
    return cells.groupBy(*KEYS, "session_block").agg(F.first("session").alias("session"), F.max_by("price", F.struct("volume", "price")).alias("poc"))


def add_profile(df: DataFrame, config: ProfileConfig | None = None, source: DataFrame | None = None) -> DataFrame:
    """Add the volume-profile layer: the point of control of the last completed session, and validity near it.

    ``source``: a materialised table of the same bars to make the profiles of.
    """
    cfg = config or ProfileConfig()
    df = with_blocks(df, cfg.sessions, "vp_session_name")
    blocks = block_profiles(df if source is None else with_blocks(source, cfg.sessions, "vp_session_name"), cfg.decimals)
    before = Window.partitionBy(*KEYS).orderBy("session_block").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col("session").isNotNull(), F.struct("session", "poc")), ignorenulls=True).over(before)
    blocks = blocks.withColumn("tm_ref", known).select(*KEYS, "session_block", F.col("tm_ref.session").alias("vp_reference_session_name"), F.col("tm_ref.poc").alias("vp_reference_poc"))
    df = df.join(blocks, [*KEYS, "session_block"], "left").drop("session_block")
    poc, flags = F.col("vp_reference_poc"), {}
    for side, zone in (("long", "demand"), ("short", "supply")):
        entry = first_existing(df, f"{zone}_zone_entry", f"{side}_entry_price", f"{side}_entry")
        low, high = first_existing(df, f"{zone}_zone_bottom", f"{zone}_zone_low"), first_existing(df, f"{zone}_zone_top", f"{zone}_zone_high")
        near = F.lit(False) if entry is None else is_true(F.abs(entry - poc) <= cfg.tolerance)
        meets = F.lit(False) if low is None or high is None else is_true((low - cfg.tolerance <= poc) & (poc <= high + cfg.tolerance))
        flags[f"volume_profile_{side}_valid"] = near | meets
    df = df.withColumns(flags)
    return df.withColumn("Volume_Profile_Valid", F.col("volume_profile_long_valid") | F.col("volume_profile_short_valid"))



"""Entry signals from zones, structure and a rejection candle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import any_recent, first_existing, is_true


def _flag(df: DataFrame, *names: str) -> Column:
    x = first_existing(df, *names)
    return F.lit(False) if x is None else is_true(x.cast("boolean"))


def add_signals(df: DataFrame, lookback: int = 20) -> DataFrame:
    """Add direction validity and ``long_signal`` / ``short_signal``.

    A long needs a valid demand zone that the bar touches and closes back out of,
    rising, with a bullish bias and a break upwards in the last bars.
    """
    flags = {}
    for side, zone, bias, breaks, given in (
        ("long", "demand", ("structure_bullish", "bullish_bias"), (("choch_up", "bullish_choch"), ("bos_up", "bullish_bos"), ("mss_up", "bullish_mss")), "recent_bull_break"),
        ("short", "supply", ("structure_bearish", "bearish_bias"), (("choch_down", "bearish_choch"), ("bos_down", "bearish_bos"), ("mss_down", "bearish_mss")), "recent_bear_break"),
    ):
        if given in df.columns:
            recent = is_true(F.col(given).cast("boolean"))
        else:
            recent = any_recent(_flag(df, *breaks[0]) | _flag(df, *breaks[1]) | _flag(df, *breaks[2]), lookback)
        valid, biased = _flag(df, f"sd_{zone}_valid"), _flag(df, *bias)
        entry = first_existing(df, f"{zone}_zone_entry")
        entry = F.lit(None).cast("double") if entry is None else entry
        back = F.col("close") >= entry if side == "long" else F.col("close") <= entry
        turned = F.col("close") > F.col("open") if side == "long" else F.col("close") < F.col("open")
        rejected = _flag(df, f"sd_{zone}_touched", f"{zone}_touched") & is_true(back) & is_true(turned)
        flags |= {
            f"atr_{side}_valid": F.col("atr_feature").isNotNull() if "atr_feature" in df.columns else F.lit(True),
            f"supply_demand_{side}_valid": valid,
            f"market_structure_{side}_valid": biased & recent,
            f"{side}_signal": valid & biased & recent & rejected,
        }
    return df.withColumns(flags)

"""Streaming counterparts: bars from a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.bars import TIMEFRAMES


def streaming_bars(ticks: DataFrame, time: str, price: str, tiebreak: str, symbol: str, timeframe: str = "H1", lateness: str = "10 minutes") -> DataFrame:
    """Bars of a tick stream; a bar is final when the watermark has passed its end, later ticks are dropped."""
    order = F.struct(time, tiebreak)
    rows = ticks.withWatermark(time, lateness)
    out = rows.groupBy(F.window(time, TIMEFRAMES[timeframe]), F.col(symbol).alias("symbol")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.count("*").cast("double").alias("tick_volume"),
    )
    return out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("window.start").alias("time"), "open", "high", "low", "close", "tick_volume")

"""Market structure: swings, their labels, trend, and breaks of the external structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import confirmed_pivot, is_true, lag, last_bar, require, rolling_mean, series, true_range
from tidemark.plans.config import StructureConfig


def _carried(x: Column, upto: int = 0) -> Column:
    return F.last(x, ignorenulls=True).over(series(last=upto))


def _label(price: Column, before: Column, atr: Column, share: float, names: tuple[str, str, str]) -> Column:
    equal, higher, lower = names
    near = F.abs(price - before) <= atr * share
    return F.when(before.isNotNull() & atr.isNotNull(), F.when(near, F.lit(equal)).when(price > before, F.lit(higher)).otherwise(F.lit(lower)))


def swings(df: DataFrame, prefix: str, length: int, equal_atr: float) -> DataFrame:
    """Add ``<prefix>_pivot_*``, ``<prefix>_swing_*`` and ``<prefix>_*_label`` for swings of a length.

    A swing is known ``length`` bars late; its price and ATR are those of its own
    bar. A first swing, or one without ATR, has a null label.
    """
    df = df.withColumns({f"{prefix}_pivot_high": confirmed_pivot("high", length, length, True), f"{prefix}_pivot_low": confirmed_pivot("low", length, length, False)})
    df = df.withColumns({f"{prefix}_swing_{side}": F.when(F.col(f"{prefix}_pivot_{side}"), lag(side, length)) for side in ("high", "low")})
    atr = lag("atr", length)
    labels = {}
    for side, names in (("high", ("EQH", "HH", "LH")), ("low", ("EQL", "HL", "LL"))):
        swing = F.col(f"{prefix}_swing_{side}")
        labels[f"{prefix}_{side}_label"] = F.when(swing.isNotNull(), _label(swing, _carried(swing, -1), atr, equal_atr, names))
    return df.withColumns(labels)


def add_structure(df: DataFrame, config: StructureConfig | None = None, atr: str | None = None) -> DataFrame:
    """Add the market-structure layer.

    A level of the external structure can be broken once, by a close beyond it; a
    wick beyond an unbroken level is a sweep. The trend follows the pair of
    latest labels where it speaks, else the last break.
    """
    cfg = config or StructureConfig()
    require(df, "open", "high", "low", "close", "bar")
    if atr is not None and atr in df.columns:
        df = df.withColumn("atr", F.col(atr))
    else:
        df = df.withColumn("tm_tr", true_range()).withColumn("atr", rolling_mean(F.col("tm_tr"), cfg.atr_period)).drop("tm_tr")
    df = df.withColumn("body", F.abs(F.col("close") - F.col("open")))
    df = swings(swings(df, "int", cfg.internal, cfg.equal_atr), "ext", cfg.external, cfg.equal_atr)
    high, low = F.col("ext_structure_high"), F.col("ext_structure_low")
    df = df.withColumns({
        "ext_structure_high": _carried(F.col("ext_swing_high")),
        "ext_structure_low": _carried(F.col("ext_swing_low")),
        # a null label replaces the one before it, so labels travel in structs
        "tm_hl": F.last(F.when(F.col("ext_pivot_high"), F.struct(F.col("ext_high_label").alias("v"))), ignorenulls=True).over(series())["v"],
        "tm_ll": F.last(F.when(F.col("ext_pivot_low"), F.struct(F.col("ext_low_label").alias("v"))), ignorenulls=True).over(series())["v"],
        "tm_hs": last_bar(F.col("ext_pivot_high")),
        "tm_ls": last_bar(F.col("ext_pivot_low")),
    })
    df = df.withColumns({"tm_hb": last_bar(F.col("close") > high, -1), "tm_lb": last_bar(F.col("close") < low, -1)})
    fresh_high, fresh_low = ~is_true(F.col("tm_hb") >= F.col("tm_hs")), ~is_true(F.col("tm_lb") >= F.col("tm_ls"))
    inferred = F.when((F.col("tm_hl") == "HH") & (F.col("tm_ll") == "HL"), 1).when((F.col("tm_hl") == "LH") & (F.col("tm_ll") == "LL"), -1).otherwise(0)
    df = df.withColumns({
        "tm_up": is_true(F.col("close") > high) & fresh_high,
        "tm_dn": is_true(F.col("close") < low) & fresh_low,
        "sweep_high": is_true((F.col("high") > high) & (F.col("close") <= high)) & fresh_high,
        "sweep_low": is_true((F.col("low") < low) & (F.col("close") >= low)) & fresh_low,
        "tm_inf": inferred,
    })
    step = F.when(F.col("tm_dn"), -1).when(F.col("tm_up"), 1).when(F.col("tm_inf") != 0, F.col("tm_inf"))
    df = df.withColumn("trend_state", F.coalesce(_carried(step), F.lit(0)))
    before = F.when(F.col("tm_inf") != 0, F.col("tm_inf")).otherwise(F.coalesce(lag("trend_state"), F.lit(0)))
    df = df.withColumn("tm_pre", before).withColumn("tm_mid", F.when(F.col("tm_up"), 1).otherwise(F.col("tm_pre")))
    pushed = is_true(F.col("body") >= F.lit(cfg.displacement_atr) * F.col("atr")) if cfg.need_displacement else F.lit(True)
    df = df.withColumns({
        "bullish_bias": F.col("trend_state") == 1,
        "bearish_bias": F.col("trend_state") == -1,
        "bos_up": F.col("tm_up") & (F.col("tm_pre") >= 0),
        "choch_up": F.col("tm_up") & (F.col("tm_pre") < 0),
        "bos_down": F.col("tm_dn") & (F.col("tm_mid") <= 0),
        "choch_down": F.col("tm_dn") & (F.col("tm_mid") > 0),
        "last_broken_high": F.when(F.col("tm_up"), high),
        "last_broken_low": F.when(F.col("tm_dn"), low),
    })
    df = df.withColumns({"mss_up": F.col("choch_up") & pushed, "mss_down": F.col("choch_down") & pushed})
    return df.drop(*[c for c in df.columns if c.startswith("tm_")])

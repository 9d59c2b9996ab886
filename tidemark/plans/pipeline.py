"""The feature pipeline: all layers in their order, defaults for those switched off, checks, and a cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.series import add_atr, require
from tidemark.functions.tables import materialise
from tidemark.operators.gaps import add_gaps
from tidemark.operators.levels import add_levels
from tidemark.operators.pools import add_pools
from tidemark.operators.retracement import add_retracement
from tidemark.operators.sessions import add_profile, add_sessions
from tidemark.operators.structure import add_structure
from tidemark.operators.zones import add_zones
from tidemark.plans.config import FeatureConfig
from tidemark.sources.runs import list_runs
from tidemark.sources.specs import pip_of
from tidemark.sources.stores import delete_path, exists, optional_table

#: Columns that stand in for a layer that is switched off: flags are false, numbers null (fixed names).
DEFAULTS = {
    "sessions": {"boolean": ["session_liquidity_long_valid", "session_liquidity_short_valid", "Session_Liquidity_Valid", "is_asia_session", "is_london_session", "is_newyork_session", "is_london_newyork_overlap", "session_low_swept", "session_high_swept"], "double": ["prev_asia_high", "prev_asia_low", "prev_london_high", "prev_london_low", "prev_newyork_high", "prev_newyork_low"], "string": ["session_name"]},
    "profile": {"boolean": ["volume_profile_long_valid", "volume_profile_short_valid", "Volume_Profile_Valid"], "double": ["vp_reference_poc", "vp_distance_to_poc"], "string": ["vp_session_name", "vp_reference_session_name"]},
    "gaps": {"boolean": ["bullish_imbalance_created", "bearish_imbalance_created", "bullish_imbalance_filled", "bearish_imbalance_filled", "imbalance_long_valid", "imbalance_short_valid", "Imbalance_Valid"], "double": ["bullish_imbalance_zone_low", "bullish_imbalance_zone_high", "bearish_imbalance_zone_low", "bearish_imbalance_zone_high", "active_bullish_imbalance_low", "active_bullish_imbalance_high", "active_bearish_imbalance_low", "active_bearish_imbalance_high"]},
    "retracement": {"boolean": ["fibonacci_long_valid", "fibonacci_short_valid", "Fibonacci_Valid"], "double": ["fib_bull_impulse_low", "fib_bull_impulse_high", "fib_bear_impulse_low", "fib_bear_impulse_high", "fib_long_band_low", "fib_long_band_high", "fib_short_band_low", "fib_short_band_high"]},
    "pools": {"boolean": ["liquidity_long_valid", "liquidity_short_valid", "Liquidity_Valid"], "double": ["liquidity_pool_high", "liquidity_pool_low"]},
    "levels": {"boolean": ["support_resistance_long_valid", "support_resistance_short_valid", "Support_Resistance_Valid"], "double": ["sr_nearest_resistance", "sr_nearest_support", "sr_long_reference_level", "sr_short_reference_level", "sr_long_target", "sr_short_target", "sr_long_target_rr", "sr_short_target_rr"]},
}


def add_defaults(df: DataFrame, layer: str) -> DataFrame:
    """Add the default columns of a layer where the table lacks them."""
    new = {}
    for kind, names in DEFAULTS[layer].items():
        for name in names:
            if name not in df.columns:
                new[name] = F.lit(False) if kind == "boolean" else F.lit(None).cast(kind)
    return df.withColumns(new) if new else df


def check_layer(df: DataFrame, layer: str) -> DataFrame:
    """Raise ValueError if a layer's columns are missing or its flags are no booleans."""
    flags = DEFAULTS[layer]["boolean"]
    require(df, *flags)
    kinds = dict(df.dtypes)
    if wrong := [f for f in flags if kinds[f] != "boolean"]:
        raise ValueError(f"not boolean: {', '.join(wrong)}")
    return df


def build_features(bars: DataFrame, config: FeatureConfig | None = None) -> DataFrame:
    """All feature layers over bars. ATR, structure and zones are always on.

    Bars may carry their symbol's pip size (``specs.attach_specs``); the settings' stands in for others.
    """
    cfg = config or FeatureConfig()
    df = add_atr(bars, cfg.atr_period, cfg.atr_method)
    df = add_structure(df, cfg.structure, "atr_feature")
    df = add_zones(df, pip_of(df, cfg.pip), cfg.zones, "atr_feature")
    df = base = materialise(df)
    layers = {"sessions": add_sessions, "profile": add_profile, "gaps": add_gaps, "retracement": add_retracement, "pools": add_pools, "levels": add_levels}
    for name, add in layers.items():
        setting = getattr(cfg, name)
        if setting is None:
            df = add_defaults(df, name)
        else:  # layers that need a table of their own make it from the base, not from all layers before them
            df = check_layer(add(df, setting, base) if name in ("profile", "gaps", "pools") else add(df, setting), name)
    return materialise(df)


def _version(spark: SparkSession, path: str) -> int:
    """Number of the last manifest, 0 without one."""
    return max((int(r["name"]) for r in list_runs(spark, f"{path}/manifest").collect() if r["name"].isdigit()), default=0)


def _told_apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and a sum of row hashes for each key, whatever their order."""
    rest = [F.col(c) for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*rest).cast("decimal(38,0)")).alias("hash"))


def cached_features(spark: SparkSession, bars: DataFrame, config: FeatureConfig, folder: str, key: str, rebuild: bool = False) -> DataFrame:
    """Features from the Parquet cache under ``folder/<key>_<signature>``, kept up with the bars.

    A manifest tells the bars of each series that the cache was made from, and its
    partitions (series and month). Series whose bars are known aren't computed; of the
    others, whose state may reach back to their first bar, all features are, and only
    partitions that differ are written, so appended bars leave old ones alone.
    Series that ``bars`` doesn't hold stay. The result equals a rebuild. A run that
    breaks off leaves its series unknown, and the next one writes them anew.
    """
    path = f"{folder.rstrip('/')}/{key}_{config.signature()}"
    if rebuild:
        delete_path(spark, path)
    at = _version(spark, path)
    series, parts = ["symbol", "timeframe"], ["tm_symbol", "tm_timeframe", "tm_month"]
    known = {kind: optional_table(spark, f"{path}/manifest/{at}/{kind}", f"{', '.join(f'{k} string' for k in keys)}, rows long, hash decimal(38,0)") for kind, keys in (("series", series), ("parts", parts))}
    now = materialise(_told_apart(bars, series))
    changed = materialise(now.join(known["series"], [*series, "rows", "hash"], "left_anti"))
    if not changed.isEmpty():
        built = build_features(bars.join(changed.select(series), series, "left_semi"), config)
        built = materialise(built.withColumns({"tm_symbol": F.col("symbol"), "tm_timeframe": F.col("timeframe"), "tm_month": F.date_format("time", "yyyy-MM")}))
        made = materialise(_told_apart(built, parts))
        own = changed.select(F.col("symbol").alias("tm_symbol"), F.col("timeframe").alias("tm_timeframe"))
        other, before = (known["parts"].join(own, parts[:2], how) for how in ("left_anti", "left_semi"))
        rest = known["series"].join(changed.select(series), series, "left_anti")

        def note(number: int, parts_: DataFrame, series_: DataFrame) -> None:
            parts_.write.mode("overwrite").parquet(f"{path}/manifest/{number}/parts")
            series_.write.mode("overwrite").parquet(f"{path}/manifest/{number}/series")

        note(at + 1, other, rest)  # until they are written, nothing is known of the changed series
        new = made.join(known["parts"], [*parts, "rows", "hash"], "left_anti")
        writer = built.join(new.select(parts), parts, "left_semi").repartition(*parts).sortWithinPartitions("symbol", "timeframe", "time").write
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/features")
        gone = before.join(made.select(parts), parts, "left_anti").collect()  # months that lost all their bars
        for r in gone:
            delete_path(spark, f"{path}/features/" + "/".join(f"{p}={r[p]}" for p in parts))
        note(at + 2, other.unionByName(made), rest.unionByName(changed))
        for old in (at, at + 1):
            delete_path(spark, f"{path}/manifest/{old}")
    if not exists(spark, f"{path}/features"):
        return build_features(bars.limit(0), config)
    return spark.read.parquet(f"{path}/features").drop(*parts)

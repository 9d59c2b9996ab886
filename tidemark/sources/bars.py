"""Bar sources: files, tick tables and retained caches, as canonical bar series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.series import require, with_bar
from tidemark.sources.stores import optional_table

#: Bar lengths by name (fixed values).
TIMEFRAMES = {"M5": "5 minutes", "M10": "10 minutes", "M15": "15 minutes", "M30": "30 minutes", "H1": "1 hour"}
BAR_SCHEMA = "symbol string, timeframe string, time timestamp_ntz, open double, high double, low double, close double, tick_volume double"
CANONICAL = ("time", "open", "high", "low", "close", "tick_volume")


#: Ending of a time of day with a zone.
_ZONE = r":[0-9]{2}([.][0-9]+)? ?(Z|UTC|GMT|[+-][0-9]{1,2}:?[0-9]{2}|[+-][0-9]{2})$"


def utc_time(df: DataFrame, name: str) -> Column:
    """A time column as UTC without a zone, whatever the session's zone.

    Epoch seconds, texts and timestamps are taken; texts without a zone and
    timestamps without one are UTC already, others are moved there. What is no time is NULL.
    """
    kind, x = dict(df.dtypes)[name], F.col(name)
    moved = lambda t: F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz"))
    if kind in ("int", "bigint", "double", "float"):
        return moved(F.timestamp_seconds(x))
    if kind == "string":
        return F.when(x.rlike(_ZONE), moved(F.try_to_timestamp(x))).otherwise(x.try_cast("timestamp_ntz"))
    return moved(x) if kind == "timestamp" else x.cast("timestamp_ntz")


def standardise(df: DataFrame) -> DataFrame:
    """Canonical bars: times in UTC (``utc_time``), six columns, no null time, first row of equal times."""
    require(df, *CANONICAL)
    time = utc_time(df, "time")
    keys = [c for c in ("symbol", "timeframe") if c in df.columns]
    one = df.select(*keys, time.alias("time"), *[F.col(c).try_cast("double").alias(c) for c in CANONICAL[1:]]).where("time is not null")
    first = Window.partitionBy(*keys, "time").orderBy("open", "high", "low", "close", "tick_volume")
    return one.withColumn("tm_k", F.row_number().over(first)).where("tm_k = 1").drop("tm_k")


def clip(df: DataFrame, start=None, end=None) -> DataFrame:
    """Bars of a closed time range."""
    if start is not None:
        df = df.where(F.col("time") >= F.lit(start))
    return df if end is None else df.where(F.col("time") <= F.lit(end))


def resample(ticks: DataFrame, time: str, price: str, tiebreak: str, symbol, timeframe: str = "H1") -> DataFrame:
    """Bars from ticks: first and last price by (time, tiebreak), extremes and number of ticks."""
    unit = {"H1": "hour"}.get(timeframe)
    bucket = F.date_trunc(unit, F.col(time)).cast("timestamp_ntz") if unit else F.window(F.col(time).cast("timestamp"), TIMEFRAMES[timeframe])["start"].cast("timestamp_ntz")
    order = F.struct(time, tiebreak)
    rows = ticks.select((F.col(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), bucket.alias("time"), F.col(price).alias("tm_p"), order.alias("tm_o"))
    out = rows.groupBy("symbol", "timeframe", "time").agg(
        F.min_by("tm_p", "tm_o").alias("open"),
        F.max("tm_p").alias("high"),
        F.min("tm_p").alias("low"),
        F.max_by("tm_p", "tm_o").alias("close"),
        F.count("*").cast("double").alias("tick_volume"),
    )
    return with_bar(out)


def event_bars(spark: SparkSession, sf_dir: str, each_type: bool = True) -> DataFrame:
    """Hourly bars of the event table: a series for each event type, or one of all events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return resample(events, "ts", "value", "event_id", "event_type" if each_type else F.lit("ALL"))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", symbols: list[str] | None = None, timeframes: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Scan stored bars; symbol, timeframe and time predicates reach the files. Raises ValueError if there are none."""
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).schema(BAR_SCHEMA)
    df = reader.format(fmt).load(path)
    if symbols:
        df = df.where(F.col("symbol").isin(symbols))
    if timeframes:
        df = df.where(F.col("timeframe").isin(timeframes))
    df = clip(standardise(df), start, end)
    if df.isEmpty():
        raise ValueError(f"no bars in {path}")
    return with_bar(df)


def write_bars(df: DataFrame, path: str) -> None:
    """Store bars in folders by symbol and timeframe."""
    df.select("symbol", "timeframe", *CANONICAL).repartition("symbol", "timeframe").sortWithinPartitions("symbol", "timeframe", "time").write.mode("overwrite").partitionBy("symbol", "timeframe").parquet(path)


def coverage(df: DataFrame) -> DataFrame:
    """First and last time and number of bars of each series."""
    return df.groupBy("symbol", "timeframe").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count("*").alias("bars"))


def covers(df: DataFrame, start, end) -> DataFrame:
    """Whether the stored bars of each series lie within a requested range, as a cache must: series, first_time, last_time, usable."""
    return coverage(df).select("symbol", "timeframe", "first_time", "last_time", ((F.col("first_time") >= F.lit(start)) & (F.col("last_time") <= F.lit(end))).alias("usable"))


def clamped_dates(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """Requested days moved into the range of each series, a day long at least where the series is.

    ``bounds`` is what ``coverage`` returns.
    """
    low, high = F.to_date("first_time"), F.to_date("last_time")
    a, b = (F.greatest(low, F.least(F.lit(x).cast("date"), high)) for x in (start, end))
    days = bounds.select("symbol", "timeframe", low.alias("low"), high.alias("high"), a.alias("a"), b.alias("b"))
    empty, at_start = F.col("a") >= F.col("b"), F.col("b") <= F.col("low")
    first = F.when(~empty, F.col("a")).when(at_start, F.col("low")).otherwise(F.greatest("low", F.date_sub("b", 1)))
    last = F.when(empty & at_start, F.least("high", F.date_add("low", 1))).otherwise(F.col("b"))
    return days.select("symbol", "timeframe", first.alias("start"), last.alias("end"))


def fetch_bars(spark: SparkSession, path: str, symbol: str, timeframe: str, start, end, remote=None, fallback=None, overwrite: bool = False) -> DataFrame:
    """Bars of one series and range: the store, else the remote source in chunks, else the last bars of the fallback.

    ``remote`` and ``fallback`` are functions of the session that return bars (see
    ``remote.chunked_bars`` and ``latest``). What they bring is standardised,
    clipped to the closed range and stored below ``path`` for the next call. A
    store is used if its bars lie within the range. Raises ValueError without bars.
    """
    own = f"{path.rstrip('/')}/{symbol}_{timeframe}_{str(start)[:10]}_{str(end)[:10]}"
    if not overwrite and not (known := optional_table(spark, own, BAR_SCHEMA)).isEmpty():
        if covers(known, start, end).where("not usable").isEmpty():
            return with_bar(known)
    for source in filter(None, (remote, fallback)):
        found = clip(standardise(source(spark)), start, end)
        if not found.isEmpty():
            found.coalesce(1).write.mode("overwrite").parquet(own)  # one series and range
            return with_bar(spark.read.schema(BAR_SCHEMA).parquet(own))
    raise ValueError(f"no bars of {symbol} {timeframe} between {start} and {end}")


def latest(df: DataFrame, n: int = 200_000) -> DataFrame:
    """The last ``n`` bars of each series."""
    w = Window.partitionBy("symbol", "timeframe").orderBy(F.desc("time"))
    return df.withColumn("tm_k", F.row_number().over(w)).where(F.col("tm_k") <= n).drop("tm_k")

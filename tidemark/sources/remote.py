"""Data sources behind functions: bars in chunks of a date range, and listed symbols with their metadata.

    spark.dataSource.register(ChunkedBars)
    spark.read.format("chunked_bars").options(fetcher="package.module:function", symbol="EURUSD", timeframe="M30", start="2024-01-01", end="2024-12-31").load()

The function takes (symbol, timeframe, start, end), and options that start with
``arg_`` by name, and returns rows of the canonical columns; it is imported on
the executors. ``symbol`` and ``timeframe`` may hold several names, with commas
between them. Every chunk of a series is one partition, and a lost one is fetched
again. With the option ``pushdown`` (``chunked_bars`` sets it, and the session's
``spark.sql.python.filterPushdown.enabled`` that it needs) predicates on symbol,
timeframe and time choose the chunks that are fetched. Chunks share their bounds, so the result goes through ``standardise``,
which keeps one row of equal times.
"""

from __future__ import annotations

import time
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

CHUNK_DAYS = 180
TRIES, WAIT = 3, 1.0


def chunks(start: datetime, end: datetime, days: int = CHUNK_DAYS) -> list[tuple[datetime, datetime]]:
    """Cut a range into parts of at most so many days. Raises ValueError if it ends before it starts."""
    if end < start:
        raise ValueError("the range ends before it starts")
    out, at = [], start
    while at < end or not out:
        to = min(at + timedelta(days=days), end)
        out.append((at, to))
        at = to
    return out


def with_retries(call, tries: int = TRIES, wait: float = WAIT):
    """Call until it succeeds, at most ``tries`` times, waiting a little longer after each failure; the last failure is raised."""
    for k in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if k == tries:
                raise
            time.sleep(wait * k)


class _Range(InputPartition):
    def __init__(self, symbol: str, timeframe: str, start: datetime, end: datetime):
        self.symbol, self.timeframe, self.start, self.end = symbol, timeframe, start, end


def _function(name: str):
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.wanted = {k: _names(options[k]) for k in ("symbol", "timeframe")}
        self.start, self.end = (datetime.fromisoformat(options[k]) for k in ("start", "end"))
        self.low, self.high = self.start, self.end

    def partitions(self):
        parts = chunks(self.start, self.end, int(self.options.get("chunk_days", CHUNK_DAYS)))
        # chunks keep their bounds, so that what a narrower read fetches is part of what a wider one does
        parts = [(a, b) for a, b in parts if a <= self.high and b >= self.low]
        return [_Range(s, t, a, b) for s in self.wanted["symbol"] for t in self.wanted["timeframe"] for a, b in parts]

    def read(self, partition):
        if partition is None:  # nothing to fetch
            return
        fetch = _function(self.options["fetcher"])
        tries, wait = int(self.options.get("tries", TRIES)), float(self.options.get("wait", WAIT))
        more = {k.removeprefix("arg_"): v for k, v in self.options.items() if k.startswith("arg_")}
        series = (partition.symbol, partition.timeframe)
        for row in with_retries(lambda: list(fetch(*series, partition.start, partition.end, **more)), tries, wait):
            yield (*series, *row)


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        """Narrow what is fetched; Spark still applies all filters."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.wanted and isinstance(f, EqualTo | EqualNullSafe | In):
                values = f.value if isinstance(f, In) else (f.value,)
                self.wanted[column] = [x for x in self.wanted[column] if x in values]
            elif column == "time" and isinstance(getattr(f, "value", None), datetime):
                at = f.value if f.value.tzinfo is None else f.value.astimezone(ZoneInfo(self.options.get("zone", "UTC"))).replace(tzinfo=None)
                if isinstance(f, EqualTo | EqualNullSafe | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, at)
                if isinstance(f, EqualTo | EqualNullSafe | LessThan | LessThanOrEqual):
                    self.high = min(self.high, at)
            yield f


class ChunkedBars(DataSource):
    """Bars of some symbols and timeframes from a function."""

    @classmethod
    def name(cls):
        return "chunked_bars"

    def schema(self):
        return "symbol string, timeframe string, time timestamp, open double, high double, low double, close double, tick_volume double"

    def reader(self, schema):
        options = dict(self.options)
        return (_PushingReader if options.get("pushdown") == "true" else _Reader)(options)


def chunked_bars(spark: SparkSession, fetcher: str, symbol: str | list[str], timeframe: str | list[str], start, end, **options) -> DataFrame:
    """Bars behind a function (``package.module:function``), a partition for each series and chunk of the range.

    Predicates on the result reach the source (``spark.sql.python.filterPushdown.enabled`` is set).
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedBars)
    joined = lambda x: x if isinstance(x, str) else ",".join(x)
    given = {"fetcher": fetcher, "symbol": joined(symbol), "timeframe": joined(timeframe), "start": str(start), "end": str(end), "zone": spark.conf.get("spark.sql.session.timeZone"), "pushdown": "true"} | {k: str(v) for k, v in options.items()}
    return spark.read.format("chunked_bars").options(**given).load()


#: What a source says of a symbol, before it is made a spec.
METADATA = "symbol string, digits int, point double, tick_size double, tick_value double, contract_size double, volume_min double, volume_max double, volume_step double, currency_base string, currency_profit string"


class _Lister(DataSourceReader):
    def __init__(self, options):
        self.options, self.names = options, None

    def read(self, partition):
        tries, wait = int(self.options.get("tries", TRIES)), float(self.options.get("wait", WAIT))
        more = {k.removeprefix("arg_"): v for k, v in self.options.items() if k.startswith("arg_")}
        fields = [c.split()[0] for c in METADATA.split(", ")]
        for row in with_retries(lambda: list(_function(self.options["lister"])(self.names, **more)), tries, wait):
            yield tuple(row.get(c) for c in fields)


class _PushingLister(_Lister):
    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("symbol",) and isinstance(f, EqualTo | In):
                values = set(f.value if isinstance(f, In) else (f.value,))
                self.names = values if self.names is None else self.names & values
            yield f


class ListedSymbols(DataSource):
    """Symbols and their metadata from a function of the wanted names (None: all) that returns dicts; unknown fields are null."""

    @classmethod
    def name(cls):
        return "listed_symbols"

    def schema(self):
        return METADATA

    def reader(self, schema):
        options = dict(self.options)
        return (_PushingLister if options.get("pushdown") == "true" else _Lister)(options)


def listed_symbols(spark: SparkSession, lister: str, **options) -> DataFrame:
    """The symbols that a function (``package.module:function``) lists, with their metadata; predicates on the symbol reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListedSymbols)
    return spark.read.format("listed_symbols").options(lister=lister, pushdown="true", **{k: str(v) for k, v in options.items()}).load()


def stored_bars(symbol: str, timeframe: str, start: datetime, end: datetime, path: str):
    """A fetcher over Parquet bars in a file system: rows of the closed range."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    columns = ["time", "open", "high", "low", "close", "tick_volume"]
    test = (pc.field("symbol") == symbol) & (pc.field("timeframe") == timeframe) & (pc.field("time") >= start) & (pc.field("time") <= end)
    for row in ds.dataset(path, format="parquet").to_table(columns, filter=test).to_pylist():
        yield tuple(row[c] for c in columns)


def stored_symbols(names: set[str] | None, path: str):
    """A lister over a Parquet table with a column ``symbol`` and some of the metadata."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    test = None if names is None else pc.field("symbol").isin(list(names))
    yield from ds.dataset(path, format="parquet").to_table(filter=test).to_pylist()

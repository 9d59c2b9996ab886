"""Series functions: Columns over bars keyed by ``symbol`` and ``timeframe``.

All windows use one partitioning and one order, so a plan that chains layers
holds a single exchange and a single sort. Missing values are NULL, never NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol", "timeframe")


def series(first: int | None = None, last: int = 0) -> WindowSpec:
    """Rows from ``first`` to ``last`` around a bar; without ``first`` from the start of the series."""
    w = Window.partitionBy(*KEYS).orderBy("time")
    return w.rowsBetween(Window.unboundedPreceding if first is None else first, last)


def ordered() -> WindowSpec:
    """The series in time order, for offset functions."""
    return Window.partitionBy(*KEYS).orderBy("time")


def lag(x: Column | str, n: int = 1) -> Column:
    """Value ``n`` bars earlier."""
    return F.lag(x, n).over(ordered())


def is_true(x: Column) -> Column:
    """A condition whose unknown result counts as false."""
    return F.coalesce(x, F.lit(False))


def with_bar(df: DataFrame) -> DataFrame:
    """Number the bars of each series from 0 in time order."""
    return df.withColumn("bar", F.row_number().over(ordered()).cast("long") - 1)


def true_range() -> Column:
    """Largest of the bar's range and its distances from the previous close."""
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def rolling_mean(x: Column, n: int) -> Column:
    """Mean of the last ``n`` values; NULL until there are so many."""
    w = series(1 - n)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def exponential_mean(df: DataFrame, source: str, target: str, alpha: float) -> DataFrame:
    """Add the recursion y[0] = x[0], y[t] = (1 - alpha) y[t-1] + alpha x[t].

    Bars are summed in blocks short enough for the powers of ``1 - alpha``, and
    a block takes over what the four before it left; older bars weigh less than
    the precision of a double. No series is gathered into one row.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    if alpha == 1:
        return df.withColumn(target, F.col(source))
    d = 1 - alpha
    size = max(1, int(math.log(1e-9) / math.log(d)))
    place = F.pmod(F.col("bar"), F.lit(size))
    part = F.when(F.col("bar") == 0, F.col(source)).otherwise(F.lit(alpha) * F.col(source))
    block = Window.partitionBy(*KEYS, "tm_block").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("tm_block", F.floor(F.col("bar") / size)).withColumn("tm_place", place)
    out = out.withColumn("tm_own", F.pow(F.lit(d), F.col("tm_place")) * F.sum(part * F.pow(F.lit(d), -F.col("tm_place"))).over(block))
    ends = F.col("tm_place") == size - 1
    out = out.withColumn("tm_e1", F.last(F.when(ends, F.col("tm_own")), ignorenulls=True).over(series(last=-1)))
    for k in (2, 3, 4):
        out = out.withColumn(f"tm_e{k}", F.last(F.when(ends, F.col(f"tm_e{k - 1}")), ignorenulls=True).over(series(last=-1)))
    carried = F.lit(0.0)
    for k in (4, 3, 2, 1):
        carried = F.coalesce(f"tm_e{k}", F.lit(0.0)) + F.lit(d**size) * carried
    out = out.withColumn(target, F.col("tm_own") + F.pow(F.lit(d), F.col("tm_place") + 1) * carried)
    return out.drop("tm_block", "tm_place", "tm_own", "tm_e1", "tm_e2", "tm_e3", "tm_e4")


def add_atr(df: DataFrame, period: int = 14, method: str = "rma", name: str = "atr_feature") -> DataFrame:
    """Add the average true range by simple (``sma``), exponential (``ema``) or Wilder (``rma``) mean."""
    if period < 1:
        raise ValueError("period must be positive")
    if method == "sma":
        return df.withColumn("tm_tr", true_range()).withColumn(name, rolling_mean(F.col("tm_tr"), period)).drop("tm_tr")
    alphas = {"ema": 2 / (period + 1), "rma": 1 / period}
    if method not in alphas:
        raise ValueError(f"unknown method {method!r}")
    return exponential_mean(df.withColumn("tm_tr", true_range()), "tm_tr", name, alphas[method]).drop("tm_tr")


def confirmed_pivot(column: str, left: int, right: int, high: bool) -> Column:
    """Whether the bar ``right`` bars ago is the extreme of its centred window (ties count)."""
    w = series(-(left + right))
    extreme = F.max(column).over(w) if high else F.min(column).over(w)
    return is_true((lag(column, right) == extreme) & (F.count(column).over(w) == left + right + 1))


def last_bar(condition: Column, upto: int = 0) -> Column:
    """Number of the last bar up to ``upto`` bars from here where the condition holds."""
    return F.last(F.when(condition, F.col("bar")), ignorenulls=True).over(series(last=upto))


def any_recent(condition: Column, n: int) -> Column:
    """Whether the condition holds on one of the last ``n`` bars."""
    return F.max(is_true(condition).cast("int")).over(series(1 - n)) == 1


def changed(x: Column) -> Column:
    """Whether the value differs from the bar before (true on the first bar)."""
    return (F.row_number().over(ordered()) == 1) | ~x.eqNullSafe(lag(x))


def runs(x: Column) -> Column:
    """Number of the run of equal values, from 1."""
    return F.sum(changed(x).cast("int")).over(series())


def zone_overlaps(a_low: Column, a_high: Column, b_low: Column, b_high: Column, tolerance: Column | float = 0.0) -> Column:
    """Whether two closed intervals meet, within a tolerance."""
    t = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    return (a_high + t >= b_low) & (a_low - t <= b_high)


def interval_join(bars: DataFrame, spans: DataFrame, keys: list[str], first: Column, last: Column, longest: int) -> DataFrame:
    """Every span with the bars of its series from ``first`` to ``last``; no span holds more than ``longest`` bars.

    Both sides meet in stretches of ``longest`` bars: a bar lies in one, a span
    touches two at most, so a shuffle moves each bar once and each span twice.
    ``spans`` has no column of ``bars`` but the keys.
    """
    stretch = lambda at: F.floor(at / longest)
    cut = spans.withColumns({"tm_first": first, "tm_last": last})
    cut = cut.withColumn("tm_stretch", F.explode(F.array_distinct(F.array(stretch(F.col("tm_first")), stretch(F.col("tm_last"))))))
    both = cut.join(bars.withColumn("tm_stretch", stretch(F.col("bar"))), [*keys, "tm_stretch"])
    return both.where(F.col("bar").between(F.col("tm_first"), F.col("tm_last"))).drop("tm_first", "tm_last", "tm_stretch")


def effective_tolerance(fixed: float, share: float, atr: Column) -> Column:
    """The larger of a fixed distance and a share of a positive ATR."""
    return F.greatest(F.lit(fixed), F.when(atr > 0, F.lit(share) * atr).otherwise(F.lit(0.0)))


def first_existing(df: DataFrame, *names: str) -> Column | None:
    """The first of several columns that the table has."""
    return next((F.col(n) for n in names if n in df.columns), None)


def require(df: DataFrame, *names: str) -> None:
    """Raise ValueError for missing columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def unordered(df: DataFrame, time: str, order: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows whose time lies before that of the row before them, by ``order``, within each series."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("tm_before", before).where(F.col(time) < F.col("tm_before")).drop("tm_before")


def optional_int(x: Column) -> Column:
    """A whole number from text or a number, rounded half to even; NULL for what is no number."""
    return F.bround(x.try_cast("double")).cast("long")

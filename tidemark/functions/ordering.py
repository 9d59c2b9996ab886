"""Row numbers and running values in a global order, without a single-partition sort.

Long series are cut into blocks of consecutive row numbers, and blocks into
groups. Every level is summed apart and combined on the next one, so no task sees
more than a block of rows or a group of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tables import join_on, materialise, stored

#: Rows of one block, and blocks of one group.
BLOCK, GROUP = 1 << 14, 1 << 12
#: Most pairs of a partition and a key that are broadcast; more are joined by a shuffle.
FEW = 100_000


def row_numbers(df: DataFrame, order: list[str | Column], name: str = "row_id", keys: list[str] | None = None, size: str | None = None, kept: list[str | Column] | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """Number rows from 1 in a total order, apart for each key if there are keys, and add the rows of the key as ``size``.

    Rows are put in range partitions, sorted there and given their places once;
    the places are then shifted by the rows that earlier partitions hold. The
    sorted table is materialised, so that counting and shifting see the same
    partitions whatever columns they read. ``kept`` has the columns to go on with
    (the keys among them), made after the sort, and has the table stored by columns, as long ones should be;
    ``held`` takes the stored table for its release.
    """
    keys = keys or []
    by = [*map(F.col, keys), *[F.col(c) if isinstance(c, str) else c for c in order]]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = (ranged if kept is None else ranged.select(kept)).withColumn("tm_m", F.monotonically_increasing_id())
    once = materialise(ranged) if kept is None else stored(ranged)
    if held is not None:
        held.append(once)
    placed = once.withColumns({"tm_part": F.shiftright("tm_m", 33), "tm_at": F.col("tm_m").bitwiseAND((1 << 33) - 1)}).drop("tm_m")
    counts = placed.groupBy("tm_part", *keys).agg(F.count("*").alias("tm_n"), F.min("tm_at").alias("tm_first"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("tm_n").over(whole.orderBy("tm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("tm_part", *keys, (before - F.col("tm_first") + 1).alias("tm_shift"), F.sum("tm_n").over(whole).alias("tm_size"))
    if not keys or counts.count() <= FEW:  # without keys a row for each partition
        shifts = F.broadcast(shifts)
    out = join_on(placed, shifts, ["tm_part", *keys]).withColumn(name, (F.col("tm_at") + F.col("tm_shift")).cast("long"))
    if size:
        out = out.withColumn(size, F.col("tm_size"))
    return out.drop("tm_part", "tm_at", "tm_shift", "tm_size")


def _block(order: str) -> Column:
    return F.floor(F.col(order) / BLOCK)


def _before(sums: DataFrame, keys: list[str], combine: dict[str, tuple]) -> DataFrame:
    """(keys, tm_block) and, for each column, its values of all earlier blocks combined; combine: (aggregate, sum of two)."""
    upto = (Window.unboundedPreceding, -1)
    sums = sums.withColumn("tm_group", F.floor(F.col("tm_block") / GROUP))
    tops = sums.groupBy(*keys, "tm_group").agg(*[f(c).alias(c) for c, (f, _) in combine.items()])
    high = Window.partitionBy(*keys).orderBy("tm_group").rowsBetween(*upto)
    tops = tops.select(*keys, "tm_group", *[f(c).over(high).alias(f"tm_high_{c}") for c, (f, _) in combine.items()])
    low = Window.partitionBy(*keys, "tm_group").orderBy("tm_block").rowsBetween(*upto)
    both = join_on(sums, tops, [*keys, "tm_group"])
    return both.select(*keys, "tm_block", *[g(F.col(f"tm_high_{c}"), f(c).over(low)).alias(c) for c, (f, g) in combine.items()])


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def with_running(df: DataFrame, values: dict[str, Column], order: str, keys: list[str] | None = None, peaks: dict[str, str] | None = None) -> DataFrame:
    """Add running sums of values, by name, along a row number, and the largest sums so far (``peaks``: name of the sum to name)."""
    keys, peaks = keys or [], peaks or {}
    df = df.withColumns({f"tm_v_{n}": x for n, x in values.items()} | {"tm_block": _block(order)})
    inside = Window.partitionBy(*keys, "tm_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"tm_own_{n}": F.sum(f"tm_v_{n}").over(inside) for n in values})
    sums = df.groupBy(*keys, "tm_block").agg(*[F.sum(f"tm_v_{n}").alias(f"tm_shift_{n}") for n in values])
    df = join_on(df, _before(sums, keys, {f"tm_shift_{n}": (F.sum, _plus) for n in values}), [*keys, "tm_block"])
    df = df.withColumns({n: F.col(f"tm_own_{n}") + F.col(f"tm_shift_{n}") for n in values})
    if peaks:
        tops = df.groupBy(*keys, "tm_block").agg(*[F.max(n).alias(f"tm_top_{n}") for n in peaks])
        df = join_on(df, _before(tops, keys, {f"tm_top_{n}": (F.max, F.greatest) for n in peaks}), [*keys, "tm_block"])
        df = df.withColumns({p: F.greatest(F.max(n).over(inside), F.col(f"tm_top_{n}")) for n, p in peaks.items()})
    return df.drop("tm_block", *[f"tm_{part}_{n}" for n in values for part in ("v", "own", "shift", "top")])


def with_last(df: DataFrame, value: Column, order: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Add the last value that isn't null up to each row, along a row number."""
    keys = keys or []
    df = df.withColumns({"tm_v": F.when(value.isNotNull(), F.struct(F.col(order).alias("at"), value.alias("v"))), "tm_block": _block(order)})
    inside = Window.partitionBy(*keys, "tm_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tops = df.groupBy(*keys, "tm_block").agg(F.max("tm_v").alias("tm_top"))
    df = join_on(df.withColumn("tm_own", F.max("tm_v").over(inside)), _before(tops, keys, {"tm_top": (F.max, F.greatest)}), [*keys, "tm_block"])
    return df.withColumn(name, F.greatest("tm_own", "tm_top")["v"]).drop("tm_v", "tm_block", "tm_own", "tm_top")


def max_drawdowns(df: DataFrame, values: dict[str, Column], order: str, keys: list[str] | None = None) -> DataFrame:
    """Largest falls of the running sums of values, by name, from their peaks, for each key.

    A stretch of rows is known by its sum, its lowest and highest running sum and
    its largest fall; stretches are joined to blocks, groups and whole series.
    The peak starts at the first sum.
    """
    keys = keys or []
    parts = df.select(*keys, F.col(order).alias("tm_at"), *[x.alias(f"{p}_{n}") for n, x in values.items() for p in ("tm_s", "tm_lo", "tm_hi")], *[F.lit(0.0).alias(f"tm_f_{n}") for n in values])
    return joined_falls(parts, list(values), keys, (BLOCK, GROUP))


def joined_falls(parts: DataFrame, names: list[str], keys: list[str], widths: tuple[int, ...]) -> DataFrame:
    """Largest falls over stretches of rows that are joined by ``widths`` at a time, and then all.

    ``parts`` has, besides the keys, the stretch's number ``tm_at`` and for each name
    tm_s (sum), tm_lo and tm_hi (lowest and highest running sum) and tm_f (largest fall).
    """
    for width in (*widths, None):
        cut = [] if width is None else ["tm_cut"]
        if cut:
            parts = parts.withColumn("tm_cut", F.floor(F.col("tm_at") / width))
        before = Window.partitionBy(*keys, *cut).orderBy("tm_at").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumns({f"tm_c_{n}": F.coalesce(F.sum(f"tm_s_{n}").over(before), F.lit(0.0)) for n in names})
        parts = parts.withColumns({f"{p}_{n}": F.col(f"{p}_{n}") + F.col(f"tm_c_{n}") for n in names for p in ("tm_lo", "tm_hi")})
        parts = parts.withColumns({f"tm_f_{n}": F.greatest(f"tm_f_{n}", F.max(f"tm_hi_{n}").over(before) - F.col(f"tm_lo_{n}")) for n in names})
        cells = [f(f"{p}_{n}").alias(f"{p}_{n}") for n in names for p, f in (("tm_s", F.sum), ("tm_lo", F.min), ("tm_hi", F.max), ("tm_f", F.max))]
        parts = parts.groupBy(*keys, *cut).agg(*cells)
        if cut:
            parts = parts.withColumnRenamed("tm_cut", "tm_at")
    return parts.select(*keys, *[F.col(f"tm_f_{n}").alias(n) for n in names])

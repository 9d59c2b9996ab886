"""Frequent keys and bounded samples, found by aggregates before anything is moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys that count as frequent. A key is frequent if it has more than this share of all rows, so there can't be more.
MOST_KEYS = 50_000


def frequent_keys(counts: DataFrame, least: int, most: int = MOST_KEYS) -> DataFrame:
    """Rows of a table with a count column ``n`` whose n is over ``least`` and over 1 / ``most`` of the sum.

    At most ``most`` rows can be, so the result may be broadcast at any size.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > max(least, total // most))


def hash_share(*columns: str) -> Column:
    """A place in [0, 1) that is fixed by the columns' values."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def smallest_hashes(df: DataFrame, rows: int, key: str, order: list[str]) -> DataFrame:
    """The ``rows`` rows with the smallest hashes of ``key``, then by ``order``.

    Rows over a bound of the hash are left out before any row is moved; the bound
    is raised until enough rows lie below it.
    """
    place, total = hash_share(key), df.count()
    bound = (rows + 6 * rows**0.5 + 10) / max(1, total)
    while bound < 1 and df.where(place <= bound).count() < rows:
        bound *= 4
    near = df if bound >= 1 else df.where(place <= bound)
    return near.orderBy(place, *order).limit(rows)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], least: int = 10_000) -> DataFrame:
    """Inner join with a stored table of one row for each key, whose column ``n`` counts the left rows of the key.

    The first key is a long. Frequent keys are matched by a broadcast copy, and
    their rows are spread over all tasks, so no key fills one. ``n`` is left out.
    """
    hot = frequent_keys(right, least)
    values = [c for c in right.columns if c not in (*keys, "n")]
    row = F.struct(F.lit(True).alias("tm_is"), *values)
    marked = left.join(F.broadcast(hot.select(*keys, row.alias("tm_hot"))), keys, "left")
    # a hash of the whole row in place of the key matches nothing
    spread = F.when(F.col("tm_hot").isNotNull(), F.xxhash64(*left.columns)).otherwise(F.col(keys[0]))
    cold = right.select(F.col(keys[0]).alias("tm_key"), *keys[1:], row.alias("tm_cold"))
    both = marked.withColumn("tm_key", spread).join(cold, ["tm_key", *keys[1:]], "left")
    found = F.when(F.col("tm_hot").isNotNull(), F.col("tm_hot")).otherwise(F.col("tm_cold"))
    return both.select(*left.columns, found.alias("tm_found")).where("tm_found is not null").select(*left.columns, *[F.col(f"tm_found.{c}").alias(c) for c in values])


def attach_large(pairs: DataFrame, counts: DataFrame, values: DataFrame, key: str, other: str, per_block: int = 1000) -> DataFrame:
    """Inner join of pairs with a table of one large value for each ``key``.

    ``counts`` (key, n) says how many pairs a key has. The pairs of a frequent key
    are cut into blocks by a hash of ``other``, and its value goes to every block.
    """
    blocks = frequent_keys(counts, 2 * per_block).select(key, F.ceil(F.col("n") / per_block).cast("int").alias("tm_blocks"))
    few = F.broadcast(blocks)
    salt = F.when(F.col("tm_blocks").isNotNull(), F.pmod(F.xxhash64(other), F.col("tm_blocks"))).otherwise(0).cast("int")
    left = pairs.join(few, key, "left").withColumn("tm_salt", salt).drop("tm_blocks")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tm_blocks"), F.lit(1)) - 1))
    right = values.join(few, key, "left").withColumn("tm_salt", copies).drop("tm_blocks")
    return left.join(right, [key, "tm_salt"]).drop("tm_salt")

"""Exact medians of groups of any size in bounded memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tables import join_on

#: Accuracy of the sketch that brackets a median: ranks are off by at most one in so many rows.
ACCURACY = 2000


def exact_medians(df: DataFrame, value: Column, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the median of the values that aren't null of each key.

    A quantile sketch of bounded size gives two values that the median lies
    between. What is below them is counted; distinct values between them, some
    thousandths of the rows, are counted one by one and added up in order. No
    group is held as a whole, and repeated values cost one row.
    """
    rows = df.select(*keys, value.cast("double").alias("tm_x")).where("tm_x is not null")
    half = 2.0 / ACCURACY
    bracket = rows.groupBy(*keys).agg(F.count("*").alias("tm_n"), F.percentile_approx("tm_x", [0.5 - half, 0.5 + half], ACCURACY).alias("tm_b"), F.min("tm_x").alias("tm_low"), F.max("tm_x").alias("tm_high"))
    # ranks near the ends of a short group are the ends themselves
    low = F.when(F.col("tm_n") < ACCURACY, F.col("tm_low")).otherwise(F.col("tm_b")[0])
    high = F.when(F.col("tm_n") < ACCURACY, F.col("tm_high")).otherwise(F.col("tm_b")[1])
    bracket = bracket.select(*keys, "tm_n", low.alias("tm_from"), high.alias("tm_to"))
    near = join_on(rows, bracket, keys).where(F.col("tm_x") <= F.col("tm_to"))
    cells = near.groupBy(*keys, F.when(F.col("tm_x") >= F.col("tm_from"), F.col("tm_x")).alias("tm_cell")).agg(F.count("*").alias("tm_c"), F.max("tm_n").alias("tm_n"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("tm_cell")).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("tm_upto", F.sum("tm_c").over(order))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("tm_upto") - F.col("tm_c") < rank) & (rank <= F.col("tm_upto")), F.col("tm_cell")))

    return cells.groupBy(*keys).agg(((at(F.floor((F.col("tm_n") + 1) / 2)) + at(F.floor(F.col("tm_n") / 2) + 1)) / 2).alias(name))

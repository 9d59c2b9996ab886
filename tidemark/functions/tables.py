"""Tables that are computed once and read several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.stores import delete_path, new_folder

#: Deletes a query's shuffle files when it ends; else they stay until the driver's garbage collector comes by.
_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Compute a table that several later steps read only once.

    Where the session names a shared checkpoint folder the plan is cut there;
    elsewhere the table is persisted, and lost parts are computed again. Tables
    are freed by ``spark.catalog.clearCache()`` or with the session; checkpoints
    by Spark's cleaner (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def stored(df: DataFrame) -> DataFrame:
    """Compute a long table once and keep it in the shared folder by columns, compressed, where checkpoints hold whole rows as they are.

    It stays until it is released or the session ends. Its shuffles are freed as soon as it is written.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, "table"), spark.conf.get(_SHUFFLES)
    spark.conf.set(_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_SHUFFLES, before)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.tm_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``stored`` keeps of a table; nothing may read it after this."""
    delete_path(df.sparkSession, df.tm_path)


def fetched(df: DataFrame) -> DataFrame:
    """A table of a few rows that no longer needs what it was made from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def renewed(df: DataFrame) -> DataFrame:
    """The same table with columns of its own, so that it can be grouped beside a table that it was made from."""
    return df.toDF(*df.columns)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls equal nulls; the keys of the left side stay. Without keys the right side is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({k: f"tm_on_{i}" for i, k in enumerate(keys)})
    same: Column = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"tm_on_{i}"))
    return left.join(named, same, how).drop(*[f"tm_on_{i}" for i in range(len(keys))])

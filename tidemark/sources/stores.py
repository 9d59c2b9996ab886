"""Stored tables that may be missing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the path's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def optional_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, or one without rows (and, without a schema, without columns) where nothing is."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema or "struct<>")
    reader = spark.read.option("header", True).option("inferSchema", schema is None) if fmt == "csv" else spark.read
    return (reader.schema(schema) if schema else reader).format(fmt).load(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; false where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Put a folder in the place of another one, which is deleted."""
    delete_path(spark, to)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = a.getFileSystem(conf)
    fs.mkdirs(b.getParent())
    fs.rename(a, b)


def write_folders(df: DataFrame, root: str, name: str) -> None:
    """Write a folder ``<root>/<value>`` for each value of the column ``name``, in one job."""
    df.write.partitionBy(name).parquet(f"{root}/_all")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/_all")
    fs = path.getFileSystem(conf)
    for status in fs.listStatus(path):
        if status.isDirectory():
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{root}/{status.getPath().getName().partition('=')[2]}"))
    fs.delete(path, True)


def new_folder(spark: SparkSession, tag: str) -> str:
    """An unused path in the shared checkpoint folder; only a session on one machine may do without that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"

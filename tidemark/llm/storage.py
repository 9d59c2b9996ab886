"""Tables that cut lineage, kept in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only a session on one
machine may do without it: a temporary folder is used then.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_made: list[str] = []  # tables of this process that haven't been dropped


def shared_dir(spark: SparkSession) -> str:
    """Return the folder for intermediate tables. Raises ValueError on a cluster that names none."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Bytes of a batch that a Python worker is given (one row at least).
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Give Python workers batches of at most ``BATCH_BYTES`` where the session doesn't set a bound of its own."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))


def new_path(spark: SparkSession, tag: str) -> str:
    """Return an unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, tag: str, codec: str = "zstd", file_rows: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back.

    ``file_rows`` bounds the rows of a file (0: no bound). Writers hold 100 rows and readers
    4,096 before they look at their bytes, so tables of rows of some megabytes need a bound.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)
    if path in _made:
        _made.remove(path)


def drop(df: DataFrame) -> None:
    """Delete the table that ``stored`` made for ``df``; nothing may read it after this."""
    names = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for path in [p for p in _made if any(n.endswith(p.rsplit("/", 1)[1]) for n in names)]:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame]):
    """Delete all tables made inside, save those of the tables in ``keep`` at the end.

    Results of an operator read their intermediate tables until they are written,
    so the writing belongs inside.
    """
    before = len(_made)
    try:
        yield
    finally:
        kept = {name.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in keep for name in df.inputFiles()}
        for path in [p for p in _made[before:] if p.rsplit("/", 1)[1] not in kept]:
            _delete(spark, path)

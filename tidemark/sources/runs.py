"""Run folders as a catalogue: names parsed into keys, versions and the latest run."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.analytics import normalise
from tidemark.sources.stores import delete_path, optional_table

#: Name of a run folder: symbol, timeframe, first and last day, time of the run; and of a training: symbol, timeframe, mode, time (fixed patterns).
RUN = r"^(.+?)_([A-Z0-9]+)_([0-9]{4}-?[0-9]{2}-?[0-9]{2})_([0-9]{4}-?[0-9]{2}-?[0-9]{2})_([0-9]{8}T?[0-9]{6})Z?$"
TRAINED = r"^(.+?)_([A-Z0-9]+)_([A-Za-z0-9_]+)_([0-9]{8}T?[0-9]{6})Z?$"
MODE = "walk_forward"


def run_name(symbol: str, timeframe: str, start, end, now: datetime | None = None) -> str:
    """Folder name of a run."""
    return f"{symbol}_{timeframe}_{str(start)[:10]}_{str(end)[:10]}_{(now or datetime.now(timezone.utc)):%Y%m%dT%H%M%S}Z"


def training_name(symbol: str, timeframe: str, now: datetime | None = None) -> str:
    """Folder name of a training."""
    return f"{symbol}_{timeframe}_{MODE}_{(now or datetime.now(timezone.utc)):%Y%m%dT%H%M%S}Z"


def parse_runs(names: DataFrame, column: str = "name") -> DataFrame:
    """Names of runs and trainings with their parts (days as eight digits, mode of a training); names of another form have NULL parts."""
    part = lambda pattern, k: F.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, k))
    day = lambda k: F.replace(part(RUN, k), F.lit("-"), F.lit(""))
    both = {p: F.coalesce(part(RUN, a), part(TRAINED, b)) for p, a, b in (("symbol", 1, 1), ("timeframe", 2, 2), ("stamp", 5, 4))}
    mode = F.when(~F.col(column).rlike(RUN), part(TRAINED, 3))
    return names.withColumns(both | {"start_day": day(3), "end_day": day(4), "mode": mode})


def run_versions(runs: DataFrame, column: str = "name") -> DataFrame:
    """Number the runs of the same key by time, as ``v1``, ``v2``, ..., newest row first."""
    key = ("symbol", "timeframe", "start_day", "end_day")
    w = Window.partitionBy(*key).orderBy("stamp", column)
    label = F.concat_ws(" ", "symbol", "timeframe", "start_day", "end_day")
    out = runs.where("stamp is not null").withColumn("version", F.row_number().over(w))
    return out.withColumn("label", F.concat(label, F.lit(" v"), F.col("version"))).orderBy(F.desc("stamp"), column)


def latest_runs(runs: DataFrame, column: str = "name") -> DataFrame:
    """The newest run of each symbol and timeframe."""
    return runs.where("stamp is not null").groupBy("symbol", "timeframe").agg(F.max_by(column, F.struct("stamp", column)).alias(column), F.max("stamp").alias("stamp"))


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders below ``root`` (empty where it does not exist)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return spark.createDataFrame([(n,) for n in found], "name string")


def orphaned_datasets(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Data sets that no run refers to any more, which may be deleted."""
    return datasets.join(runs.select("dataset").distinct(), "dataset", "left_anti")


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, names and date range of each stored data set."""
    return df.groupBy("dataset").agg(F.count("*").alias("rows"), F.min("symbol").alias("symbol"), F.min("timeframe").alias("timeframe"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def delete_runs(spark: SparkSession, root: str, names: DataFrame, datasets: str | None = None) -> dict[str, list[str]]:
    """Delete the runs ``names`` (name) below ``root``, and each data set that no run left there belongs to.

    Data sets are ``<datasets>/<symbol>_<timeframe>`` of deleted runs. Returns the names of what was deleted.
    """
    known = parse_runs(list_runs(spark, root)).withColumn("tm_series", F.concat_ws("_", "symbol", "timeframe"))
    wanted = names.select("name").distinct()
    gone = [r["name"] for r in known.join(wanted, "name", "left_semi").select("name").collect()]  # folders, which the driver has listed
    series = parse_runs(wanted).where("stamp is not null").select(F.concat_ws("_", "symbol", "timeframe").alias("tm_series")).distinct()
    left = known.where("stamp is not null").join(wanted, "name", "left_anti").select("tm_series")
    free = [r[0] for r in series.join(left, "tm_series", "left_anti").collect()] if datasets else []
    return {"run": [n for n in gone if delete_path(spark, f"{root}/{n}")], "dataset": [n for n in free if delete_path(spark, f"{datasets}/{n}")]}


def delete_run(spark: SparkSession, root: str, name: str, datasets: str | None = None) -> dict[str, bool]:
    """Delete one run as ``delete_runs`` does. Returns what was deleted."""
    done = delete_runs(spark, root, spark.createDataFrame([(name,)], "name string"), datasets)
    return {kind: bool(found) for kind, found in done.items()}


#: Tables of a stored simulation and of a stored training, with their formats (fixed names).
SIMULATION = {"account_info": "json", "trade_stats": "json", "trades": "csv"}
TRAINING = {"training_summary": "json", "walk_forward_fold_summary": "csv", "feature_importance": "csv", "validation_keep_ratio_sweep": "csv", "validation_predictions": "csv", "test_predictions": "csv", "validation_confluence_lift": "csv", "test_confluence_lift": "csv", "model_metadata": "json"}


def load_bundle(spark: SparkSession, folder: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """All tables of a stored run by name; a missing one is empty. Trades are normalised."""
    found = {name: optional_table(spark, f"{folder}/{name}", None, fmt) for name, fmt in tables.items()}
    if "trades" in found and found["trades"].columns:
        found["trades"] = normalise(found["trades"])
    return found


#: What is known of a stored model without loading it (fixed names).
METADATA = ("target", "keep_ratio", "selection_method", "walk_forward_folds", "feature_columns", "config")


def model_metadata(spark: SparkSession, folder: str) -> dict:
    """Metadata of the model stored with a training run; empty where there is none."""
    row = optional_table(spark, f"{folder}/model_metadata", None, "json").first()  # one row
    return {} if row is None else {k: v for k, v in row.asDict(recursive=True).items() if k in METADATA}

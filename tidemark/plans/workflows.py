"""Whole runs: bars to trades and artifacts, and stored data sets to a trained filter."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.tables import materialise
from tidemark.operators import classification, dataset, execution, performance
from tidemark.operators.model import TrainConfig, Training, train_filter
from tidemark.operators.signals import add_signals
from tidemark.plans.config import ExecutionConfig, FeatureConfig
from tidemark.plans.pipeline import build_features
from tidemark.sources import runs, sinks, stores


@dataclass
class Simulation:
    """Tables of one run over any number of series."""

    features: DataFrame
    trades: DataFrame
    report: DataFrame
    equity: DataFrame
    stats: DataFrame
    account: DataFrame


def simulate(bars: DataFrame, features: FeatureConfig | None = None, execution_config: ExecutionConfig | None = None) -> Simulation:
    """Features, signals and trades of all series at once; statistics are by series."""
    cfg = execution_config or ExecutionConfig()
    signals = add_signals(build_features(bars, features))
    trades = materialise(execution.run_trades(signals, cfg))
    keys = ["symbol", "timeframe"]
    stats = performance.engine_summary(trades, cfg.balance, keys).join(performance.trade_stats(trades, cfg.balance, keys).drop("trades", "wins", "losses", "breakevens", "gross_profit", "gross_loss"), keys)
    moments = performance.deflated_sharpe(trades, cfg.balance, keys).select(*keys, "sharpe", "deflated_sharpe_ratio", "deflated_sharpe_threshold", "deflated_sharpe_trials", "deflated_sharpe_mode")
    account = performance.account_info(trades.withColumn("row_id", F.col("trade_no").cast("long")), cfg.balance, "row_id", keys)
    return Simulation(signals, trades, execution.trade_report(trades, signals, cfg), execution.equity_curve(trades, signals, cfg.balance), stats.join(moments, keys), account)


def run_simulation(bars: DataFrame, folder: str, features: FeatureConfig | None = None, execution_config: ExecutionConfig | None = None) -> Simulation:
    """Simulate and store account figures, statistics, trades, the raw log, equity and the training table below ``folder``."""
    run = simulate(bars, features, execution_config)
    sinks.save_run(folder, run.report, run.stats, run.account)
    sinks.write_csv(sinks.trade_log(run.report), f"{folder}/trade_log")
    sinks.write_csv(run.equity, f"{folder}/equity_curve")
    table = dataset.safe_frame(run.report.withColumn("position", F.initcap("side")))
    if not run.trades.isEmpty():
        sinks.save_dataset(table, f"{folder}/dataset")
    else:
        stores.delete_path(bars.sparkSession, f"{folder}/dataset")  # that of an earlier run
    return run


def run_training(spark: SparkSession, pattern: str, folder: str, cfg: TrainConfig | None = None) -> Training:
    """Train the filter on stored data sets and store everything below ``folder``.

    Tables are CSV and the summary JSON, under the names of ``runs.TRAINING``; the
    model is a Spark pipeline in ``model`` and its metadata JSON beside it.
    """
    cfg = cfg or TrainConfig()
    data = dataset.load_training_data(spark, pattern, cfg.target)
    run = train_filter(data, cfg)
    for name, df in run.tables.items():
        sinks.write_csv(df, f"{folder}/{name}")
    run.model.write().overwrite().save(f"{folder}/model")
    seen = data.agg(F.count("*").alias("rows"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count_distinct("symbol").alias("symbols"), F.avg(cfg.target).alias("positive_rate")).first().asDict()  # one row
    run.summary["dataset_overview"] = {k: str(v) if k.endswith("date") else v for k, v in seen.items()}
    for name, value in (("training_summary", rounded(run.summary)), ("model_metadata", run.metadata)):
        spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return run


def training_folder(spark: SparkSession, pattern: str, root: str) -> str:
    """Folder below ``root`` for a training on these data sets, named as ``stored_predictions`` looks for it.

    Its name has the symbol and timeframe (``ALL`` where there are several) and the time.
    """
    seen = dataset.load_training_data(spark, pattern).agg(F.min("symbol").alias("s1"), F.max("symbol").alias("s2"), F.min("timeframe").alias("t1"), F.max("timeframe").alias("t2")).first()
    symbol, timeframe = (seen[f"{c}1"] if seen[f"{c}1"] == seen[f"{c}2"] else "ALL" for c in "st")
    return f"{root.rstrip('/')}/{runs.training_name(symbol, timeframe)}"


def rounded(value, name: str = ""):
    """A nested figure rounded by its names, as ``sinks.display`` rounds columns; infinite and undefined ones become None."""
    if isinstance(value, dict):
        return {k: rounded(v, k) for k, v in value.items()}
    if isinstance(value, float):
        return round(value, sinks.places(name)) if math.isfinite(value) else None
    return value


def stored_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Predictions of the latest training of each symbol and timeframe below ``root``: run, split, label, selected, ranking_score.

    The score is 1 less the rank's share, which falls as the model's score does;
    what isn't a number counts as 0.
    """
    latest = runs.latest_runs(runs.parse_runs(runs.list_runs(spark, root)))
    out = None
    for row in latest.collect():  # a row for each stored series
        target = runs.model_metadata(spark, f"{root}/{row['name']}").get("target", "label_positive")
        for split in ("validation", "test"):
            df = spark.read.option("header", True).csv(f"{root}/{row['name']}/{split}_predictions")
            whole = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
            part = df.select(F.lit(f"{row['symbol']}_{row['timeframe']}").alias("run"), F.lit(split).alias("split"), whole(target).cast("int").alias("label"), whole("selected").cast("int").alias("selected"), (1.0 - whole("rank_pct")).alias("ranking_score"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "run string, split string, label int, selected int, ranking_score double, row_id long")
    return out.withColumn("row_id", F.monotonically_increasing_id())


def run_analysis(spark: SparkSession, root: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Classification metrics of the stored trainings, per run and pooled, stored as CSV and JSON below ``folder``."""
    per_run, pooled = classification.run_metrics(materialise(stored_predictions(spark, root)))
    sinks.write_csv(per_run, f"{folder}/classification_metrics_per_run")
    sinks.write_csv(pooled, f"{folder}/classification_metrics_aggregate")
    sinks.write_json(pooled, f"{folder}/classification_metrics_aggregate_json")
    return per_run, pooled

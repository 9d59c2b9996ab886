"""Training on stored data sets, its analysis, and stored runs."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dataset, execution, performance, ranking
from tidemark.operators.model import TrainConfig, prediction_metrics
from tidemark.plans import settings, workflows
from tidemark.plans.config import ExecutionConfig
from tidemark.sources import bars as bar_source
from tidemark.sources import remote, runs, specs, stores


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    """A small training: the feature ``edge`` knows the outcome, a text has a value that only later rows hold."""
    root = tmp_path_factory.mktemp("training")
    k = F.col("id")
    won = (k * 7919 % 10) < 4
    day = F.timestamp_add("DAY", F.floor(k / 10).cast("int"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    rows = spark.range(400).select(
        F.lit("eurusd ").alias("symbol"), F.lit("h1").alias("timeframe"), day.alias("trade_date"), k.alias("entry_bar"), F.lit("Long").alias("position"), F.when(won, 100.0).otherwise(-50.0).alias("pnl_cash"), F.when(won, 2.0).otherwise(-1.0).alias("pnl_r"), won.cast("int").alias("label_positive"), F.lit(0).alias("label_hit_target"), F.lit(0).alias("label_runner"),
        (F.when(won, 1.0).otherwise(0.0) + (k % 3) * 0.01).alias("edge"), F.when(k > 350, "late").otherwise("early").alias("phase"), (k % 2 == 0).alias("gap_valid"), F.lit(None).cast("double").alias("nothing"),
    )
    rows.where("id < 200").write.parquet(f"{root}/sets/a")
    rows.where("id >= 200").write.parquet(f"{root}/sets/b")
    folder = f"{root}/runs/EURUSD_H1_20240101_20240209_20240301T000000Z"
    run = workflows.run_training(spark, f"{root}/sets/*", folder, TrainConfig(trees=3, depth=2, folds=dataset.FoldConfig(0.6, 2)))
    return root, folder, run


def test_training_finds_the_edge_and_keeps_it(spark, trained):
    _, folder, run = trained
    assert run.metadata["feature_columns"] and not {"nothing", "pnl_cash", "label_positive"} & set(run.metadata["feature_columns"])
    assert run.tables["feature_importance"].first()["feature"] == "edge"
    got = runs.load_bundle(spark, folder, runs.TRAINING)
    assert got["walk_forward_fold_summary"].count() == 2 and got["validation_keep_ratio_sweep"].count() == 14
    assert "cutoff_score" not in got["validation_keep_ratio_sweep"].columns
    effect = prediction_metrics(run.tables["test_predictions"]).first()
    assert effect["filtered_win_rate"] > effect["baseline_win_rate"] and effect["kept"] < effect["rows"] and effect["folds"] == 2
    summary = got["training_summary"].first().asDict(recursive=True)
    assert summary["walk_forward_folds"] == 2 and summary["dataset_overview"]["rows"] == 400
    assert runs.model_metadata(spark, folder)["selection_method"] == "walk_forward_top_x_percent"
    assert runs.model_metadata(spark, f"{folder}/none") == {}


def test_the_stored_model_scores_alike(spark, trained):
    from pyspark.ml import PipelineModel

    from tidemark.operators.model import prepared

    root, folder, run = trained
    rows = dataset.load_training_data(spark, f"{root}/sets/*")
    numeric = [c for c in run.metadata["feature_columns"] if c in rows.columns]
    ready = prepared(rows, numeric)
    a, b = (m.transform(ready).select("row_id", "probability").orderBy("row_id").collect() for m in (run.model, PipelineModel.load(f"{folder}/model")))
    assert [x["probability"] for x in a] == [x["probability"] for x in b] and len(a) == 400


def test_analysis_of_stored_trainings(spark, trained):
    root, _, run = trained
    per_run, pooled = workflows.run_analysis(spark, f"{root}/runs", f"{root}/analysis")
    rows = {r["split"]: r for r in per_run.collect()}
    assert set(rows) == {"validation", "test"} and rows["test"]["rows"] == run.tables["test_predictions"].count() and rows["test"]["roc_auc"] > 0.95
    assert [r["run"] for r in pooled.collect()] == ["AGGREGATE"] * 2
    assert stores.exists(spark, f"{root}/analysis/classification_metrics_per_run")
    assert workflows.stored_predictions(spark, f"{root}/nowhere").count() == 0


def test_training_folders_are_named_by_their_rows(spark, trained):
    root, _, _ = trained
    name = workflows.training_folder(spark, f"{root}/sets/*", "/out/").rsplit("/", 1)[1]
    parsed = runs.parse_runs(spark.createDataFrame([(name,)], "name string")).first()
    assert (parsed["symbol"], parsed["timeframe"], parsed["mode"], parsed["start_day"]) == ("EURUSD", "H1", "walk_forward", None)
    run = runs.parse_runs(spark.createDataFrame([("US_500.x_M30_2024-01-01_2024-02-09_20240301T000000Z",)], "name string")).first()
    assert (run["symbol"], run["timeframe"], run["mode"], run["start_day"], run["end_day"]) == ("US_500.x", "M30", None, "20240101", "20240209")


def test_numbers_round_by_their_names():
    got = workflows.rounded({"a": {"win_rate": 12.3456, "sharpe": 1.23456}, "x": float("inf"), "n": 3})
    assert got == {"a": {"win_rate": 12.35, "sharpe": 1.2346}, "x": None, "n": 3} and json.dumps(got)


def test_equity_is_rebuilt_from_stored_trades(spark):
    rows = [(datetime(2024, 1, d), c, b) for d, c, b in ((3, -5.0, None), (1, 10.0, 110.0), (2, 20.0, None))]
    t = spark.createDataFrame(rows, "trade_date timestamp_ntz, pnl_cash double, balance_after double")
    order = lambda df: [r["equity"] for r in df.orderBy("step").collect()]
    assert order(performance.rebuilt_equity(t, 100.0)) == [100, 110, 110, 110]
    assert order(performance.rebuilt_equity(t.drop("balance_after"), 100.0)) == [100, 110, 130, 125]
    assert performance.rebuilt_equity(t.where("false"), 100.0).count() == 0


def test_settings_from_the_environment(monkeypatch):
    for name, value in {"X_SYMBOLS": " EURUSD, ,GBPUSD", "X_NUMBER": "odd", "X_FLAG": " Yes ", "X_START": "2024-02-03", "X_LOGIN": "12", "X_PASSWORD": "p", "X_SERVER": "s"}.items():
        monkeypatch.setenv(name, value)
    assert settings.env_list("X_SYMBOLS", []) == ["EURUSD", "GBPUSD"] and settings.env_list("X_NONE", ["a"]) == ["a"]
    assert settings.env_float("X_NUMBER", 1.5) == 1.5 and settings.env_bool("X_FLAG", False) and settings.env_bool("X_NONE", True) and not settings.env_bool("X_NUMBER", True)
    assert settings.env_datetime("X_START", datetime(1, 1, 1)) == datetime(2024, 2, 3) and settings.env_datetime("X_NUMBER", datetime(1, 1, 1)) == datetime(1, 1, 1)
    assert settings.Credentials.from_env("X").login == 12 and settings.Credentials.from_env("Y") is None
    assert settings.Universe.from_env("X").symbols == ("EURUSD", "GBPUSD")
    monkeypatch.setenv("X_LOGIN", "me")
    with pytest.raises(ValueError):
        settings.Credentials.from_env("X")


def test_failed_calls_are_repeated():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no answer")
        return "bars"

    assert remote.with_retries(flaky, 3, 0) == "bars" and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        remote.with_retries(flaky, 2, 0)


def test_bars_come_from_the_store_the_source_or_the_fallback(spark, tmp_path):
    rows = [("X", "H1", datetime(2024, 1, 1) + timedelta(hours=k), 1.0, 2.0, 0.5, float(k), 1.0) for k in range(5)]
    bars = spark.createDataFrame(rows, bar_source.BAR_SCHEMA)
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 1, 3)
    ask = lambda *sources: bar_source.fetch_bars(spark, str(tmp_path), "X", "H1", start, end, *sources).count()
    with pytest.raises(ValueError):
        ask()
    assert ask(lambda s: bars.where("false"), lambda s: bars) == 4  # the source has none
    assert ask() == 4  # the store
    assert bar_source.fetch_bars(spark, str(tmp_path), "X", "H1", start, end, lambda s: bars.where("close < 2"), overwrite=True).count() == 2


def test_each_series_has_its_own_pip(spark):
    bars = spark.createDataFrame([("EURJPY", 1), ("EURUSD", 2), ("OTHER", 3)], "symbol string, n int")
    known = specs.build_specs(spark.createDataFrame([("EURJPY", None), ("EURUSD", 0.00001)], "symbol string, point double").withColumn("digits", F.lit(5)))
    got = {r["symbol"]: r["pip"] for r in specs.attach_specs(bars, known).select("symbol", specs.pip_of(specs.attach_specs(bars, known), 0.5).alias("pip")).collect()}
    assert got == {"EURJPY": 0.01, "EURUSD": pytest.approx(0.0001), "OTHER": 0.5}
    import pandas as pd

    assert execution.own_config(pd.DataFrame({"pip_size": [0.01], "tick_size": [None], "contract_size": [100.0]}), ExecutionConfig()).contract_size == 100.0


def test_ranks_of_folds_with_ties_and_bad_scores(spark):
    df = spark.createDataFrame([(1, "a", "0.5"), (2, "a", "x"), (3, "a", "0.5"), (4, None, "1"), (5, None, None)], "row_id long, fold string, score string")
    got = {r["row_id"]: r["rank_pct"] for r in ranking.rank_percent(df).collect()}
    assert got == {1: pytest.approx(1 / 3), 3: pytest.approx(2 / 3), 2: 1.0, 4: 0.5, 5: 1.0}



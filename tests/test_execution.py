"""Execution, statistics and training helpers on hand-made tables."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import analytics, dataset, execution, performance, ranking
from tidemark.plans.config import ExecutionConfig
from tidemark.sources import bars as bar_source
from tidemark.sources import runs, sinks, specs


def path(prices, **more):
    """Bars (high, low, close) with one long signal on the first bar: entry 100, stop 99."""
    n = len(prices)
    df = pd.DataFrame(prices, columns=["high", "low", "close"])
    base = {"symbol": "X", "timeframe": "H1", "bar": range(n), "fill_cost": 0.0, "atr": 1.0, "long_signal": [True] + [False] * (n - 1), "short_signal": False, "long_entry": 100.0, "long_stop": 99.0, "short_entry": None, "short_stop": None, "long_runner": None, "short_runner": None}
    return df.assign(**(base | more))


CFG = ExecutionConfig(slippage_pips=0.0, contract_size=100.0)


def simulated(rows, cfg=CFG):
    """Trades of bars in a pandas table, in order."""
    from pyspark.sql import SparkSession

    numbers = [c for c in rows.columns if c not in ("symbol", "timeframe", "bar", "long_signal", "short_signal")]
    schema = "symbol string, timeframe string, bar long, long_signal boolean, short_signal boolean, " + ", ".join(f"{c} double" for c in numbers)
    names = [c.split()[0] for c in schema.split(", ")]
    own = rows[names].astype(object).where(rows[names].notna(), None)
    table = SparkSession.getActiveSession().createDataFrame([tuple(float(v) if c in numbers and v is not None else v for c, v in zip(names, r, strict=True)) for r in own.itertuples(index=False)], schema)
    return execution.simulate(table, cfg).toPandas().sort_values(["symbol", "trade_no"]).reset_index(drop=True)


def one(rows, cfg=CFG):
    got = simulated(rows, cfg)
    assert len(got) == 1
    return got.iloc[0]


def test_stop_comes_before_target_on_one_bar(spark):
    t = one(path([(100.5, 99.9, 100), (103, 98.5, 101)], long_stop=99.0))
    assert (t.exit_type, t.outcome) == ("stop_before_2r", "Breakeven")  # 1R is reached first, so the stop has moved
    t = one(path([(100.5, 99.9, 100), (100.9, 98.5, 99)]))
    assert (t.exit_type, t.exit, t.outcome, t.pnl_r) == ("stop_before_2r", 99.0, "Loss", pytest.approx(-1))


def test_break_even_covers_commission(spark):
    t = one(path([(100, 100, 100), (101.2, 100.5, 101), (101, 99.9, 100)]), ExecutionConfig(slippage_pips=0.0, contract_size=100.0, commission_per_lot=7.0))
    assert (t.outcome, t.exit) == ("Breakeven", pytest.approx(100.07))
    assert t.pnl_cash == pytest.approx(0, abs=1e-9)


def test_target_without_runner_closes_in_two_parts(spark):
    t = one(path([(100, 100, 100), (102.5, 100.5, 102)]))
    assert (t.exit_type, t.partial_bar, t.runner_active, t.pnl_r) == ("close_rest_at_2r", 1, False, pytest.approx(2))
    t = one(path([(100, 100, 100), (102.5, 100.5, 102)]), ExecutionConfig(slippage_pips=0.0, contract_size=100.0, runner="none"))
    assert (t.exit_type, t.partial_bar is pd.NA or pd.isna(t.partial_bar)) == ("full_close_at_2r", True)


def test_runner_trails_and_stops_before_its_target(spark):
    rows = path([(100, 100, 100), (102.5, 100.5, 102.4), (103, 102.2, 102.9), (106, 101.5, 105)], long_runner=105.0)
    t = one(rows)
    assert (t.exit_type, t.runner_exit_reason, t.exit_bar) == ("runner_stop", "atr_trail_stop", 3)
    assert t.exit == pytest.approx(101.9)
    t = one(rows.assign(low=[100, 100.5, 102.2, 102.0]))
    assert (t.exit_type, t.exit) == ("runner_target", 105.0)


def test_end_of_data_closes_at_the_last_close(spark):
    t = one(path([(100, 100, 100), (100.5, 99.5, 100.4)]))
    assert (t.exit_type, t.exit, t.exit_bar) == ("end_of_data", 100.4, 1)


def test_shorts_mirror_longs(spark):
    prices = [(100, 100, 100), (102.5, 100.5, 102.4), (103, 102.2, 102.9), (106, 101.5, 105)]
    a = one(path(prices, long_runner=105.0))
    flipped = [(200 - lo, 200 - hi, 200 - c) for hi, lo, c in prices]
    b = one(path(flipped, long_signal=False, short_signal=[True, False, False, False], short_entry=100.0, short_stop=101.0, short_runner=95.0))
    assert (b.side, b.exit_type, b.pnl_r) == ("short", a.exit_type, pytest.approx(a.pnl_r))
    assert b.exit == pytest.approx(200 - a.exit)


def test_one_position_and_cooldown(spark):
    prices = [(100, 100, 100)] + [(100.2, 98.9, 100)] * 9
    every = path(prices, long_signal=True)
    assert simulated(every, CFG).entry_bar.tolist() == [0, 2, 4, 6, 8]
    assert simulated(every, ExecutionConfig(slippage_pips=0.0, contract_size=100.0, cooldown=2)).entry_bar.tolist() == [0, 4, 8]
    balance = simulated(every, CFG)
    assert balance.balance_after.iloc[-1] == pytest.approx(CFG.balance + balance.pnl_cash.sum())


def test_sizes_round_down_and_vanish():
    assert execution.lots_for(10_000, 0.01, 0.37, CFG) == 2.7
    assert execution.lots_for(10_000, 0.01, 1e6, CFG) == 0.0
    assert execution.lots_for(10_000, 0.01, 0.0, CFG) == 0.0


def test_size_zero_opens_nothing(spark):
    assert simulated(path([(100, 100, 100), (100, 98, 99)], long_stop=-1e9), CFG).empty


@pytest.fixture(scope="module")
def trades(spark):
    rows = [(k, "X", "H1", "Long", datetime(2024, 1, 1) + timedelta(days=k), k, c, c / 10, k % 2 == 0, k % 3 == 0, o) for k, (c, o) in enumerate([(10.0, "Win"), (-5.0, "Loss"), (0.0, "Breakeven"), (20.0, "Win"), (-30.0, "Loss"), (5.0, "Win"), (7.0, "Win"), (-1.0, "Loss")], 1)]
    return spark.createDataFrame(rows, "row_id long, symbol string, timeframe string, position string, trade_date timestamp_ntz, entry_bar long, pnl_cash double, pnl_r double, a_valid boolean, b_valid boolean, outcome string").persist()


def test_metrics(trades):
    m = performance.trading_metrics(trades).first()
    assert (m["trades"], m["pnl"], m["max_drawdown"], m["win_rate"]) == (8.0, 6.0, 30.0, 50.0)
    none = performance.trading_metrics(trades.where("false")).first()
    assert (none["trades"], none["profit_factor"], none["max_drawdown"]) == (0.0, 0.0, 0.0)
    assert performance.trading_metrics(trades.where("pnl_cash > 0")).first()["profit_factor"] == float("inf")
    assert performance.engine_summary(trades.where("pnl_cash > 0"), 100.0).first()["profit_factor"] == 0.0
    account = performance.account_info(trades, 100.0).first()
    assert (account["ending_balance"], account["max_drawdown"], account["initial_drawdown"]) == (106.0, 30.0, 5.0)


def test_moments_match_pandas(trades):
    r = pd.Series([x["pnl_cash"] / 100 for x in trades.collect()])
    m = performance.deflated_sharpe(trades, 100.0).first()
    assert m["skew"] == pytest.approx(r.skew()) and m["kurtosis"] == pytest.approx(r.kurt())
    assert m["deflated_sharpe_mode"] == "single_trial_psr_equivalent"
    assert performance.deflated_sharpe(trades.limit(1), 100.0).first()["deflated_sharpe_mode"] == "insufficient_observations"


def test_trials_raise_the_threshold(spark, trades):
    import math
    from statistics import NormalDist, variance

    from tidemark.functions.normal import normal_quantile_of

    p = [1e-9, 0.001, 0.2, 0.5, 0.5001, 0.9, 1 - 1e-7]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(normal_quantile_of(F.col("p"))).collect()
    assert [x[0] for x in got] == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-8)
    many = performance.deflated_sharpe(trades.withColumn("run", F.col("row_id") % 3), 100.0, trial=["run"]).first()
    rows = trades.collect()
    own = [[x["pnl_cash"] / 100 for x in rows if x["row_id"] % 3 == k] for k in range(3)]
    ratios = [sum(r) / len(r) / math.sqrt(variance(r)) for r in own]
    top = (1 - performance.EULER_GAMMA) * NormalDist().inv_cdf(1 - 1 / 3) + performance.EULER_GAMMA * NormalDist().inv_cdf(1 - 1 / (3 * math.e))
    assert many["deflated_sharpe_threshold"] == pytest.approx(math.sqrt(variance(ratios)) * top)
    assert (many["deflated_sharpe_trials"], many["deflated_sharpe_mode"]) == (3, "multiple_testing_adjusted")
    assert many["deflated_sharpe_ratio"] < performance.deflated_sharpe(trades, 100.0).first()["deflated_sharpe_ratio"]
    given = performance.deflated_sharpe(trades, 100.0, trials=3, variance=variance(ratios)).first()
    assert given["deflated_sharpe_ratio"] == pytest.approx(many["deflated_sharpe_ratio"])


def test_condition_tables(trades):
    t = analytics.outcome_groups(trades)
    impact = {r["confluence"]: r for r in analytics.condition_impact(t).collect()}
    assert (impact["a"]["trades_with"], impact["a"]["trades_without"]) == (4, 4)
    sets = {r["confluence_set"]: r for r in analytics.condition_sets(t).collect()}
    assert sets["a, b"]["trade_count"] == 1 and "" not in sets
    unknown = trades.withColumn("outcome", F.lit("odd"))
    assert {r["outcome_group"] for r in analytics.outcome_groups(unknown).collect()} == {"Win", "Loss", "Breakeven"}
    assert analytics.filter_trades(t, date_from="2024-01-03", date_to="2024-01-04", condition="a_valid", state="inactive").count() == 1


def test_folds():
    assert dataset.fold_bounds(20) == [(1, 14, 15, 16), (2, 16, 17, 18), (3, 18, 19, 20)]
    assert dataset.fold_bounds(6) == [(1, 4, 5, 6)]
    with pytest.raises(ValueError):
        dataset.fold_bounds(5)


def test_keep_ratios_and_ties(spark, trades):
    ratios = ranking.RankingConfig().ratios()
    assert len(ratios) == 14 and ratios[-1] == 0.9999999999999999
    scored = trades.withColumns({"fold": F.lit(1), "score": F.lit(0.5)})
    assert [r["row_id"] for r in ranking.top_fraction(scored, 0.35).orderBy("row_id").collect()] == [1, 2, 3]
    best = ranking.best_ratio(ranking.keep_ratio_sweep(scored, ranking.RankingConfig(min_trades=2))).first()
    assert best["pnl"] == max(r["pnl"] for r in ranking.keep_ratio_sweep(scored).where("eligible or trades >= 2").collect())


def test_candidates_equal_metrics_of_their_rows(spark, monkeypatch):
    """One pass over blocks against the metrics of the rows that each ratio keeps."""
    import random

    r = random.Random(8)
    monkeypatch.setattr(ranking, "BLOCK", 16)
    monkeypatch.setattr(ranking, "GROUP", 3)
    rows = [(k, k % 3, r.choice((None, float(r.randrange(-40, 50)))), r.randrange(-20, 30) / 8, r.randrange(40) / 4) for k in range(1, 400)]
    df = spark.createDataFrame(rows, "row_id long, fold int, pnl_cash double, pnl_r double, score double")
    got = {x["keep_ratio"]: x for x in ranking.keep_ratio_sweep(df).collect()}
    for ratio in (0.35, ranking.RankingConfig().ratios()[5], ranking.RankingConfig().ratios()[-1]):
        own = ranking.top_fraction(df, ratio)
        want = performance.trading_metrics(own).first()
        assert all(got[ratio][c] == pytest.approx(want[c]) for c in want.asDict())
        cuts = own.groupBy("fold").agg(F.min("score").alias("c")).agg(F.median("c")).first()[0]
        assert got[ratio]["cutoff_score"] == cuts


def test_enrichment_takes_the_fullest_report(trades):
    reports = trades.withColumn("report", F.lit("full")).unionByName(trades.where("row_id < 4").withColumn("report", F.lit("z_part")))
    got = dataset.enrich(trades.drop("pnl_cash"), reports, ["pnl_cash"])
    assert got.where("matched").count() == 8 and got.agg(F.sum("pnl_cash")).first()[0] == 6.0


def test_sources_and_sinks(spark, tmp_path, trades):
    raw = spark.createDataFrame([("EURUSD", "H1", 0, 1.0, 2.0, 0.5, 1.5, 3.0), ("EURUSD", "H1", 0, 1.0, 2.0, 0.5, 1.6, 3.0), ("EURUSD", "H1", 3600, 1.5, 2.0, 1.0, 1.7, 2.0)], "symbol string, timeframe string, time long, open double, high double, low double, close double, tick_volume double")
    bar_source.write_bars(bar_source.standardise(raw), str(tmp_path / "bars"))
    back = bar_source.read_bars(spark, str(tmp_path / "bars"), symbols=["EURUSD"])
    assert [(r["bar"], r["close"]) for r in back.orderBy("bar").collect()] == [(0, 1.5), (1, 1.7)]
    with pytest.raises(ValueError):
        bar_source.read_bars(spark, str(tmp_path / "bars"), symbols=["NONE"])
    name = runs.run_name("EURUSD", "M30", "2024-01-01", "2024-02-01", datetime(2024, 3, 1))
    parsed = runs.parse_runs(spark.createDataFrame([(name,), ("odd",)], "name string"))
    assert [r["symbol"] for r in parsed.orderBy("name").collect()] == ["EURUSD", None]
    wanted = spark.createDataFrame([("EURUSD",), ("GOLD",), ("NOPE",)], "symbol string")
    listed = spark.createDataFrame([("EURUSD.m",), ("EURUSD",), ("GOLD.spot",)], "name string")
    found = {r["symbol"]: r["broker_symbol"] for r in specs.resolve_symbols(wanted, listed).collect()}
    assert found == {"EURUSD": "EURUSD", "GOLD": "GOLD.spot", "NOPE": None}
    shown = sinks.display(spark.createDataFrame([(1.005, 12.345678, float("inf"))], "roi_pct double, other double, x double")).first()
    assert shown["other"] == 12.3457 and shown["x"] is None
    names = {"roi_pct": 2, "win_rate": 2, "profit_factor": 2, "avg_bars_in_trade": 2, "sharpe": 4, "expectancy_r": 4, "avg_win": 4}
    assert {n: sinks.places(n) for n in names} == names
    with pytest.raises(ValueError):
        sinks.save_dataset(trades.withColumn("label_positive", F.lit(None).cast("int")), str(tmp_path / "set"))


def test_streamed_bars(spark, tmp_path):
    from tidemark.streaming.bars import streaming_bars

    ticks = [(datetime(2024, 1, 1, 0, m), k, "X", p) for k, (m, p) in enumerate([(1, 5.0), (50, 7.0), (59, 6.0)])] + [(datetime(2024, 1, 1, 5, 0), 9, "X", 1.0)]
    spark.createDataFrame(ticks, "ts timestamp, id long, symbol string, price double").write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema("ts timestamp, id long, symbol string, price double").parquet(str(tmp_path / "ticks"))
    q = streaming_bars(stream, "ts", "price", "id", "symbol").writeStream.format("memory").queryName("bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select open, high, low, close, tick_volume from bars").collect()
    assert [tuple(r) for r in got] == [(5.0, 7.0, 5.0, 6.0, 3.0)]

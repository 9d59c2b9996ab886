"""Whole runs on small tables, the chunked source and the feature cache."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans.config import DEMO, DEMO_EXECUTION
from tidemark.plans.pipeline import DEFAULTS, build_features, cached_features
from tidemark.plans.workflows import run_simulation
from tidemark.sources.bars import event_bars, standardise, utc_time
from tidemark.sources.remote import ChunkedBars, chunked_bars, chunks, listed_symbols
from tidemark.sources.sinks import save_dataset
from tidemark.sources.specs import build_specs

SF = "/root/testdata/sf0.001"
LEAN = replace(DEMO, sessions=None, profile=None, gaps=None, retracement=None, pools=None, levels=None)


def fetch(symbol, timeframe, start, end):
    """Daily bars of a closed range."""
    day = start
    while day <= end:
        yield (day, 1.0, 2.0, 0.5, float(day.day), 1.0)
        day += timedelta(days=1)


def fetch_and_note(symbol, timeframe, start, end, log):
    with open(log, "a") as f:
        f.write(f"{symbol} {timeframe} {start}\n")
    return fetch(symbol, timeframe, start, end)


def test_chunks_cover_the_range_once(spark):
    got = chunks(datetime(2024, 1, 1), datetime(2024, 1, 10), 4)
    assert got[0][0] == datetime(2024, 1, 1) and got[-1][1] == datetime(2024, 1, 10) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    with pytest.raises(ValueError):
        chunks(datetime(2024, 1, 2), datetime(2024, 1, 1))
    spark.dataSource.register(ChunkedBars)
    options = {"fetcher": "tests.test_workflows:fetch", "symbol": "X", "timeframe": "D1", "start": "2024-01-01", "end": "2024-01-10", "chunk_days": "4"}
    df = standardise(spark.read.format("chunked_bars").options(**options).load())
    assert [r["close"] for r in df.orderBy("time").collect()] == [float(k) for k in range(1, 11)]


def test_disabled_layers_leave_defaults_and_the_cache_is_reused(spark, tmp_path):
    bars = event_bars(spark, SF, each_type=False)
    df = build_features(bars, LEAN)
    for layer in DEFAULTS.values():
        for names in layer.values():
            assert set(names) <= set(df.columns)
    assert df.where("Liquidity_Valid or session_name is not null").count() == 0
    first = cached_features(spark, bars, LEAN, str(tmp_path), "all")
    again = cached_features(spark, bars.where("false"), LEAN, str(tmp_path), "all")
    assert first.count() == again.count() > 0


def test_predicates_choose_the_chunks_that_are_fetched(spark, tmp_path):
    log = str(tmp_path / "calls")

    def calls(condition, symbol="X,Y,Z", start="2024-01-01", end="2024-01-31"):
        open(log, "w").close()
        df = chunked_bars(spark, "tests.test_workflows:fetch_and_note", symbol, ["D1", "H4"], start, end, chunk_days=10, arg_log=log).where(condition)
        rows = {(r["symbol"], r["timeframe"], r["time"]) for r in df.collect()}
        return rows, sorted(set(open(log).read().split("\n")) - {""})

    every, fetched = calls("true")
    assert len(fetched) == 18 and len(every) == 3 * 2 * 31
    for condition, most in (("symbol = 'Y'", 6), ("symbol IN ('X', 'Z') AND timeframe = 'D1'", 6), ("time >= timestamp'2024-01-25' AND symbol = 'X'", 2), ("time < timestamp'2024-01-05'", 6), ("time = timestamp'2024-01-15' AND timeframe = 'H4'", 3), ("symbol = 'none'", 0), ("time > timestamp'2025-01-01'", 0)):
        rows, fetched = calls(condition)
        want = {(r["symbol"], r["timeframe"], r["time"]) for r in spark.createDataFrame(list(every), "symbol string, timeframe string, time timestamp").where(condition).collect()}
        assert rows == want and len(fetched) == most, (condition, fetched)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_are_utc_in_any_session(spark, zone):
    texts = ["2024-03-10 02:30:00", "2024-03-10T04:30:00+02:00", "2024-03-09 21:30:00.000 -05:00", "2024-03-10T02:30:00Z", "2024-03-10", "2024-03-09 17:00:00-0700", "soon", None]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("s", F.lit(1710037800).cast("long"))
        rows = df.select("k", utc_time(df, "t").alias("t"), utc_time(df, "s").alias("s")).orderBy("k").collect()
        stamps = df.select(F.timestamp_seconds(F.col("s")).alias("x"))
        assert stamps.select(utc_time(stamps, "x")).first()[0] == datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    half, midnight = datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10)
    assert [r["t"] for r in rows] == [half, half, half, half, midnight, midnight, None, None]
    assert {r["s"] for r in rows} == {half}


def test_listed_symbols_become_specs(spark, tmp_path):
    spark.createDataFrame([("EURUSD", 5, 0.00001), ("USDJPY", 3, 0.001), ("GOLD", None, None)], "symbol string, digits int, point double").write.parquet(str(tmp_path / "listed"))
    listed = listed_symbols(spark, "tidemark.sources.remote:stored_symbols", arg_path=str(tmp_path / "listed"))
    assert sorted(r["symbol"] for r in listed.collect()) == ["EURUSD", "GOLD", "USDJPY"]
    own = build_specs(listed.where("symbol IN ('USDJPY', 'GOLD')")).collect()
    assert {r["symbol"]: r["digits"] for r in own}["USDJPY"] == 3 and len(own) == 2


def test_the_cache_is_kept_up_with_appended_bars(spark, tmp_path):
    """Old partitions and unchanged series stay as they are; the table equals a rebuild."""
    bars = event_bars(spark, SF).where("symbol IN ('view', 'click')").persist()
    first = bars.where("(symbol = 'view' AND time < '2024-01-10') OR symbol = 'click'")
    more = bars.unionByName(bars.where("symbol = 'view'").withColumn("time", F.expr("time + INTERVAL 31 DAYS")).withColumn("bar", F.col("bar") + 10_000))
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.rglob("features/**/*.parquet")}
    cached_features(spark, first, LEAN, str(tmp_path), "all")
    a = files()
    cached_features(spark, bars, LEAN, str(tmp_path), "all")
    b = files()
    got = cached_features(spark, more, LEAN, str(tmp_path), "all")
    c = files()
    click = {p for p in a if "tm_symbol=click" in str(p)}
    assert click and all(b[p] == a[p] and c[p] == a[p] for p in click)
    january = {p for p in b if "tm_symbol=view" in str(p) and "2024-01" in str(p)}
    assert january and not january & set(a) and all(c.get(p) == b[p] for p in january)
    assert any("2024-02" in str(p) for p in c)
    want = build_features(more, LEAN)
    names = sorted(want.columns)
    assert sorted(got.columns) == names and got.select(names).exceptAll(want.select(names)).isEmpty() and got.count() == want.count()
    # bars that are taken away go from the cache
    fewer = cached_features(spark, first, LEAN, str(tmp_path), "all")
    assert fewer.where("time >= '2024-01-10' AND symbol = 'view'").isEmpty() and fewer.count() == first.count()


def test_bad_training_tables_are_refused_and_leave_the_old_one(spark, tmp_path):
    path, scans = str(tmp_path / "set"), spark.sparkContext.accumulator(0)

    @F.udf("int")
    def watched(x):
        scans.add(1)
        return x

    good = spark.range(50, numPartitions=2).select("id", watched(F.col("id").cast("int")).alias("label_positive"))
    save_dataset(good, path)
    assert scans.value == 50  # counted and written in one pass
    for bad in (good.limit(0), good.withColumn("label_positive", F.lit(None).cast("int"))):
        with pytest.raises(ValueError):
            save_dataset(bad, path)
    assert spark.read.parquet(path).count() == 50 and [p.name for p in tmp_path.iterdir()] == ["set"]
    save_dataset(good.where("id < 7"), path)
    assert spark.read.parquet(path).count() == 7


def test_a_run_stores_its_artifacts(spark, tmp_path):
    run = run_simulation(event_bars(spark, SF, each_type=False), str(tmp_path / "run"), LEAN, replace(DEMO_EXECUTION, runner="none"))
    trades = run.trades.collect()
    assert all(a["exit_bar"] < b["entry_bar"] for a, b in zip(trades, trades[1:]))
    equity = run.equity.orderBy("seq").collect()
    assert equity[0]["equity"] == DEMO_EXECUTION.balance
    assert equity[-1]["equity"] == pytest.approx(DEMO_EXECUTION.balance + sum(t["pnl_cash"] for t in trades))
    for name in ("account_info", "trade_stats", "trades"):
        assert (tmp_path / "run" / name).exists()
    if trades:
        stored = spark.read.parquet(str(tmp_path / "run" / "dataset"))
        assert stored.count() == len(trades) and "exit_type" not in stored.columns
        assert stored.where(F.col("label_positive") == 1).count() == sum(t["pnl_cash"] > 0 for t in trades)

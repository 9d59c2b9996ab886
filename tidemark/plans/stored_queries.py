"""Queries over sources, sinks, stored runs and training tables. What they store goes to the shared folder and is read back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.functions.ordering import row_numbers
from tidemark.functions.tables import materialise, release
from tidemark.operators import analytics, classification, dataset, execution, model, performance, ranking, signals, zones
from tidemark.plans.catalogue import KEY, PIP, SETTINGS, _bars, _features, _folded, _predicted, _rounded, _trades
from tidemark.plans.config import DEMO_EXECUTION
from tidemark.plans.pipeline import DEFAULTS, build_features, cached_features
from tidemark.sources import bars as bar_source
from tidemark.sources import remote, runs, sinks, specs
from tidemark.sources.stores import new_folder, write_folders


def bars_stored(spark, sf_dir):
    """Bars stored by series and read back for two symbols and a closed range."""
    path = new_folder(spark, "bars")
    bar_source.write_bars(_bars(spark, sf_dir), path)
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 06:00:00", "2024-01-20 18:00:00"))
    return bar_source.read_bars(spark, path, symbols=["click", "view"], timeframes=["H1"], start=start, end=end).select("symbol", "bar", "time", "open", "close")


def bars_standardised(spark, sf_dir):
    """Bars from CSV texts: malformed times go, of equal times one row stays."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    minute = F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm:ss")
    raw = e.select(F.col("event_type").alias("symbol"), F.lit("M1").alias("timeframe"), F.when(F.col("event_id") % 50 == 0, "oops").otherwise(minute).alias("time"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("tick_volume"))
    path = new_folder(spark, "csv")
    sinks.write_csv(raw, path)
    return bar_source.standardise(spark.read.option("header", True).csv(path)).select("symbol", "time", "close")


def bars_zoned(spark, sf_dir):
    """Bars from CSV texts whose times have different zones or none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    minute, k = F.date_trunc("minute", "ts").cast("timestamp_ntz"), F.col("event_id") % 4
    text = lambda hours, zone: F.concat(F.date_format(minute + F.make_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))
    time = F.when(k == 0, text(0, "")).when(k == 1, text(2, "+02:00")).when(k == 2, text(-5, "-05:00")).otherwise(text(0, "Z"))
    raw = e.select(F.col("event_type").alias("symbol"), F.lit("M1").alias("timeframe"), time.alias("time"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("tick_volume"))
    path = new_folder(spark, "csv")
    sinks.write_csv(raw, path)
    return bar_source.standardise(spark.read.option("header", True).csv(path)).select("symbol", "time", "close")


def bars_chunked(spark, sf_dir):
    """Bars of one series fetched in chunks of a remote source, stored, and read again from the store."""
    store, path = new_folder(spark, "remote"), new_folder(spark, "fetched")
    _bars(spark, sf_dir).write.parquet(store)
    start, end = "2024-01-03 00:00:00", "2024-01-25 12:00:00"
    ask = lambda s: remote.chunked_bars(s, "tidemark.sources.remote:stored_bars", "purchase", "H1", start, end, chunk_days=5, arg_path=store)
    bounds = [F.lit(x).cast("timestamp_ntz") for x in (start, end)]
    bar_source.fetch_bars(spark, path, "purchase", "H1", start, end, ask)
    again = bar_source.fetch_bars(spark, path, "purchase", "H1", start, end)  # no source: from the store
    return bar_source.clip(again, *bounds).select("symbol", "timeframe", "bar", "time", "open", "high", "low", "close", "tick_volume")


def bars_fetched(spark, sf_dir):
    """Bars of all series from a remote source, of which predicates choose the series and chunks to fetch."""
    store = new_folder(spark, "remote")
    _bars(spark, sf_dir).write.parquet(store)
    found = remote.chunked_bars(spark, "tidemark.sources.remote:stored_bars", ["click", "error", "purchase", "signup", "view"], "H1", "2024-01-01 00:00:00", "2024-01-31 00:00:00", chunk_days=5, arg_path=store)
    asked = found.where("symbol IN ('view', 'error', 'none') AND time >= timestamp'2024-01-12 03:00:00' AND time < timestamp'2024-01-21 00:00:00'")
    return bar_source.standardise(asked).select("symbol", "timeframe", "time", "open", "high", "low", "close", "tick_volume")


def symbols_listed(spark, sf_dir):
    """Symbols that a source lists with their metadata, as specs."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "USDJPY").when(k % 3 == 1, "XAUUSD").otherwise("EURUSD"), F.lit("."), k)
    raw = spark.read.parquet(f"{sf_dir}/part.parquet").select(name.alias("symbol"), F.when(k % 5 != 0, (k % 6).cast("int")).alias("digits"), F.when(k % 4 != 0, F.lit(0.001)).alias("point"), F.lit(0.25).alias("tick_size"), F.lit(100.0).alias("contract_size"))
    path = new_folder(spark, "listed")
    raw.write.parquet(path)
    listed = remote.listed_symbols(spark, "tidemark.sources.remote:stored_symbols", arg_path=path).where("contract_size = 100")
    return listed.select("symbol", "digits", "point", "tick_size", "contract_size", F.col("volume_min").isNull().alias("unknown"))


def features_cached(spark, sf_dir):
    """Validity of all layers and the signals from a cache that was made from the first half of the bars and kept up with all of them."""
    bars, folder = materialise(_bars(spark, sf_dir)), new_folder(spark, "features")
    middle = bars.agg(F.timestamp_seconds((F.min(F.unix_seconds(F.col("time").cast("timestamp"))) + F.max(F.unix_seconds(F.col("time").cast("timestamp")))) / 2).alias("m")).first()["m"]
    cached_features(spark, bars.where(F.col("time") < F.lit(middle).cast("timestamp_ntz")), SETTINGS, folder, "H1")
    kept = signals.add_signals(cached_features(spark, bars, SETTINGS, folder, "H1"))
    layers = ("session_liquidity", "volume_profile", "imbalance", "fibonacci", "liquidity", "support_resistance", "market_structure", "supply_demand")
    return kept.select(*KEY, *[f"{n}_{s}_valid" for n in layers for s in ("long", "short")], "long_signal", "short_signal")


def cache_covers(spark, sf_dir):
    """Whether stored bars lie inside a requested range."""
    return bar_source.covers(_bars(spark, sf_dir), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-30 22:00:00").cast("timestamp_ntz")).drop("timeframe")


def date_ranges(spark, sf_dir):
    """Requested days moved into the range of each series."""
    known = materialise(bar_source.coverage(_bars(spark, sf_dir)))
    out = None
    for k, (a, b) in enumerate((("2023-11-01", "2024-01-10"), ("2024-01-12", "2024-03-01"), ("2025-01-01", "2025-02-01"), ("2020-01-01", "2020-02-01"), ("2024-01-09", "2024-01-09"))):
        one = bar_source.clamped_dates(known, a, b).select("symbol", F.lit(k).alias("request"), "start", "end")
        out = one if out is None else out.unionByName(one)
    return out


def unordered_times(spark, sf_dir):
    """Ticks whose time lies before that of the previous value in the order of values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.struct("value", "event_id"))
    return S.unordered(e, "ts", "at", ("event_type",)).groupBy("event_type").agg(F.count("*").alias("rows"))


def symbols_resolved(spark, sf_dir):
    """Catalogue names for wanted symbols."""
    wanted = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.element_at(F.split("p_name", " "), -1).alias("symbol")).unionByName(spark.createDataFrame([(" red ",), ("small ring",), ("none",)], "symbol string"))
    listed = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    return specs.resolve_symbols(wanted, listed)


def symbols_tradable(spark, sf_dir):
    """Currency pairs and metals among names of many forms."""
    k = F.col("p_partkey")
    made = ("EURUSD.m", "XAUUSDpro", "US500", "gbpjpy", "SILVERx", "Gold.spot", "USDCAD_i", "BTCUSD")
    name = F.get(F.array(*map(F.lit, made)), (k % 8).cast("int"))
    return specs.tradable(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(name, F.when(k % 3 == 0, "").otherwise("2")).alias("name")), ["GBPJPY"])


def zones_by_spec(spark, sf_dir):
    """Zone candidates with the pip size of each symbol's spec."""
    raw = spark.createDataFrame([("error", 20.0), ("view", 30.0), ("click", None)], "symbol string, point double")
    bars = specs.attach_specs(zones.with_zone_inputs(_bars(spark, sf_dir)), specs.build_specs(raw.withColumn("digits", F.lit(2))).where("source = 'broker'"))
    out = zones.zone_candidates(bars, specs.pip_of(bars, PIP)).select("symbol", "side", "created", "pivot_bar", "entry", "stop", "width_pips", "stop_pips")
    return _rounded(out, "stop", "width_pips", "stop_pips")


def training_rows(spark, sf_dir):
    """Stored data sets of two series groups loaded as one numbered table."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = F.when(F.col("l_linenumber") % 2 == 0, " long").otherwise("Short ")
    t = raw.groupBy(F.concat(F.lit(" "), F.lower("l_returnflag")).alias("symbol"), F.lower("l_linestatus").alias("timeframe"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("trade_date"), F.col("l_orderkey").cast("string").alias("entry_bar"), side.alias("position")).agg(F.sum("l_quantity").alias("q"), F.max("l_partkey").alias("p"), F.max("l_extendedprice").alias("carried"))
    t = t.withColumns({"pnl_cash": F.when(F.col("p") % 100 == 0, "n/a").otherwise(F.col("q").cast("string")), "label_positive": F.when(F.col("p") % 7 != 0, F.when(F.col("q") > 25, "1").otherwise("0"))}).drop("q", "p")
    path = new_folder(spark, "sets")
    t.where("symbol = ' a'").write.parquet(f"{path}/first")
    t.where("symbol <> ' a'").write.parquet(f"{path}/second")
    out = dataset.load_training_data(spark, f"{path}/*")
    return out.select("row_id", "symbol", "timeframe", "trade_date", "entry_bar", "position", "label_positive")


def safe_rows(spark, sf_dir):
    """The leakage-free projection of a trade report."""
    t = _trades(spark, sf_dir, False).select("symbol", "timeframe", "trade_date", "entry_bar", "position", "session_valid", "pnl_cash", "outcome", F.when(F.col("pnl_r") > 2, float("inf")).when(F.col("pnl_r") < -2, float("nan")).otherwise(F.col("pnl_r")).alias("risk"), F.col("score").alias("exit_price"), F.lit(1).alias("label_positive"), F.lit(0).alias("label_hit_target"), F.lit(0).alias("label_runner"))
    return dataset.safe_frame(t)


def normalised_trades(spark, sf_dir):
    """A trade table of texts with its times, numbers and flags coerced."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_partkey") + F.col("l_linenumber")
    words = F.array(*map(F.lit, ("TRUE", " yes", "1", "0", "no", "maybe", "")))
    t = raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(k % 9 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("trade_date"), F.when(k % 5 == 0, "?").otherwise(F.col("l_quantity").cast("string")).alias("pnl_cash"), F.lit(None).cast("string").alias("pnl_r"),
        F.get(words, (k % 8).cast("int")).alias("gap_valid"), F.get(words, (k % 7).cast("int")).alias("runner_active"), (F.col("l_quantity") / 4).cast("string").alias("lots"),
    )
    return analytics.normalise(t).withColumn("lots", S.optional_int(F.col("lots"))).groupBy("gap_valid", "runner_active", "outcome_group", "lots").agg(F.count("*").alias("rows"), F.sum("pnl_cash").alias("pnl"), F.count("trade_date").alias("dated"), F.max("trade_date").alias("last"))


def trade_details(spark, sf_dir):
    """Fields of single trades in named sections, flattened to dotted names."""
    sections = {"result": ["pnl_cash", "pnl_r", "unknown"], "conditions": ["session_valid", "gap_valid"], "none": ["nothing"]}
    rows = analytics.detail_sections(_trades(spark, sf_dir), sections)
    return sinks.flattened(rows.select("row_id", "result", "conditions"))


def equity_rebuilt(spark, sf_dir):
    """Equity curves of a trade table with some stored balances, and of one without any."""
    t = _trades(spark, sf_dir)
    known = t.withColumn("balance_after", F.when(F.col("row_id") % 3 == 0, F.col("row_id") * 1.5)).where("row_id > 2")
    a = performance.rebuilt_equity(known, 10_000.0, ["row_id"]).withColumn("stored", F.lit(True))
    return a.unionByName(performance.rebuilt_equity(t, 10_000.0, ["row_id"]).withColumn("stored", F.lit(False)))


def run_stats(spark, sf_dir):
    """Statistics of a run stored for display and read back, with their rounding."""
    t = _trades(spark, sf_dir).withColumnRenamed("row_id", "trade_no")
    folder = new_folder(spark, "run")
    stats = performance.trade_stats(t, 10_000.0, ["symbol"]).withColumn("undefined", F.lit(float("nan")))
    sinks.save_run(folder, t, stats, t.groupBy("symbol").agg(F.sum("pnl_cash").alias("balance")))
    return runs.load_bundle(spark, folder, runs.SIMULATION)["trade_stats"].select("symbol", "trades", "net_pnl", "roi_pct", "avg_win", "avg_loss", "avg_rr_per_trade")


def run_trades_stored(spark, sf_dir):
    """Trades of a stored run, read back and normalised; a missing table of it is empty."""
    t = _trades(spark, sf_dir).withColumnRenamed("row_id", "trade_no")
    folder = new_folder(spark, "run")
    sinks.save_run(folder, t, t.agg(F.count("*").alias("n")), t.agg(F.sum("pnl_cash").alias("balance")))
    back = runs.load_bundle(spark, folder, runs.SIMULATION | {"missing": "csv"})
    none = back["missing"].agg(F.count("*").alias("missing_rows"))
    return back["trades"].groupBy("symbol", "gap_valid", "outcome_group").agg(F.count("*").alias("rows"), F.sum("pnl_cash").alias("pnl"), F.max("trade_date").alias("last")).crossJoin(F.broadcast(none))


def trade_log(spark, sf_dir):
    """The raw log of the simulated trades."""
    f = _features(spark, sf_dir)
    trades = materialise(execution.run_trades(f, DEMO_EXECUTION))
    log = sinks.trade_log(execution.trade_report(trades, f, DEMO_EXECUTION))
    return _rounded(log, *[c for c, kind in log.dtypes if kind == "double"])


def trade_report(spark, sf_dir):
    """The simulated trades with their entry-time conditions, costs and labels."""
    f = _features(spark, sf_dir)
    trades = materialise(execution.run_trades(f, DEMO_EXECUTION))
    more = ["trade_date", "exit_time", "session_name", "confluence_count", "duration_bars", "risk_pips", "entry_spread_pips", "entry_slippage_pips", "exit_spread_pips", "exit_slippage_pips", "exit_session_factor", "exit_volatility_factor", "sr_reference_level", "sr_target_rr", "label_positive", "label_hit_target", "label_runner"]
    layers = ("session_liquidity", "volume_profile", "imbalance", "fibonacci", "liquidity", "support_resistance", "market_structure", "supply_demand")
    out = execution.trade_report(trades, f, DEMO_EXECUTION).select(*trades.columns, *more, *[f"{n}_valid" for n in layers])
    return _rounded(out, *[c for c, kind in out.dtypes if kind == "double" and not c.startswith("exit_") or c in ("exit_spread_pips", "exit_slippage_pips")])


def deflated_sharpe_trials(spark, sf_dir):
    """Deflated Sharpe ratios of all trades of a symbol, whose years are its trials."""
    t = _trades(spark, sf_dir, False).withColumn("year", F.year("trade_date"))
    m = performance.deflated_sharpe(t, 10_000.0, ["symbol"], trial=["year"])
    return _rounded(m, "sharpe", "deflated_sharpe_ratio", "deflated_sharpe_threshold").select("symbol", "sharpe", "deflated_sharpe_ratio", "deflated_sharpe_threshold", "deflated_sharpe_trials", "deflated_sharpe_mode")


def _traded(spark, sf_dir, runner):
    out = execution.run_trades(_features(spark, sf_dir), replace(DEMO_EXECUTION, runner=runner))
    return _rounded(out, *[c for c, kind in out.dtypes if kind == "double"])


def trades_without_runner(spark, sf_dir):
    """Simulated trades that close at their target."""
    return _traded(spark, sf_dir, "none")


def trades_with_fixed_stop(spark, sf_dir):
    """Simulated trades whose runners keep their stop."""
    return _traded(spark, sf_dir, "sr_only")


def streamed_sweeps(spark, sf_dir):
    """Session sweeps of a stream of bars with zones, in three runs that restart from one checkpoint; bars that the watermark hasn't passed are missing."""
    from tidemark.streaming.sessions import streaming_sessions

    source, out = new_folder(spark, "bars"), new_folder(spark, "swept")
    bars = materialise(zones.add_zones(_bars(spark, sf_dir), PIP).select(*S.KEYS, F.col("time").cast("timestamp").alias("time"), "high", "low", "close", "sd_demand_valid", "sd_supply_valid"))
    first, last = bars.agg(F.min(F.unix_seconds("time")), F.max(F.unix_seconds("time"))).first()
    third = F.floor((F.unix_seconds("time") - first) * 3 / (last - first + 1))
    for k in range(3):
        bars.where(third == k).write.mode("append").parquet(f"{source}/bars")
        made = streaming_sessions(spark.readStream.schema(bars.schema).parquet(f"{source}/bars"), SETTINGS.sessions, "90 minutes")
        made.writeStream.format("parquet").option("path", f"{out}/bars").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/bars").select(*KEY, "session_low_swept", "session_high_swept", "session_liquidity_long_valid", "session_liquidity_short_valid", "Session_Liquidity_Valid")


def layer_flags(spark, sf_dir):
    """Validity of all layers and the signals, from the whole feature pipeline."""
    layers = ("session_liquidity", "volume_profile", "imbalance", "fibonacci", "liquidity", "support_resistance", "market_structure", "supply_demand")
    return _features(spark, sf_dir).select(*KEY, *[f"{n}_{s}_valid" for n in layers for s in ("long", "short")], "long_signal", "short_signal")


def lean_features(spark, sf_dir):
    """The pipeline with all optional layers off: their columns are false or null."""
    df = build_features(_bars(spark, sf_dir), replace(SETTINGS, sessions=None, profile=None, gaps=None, retracement=None, pools=None, levels=None))
    flags = [n for layer in DEFAULTS.values() for n in layer["boolean"]]
    rest = [n for layer in DEFAULTS.values() for kind in ("double", "string") for n in layer.get(kind, [])]
    return df.groupBy("symbol").agg(F.count("*").alias("bars"), F.sum(sum((F.col(n).cast("int") for n in flags), F.lit(0))).alias("flags"), F.sum(sum((F.col(n).isNotNull().cast("int") for n in rest), F.lit(0))).alias("known"))


def dataset_summaries(spark, sf_dir):
    """Stored training tables with their rows and dates; a table without labels isn't stored."""
    t = _trades(spark, sf_dir).withColumn("label_positive", F.col("label"))
    folder = new_folder(spark, "sets")
    for symbol in ("A", "N", "R"):
        sinks.save_dataset(t.where(F.col("symbol") == symbol), f"{folder}/{symbol}_X1")
    back = spark.read.parquet(f"{folder}/*").withColumn("dataset", F.element_at(F.split("_metadata.file_path", "/"), -2))
    return runs.dataset_summary(back).drop("timeframe")  # the first of several


def runs_deleted(spark, sf_dir):
    """Runs and data sets that are left when runs over odd numbers of orders, and all of one status, were deleted."""
    root, sets = new_folder(spark, "runs"), new_folder(spark, "sets")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    series = [F.concat(F.lit("SYM"), F.col("o_orderstatus")).alias("symbol"), F.concat(F.lit("H"), F.col("o_custkey") % 3).alias("timeframe")]
    yearly = o.groupBy(*series, F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("last"))
    day = lambda x: F.concat(F.col("year"), F.lit(x))
    named = materialise(yearly.withColumn("name", F.concat_ws("_", "symbol", "timeframe", day("0101"), day("1231"), F.concat(F.date_format("last", "yyyyMMdd"), F.lit("T"), F.lpad(F.col("orders").cast("string"), 6, "0"), F.lit("Z")))))
    write_folders(named, root, "name")
    write_folders(named.withColumn("dataset", F.concat_ws("_", "symbol", "timeframe")), sets, "dataset")
    runs.delete_runs(spark, root, named.where("orders % 2 = 1 OR symbol = 'SYMP'"), sets)
    left = [runs.list_runs(spark, p).select(F.lit(kind).alias("kind"), "name") for kind, p in (("run", root), ("dataset", sets))]
    return left[0].unionByName(left[1])


def orphaned_datasets(spark, sf_dir):
    """Data sets of series that no open order refers to."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws("_", "p_brand", "p_type").alias("dataset")).distinct()
    used = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 10").select(F.concat_ws("_", "p_brand", "p_type").alias("dataset"))
    return runs.orphaned_datasets(part, used)


def encoded_features(spark, sf_dir):
    """Sums of the encoded features, by an encoder that was fitted on part of the rows."""
    t = _trades(spark, sf_dir).select("symbol", "timeframe", "position", F.when(F.col("row_id") % 4 != 0, F.col("l_discount")).alias("l_discount"), "gap_valid", "pnl_cash", F.when(F.col("symbol") == "R", F.col("l_tax")).alias("l_tax"), F.col("label").alias("label_positive"))
    pipe, numeric = model.encoder(t.where("symbol <> 'R'"), "label_positive")
    encoded = pipe.fit(model.prepared(t.where("symbol <> 'R'"), numeric)).transform(model.prepared(t, numeric))
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(n) for n in model.feature_names(encoded)])
    cells = encoded.select(F.posexplode(vector_to_array("features")).alias("at", "value"))
    sums = cells.groupBy("at").agg(F.sum("value").alias("total"))
    return sums.select(F.get(names, F.col("at")).alias("feature"), F.round("total", 4).alias("total"))


def selection_effect(spark, sf_dir):
    """Results of all and of the selected trades of stored predictions."""
    df = model.prediction_metrics(_predicted(spark, sf_dir), ["timeframe"])
    names = [f"{kind}_{c}" for kind in ("baseline", "filtered") for c in ("pnl", "expectancy_r", "win_rate", "profit_factor")]
    return _rounded(df.select("timeframe", "rows", "kept", "folds", *names), *names)


def _run_predictions(spark, sf_dir, held):
    """Predictions of all trades; ``held`` takes the stored table that they are read from."""
    own = []
    trades = _trades(spark, sf_dir, kept=["symbol", "timeframe", "label", "score"], held=own)
    ranked = ranking.ranked_and_flagged(trades, 0.35, ["row_id", "symbol", "timeframe", "label"], held, group="symbol")
    release(own[0])
    return ranked.select(F.col("symbol").alias("run"), F.when(F.col("timeframe") == "F", "test").otherwise("validation").alias("split"), "label", "selected", (1.0 - F.col("rank_pct")).alias("ranking_score"), "row_id")


def classification_runs(spark, sf_dir):
    """Classification metrics of each run and split, and pooled over runs with their means."""
    held = []
    per_run, pooled = classification.run_metrics(_run_predictions(spark, sf_dir, held))
    release(held[0])
    out = per_run.unionByName(pooled, allowMissingColumns=True)
    names = [c for c, kind in out.dtypes if kind == "double"]
    return _rounded(out.drop("mean_accuracy"), *[n for n in names if n != "mean_accuracy"])


def keep_ratio_choice(spark, sf_dir):
    """The ratio that the sweep chooses."""
    best = ranking.best_ratio(ranking.keep_ratio_sweep(_folded(spark, sf_dir)))
    return best.select(F.round("keep_ratio", 6).alias("keep_ratio"), "trades", "pnl", F.round("max_drawdown_r", 4).alias("max_drawdown_r"), F.round("objective_score", 4).alias("objective_score"), "eligible")


def streamed_bars(spark, sf_dir):
    """Hourly bars of the event table read as a stream; bars that the watermark hasn't closed are missing."""
    from tidemark.streaming.bars import streaming_bars

    source, out = new_folder(spark, "ticks"), new_folder(spark, "streamed")
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    ticks.write.parquet(source)
    stream = spark.readStream.schema(ticks.schema).parquet(source)
    made = streaming_bars(stream, "ts", "value", "event_id", "event_type")
    query = made.writeStream.format("parquet").option("path", f"{out}/bars").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/bars").select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "tick_volume")


def latest_rows(spark, sf_dir):
    """The last row of each series by date and number."""
    t = _trades(spark, sf_dir)
    return dataset.latest_by(t, "symbol", "row_id").select("symbol", "row_id", "pnl_cash")


def rows_in_blocks(spark, sf_dir):
    """Row numbers of each series by falling price, with columns that take no part in the order."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(6)
    out = row_numbers(raw, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax"], "place", ["l_returnflag"], "of")
    return out.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count_distinct("place").alias("places"), F.max("place").alias("last"), F.max("of").alias("of"), F.round(F.sum(F.when(F.col("place") <= 100, F.col("l_extendedprice"))), 2).alias("top"))


_ALL = (
    bars_zoned, bars_fetched, symbols_listed, features_cached, bars_stored, bars_standardised, bars_chunked, cache_covers, date_ranges, unordered_times, symbols_resolved, symbols_tradable, zones_by_spec, training_rows, safe_rows, normalised_trades, trade_details, equity_rebuilt, run_stats, run_trades_stored, trade_log, trade_report,
    layer_flags, lean_features, dataset_summaries, runs_deleted, orphaned_datasets, encoded_features, selection_effect, classification_runs, keep_ratio_choice, streamed_bars, latest_rows, rows_in_blocks, deflated_sharpe_trials, trades_without_runner, trades_with_fixed_stop, streamed_sweeps,
)


def queries() -> dict:
    """All queries of this module by name."""
    return {f.__name__: f for f in _ALL}

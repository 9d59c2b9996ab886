"""Queries over the tables of the test data, one for each operator family."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.functions.ordering import max_drawdowns, row_numbers, with_running
from tidemark.functions.tables import materialise
from tidemark.operators import analytics, classification, dataset, execution, gaps, levels, performance, pools, ranking, retracement, sessions, signals, structure, zones
from tidemark.plans import oracle, oracle_states
from tidemark.plans.config import DEMO, DEMO_EXECUTION, FeatureConfig
from tidemark.plans.pipeline import build_features
from tidemark.sources import bars as bar_source
from tidemark.sources import runs, specs

#: The settings that all bar queries share; the simple ATR keeps their SQL twins free of recursion.
SETTINGS: FeatureConfig = replace(DEMO, atr_method="sma")
PIP = SETTINGS.pip
#: Trees of the registered query; the filter's default is 400.
GBT_TREES = 10


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_source.event_bars(spark, sf_dir)


def _structure(spark, sf_dir) -> DataFrame:
    return structure.add_structure(_bars(spark, sf_dir))


def _zone_inputs(spark, sf_dir) -> DataFrame:
    return zones.with_zone_inputs(_bars(spark, sf_dir))


def _zoned(spark, sf_dir) -> DataFrame:
    return materialise(zones.add_zones(_bars(spark, sf_dir), PIP))


def _trades(spark: SparkSession, sf_dir: str, numbered: bool = True, kept: list[str] | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """The order lines as a trade table, numbered in a total order where that is asked for; ``kept`` names its columns of a long table that go on."""
    order = ["l_shipdate", "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(order)
    cash = (F.col("l_quantity") - 25) * 10
    flag = lambda c, n: F.col(c) % n == 0
    cols = {
        "symbol": F.col("l_returnflag"), "timeframe": F.col("l_linestatus"), "position": F.when(F.col("l_linenumber") % 2 == 0, "Long").otherwise("Short"),
        "trade_date": F.col("l_shipdate"), "entry_bar": F.col("l_orderkey"), "pnl_cash": cash, "pnl_r": (F.col("l_quantity") - 25) / 10,
        "session_valid": flag("l_partkey", 2), "profile_valid": flag("l_suppkey", 2), "gap_valid": flag("l_partkey", 3), "fib_valid": flag("l_suppkey", 3), "pool_valid": flag("l_partkey", 5), "level_valid": flag("l_suppkey", 5),
        "label": (cash > 0).cast("int"), "score": F.col("l_extendedprice"),
    }
    if kept:
        return row_numbers(raw, order, kept=[n if n in order else cols[n].alias(n) for n in kept], held=held)
    rows = row_numbers(raw, order) if numbered else raw
    out = rows.select(*(["row_id"] if numbered else []), "l_discount", "l_tax", *[c.alias(n) for n, c in cols.items()])
    return out.withColumn("outcome", F.when(F.col("pnl_cash") > 0, "Win").when(F.col("pnl_cash") < 0, "Loss").otherwise("Breakeven"))


FLAGS = ["session_valid", "profile_valid", "gap_valid", "fib_valid", "pool_valid", "level_valid"]
KEY = ["symbol", "bar"]


def bars_h1(spark, sf_dir):
    """Hourly bars of every event type."""
    return _bars(spark, sf_dir).drop("timeframe")


def bar_coverage(spark, sf_dir):
    """Range and number of bars of each series."""
    return bar_source.coverage(_bars(spark, sf_dir)).drop("timeframe")


def bars_latest(spark, sf_dir):
    """The last hundred bars of each series."""
    return bar_source.latest(_bars(spark, sf_dir), 100).select("symbol", "time", "close")


def true_range(spark, sf_dir):
    return _rounded(_bars(spark, sf_dir).select(*KEY, S.true_range().alias("tr")), "tr")


def atr_sma(spark, sf_dir):
    return _rounded(S.add_atr(_bars(spark, sf_dir), 14, "sma").select(*KEY, "atr_feature"), "atr_feature")


def atr_rma(spark, sf_dir):
    return _rounded(S.add_atr(_bars(spark, sf_dir), 14, "rma").select(*KEY, "atr_feature"), "atr_feature")


def atr_ema(spark, sf_dir):
    return _rounded(S.add_atr(_bars(spark, sf_dir), 14, "ema").select(*KEY, "atr_feature"), "atr_feature")


def pivots(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return b.select(*KEY, *[S.confirmed_pivot(c, n, n, c == "high").alias(f"pivot_{c}_{n}") for n in (3, 8) for c in ("high", "low")])


def swing_labels(spark, sf_dir):
    return _structure(spark, sf_dir).select(*KEY, "ext_swing_high", "ext_swing_low", "ext_high_label", "ext_low_label", "int_high_label", "int_low_label", "ext_structure_high", "ext_structure_low")


def trend_state(spark, sf_dir):
    return _structure(spark, sf_dir).select(*KEY, F.col("trend_state").cast("int").alias("trend_state"), "bullish_bias", "bearish_bias")


def structure_breaks(spark, sf_dir):
    return _structure(spark, sf_dir).select(*KEY, "bos_up", "bos_down", "choch_up", "choch_down", "mss_up", "mss_down", "sweep_high", "sweep_low", "last_broken_high", "last_broken_low")


def last_opposing(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return b.select(*KEY, F.coalesce(S.last_bar(F.col("close") < F.col("open")), F.lit(-1)).alias("last_bearish"), F.coalesce(S.last_bar(F.col("close") > F.col("open")), F.lit(-1)).alias("last_bullish"))


def departures(spark, sf_dir):
    return _zone_inputs(spark, sf_dir).select(*KEY, "bull_departure", "bear_departure", "pivot_high", "pivot_low")


def _zone_columns(df, *more):
    return _rounded(df.select("symbol", "side", "created", "pivot_bar", "base_start", "base_end", "departure", "top", "bottom", "entry", "stop", "width_pips", "stop_pips", *more), "stop", "width_pips", "stop_pips")


def zone_candidates(spark, sf_dir):
    return _zone_columns(zones.zone_candidates(_zone_inputs(spark, sf_dir), PIP))


def zones_accepted(spark, sf_dir):
    found = zones.accepted_zones(zones.zone_candidates(_zone_inputs(spark, sf_dir), PIP))
    return _zone_columns(found, "zone_id")


def zone_lifecycle(spark, sf_dir):
    df = _zone_inputs(spark, sf_dir)
    life = zones.zone_lifecycle(df, zones.accepted_zones(zones.zone_candidates(df, PIP)))
    return life.where("alive").select("symbol", "side", "zone_id", "bar", "age", "retests", "touched")


def nearest_zone(spark, sf_dir):
    z = _zoned(spark, sf_dir)
    cols = [f"{s}_zone_{c}" for s in ("demand", "supply") for c in ("entry", "retests", "age")]
    return z.select(*KEY, *cols, "sd_demand_valid", "sd_supply_valid", "sd_demand_touched", "sd_supply_touched", "long_entry_signal", "short_entry_signal")


def session_blocks(spark, sf_dir):
    return sessions.session_levels(sessions.with_blocks(_bars(spark, sf_dir), SETTINGS.sessions.sessions)).drop("timeframe")


def session_levels(spark, sf_dir):
    df = sessions.add_sessions(_bars(spark, sf_dir), SETTINGS.sessions)
    return df.select(*KEY, "session_name", *[f"prev_{s}_{e}" for s in ("asia", "london", "newyork") for e in ("high", "low")])


def session_sweeps(spark, sf_dir):
    df = sessions.add_sessions(_zoned(spark, sf_dir), SETTINGS.sessions)
    return df.select(*KEY, "session_low_swept", "session_high_swept", "session_liquidity_long_valid", "session_liquidity_short_valid", "Session_Liquidity_Valid")


def volume_profile_poc(spark, sf_dir):
    df = sessions.add_profile(_zoned(spark, sf_dir), SETTINGS.profile)
    return df.select(*KEY, "vp_session_name", "vp_reference_session_name", "vp_reference_poc", "volume_profile_long_valid", "volume_profile_short_valid")


def fvg_gaps(spark, sf_dir):
    return gaps.detect_gaps(_bars(spark, sf_dir)).select(*KEY, "bullish_imbalance_created", "bearish_imbalance_created", "bullish_imbalance_zone_low", "bullish_imbalance_zone_high", "bearish_imbalance_zone_low", "bearish_imbalance_zone_high")


def fvg_fill(spark, sf_dir):
    df = gaps.add_gaps(_zoned(spark, sf_dir), SETTINGS.gaps)
    return df.select(*KEY, *[c for kind, side in (("bullish", "long"), ("bearish", "short")) for c in (f"{kind}_imbalance_filled", f"active_{kind}_imbalance_low", f"active_{kind}_imbalance_high", f"imbalance_{side}_valid")], "Imbalance_Valid")


def fib_legs(spark, sf_dir):
    df = retracement.add_retracement(_structure(spark, sf_dir))
    return _rounded(df.select(*KEY, "fib_bull_impulse_low", "fib_bull_impulse_high", "fib_bear_impulse_low", "fib_bear_impulse_high", "fib_long_band_high", "fib_short_band_low"), "fib_long_band_high", "fib_short_band_low")


def fib_valid(spark, sf_dir):
    """Validity of the retracement bands against the zones."""
    df = retracement.add_retracement(zones.add_zones(_structure(spark, sf_dir).drop("atr"), PIP))
    return df.select(*KEY, "fibonacci_long_valid", "fibonacci_short_valid", "Fibonacci_Valid")


def _leveled(spark, sf_dir):
    return levels.add_levels(_zoned(spark, sf_dir), SETTINGS.levels, "atr")


def sr_levels(spark, sf_dir):
    out = _leveled(spark, sf_dir).select(*KEY, "sr_pivot_high", "sr_pivot_low", "sr_nearest_resistance", "sr_nearest_support")
    return out.withColumns({c: F.round(c, 9) for c in ("sr_nearest_resistance", "sr_nearest_support")})  # means of cents can end in a 5 at fewer places


def sr_targets(spark, sf_dir):
    names = [f"sr_{s}_{c}" for s in ("long", "short") for c in ("reference_level", "target", "target_rr")]
    out = _leveled(spark, sf_dir).select(*KEY, *names, "support_resistance_long_valid", "support_resistance_short_valid")
    return out.withColumns({c: F.round(c, 9) for c in names})


def _features(spark, sf_dir, each_type: bool = True):
    return signals.add_signals(build_features(bar_source.event_bars(spark, sf_dir, each_type), SETTINGS))


def liquidity_pools(spark, sf_dir):
    df = zones.add_zones(_structure(spark, sf_dir).drop("atr"), PIP)
    return _rounded(pools.add_pools(df, SETTINGS.pools).select(*KEY, "liquidity_pool_low", "liquidity_pool_high", "liquidity_long_valid", "liquidity_short_valid"), "liquidity_pool_low", "liquidity_pool_high")


def signals_all(spark, sf_dir):
    df = zones.add_zones(_structure(spark, sf_dir).drop("atr"), PIP)
    return signals.add_signals(df).select(*KEY, "market_structure_long_valid", "market_structure_short_valid", "long_signal", "short_signal")


def exec_costs(spark, sf_dir):
    df = sessions.add_sessions(S.add_atr(_bars(spark, sf_dir), 14, "sma"), SETTINGS.sessions)
    out = execution.with_costs(df, DEMO_EXECUTION).select(*KEY, "session_factor", "volatility_factor", "spread_pips", "slippage_pips", "fill_cost", "baseline_atr")
    return _rounded(out, "spread_pips", "slippage_pips", "fill_cost", "baseline_atr")


def sizing(spark, sf_dir):
    """Lots for every accepted zone at the first balance."""
    z = zones.accepted_zones(zones.zone_candidates(_zone_inputs(spark, sf_dir), PIP))
    lots = execution.lots_column(F.lit(DEMO_EXECUTION.balance), F.abs(F.col("entry") - F.col("stop")), DEMO_EXECUTION)
    return z.select("symbol", "side", "zone_id", lots.alias("lots"))


def trades(spark, sf_dir):
    """Simulated trades of all series."""
    out = execution.run_trades(_features(spark, sf_dir), DEMO_EXECUTION)
    return _rounded(out, *[c for c, kind in out.dtypes if kind == "double"])


def equity_curve(spark, sf_dir):
    f = _features(spark, sf_dir)
    return _rounded(execution.equity_curve(execution.run_trades(f, DEMO_EXECUTION), f, DEMO_EXECUTION.balance), "equity")


def drawdown(spark, sf_dir):
    return max_drawdowns(_trades(spark, sf_dir), {"max_drawdown": F.col("pnl_cash")}, "row_id")


def running_equity(spark, sf_dir):
    run = with_running(_trades(spark, sf_dir), {"cum": F.col("pnl_cash")}, "row_id", None, {"cum": "peak"})
    return run.select("row_id", "cum", "peak")


def trade_stats(spark, sf_dir):
    return _rounded(performance.trade_stats(_trades(spark, sf_dir), 10_000.0, ["symbol"]), "roi_pct", "avg_win", "avg_loss", "avg_pnl_per_trade", "avg_rr_per_trade")


def engine_summary(spark, sf_dir):
    return _rounded(performance.engine_summary(_trades(spark, sf_dir, False), 10_000.0, ["symbol"]), "win_rate", "expectancy_r", "profit_factor")


def account_info(spark, sf_dir):
    return _rounded(performance.account_info(_trades(spark, sf_dir), 10_000.0), "max_drawdown_pct", "initial_drawdown_pct")


def trading_metrics(spark, sf_dir):
    return _rounded(performance.trading_metrics(_trades(spark, sf_dir)), "pnl_r", "expectancy", "expectancy_r", "win_rate", "profit_factor", "max_drawdown_r")


def sharpe_moments(spark, sf_dir):
    m = performance.sharpe_moments(_trades(spark, sf_dir, False), 10_000.0, ["symbol"])
    return _rounded(m, "mean", "deviation", "skew", "kurtosis", "sharpe_per_trade", "sharpe")


def deflated_sharpe(spark, sf_dir):
    m = performance.deflated_sharpe(_trades(spark, sf_dir, False), 10_000.0, ["symbol", "timeframe"])
    return m.select("symbol", "timeframe", F.round("sharpe", 6).alias("sharpe"), F.round("deflated_sharpe_ratio", 6).alias("deflated_sharpe_ratio"), "deflated_sharpe_mode")


def outcome_groups(spark, sf_dir):
    return analytics.outcome_groups(_trades(spark, sf_dir, False)).groupBy("symbol", "outcome_group").agg(F.count("*").alias("n"), F.sum("pnl_cash").alias("pnl"))


def _normal(spark, sf_dir, numbered=False):
    return analytics.outcome_groups(_trades(spark, sf_dir, numbered))


def confluence_summary(spark, sf_dir):
    return _rounded(analytics.condition_summary(_normal(spark, sf_dir)), "active_rate_pct", "win_rate_when_active", "avg_r_when_active")


def confluence_impact(spark, sf_dir):
    return _rounded(analytics.condition_impact(_normal(spark, sf_dir)), "win_rate_with", "expectancy_with", "win_rate_without", "expectancy_without", "win_rate_delta_pp", "expectancy_delta_r")


def confluence_sets(spark, sf_dir):
    return _rounded(analytics.condition_sets(_normal(spark, sf_dir)), "win_rate", "expectancy_r")


def confluence_counts(spark, sf_dir):
    return analytics.condition_counts(_trades(spark, sf_dir, False))


def mean_confluences(spark, sf_dir):
    return _rounded(analytics.mean_active(_trades(spark, sf_dir, False)), "mean_active")


def filter_trades(spark, sf_dir):
    return analytics.filter_trades(_normal(spark, sf_dir, True), symbol="A", side=None, outcome="Win", date_from="1994-01-01", date_to="1996-12-31", condition="gap_valid", state="active", min_r=1.0).select("row_id", "trade_date", "pnl_r")


def _run_names(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyyMMdd")
    name = F.concat_ws("_", F.concat(F.lit("SYM"), F.col("o_orderstatus")), F.concat(F.lit("H"), F.col("o_custkey") % 3), day, day, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), F.lit("Z")))
    return o.select(name.alias("name")).distinct()


def run_labels(spark, sf_dir):
    return runs.run_versions(runs.parse_runs(_run_names(spark, sf_dir))).select("name", "stamp", "version", "label")


def latest_runs(spark, sf_dir):
    return runs.latest_runs(runs.parse_runs(_run_names(spark, sf_dir)))


def pip_sizes(spark, sf_dir):
    """Pip sizes of made-up metadata taken from the parts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    raw = p.select(k.alias("part"), F.when(k % 4 == 0, "USDJPY").when(k % 4 == 1, "XAUUSD").otherwise("EURUSD").alias("symbol"), F.when(k % 5 != 0, (k % 6).cast("int")).alias("digits"), F.when(k % 3 != 0, F.lit(0.001)).alias("point"), F.lit(0.25).alias("tick_size"))
    return specs.build_specs(raw, {"XAU": 0.1}).select("part", "symbol", F.round("pip_size", 6).alias("pip_size"), "source")


def join_enrich(spark, sf_dir):
    """Outcomes of the better of two reports joined to a data set by five keys."""
    t = _trades(spark, sf_dir, False).groupBy("symbol", "timeframe", "trade_date", "entry_bar", "position").agg(F.sum("pnl_cash").alias("pnl_cash"))
    reports = t.withColumn("report", F.lit("full")).unionByName(t.where("symbol = 'A'").withColumn("report", F.lit("part")))
    data = t.drop("pnl_cash")
    return dataset.enrich(data, reports, ["pnl_cash"]).groupBy("symbol", "matched").agg(F.count("*").alias("n"), F.sum("pnl_cash").alias("pnl"))


def walk_forward_folds(spark, sf_dir):
    return dataset.fold_summary(dataset.walk_forward(_trades(spark, sf_dir)))


def trade_quality_features(spark, sf_dir):
    z = S.add_atr(_leveled(spark, sf_dir), 14, "sma")
    out = dataset.quality_features(z)
    names = [c for c in out.columns if c.startswith("feat_")]
    return _rounded(out.select(*KEY, *names), *names)


def sample_weights(spark, sf_dir):
    return _trades(spark, sf_dir).select("row_id", F.round(dataset.sample_weight(), 6).alias("weight"))


def _folded(spark, sf_dir, numbered=True):
    return _trades(spark, sf_dir, numbered).withColumn("fold", F.col("symbol"))


def rank_pct(spark, sf_dir):
    return ranking.rank_percent(_folded(spark, sf_dir)).select("row_id", "fold", F.round("rank_pct", 9).alias("rank_pct"))


def top_fraction(spark, sf_dir):
    return ranking.top_fraction(_folded(spark, sf_dir), 0.35).select("row_id", "fold")


def keep_ratio_sweep(spark, sf_dir):
    out = ranking.keep_ratio_sweep(_folded(spark, sf_dir))
    return out.select(F.round("keep_ratio", 6).alias("keep_ratio"), "trades", "pnl", F.round("max_drawdown", 6).alias("max_drawdown"), "cutoff_score", F.round("expectancy", 6).alias("expectancy"), F.round("pnl_retention", 6).alias("pnl_retention"))


def confluence_lift(spark, sf_dir):
    t = _folded(spark, sf_dir)
    return _rounded(ranking.condition_lift(t, ranking.top_fraction(t, 0.35), FLAGS), "baseline_freq", "accepted_freq", "lift")


def _predicted(spark, sf_dir):
    return ranking.flag_selected(_folded(spark, sf_dir), 0.35)


def confusion_metrics(spark, sf_dir):
    return _rounded(classification.confusion(_predicted(spark, sf_dir), ["fold"]), "precision", "recall", "accuracy", "selected_rate", "positive_rate", "f1")


def roc_auc(spark, sf_dir):
    return _rounded(classification.roc_auc(_folded(spark, sf_dir, False), ["fold"]), "roc_auc")


def average_precision(spark, sf_dir):
    return _rounded(classification.average_precision(_folded(spark, sf_dir), ["fold"], "row_id"), "average_precision")


def roc_points(spark, sf_dir):
    return _rounded(classification.roc_points(_folded(spark, sf_dir, False), ["fold"]), "fpr", "tpr")


def pooled_metrics(spark, sf_dir):
    c = classification.confusion(_predicted(spark, sf_dir).withColumn("split", F.col("timeframe")), ["fold", "split"])
    return _rounded(classification.pooled_and_mean(c), "precision", "recall", "mean_precision", "mean_recall", "mean_accuracy", "mean_f1")


def dataset_overview(spark, sf_dir):
    return dataset.overview(_trades(spark, sf_dir, False), "label")


def gbt_scores(spark, sf_dir):
    """Walk-forward scores of boosted trees: three folds of trees of the default depth (fewer of them, for the test tables)."""
    from tidemark.operators.model import TrainConfig, scored_fold, side_by_side

    t = _trades(spark, sf_dir, kept=["symbol", "timeframe", "position", "trade_date", "entry_bar", "l_discount", "l_tax", "pnl_cash", "pnl_r", *FLAGS, "label"]).withColumnRenamed("label", "label_positive")
    bounds, folds = dataset.fold_dates(t)
    cfg, out = TrainConfig(trees=GBT_TREES), None
    for parts in side_by_side(spark, folds, lambda fold: scored_fold(dataset.in_fold(t, bounds, fold), cfg), cfg.parallel):
        for split, part in parts.items():
            one = part.select("fold", F.lit(split).alias("split"), "row_id", "score")
            out = one if out is None else out.unionByName(one)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feature layers and signals over the series of all events."""
    return _features(spark, sf_dir, each_type=False)


_ALL = (
    bars_h1, bar_coverage, bars_latest, true_range, atr_sma, atr_rma, atr_ema, pivots, swing_labels, trend_state, structure_breaks, last_opposing, departures, zone_candidates, zones_accepted, zone_lifecycle, nearest_zone,
    session_blocks, session_levels, session_sweeps, volume_profile_poc, fvg_gaps, fvg_fill, fib_legs, fib_valid, sr_levels, sr_targets, liquidity_pools, signals_all, exec_costs, sizing, trades, equity_curve, drawdown, running_equity, trade_stats, engine_summary,
    account_info, trading_metrics, sharpe_moments, deflated_sharpe, outcome_groups, confluence_summary, confluence_impact, confluence_sets, confluence_counts, mean_confluences, filter_trades, run_labels, latest_runs, pip_sizes, join_enrich, walk_forward_folds,
    trade_quality_features, sample_weights, rank_pct, top_fraction, keep_ratio_sweep, confluence_lift, confusion_metrics, roc_auc, average_precision, roc_points, pooled_metrics, dataset_overview, gbt_scores, flagship,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """SQL twins by name."""
    return oracle.SQL | oracle_states.SQL

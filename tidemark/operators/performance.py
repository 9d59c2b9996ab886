"""Statistics of trade tables: summaries, account figures, Sharpe ratios, drawdowns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.normal import normal_cdf, normal_quantile_of
from tidemark.functions.ordering import max_drawdowns, row_numbers, with_last, with_running
from tidemark.functions.tables import join_on

#: Profit and loss smaller than this counts as none in ranking metrics.
TOLERANCE = 1e-6
EULER_GAMMA = 0.5772156649015329


def _sum_if(test: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, x)), F.lit(0.0))


def _ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(other))


def cash(name: str = "pnl_cash") -> Column:
    """A numeric column whose missing and malformed values count as 0."""
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def trading_metrics(trades: DataFrame, order: str = "row_id", keys: list[str] | None = None) -> DataFrame:
    """Nine selection metrics for each key: trades, pnl, pnl_r, expectancies, win_rate, profit_factor, drawdowns.

    A win is a profit over the tolerance, the win rate counts over all trades,
    and the profit factor without losses is infinite.
    """
    keys = keys or []
    p, r = cash("pnl_cash"), cash("pnl_r")
    won, lost = _sum_if(p > TOLERANCE, p), F.abs(_sum_if(p < -TOLERANCE, p))
    base = trades.groupBy(*keys).agg(
        F.count("*").cast("double").alias("trades"),
        F.coalesce(F.sum(p), F.lit(0.0)).alias("pnl"),
        F.coalesce(F.sum(r), F.lit(0.0)).alias("pnl_r"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("expectancy"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("expectancy_r"),
        F.coalesce(F.avg((p > TOLERANCE).cast("double")) * 100.0, F.lit(0.0)).alias("win_rate"),
        F.when(lost > TOLERANCE, won / lost).when(won > TOLERANCE, F.lit(math.inf)).otherwise(F.lit(0.0)).alias("profit_factor"),
    )
    base = join_on(base, max_drawdowns(trades, {"max_drawdown": p, "max_drawdown_r": r}, order, keys), keys, "left")
    return base.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in ("max_drawdown", "max_drawdown_r")})


def engine_summary(trades: DataFrame, balance: float, keys: list[str] | None = None) -> DataFrame:
    """Totals of a simulation; break-even exits are no wins or losses, and no losses give a profit factor of 0."""
    even = F.col("outcome") == "Breakeven"
    p = F.col("pnl_cash")
    wins, losses = F.count_if((p > 0) & ~even), F.count_if((p < 0) & ~even)
    profit, loss = _sum_if(p > 0, p), F.abs(_sum_if(p < 0, p))
    return trades.groupBy(*(keys or [])).agg(
        F.count("*").alias("trades"), wins.alias("wins"), losses.alias("losses"), F.count_if(even).alias("breakevens"),
        (_ratio(wins.cast("double"), wins + losses) * 100.0).alias("win_rate"),
        F.coalesce(F.avg("pnl_r"), F.lit(0.0)).alias("expectancy_r"),
        _ratio(profit, loss).alias("profit_factor"), profit.alias("gross_profit"), loss.alias("gross_loss"),
        (F.lit(float(balance)) + F.coalesce(F.sum(p), F.lit(0.0))).alias("balance"),
    )


def trade_stats(trades: DataFrame, balance: float, keys: list[str] | None = None) -> DataFrame:
    """Report statistics; gross figures leave break-even exits out."""
    even, p = F.col("outcome") == "Breakeven", F.col("pnl_cash")
    won, lost = (p > 0) & ~even, (p < 0) & ~even
    duration = F.col("exit_bar") - F.col("entry_bar") if "exit_bar" in trades.columns else F.lit(None).cast("double")
    net = F.coalesce(F.sum(p), F.lit(0.0))
    return trades.groupBy(*(keys or [])).agg(
        F.count("*").alias("trades"), F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"), F.count_if(even).alias("breakevens"),
        net.alias("net_pnl"), (net / balance * 100.0).alias("roi_pct"),
        _sum_if(won, p).alias("gross_profit"), F.abs(_sum_if(lost, p)).alias("gross_loss"),
        F.coalesce(F.avg(F.when(won, p)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(lost, p)), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("avg_pnl_per_trade"), F.coalesce(F.avg("pnl_r"), F.lit(0.0)).alias("avg_rr_per_trade"),
        F.coalesce(F.max(p), F.lit(0.0)).alias("largest_win"),
        F.coalesce(F.min(p), F.lit(0.0)).alias("largest_loss"),
        F.coalesce(F.avg(duration), F.lit(0.0)).alias("avg_bars_in_trade"),
    )


def sharpe_moments(trades: DataFrame, balance: float, keys: list[str] | None = None) -> DataFrame:
    """Returns' count, mean, deviation, bias-corrected skewness and excess kurtosis, and the Sharpe ratio over all trades."""
    r = F.col("pnl_cash") / balance
    base = trades.groupBy(*(keys or [])).agg(F.count("*").cast("double").alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("deviation"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    n = F.col("n")
    skew = F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    per_trade = F.try_divide(F.col("mean"), F.col("deviation"))
    return base.withColumns({"skew": F.coalesce(skew, F.lit(0.0)), "kurtosis": F.coalesce(kurt, F.lit(0.0)), "sharpe_per_trade": F.coalesce(per_trade, F.lit(0.0)), "sharpe": F.coalesce(per_trade * F.sqrt(n), F.lit(0.0))}).drop("g1", "g2")


def deflated_sharpe(trades: DataFrame, balance: float, keys: list[str] | None = None, trials: int = 1, variance: float = 0.0, trial: list[str] | None = None) -> DataFrame:
    """Probability that the Sharpe ratio exceeds the threshold of the trials, given skewness and kurtosis.

    The threshold is the largest ratio to expect of so many trials without skill.
    ``trial`` names columns whose groups are the trials of a key: their number and the
    variance of their Sharpe ratios stand in for ``trials`` and ``variance``.
    """
    keys = keys or []
    m = sharpe_moments(trades, balance, keys)
    known = {"tm_trials": F.lit(max(1, trials)).cast("long"), "tm_variance": F.lit(float(variance))}
    if trial:
        own = sharpe_moments(trades, balance, [*keys, *trial])
        ratio = F.try_divide(F.col("mean"), F.col("deviation"))
        spread_of = own.groupBy(*keys).agg(F.count("*").alias("tm_trials"), F.coalesce(F.var_samp(ratio), F.lit(0.0)).alias("tm_variance"))
        m = join_on(m, spread_of, keys)
    else:
        m = m.withColumns(known)
    many = (F.col("tm_trials") > 1) & (F.col("tm_variance") > 0) & (F.col("n") >= 2)
    count = F.when(many, F.col("tm_trials").cast("double"))
    top = (1 - EULER_GAMMA) * normal_quantile_of(1 - 1 / count) + EULER_GAMMA * normal_quantile_of(1 - 1 / (count * math.e))
    threshold = F.when(many, F.sqrt("tm_variance") * top).otherwise(F.lit(0.0))
    m = m.withColumn("deflated_sharpe_threshold", threshold)
    s, n = F.col("sharpe_per_trade"), F.col("n")
    spread = 1 - F.col("skew") * s + (F.col("kurtosis") + 2) / 4.0 * s * s
    z = (s - F.col("deflated_sharpe_threshold")) * F.sqrt(n - 1) / F.sqrt(spread)
    mode = F.when(n < 2, "insufficient_observations").when(many, "multiple_testing_adjusted").otherwise("single_trial_psr_equivalent")
    ratio = F.when((n >= 2) & (spread > 0), normal_cdf(z)).otherwise(F.lit(0.0))
    shown = F.when(n < 2, F.lit(1)).otherwise(F.col("tm_trials")).cast("int")
    return m.withColumns({"deflated_sharpe_ratio": ratio, "deflated_sharpe_trials": shown, "deflated_sharpe_mode": mode}).drop("tm_trials", "tm_variance")


def account_info(trades: DataFrame, balance: float, order: str = "row_id", keys: list[str] | None = None) -> DataFrame:
    """Balances and both drawdowns, from the running peak and from the first balance, absolute and in percent."""
    keys = keys or []
    run = with_running(trades, {"tm_cum": cash()}, order, keys, {"tm_cum": "tm_peak"})
    equity, peak = F.lit(float(balance)) + F.col("tm_cum"), F.greatest(F.lit(float(balance)) + F.col("tm_peak"), F.lit(float(balance)))
    fall = peak - equity
    return run.groupBy(*keys).agg(
        F.lit(float(balance)).alias("initial_balance"),
        F.max_by(equity, order).alias("ending_balance"),
        F.max(F.greatest(fall, F.lit(0.0))).alias("max_drawdown"),
        F.max(F.greatest(fall / peak * 100.0, F.lit(0.0))).alias("max_drawdown_pct"),
        F.max(F.greatest(F.lit(float(balance)) - equity, F.lit(0.0))).alias("initial_drawdown"),
        (F.max(F.greatest(F.lit(float(balance)) - equity, F.lit(0.0))) / balance * 100.0).alias("initial_drawdown_pct"),
    )


def rebuilt_equity(trades: DataFrame, balance: float, order: list[str] | None = None) -> DataFrame:
    """Equity after each stored trade by date: step, time, equity, and step 0 with the first balance.

    Stored balances are used where the table has any, the last known one for
    missing ones; else the results are summed. ``order`` breaks ties of the date.
    """
    rows = row_numbers(trades, ["trade_date", *(order or [])], "tm_step")
    summed = with_running(rows, {"tm_cash": cash() if "pnl_cash" in trades.columns else F.lit(0.0)}, "tm_step")
    equity = F.lit(float(balance)) + F.col("tm_cash")
    if "balance_after" in trades.columns:
        summed = with_last(summed, F.col("balance_after"), "tm_step", "tm_known")
        known = trades.agg((F.count("balance_after") > 0).alias("tm_any"))  # one row
        summed = summed.crossJoin(F.broadcast(known))
        equity = F.when(F.col("tm_any"), F.col("tm_known")).otherwise(equity)
    points = summed.select(F.col("tm_step").alias("step"), F.col("trade_date").alias("time"), equity.alias("equity"))
    first = trades.agg(F.count("*").alias("n"), F.min("trade_date").alias("time")).where("n > 0")
    return first.select(F.lit(0).cast("long").alias("step"), "time", F.lit(float(balance)).alias("equity")).unionByName(points)

"""Analysis of executed trades: normalising, filtering, outcomes, conditions and their sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import is_true
from tidemark.operators.performance import cash

#: Conditions that every trade meets (fixed names); all other ``*_valid`` columns are optional.
CORE = ("atr_valid", "supply_demand_valid", "market_structure_valid")
#: Texts that stand for an outcome (fixed values).
OUTCOMES = {"win": "Win", "winner": "Win", "w": "Win", "profit": "Win", "loss": "Loss", "loser": "Loss", "l": "Loss", "breakeven": "Breakeven", "break-even": "Breakeven", "be": "Breakeven"}
#: Columns of a stored trade table that are times, numbers and flags (fixed names).
TIMES = ("trade_date", "exit_time", "signal_time", "last_partial_time")
NUMBERS = ("pnl_cash", "pnl_r", "entry", "exit", "initial_stop", "final_stop", "target", "risk_price", "risk_pips", "target_pips", "size", "balance_after", "confluence_count", "commission")
MORE_FLAGS = ("label_hit_target", "label_runner", "runner_qualified", "runner_active")


def coerced_bool(name: str) -> Column:
    """Text, number or boolean as a boolean; anything unknown is false."""
    return F.coalesce(F.lower(F.trim(F.col(name).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def conditions(df: DataFrame, optional: bool = True) -> list[str]:
    """Condition columns of a trade table."""
    found = [c for c in df.columns if c.lower().endswith("_valid")]
    return [c for c in found if c.lower() not in CORE] if optional else found


def readable(name: str) -> str:
    """Column name as a label."""
    text = name[: -len("_valid")] if name.lower().endswith("_valid") else name
    return text.replace("_", " ")


def normalise(df: DataFrame, times: tuple[str, ...] = TIMES, numbers: tuple[str, ...] = NUMBERS, flags: tuple[str, ...] = MORE_FLAGS) -> DataFrame:
    """Coerce times, numbers, condition flags and a few more, and add ``outcome_group``. What can't be read is NULL, a flag false."""
    new = {c: F.col(c).try_cast("timestamp_ntz") for c in times if c in df.columns and dict(df.dtypes)[c] == "string"}
    new |= {c: F.col(c).try_cast("double") for c in numbers if c in df.columns}
    new |= {c: coerced_bool(c) for c in (*conditions(df, optional=False), *flags) if c in df.columns}
    return outcome_groups(df.withColumns(new))


def outcome_groups(df: DataFrame) -> DataFrame:
    """Add ``outcome_group``: the outcome texts if all of them are known, else the sign of the result."""
    r, c = cash("pnl_r"), cash("pnl_cash")
    signed = F.when(r == 0, c).otherwise(r)
    by_sign = F.when(signed > 0, "Win").when(signed < 0, "Loss").otherwise("Breakeven")
    if "outcome" not in df.columns:
        return df.withColumn("outcome_group", by_sign)
    table = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    mapped = F.get(F.array(F.try_element_at(table, F.lower(F.trim(F.col("outcome"))))), 0)
    whole = df.agg(F.coalesce(F.bool_and(mapped.isNotNull()), F.lit(False)).alias("tm_all"))  # one row
    return df.crossJoin(F.broadcast(whole)).withColumn("outcome_group", F.when(F.col("tm_all"), mapped).otherwise(by_sign)).drop("tm_all")


def filter_trades(df: DataFrame, *, symbol=None, timeframe=None, side=None, outcome=None, date_from=None, date_to=None, condition=None, state=None, runner=None, min_r=None, max_r=None) -> DataFrame:
    """Trades that meet all given filters, by date. A plain end date covers its whole day."""
    for name, value in (("symbol", symbol), ("timeframe", timeframe), ("side", side), ("outcome_group", outcome)):
        if value not in (None, "All"):
            df = df.where(F.col(name) == value)
    if date_from is not None:
        df = df.where(F.col("trade_date") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        end = F.lit(date_to).cast("timestamp_ntz")
        if isinstance(date_to, str) and len(date_to) == 10:
            end = end + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
        df = df.where(F.col("trade_date") <= end)
    if condition is not None and state in ("active", "inactive"):
        df = df.where(is_true(F.col(condition)) if state == "active" else ~is_true(F.col(condition)))
    if runner is not None:
        df = df.where(is_true(F.col("runner_active")) == F.lit(bool(runner)))
    if min_r is not None:
        df = df.where(F.col("pnl_r") >= min_r)
    if max_r is not None:
        df = df.where(F.col("pnl_r") <= max_r)
    return df.orderBy("trade_date")


def _long(df: DataFrame) -> DataFrame:
    """One row for each trade and optional condition."""
    cells = F.array(*[F.struct(F.lit(readable(c)).alias("confluence"), coerced_bool(c).alias("active")) for c in conditions(df)])
    return df.select("outcome_group", cash("pnl_r").alias("r"), cash("pnl_cash").alias("c"), F.inline(cells))


def _subset(test: Column, suffix: str, names: tuple[str, str, str, str]) -> list[Column]:
    count, rate, mean, total = names
    won = F.when(test, (F.col("outcome_group") == "Win").cast("double"))
    return [
        F.count_if(test).alias(count + suffix),
        F.coalesce(F.avg(won) * 100.0, F.lit(0.0)).alias(rate + suffix),
        F.coalesce(F.avg(F.when(test, F.col("r"))), F.lit(0.0)).alias(mean + suffix),
        F.coalesce(F.sum(F.when(test, F.col("c"))), F.lit(0.0)).alias(total + suffix),
    ]


def condition_summary(df: DataFrame) -> DataFrame:
    """Trades and results with each optional condition active."""
    active = F.col("active")
    out = _long(df).groupBy("confluence").agg(F.count("*").alias("tm_n"), *_subset(active, "", ("active_trade_count", "win_rate_when_active", "avg_r_when_active", "pnl_when_active")))
    out = out.withColumns({"inactive_trade_count": F.col("tm_n") - F.col("active_trade_count"), "active_rate_pct": F.col("active_trade_count") / F.col("tm_n") * 100.0}).drop("tm_n")
    return out.orderBy(F.desc("active_trade_count"), F.desc("win_rate_when_active"), F.desc("avg_r_when_active"), "confluence")


def condition_impact(df: DataFrame) -> DataFrame:
    """Results with and without each optional condition, and their differences."""
    names = ("trades", "win_rate", "expectancy", "pnl")
    out = _long(df).groupBy("confluence").agg(*_subset(F.col("active"), "_with", names), *_subset(~F.col("active"), "_without", names))
    out = out.withColumns({"win_rate_delta_pp": F.col("win_rate_with") - F.col("win_rate_without"), "expectancy_delta_r": F.col("expectancy_with") - F.col("expectancy_without")})
    return out.orderBy(F.desc("expectancy_delta_r"), F.desc("win_rate_delta_pp"), F.desc("trades_with"), "confluence")


def condition_sets(df: DataFrame) -> DataFrame:
    """Results of trades with exactly the same optional conditions, for sets that a positive trade shows.

    Break-even trades are left out of the results but may show a set.
    """
    names = [(c, readable(c)) for c in conditions(df)]
    active = F.filter(F.array(*[F.when(coerced_bool(c), F.lit(label)) for c, label in names]), lambda x: x.isNotNull())
    r, c, group = cash("pnl_r"), cash("pnl_cash"), F.col("outcome_group")
    rows = df.select(active.alias("set"), group, r.alias("r"), c.alias("c")).where(F.size("set") > 0)
    rated = group != "Breakeven"
    positive = F.coalesce((group == "Win") | (F.col("r") > 0) | (F.col("c") > 0), F.lit(False))
    out = rows.groupBy("set").agg(F.max(positive.cast("int")).alias("tm_shown"), *_subset(rated, "", ("trade_count", "win_rate", "expectancy_r", "pnl_cash"))).where("tm_shown = 1")
    out = out.select(F.array_join("set", ", ").alias("confluence_set"), F.size("set").alias("set_size"), "trade_count", "win_rate", "expectancy_r", "pnl_cash")
    return out.orderBy(F.desc("expectancy_r"), F.desc("win_rate"), F.desc("trade_count"), F.desc("set_size"), "confluence_set")


def condition_counts(df: DataFrame) -> DataFrame:
    """Trades with each condition, core ones included."""
    cells = F.array(*[F.struct(F.lit(c).alias("condition"), coerced_bool(c).cast("long").alias("n")) for c in conditions(df, optional=False)])
    return df.select(F.inline(cells)).groupBy("condition").agg(F.sum("n").alias("trades"))


def mean_active(df: DataFrame) -> DataFrame:
    """Mean number of active optional conditions of a trade (one row)."""
    total = sum((coerced_bool(c).cast("int") for c in conditions(df)), F.lit(0))
    return df.agg(F.coalesce(F.avg(total), F.lit(0.0)).alias("mean_active"))


def detail_sections(df: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """Each trade's fields grouped in named structs; a section without any known column is left out."""
    known = {s: [c for c in cols if c in df.columns] for s, cols in sections.items()}
    return df.select("*", *[F.struct(*cols).alias(s) for s, cols in known.items() if cols])

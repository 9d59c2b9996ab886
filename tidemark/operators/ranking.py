"""Ranking of scored trades: top fractions by group, the keep-ratio search, and condition lift."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import BLOCK, GROUP, joined_falls, row_numbers
from tidemark.functions.tables import materialise
from tidemark.operators.performance import TOLERANCE, cash


@dataclass(frozen=True)
class RankingConfig:
    low: float = 0.35
    high: float = 1.0
    step: float = 0.05
    min_trades: int = 12
    min_retention: float = 0.95
    max_profit_factor: float = 5.0

    def ratios(self) -> list[float]:
        """The candidates, in the double arithmetic of an evenly spaced range."""
        delta = (self.low + self.step) - self.low
        out, k = [], 0
        while self.low + k * self.step < self.high + 1e-9:
            out.append(self.low + k * delta)
            k += 1
        return out


def _ranked(df: DataFrame, group: str, score: str, order: str, kept: list[str] | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """Add tm_rank (place by falling score in the group, earlier row first), tm_n (size of the group) and tm_score."""
    scored = df.withColumn("tm_score", F.coalesce(F.col(score).try_cast("double"), F.lit(0.0)))
    return row_numbers(scored, [F.desc("tm_score"), order], "tm_rank", [group], "tm_n", kept, held)


def rank_percent(df: DataFrame, group: str = "fold", score: str = "score", order: str = "row_id") -> DataFrame:
    """Add ``rank_pct``: place by falling score within a group, as a share of its size (earlier row first)."""
    return _ranked(df, group, score, order).withColumn("rank_pct", F.col("tm_rank") / F.col("tm_n")).drop("tm_score", "tm_n", "tm_rank")


def top_fraction(df: DataFrame, ratio: float, group: str = "fold", score: str = "score", order: str = "row_id") -> DataFrame:
    """Keep the best rows of every group: max(1, ceil(size * ratio))."""
    keep = F.greatest(F.lit(1), F.ceil(F.col("tm_n") * F.lit(float(ratio))))
    return _ranked(df, group, score, order).where(F.col("tm_rank") <= keep).drop("tm_score", "tm_n", "tm_rank")


def flag_selected(df: DataFrame, ratio: float, group: str = "fold", score: str = "score", order: str = "row_id") -> DataFrame:
    """Add ``selected`` (0/1) for membership in the top fraction."""
    keep = F.greatest(F.lit(1), F.ceil(F.col("tm_n") * F.lit(float(ratio))))
    return _ranked(df, group, score, order).withColumn("selected", (F.col("tm_rank") <= keep).cast("int")).drop("tm_score", "tm_n", "tm_rank")


def ranked_and_flagged(df: DataFrame, ratio: float, kept: list[str], held: list[DataFrame] | None = None, group: str = "fold", score: str = "score", order: str = "row_id") -> DataFrame:
    """``rank_pct`` and ``selected`` by one ranking, beside the columns to be kept (the group among them)."""
    keep = F.greatest(F.lit(1), F.ceil(F.col("tm_n") * F.lit(float(ratio))))
    rows = _ranked(df, group, score, order, kept, held)
    return rows.withColumns({"rank_pct": F.col("tm_rank") / F.col("tm_n"), "selected": (F.col("tm_rank") <= keep).cast("int")}).drop("tm_n", "tm_rank")


_DRAWN = ("max_drawdown", "max_drawdown_r")
_SUMS = ("trades", "wins", "won", "lost", "pnl", "pnl_r")
_CELLS = "keep_ratio double, tm_at long, " + ", ".join(f"{c} double" for c in (*_SUMS, *[f"tm_{p}_{n}" for n in _DRAWN for p in ("s", "lo", "hi", "f")]))


def candidate_sums(rows: pd.DataFrame, block: int, ratios: list[float], order: str) -> pd.DataFrame:
    """Sums of every candidate over the rows of one block that it keeps, and what its running sums do there."""
    rows = rows.sort_values(order)
    p, r = (rows[c].fillna(0.0).to_numpy(float) for c in ("tm_p", "tm_r"))
    rank, n = rows["tm_rank"].to_numpy(), rows["tm_n"].to_numpy()
    out = []
    for ratio in ratios:
        keep = rank <= np.maximum(1, np.ceil(n * abs(ratio)))
        if keep.any():
            own, won, lost = p[keep], p[keep] > TOLERANCE, p[keep] < -TOLERANCE
            falls = []
            for x in (own, r[keep]):
                c = np.cumsum(x)
                falls += [c[-1], c.min(), c.max(), (np.maximum.accumulate(c) - c).max()]
            out.append((ratio, block, len(own), won.sum(), own[won].sum(), own[lost].sum(), own.sum(), r[keep].sum(), *falls))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _CELLS.split(", ")])


def candidate_metrics(ranked: DataFrame, ratios: list[float], order: str) -> DataFrame:
    """``trading_metrics`` of every candidate, from one pass over the rows: blocks are summed for all candidates at once, without copies of rows."""
    rows = ranked.select(F.floor(F.col(order) / BLOCK).alias("tm_block"), order, cash("pnl_cash").alias("tm_p"), cash("pnl_r").alias("tm_r"), "tm_rank", "tm_n")
    cells = materialise(rows.groupBy("tm_block").applyInPandas(lambda key, own: candidate_sums(own, int(key[0]), ratios, order), _CELLS))
    sums = cells.groupBy("keep_ratio").agg(*[F.sum(c).alias(c) for c in _SUMS])
    lost, n = F.abs("lost"), F.col("trades")
    factor = F.when(lost > TOLERANCE, F.col("won") / lost).when(F.col("won") > TOLERANCE, F.lit(float("inf"))).otherwise(F.lit(0.0))
    out = sums.select("keep_ratio", "trades", "pnl", "pnl_r", (F.col("pnl") / n).alias("expectancy"), (F.col("pnl_r") / n).alias("expectancy_r"), (F.col("wins") / n * 100.0).alias("win_rate"), factor.alias("profit_factor"))
    return out.join(joined_falls(cells, list(_DRAWN), ["keep_ratio"], (GROUP,)), "keep_ratio")


def keep_ratio_sweep(df: DataFrame, cfg: RankingConfig | None = None, group: str = "fold", score: str = "score", order: str = "row_id") -> DataFrame:
    """Metrics, retention and objective of every candidate ratio.

    One more candidate (-1) keeps all rows as the baseline. The cut-off score of a
    ratio is the median over the groups of the last score that it keeps.
    """
    cfg = cfg or RankingConfig()
    ranked = materialise(_ranked(df.select(order, group, "pnl_cash", "pnl_r", score), group, score, order))
    metrics = candidate_metrics(ranked, [-1.0, *cfg.ratios()], order)
    ratios = F.array(*[F.lit(r) for r in cfg.ratios()])
    last = F.filter(ratios, lambda x: F.col("tm_rank") == F.greatest(F.lit(1), F.ceil(F.col("tm_n") * x)))
    # a median of a value for each group
    cuts = ranked.select(F.explode(last).alias("keep_ratio"), "tm_score").groupBy("keep_ratio").agg(F.median("tm_score").alias("cutoff_score"))
    every = Window.partitionBy(F.lit(0))  # a row for each candidate
    base = {n: F.max(F.when(F.col("keep_ratio") < 0, F.col(c))).over(every) for n, c in (("b_pnl", "pnl"), ("b_dd", "max_drawdown_r"))}
    out = metrics.withColumns(base).where("keep_ratio > 0").join(cuts, "keep_ratio")
    factor = F.least(F.col("profit_factor"), F.lit(cfg.max_profit_factor))
    retention, fall = F.col("pnl") / F.col("b_pnl"), F.col("max_drawdown_r") / F.col("b_dd")
    out = out.withColumns({
        "pnl_retention": F.when(F.col("b_pnl") > 0, retention),
        "drawdown_ratio": F.when(F.col("b_dd") > 0, fall),
        "profit_factor_capped": factor,
    })
    better = F.when(F.col("b_dd") > 0, (F.col("b_dd") - F.col("max_drawdown_r")) / F.col("b_dd")).otherwise(F.lit(0.0))
    objective = 4.0 * F.coalesce("pnl_retention", F.lit(1.0)) + 2.0 * F.col("expectancy_r") + better + 0.5 * factor - 0.05 * F.col("keep_ratio")
    eligible = (F.col("trades") >= cfg.min_trades) & F.coalesce(F.col("pnl_retention") >= cfg.min_retention, F.lit(True))
    return out.withColumns({"objective_score": objective, "eligible": eligible}).drop("b_pnl", "b_dd")


def best_ratio(sweep: DataFrame) -> DataFrame:
    """The chosen candidate: among eligible ones by profit, else by objective first (one row)."""
    any_ok = F.max("eligible").over(Window.partitionBy(F.lit(0)))  # a row for each candidate
    rows = sweep.withColumn("tm_any", any_ok).where("eligible or not tm_any")
    first = F.when(~F.col("tm_any"), F.col("objective_score"))
    return rows.orderBy(F.desc_nulls_last(first), F.desc("pnl"), F.desc("expectancy_r"), F.desc("profit_factor_capped"), "max_drawdown_r", "keep_ratio").limit(1).drop("tm_any")


def condition_lift(base: DataFrame, accepted: DataFrame, columns: list[str]) -> DataFrame:
    """Frequencies of conditions in two tables and their ratio, for those that differ."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v")) for c in columns])
        return df.select(F.inline(cells)).groupBy("feature").agg(F.avg("v").alias(name))

    both = shares(base, "b").join(shares(accepted, "a"), "feature", "left").withColumn("a", F.coalesce("a", F.lit(0.0)))
    out = both.select("feature", (F.col("b") * 100.0).alias("baseline_freq"), (F.col("a") * 100.0).alias("accepted_freq"), F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(F.lit(0.0)).alias("lift"))
    return out.where(F.abs(F.col("accepted_freq") - F.col("baseline_freq")) > 1e-12).orderBy(F.desc("lift"), F.desc("accepted_freq"), "feature")


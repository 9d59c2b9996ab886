"""Sinks: artifacts of a run, rounded figures, and flattened metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.stores import delete_path, move_path

#: Names and parts of names whose values have two decimals; all others have four (fixed values).
PERCENT_NAMES = ("win_rate", "baseline_freq", "accepted_freq", "long_signal_hit_rate", "short_signal_hit_rate", "overall_signal_hit_rate")
TWO_DECIMALS = ("balance", "pnl", "profit", "loss", "drawdown", "roi_pct", "avg_pnl", "largest_", "commission", "price", "pips", "bars")


def places(name: str) -> int:
    """Decimals of a figure of that name."""
    low = name.lower()
    return 2 if low.endswith("_pct") or low in PERCENT_NAMES or any(part in low for part in TWO_DECIMALS) else 4


def display_value(name: str, kind: str) -> Column:
    """A figure rounded by its name; infinite and undefined values become NULL; whole numbers, flags and texts stay."""
    x = F.col(name)
    if kind not in ("double", "float"):
        return x
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.bround(x, places(name)))


def display(df: DataFrame) -> DataFrame:
    """All figures of a table rounded for display."""
    return df.select(*[display_value(n, k).alias(n) for n, k in df.dtypes])


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def walk(schema: StructType, path: list[str]):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, [*path, f.name])
            else:
                yield F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias(".".join([*path, f.name]))

    return df.select(*walk(df.schema, []))


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header and ISO times."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines; undefined numbers become null."""
    clean = df.withColumns({n: F.when(~F.isnan(n) & (F.abs(n) != float("inf")), F.col(n)) for n, k in df.dtypes if k in ("double", "float")})
    clean.write.mode("overwrite").json(path)


def save_run(folder: str, trades: DataFrame, stats: DataFrame, account: DataFrame) -> None:
    """The three artifacts of a simulation: account figures, statistics and trades."""
    write_json(display(account), f"{folder}/account_info")
    write_json(display(stats), f"{folder}/trade_stats")
    write_csv(trades, f"{folder}/trades")


def save_dataset(df: DataFrame, path: str, label: str = "label_positive") -> None:
    """A training table as Parquet. Raises ValueError without rows or without any label, and leaves what was stored before.

    Rows and labels are counted while they are written, beside the wanted path, so the table is computed once.
    """
    seen = Observation()
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.count(label).alias("labels")).write.parquet(beside)
    counts = seen.get
    if not counts.get("n") or not counts.get("labels"):
        delete_path(df.sparkSession, beside)
        raise ValueError(f"{counts.get('n', 0)} rows with {counts.get('labels', 0)} labels can't be stored for training")
    move_path(df.sparkSession, beside, path)


#: Columns of the raw log of trades with what they are taken from (fixed names).
LOG = {
    "direction": "side", "entry_time": "trade_date", "exit_time": "exit_time", "open_bar": "entry_bar", "close_bar": "exit_bar", "entry": "entry", "stop": "final_stop", "initial_stop": "initial_stop", "target": "target", "exit_price": "exit", "size": "size", "remaining_size": None, "risk": "risk_price", "breakeven_moved": "be_moved",
    "is_breakeven_exit": None, "partial_taken": None, "partial_price": "partial_price", "partial_bar": "partial_bar", "runner_qualified": "runner_qualified", "runner_active": "runner_active", "runner_reference_level": "sr_reference_level", "runner_target_price": "runner_target", "runner_target_rr": "sr_target_rr", "runner_stop_price": "runner_stop",
    "runner_exit_reason": "runner_exit_reason", "final_exit_type": "exit_type", "result_r": "pnl_r", "pnl": "pnl_cash", "commission_paid": "commission", "balance_after": "balance_after", "entry_slippage_pips": "entry_slippage_pips", "entry_spread_pips": "entry_spread_pips",
}


def trade_log(report: DataFrame) -> DataFrame:
    """The raw log of a trade report: 32 columns after the series; nothing remains of a finished trade's size."""
    own = {"remaining_size": F.lit(0.0), "is_breakeven_exit": F.col("outcome") == "Breakeven", "partial_taken": F.col("partial_bar").isNotNull()}
    cells = [own[n] if n in own else F.col(c) if c in report.columns else F.lit(None).cast("double") for n, c in LOG.items()]
    return report.select("symbol", "timeframe", *[c.alias(n) for n, c in zip(LOG, cells, strict=True)])

"""Training tables: key joins, enrichment by the best report, derived features, weights and walk-forward folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import row_numbers
from tidemark.functions.series import require
from tidemark.functions.tables import materialise
from tidemark.operators.performance import cash

KEYS = ("symbol", "timeframe", "trade_date", "entry_bar", "position")
#: Columns that reveal the outcome or only locate a trade and are no features (fixed names).
LEAKAGE = frozenset(["pnl_cash", "pnl_r", "outcome", "outcome_group", "exit", "exit_bar", "exit_time", "exit_price", "exit_type", "duration_bars", "partial_bar", "partial_price", "be_moved", "runner_active", "runner_stop", "runner_exit_reason", "balance_after", "commission", "final_stop", "exit_spread_pips", "exit_slippage_pips", "exit_session_factor", "exit_volatility_factor"])
LABELS = ("label_positive", "label_hit_target", "label_runner")
SCHEMA_VERSION = 1


def normalise_keys(df: DataFrame) -> DataFrame:
    """Keys in one form: plain timestamps, trimmed upper-case names, whole bar numbers."""
    return df.withColumns({
        "symbol": F.upper(F.trim("symbol")),
        "timeframe": F.upper(F.trim("timeframe")),
        "position": F.upper(F.trim("position")),
        "trade_date": F.col("trade_date").try_cast("timestamp_ntz"),
        "entry_bar": F.col("entry_bar").try_cast("bigint"),
    })


def safe_frame(report: DataFrame) -> DataFrame:
    """Leakage-free projection of a trade report: keys, version, features, then outcomes and labels."""
    require(report, *LABELS)
    flags = {c: F.col(c).cast("int") for c, kind in report.dtypes if kind == "boolean"}
    finite = {c: F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)) for c, kind in report.dtypes if kind == "double"}
    keys = [c for c in KEYS if c in report.columns]
    outcomes = [c for c in ("pnl_cash", "pnl_r", "outcome", "duration_bars", "commission") if c in report.columns]
    rest = [c for c in report.columns if c not in (*keys, *LABELS) and c not in LEAKAGE]
    return report.withColumns(flags | finite).withColumn("schema_version", F.lit(SCHEMA_VERSION)).select(*keys, "schema_version", *rest, *outcomes, *LABELS)


def match_counts(dataset: DataFrame, reports: DataFrame) -> DataFrame:
    """For each candidate report: rows, matched dataset rows, full match, equal length. ``reports`` has a ``report`` column."""
    keys = list(KEYS)
    rows = dataset.select(keys).distinct()
    own = reports.select("report", *keys).distinct()
    hit = own.join(rows.withColumn("tm_hit", F.lit(1)), keys, "left")
    out = hit.groupBy("report").agg(F.count("*").alias("report_rows"), F.count("tm_hit").alias("matches"))
    out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias("tm_size"))))  # one row
    return out.withColumns({"full_match": F.col("matches") == F.col("tm_size"), "same_length": F.col("report_rows") == F.col("tm_size")}).drop("tm_size")


def enrich(dataset: DataFrame, reports: DataFrame, outcomes: list[str]) -> DataFrame:
    """Left-join outcomes of the best report: full match, then matches, then equal length, then the last name."""
    ranked = match_counts(dataset, reports).orderBy(F.desc("full_match"), F.desc("matches"), F.desc("same_length"), F.desc("report")).limit(1)
    best = reports.join(F.broadcast(ranked.select("report")), "report", "left_semi").dropDuplicates(list(KEYS))  # one row decides
    taken = best.select(*KEYS, *[F.col(c).alias(f"{c}_report" if c in dataset.columns else c) for c in outcomes], F.lit(True).alias("tm_hit"))
    out = dataset.join(taken, list(KEYS), "left")
    return out.withColumn("matched", F.coalesce("tm_hit", F.lit(False))).drop("tm_hit")


def load_training_data(spark: SparkSession, pattern: str, target: str = "label_positive") -> DataFrame:
    """Stored data sets as one table: normalised keys, source file, usable target, rows numbered by date and keys."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(pattern) if pattern.endswith("csv") else spark.read.parquet(pattern)
    rows = normalise_keys(raw.withColumn("source_file", F.col("_metadata.file_name")))
    require(rows, target, "pnl_cash")
    rows = rows.withColumn(target, F.col(target).try_cast("int")).where(F.col(target).isNotNull() & F.col("pnl_cash").try_cast("double").isNotNull())
    return row_numbers(rows, ["trade_date", "symbol", "timeframe", "entry_bar", "position", "source_file"])


def overview(df: DataFrame, target: str = "label_positive") -> DataFrame:
    """Rows and date range of each series and target value (null targets on their own)."""
    return df.groupBy("symbol", "timeframe", target).agg(F.count("*").alias("rows"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def quality_features(df: DataFrame) -> DataFrame:
    """Derived features of zone, cost, resistance, profile and pool context, where their inputs exist."""
    have = set(df.columns)
    n = lambda c: F.col(c).try_cast("double")
    div = lambda a, b: F.try_divide(a, b)
    new: dict[str, Column] = {}
    if "confluence_count" in have:
        new["feat_confluence_ratio"] = n("confluence_count") / 9.0
    if "risk_pips" in have:
        cost = sum((F.coalesce(n(c), F.lit(0.0)) for c in ("entry_spread_pips", "entry_slippage_pips") if c in have), F.lit(0.0))
        new |= {"feat_entry_cost_pips": cost, "feat_entry_cost_to_risk": div(cost, n("risk_pips"))}
    if "sr_runner_target_rr" in have:
        new["feat_runner_rr_buffer"] = n("sr_runner_target_rr") - 2.0
    for side, zone, sign, level, pool in (("long", "demand", 1, "sr_nearest_resistance", "liquidity_pool_high"), ("short", "supply", -1, "sr_nearest_support", "liquidity_pool_low")):
        entry, stop = f"{zone}_zone_entry", f"{zone}_zone_stop"
        if not {entry, stop} <= have:
            continue
        risk = (n(entry) - n(stop)) * sign
        new[f"feat_{side}_risk_price"] = risk
        if "atr_feature" in have:
            new[f"feat_{side}_risk_atr"] = div(risk, n("atr_feature"))
        if level in have:
            new[f"feat_{side}_rr_to_sr"] = div((n(level) - n(entry)) * sign, risk)
        if {"atr_feature", "vp_reference_poc"} <= have:
            new[f"feat_{side}_poc_distance_atr"] = div(F.abs(n("vp_reference_poc") - n(entry)), n("atr_feature"))
        if {"atr_feature", pool} <= have:
            new[f"feat_{side}_liquidity_distance_atr"] = div((n(pool) - n(entry)) * sign, n("atr_feature"))
    return df.withColumns(new) if new else df


def sample_weight() -> Column:
    """1 plus the size of the result in R, at most 5."""
    return 1.0 + F.least(F.abs(cash("pnl_r")), F.lit(5.0))


@dataclass(frozen=True)
class FoldConfig:
    train_ratio: float = 0.70
    folds: int = 3


def fold_bounds(dates: int, cfg: FoldConfig | None = None) -> list[tuple[int, int, int, int]]:
    """(fold, last date number of train, of valid, of test) over so many distinct dates. Raises ValueError under 6."""
    cfg = cfg or FoldConfig()
    if dates < 6:
        raise ValueError("at least 6 distinct dates are needed")
    first = min(max(1, int(dates * cfg.train_ratio)), dates - 2)
    rest = dates - first
    count = min(cfg.folds, max(1, rest // 2))
    width = max(1, rest // (count * 2))
    out = []
    for f in range(count):
        train = first + 2 * f * width
        valid = train + width
        test = valid + width
        if valid >= dates:
            break
        if f == count - 1 or test > dates:
            test = dates
        out.append((f + 1, train, valid, test))
    return out


def fold_dates(df: DataFrame, cfg: FoldConfig | None = None) -> tuple[DataFrame, list[int]]:
    """(one row with the last dates of train, valid and test of each fold, the folds' numbers)."""
    ranks = materialise(df.select("trade_date").distinct())
    numbered = row_numbers(ranks, ["trade_date"], "tm_rank")
    date = lambda k: F.max(F.when(F.col("tm_rank") == k, F.col("trade_date")))
    bounds = fold_bounds(ranks.count(), cfg)
    folds = F.array(*[F.struct(F.lit(f).alias("fold"), date(a).alias("tm_a"), date(b).alias("tm_b"), date(c).alias("tm_c")) for f, a, b, c in bounds])
    return materialise(numbered.agg(folds.alias("tm_folds"))), [f for f, *_ in bounds]


def _split(rows: DataFrame) -> DataFrame:
    split = F.when(F.col("trade_date") <= F.col("tm_a"), "train").when(F.col("trade_date") <= F.col("tm_b"), "valid").otherwise("test")
    return rows.withColumn("split", split).drop("tm_a", "tm_b", "tm_c")


def in_fold(df: DataFrame, bounds: DataFrame, fold: int) -> DataFrame:
    """The rows of one fold, with ``fold`` and ``split``; ``bounds`` are those of ``fold_dates``."""
    own = df.crossJoin(F.broadcast(bounds.select(F.inline("tm_folds")).where(F.col("fold") == fold)))  # one row
    return _split(own.where(F.col("trade_date") <= F.col("tm_c")))


def walk_forward(df: DataFrame, cfg: FoldConfig | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Assign rows to folds: one row for each row and fold it takes part in, with ``fold`` and ``split``."""
    bounds = fold_dates(df, cfg)[0] if bounds is None else bounds
    rows = df.crossJoin(F.broadcast(bounds))  # one row: it goes to the rows, which stay where they are
    return _split(rows.select(*df.columns, F.inline(F.filter("tm_folds", lambda x: F.col("trade_date") <= x["tm_c"]))))


def fold_summary(assigned: DataFrame) -> DataFrame:
    """Rows and date range of each fold and split."""
    return assigned.groupBy("fold", "split").agg(F.count("*").alias("rows"), F.min("trade_date").alias("start"), F.max("trade_date").alias("end"))


def latest_by(df: DataFrame, key: str, stamp: str) -> DataFrame:
    """The row with the latest stamp of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(stamp))
    return df.withColumn("tm_k", F.row_number().over(w)).where("tm_k = 1").drop("tm_k")

"""Boosted-tree filter of trades: encoding, fitting with early stopping, scoring, and the training run."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tidemark.functions.ordering import row_numbers
from tidemark.functions.tables import join_on, materialise
from tidemark.operators.analytics import conditions
from tidemark.operators.boosting import BoostConfig, ColumnInputs, fit_boosted
from tidemark.operators.dataset import KEYS, LABELS, LEAKAGE, FoldConfig, fold_dates, in_fold, quality_features, sample_weight, walk_forward
from tidemark.operators.performance import trading_metrics
from tidemark.operators.ranking import RankingConfig, best_ratio, condition_lift, flag_selected, keep_ratio_sweep, rank_percent

#: Raw price levels, which carry no information across time (fixed names).
RAW_LEVELS = frozenset(["entry", "initial_stop", "target", "demand_zone_entry", "demand_zone_stop", "supply_zone_entry", "supply_zone_stop", "sr_nearest_resistance", "sr_nearest_support", "vp_reference_poc", "liquidity_pool_high", "liquidity_pool_low"])


@dataclass(frozen=True)
class TrainConfig:
    target: str = "label_positive"
    trees: int = 400
    depth: int = 4
    rate: float = 0.04
    subsample: float = 0.85
    columns: float = 0.85
    min_child_weight: float = 2.0
    l2: float = 1.0
    l1: float = 0.0
    patience: int = 40
    seed: int = 42
    parallel: int = 3  # folds that are trained side by side
    folds: FoldConfig = field(default_factory=FoldConfig)
    ranking: RankingConfig = field(default_factory=RankingConfig)


def feature_columns(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """(numeric, text) columns to learn from: no keys, labels, outcomes or raw price levels."""
    skip = {"row_id", "trade_no", "trade_date", "entry_bar", "source_file", "schema_version", "fold", "split", "score", target, *LABELS} | LEAKAGE | RAW_LEVELS
    numeric = [c for c, k in df.dtypes if c not in skip and k in ("int", "bigint", "double", "float", "boolean", "smallint", "tinyint")]
    text = [c for c, k in df.dtypes if c not in skip and k == "string"]
    return numeric, text


def encoder(train: DataFrame, target: str):
    """One encoder fitted on the training rows: one-hot text with a place for unknown values, numbers with 0 for null.

    Columns without any training value are left out.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    numeric, text = feature_columns(train, target)
    filled = train.agg(*[F.count(c).alias(c) for c in (*numeric, *text)]).first()
    numeric, text = [c for c in numeric if filled[c]], [c for c in text if filled[c]]
    stages = []
    if text:
        stages += [StringIndexer(inputCols=text, outputCols=[f"{c}_i" for c in text], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in text], outputCols=[f"{c}_v" for c in text], dropLast=False)]
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}_v" for c in text]], outputCol="features"))
    return Pipeline(stages=stages), numeric


def prepared(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Numbers without nulls."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}) if numeric else df


def labels_of(encode: PipelineModel) -> dict[str, list[str]]:
    """Known values of each text column of a fitted encoder."""
    found = {}
    for stage in encode.stages:
        if hasattr(stage, "labelsArray"):
            found |= {c: list(known) for c, known in zip(stage.getInputCols(), stage.labelsArray, strict=True)}
    return found


def fit_scorer(train: DataFrame, valid: DataFrame | None, cfg: TrainConfig):
    """Fit the trees on weighted rows; a validation part stops them early. Returns a scoring function, the model and the encoder."""
    pipe, numeric = encoder(train, cfg.target)
    encode = pipe.fit(prepared(train, numeric))
    rows = train.withColumn("tm_valid", F.lit(False))
    if valid is not None:
        rows = rows.unionByName(valid.withColumn("tm_valid", F.lit(True)))
    inputs = ColumnInputs(numeric, labels_of(encode))  # the encoder's values without its vectors
    model = fit_boosted(rows.withColumn("weight", sample_weight()), cfg.target, BoostConfig(cfg.trees, cfg.depth, cfg.rate, cfg.subsample, cfg.columns, cfg.min_child_weight, cfg.l2, cfg.l1, cfg.patience, cfg.seed), inputs)

    def score(df: DataFrame) -> DataFrame:
        return df.select(*df.columns, model.scores(inputs).alias("score"))

    return score, model, encode


def feature_names(encoded: DataFrame) -> list[str]:
    """Names of the assembled features in their order."""
    groups = encoded.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    return [a["name"] for a in sorted((a for group in groups.values() for a in group), key=lambda a: a["idx"])]


def importance(encoded: DataFrame, model) -> DataFrame:
    """Non-zero importances by feature name, largest first. ``encoded`` is a table with the assembled features."""
    names = dict(enumerate(feature_names(encoded)))
    values = model.featureImportances
    rows = [(names.get(int(i), f"feature_{int(i)}"), float(v)) for i, v in zip(values.indices, values.values, strict=True) if v > 0]
    return encoded.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@dataclass
class Training:
    """Result of a walk-forward training: tables by name, the model refitted on all rows, and what is known of it."""

    tables: dict[str, DataFrame]
    model: PipelineModel
    metadata: dict
    summary: dict


def _metrics_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline and filtered metrics for each key, side by side as ``baseline_*`` and ``filtered_*``."""
    both = {}
    for kind, part in (("baseline", df), ("filtered", df.where("selected > 0"))):
        rows = trading_metrics(part, keys=keys)
        both[kind] = rows.withColumnsRenamed({c: f"{kind}_{c}" for c in rows.columns if c not in keys})
    return join_on(both["baseline"], both["filtered"], keys, "left")


def prediction_metrics(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What a stored selection does to the results: baseline and filtered metrics, rows kept, folds, for each key.

    Rows without a ``row_id`` are numbered by date and the other keys of a trade.
    """
    keys = keys or []
    if "row_id" not in predictions.columns:
        predictions = row_numbers(predictions, [c for c in ("trade_date", *KEYS) if c in predictions.columns])
    kept = predictions.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.col("selected") > 0).alias("kept"), F.count_distinct("fold").alias("folds"))
    return join_on(kept, _metrics_of(predictions, keys), keys, "left")


def fold_table(assigned: DataFrame, predictions: dict[str, DataFrame]) -> DataFrame:
    """One row for each fold: rows and date range of its splits, and results of baseline and filtered trades."""
    ranges = None
    for split in ("train", "valid", "test"):
        part = assigned.where(F.col("split") == split).groupBy("fold").agg(F.count("*").alias(f"{split}_rows"), F.min("trade_date").alias(f"{split}_start"), F.max("trade_date").alias(f"{split}_end"))
        ranges = part if ranges is None else ranges.join(part, "fold", "left")
    for split, wanted in (("valid", ("pnl",)), ("test", ("pnl", "expectancy_r", "profit_factor", "max_drawdown_r"))):
        rows = _metrics_of(predictions[split], ["fold"])
        ranges = ranges.join(rows.select("fold", *[F.col(f"{kind}_{c}").alias(f"{split}_{kind}_{c}") for c in wanted for kind in ("baseline", "filtered")]), "fold", "left")
    return ranges.orderBy("fold")


def side_by_side(spark: SparkSession, items: list, work, most: int) -> list:
    """Results of ``work`` for every item, in their order; at most ``most`` at once, each in a scheduler pool of its own."""

    def run(numbered):
        number, item = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"tidemark-{number % most}")
        return work(item)

    with ThreadPoolExecutor(max(1, most)) as threads:
        return list(threads.map(inheritable_thread_target(spark)(run), enumerate(items)))


def scored_fold(own: DataFrame, cfg: TrainConfig) -> dict[str, DataFrame]:
    """Scored validation and test rows of one fold."""
    score, _, _ = fit_scorer(own.where("split = 'train'"), own.where("split = 'valid'"), cfg)
    return {split: score(own.where(F.col("split") == split)) for split in ("valid", "test")}


def train_filter(data: DataFrame, cfg: TrainConfig | None = None) -> Training:
    """Walk-forward training of the filter.

    A model for each fold scores its validation and test rows; the ratio to keep
    is chosen on all validation rows and applied to both splits; one more model is
    fitted on all rows. Needs six distinct dates. Folds are trained side by side,
    ``cfg.parallel`` at once: a level of a small tree leaves most of a cluster idle.
    """
    cfg = cfg or TrainConfig()
    data = materialise(quality_features(data))
    bounds, folds = fold_dates(data, cfg.folds)
    rows = walk_forward(data, cfg.folds, bounds)
    scored: dict[str, DataFrame | None] = {"valid": None, "test": None}
    for parts in side_by_side(data.sparkSession, folds, lambda fold: scored_fold(in_fold(data, bounds, fold), cfg), cfg.parallel):
        for split, part in parts.items():
            scored[split] = part if scored[split] is None else scored[split].unionByName(part)
    ranked = {s: rank_percent(df) for s, df in scored.items()}
    sweep = materialise(keep_ratio_sweep(ranked["valid"], cfg.ranking))
    ratio = best_ratio(sweep).first()["keep_ratio"]
    chosen = {s: materialise(flag_selected(df, ratio)) for s, df in ranked.items()}
    flags = [c for c in conditions(data)]
    lifts = {s: condition_lift(df, df.where("selected > 0"), flags) if flags else df.sparkSession.createDataFrame([], "feature string, baseline_freq double, accepted_freq double, lift double") for s, df in chosen.items()}
    _, trees, encode = fit_scorer(data, None, cfg)
    encoded = encode.transform(prepared(data, feature_columns(data, cfg.target)[0]))
    found = importance(encoded, trees)
    keys = [c for c in KEYS if c in data.columns]
    columns = [*keys, "fold", "pnl_cash", "pnl_r", cfg.target, "rank_pct", "selected"]
    names = feature_names(encoded)
    metadata = {"target": cfg.target, "keep_ratio": float(ratio), "selection_method": "walk_forward_top_x_percent", "walk_forward_folds": len(folds), "feature_columns": names, "config": asdict(cfg)}
    tables = {
        "validation_keep_ratio_sweep": sweep.drop("cutoff_score"), "validation_predictions": chosen["valid"].select(columns), "test_predictions": chosen["test"].select(columns),
        "walk_forward_fold_summary": fold_table(rows, chosen), "validation_confluence_lift": lifts["valid"], "test_confluence_lift": lifts["test"], "feature_importance": found,
    }
    totals = {s: prediction_metrics(df).first().asDict() for s, df in chosen.items()}  # one row each
    summary = {"evaluation_mode": "walk_forward", "walk_forward_folds": len(folds), "initial_train_ratio": cfg.folds.train_ratio, "selected_keep_ratio": float(ratio), "feature_count": len(names), "validation": totals["valid"], "test": totals["test"]}
    whole = PipelineModel(stages=[*encode.stages, trees])
    return Training(tables, whole, metadata, summary)

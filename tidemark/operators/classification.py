"""Classification metrics of predictions: confusion, ROC, average precision, per run and pooled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ordering import FEW, row_numbers, with_running
from tidemark.functions.tables import fetched, join_on, release, stored


def confusion(df: DataFrame, keys: list[str], target: str = "label", chosen: str = "selected") -> DataFrame:
    """Counts and rates of a selection against the target."""
    t, c = F.col(target) == 1, F.col(chosen) == 1
    base = df.groupBy(*keys).agg(F.count_if(t & c).alias("tp"), F.count_if(~t & c).alias("fp"), F.count_if(t & ~c).alias("fn"), F.count_if(~t & ~c).alias("tn"), F.count("*").alias("rows"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    out = base.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "accuracy": share(tp + tn, F.col("rows")), "selected_rate": share(tp + fp, F.col("rows")), "positive_rate": share(tp + fn, F.col("rows"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", share(2 * p * r, p + r))


def _by_score(df: DataFrame, keys: list[str], target: str, score: str) -> DataFrame:
    """One row for each distinct score: positives and rows. Ties are one threshold, so all curves start here."""
    return df.groupBy(*keys, score).agg(F.sum((F.col(target) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))


def roc_auc(df: DataFrame, keys: list[str], target: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by average ranks; NULL with one class only."""
    cells = _by_score(df, keys, target, score).withColumn("neg", F.col("n") - F.col("pos"))
    cells = with_running(row_numbers(cells, [score], "tm_rank", keys), {"tm_upto": F.col("neg")}, "tm_rank", keys)
    wins = F.sum(F.col("pos") * (F.col("tm_upto") - F.col("neg") / 2.0))
    out = cells.groupBy(*keys).agg(wins.alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return out.select(*keys, F.try_divide(F.col("w"), (F.col("p") * F.col("q")).cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, keys: list[str], order: str, target: str = "label", score: str = "score") -> DataFrame:
    """Mean precision at each positive row, by falling score and then row order; 0 without positives."""
    ranked = row_numbers(df.select(*keys, score, order, target), [F.desc(score), order], "tm_rank", keys)
    run = with_running(ranked, {"tm_hits": (F.col(target) == 1).cast("long")}, "tm_rank", keys)
    hit = F.when(F.col(target) == 1, F.col("tm_hits") / F.col("tm_rank"))
    return run.groupBy(*keys).agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("average_precision"))


def roc_points(df: DataFrame, keys: list[str], target: str = "label", score: str = "score") -> DataFrame:
    """False and true positive rates at every distinct threshold."""
    cells = _by_score(df, keys, target, score).withColumn("neg", F.col("n") - F.col("pos"))
    run = with_running(row_numbers(cells, [F.desc(score)], "tm_rank", keys), {"tm_neg": F.col("neg"), "tm_pos": F.col("pos")}, "tm_rank", keys)
    run = join_on(run, cells.groupBy(*keys).agg(F.sum("neg").alias("tm_all_neg"), F.sum("pos").alias("tm_all_pos")), keys)
    rate = lambda c: F.try_divide(F.col(f"tm_{c}").cast("double"), F.col(f"tm_all_{c}"))
    return run.select(*keys, F.col(score).alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))


def _with_positives(rows: DataFrame) -> DataFrame:
    """Add to sorted partitions tm_pos (positive rows of the partition so far) and tm_tied (its neighbours may have the same key and score).

    The first and the last row of a batch count as tied, as their neighbours aren't seen.
    """

    def run(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                pos = total + np.cumsum(batch.column("tm_y").to_numpy(zero_copy_only=False))
                total, group = int(pos[-1]), batch.column("tm_group").to_numpy(zero_copy_only=False)
                same = np.concatenate([[True], group[1:] == group[:-1], [True]])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pos, pa.int64()), pa.array(same[1:] | same[:-1])], [*batch.schema.names[:-1], "tm_pos", "tm_tied"])

    fields = [f for f in rows.schema.fields if f.name != "tm_group"]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("tm_pos", T.LongType()), T.StructField("tm_tied", T.BooleanType())]))


def curve_areas(df: DataFrame, keys: list[str], order: str, target: str = "label", score: str = "score") -> DataFrame:
    """``roc_auc`` and ``average_precision`` of each key by one sort: a small table, whose long ones are gone when it is there.

    Rows are stored by falling score with the positives that their partition has so far; those of earlier
    partitions are added from a table of partitions. A positive row then knows its place and the negatives
    above it. Of equal scores half of the pairs count, so rows that share theirs are put right by groups.
    """
    y = F.coalesce((F.col(target) == 1).cast("int"), F.lit(0))
    rows = df.select(*keys, F.col(score).alias("tm_s"), F.col(order).alias("tm_o"), y.alias("tm_y"))
    by = [*map(F.col, keys), F.desc("tm_s"), F.col("tm_o")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = ranged.select(*keys, "tm_s", "tm_y", F.monotonically_increasing_id().alias("tm_m"), F.xxhash64(*keys, F.col("tm_s")).alias("tm_group"))
    table = stored(_with_positives(ranged))
    try:
        placed = table.withColumns({"tm_part": F.shiftright("tm_m", 33), "tm_at": F.col("tm_m").bitwiseAND((1 << 33) - 1)}).drop("tm_m")
        counts = placed.groupBy("tm_part", *keys).agg(F.count("*").alias("tm_n"), F.sum("tm_y").alias("tm_p"), F.min("tm_at").alias("tm_first"), F.min(F.col("tm_pos") - F.col("tm_y")).alias("tm_base"))
        earlier = Window.partitionBy(*keys).orderBy("tm_part").rowsBetween(Window.unboundedPreceding, -1)
        before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
        shifts = counts.select("tm_part", *keys, (before("tm_n") - F.col("tm_first") + 1).alias("tm_shift"), (before("tm_p") - F.col("tm_base")).alias("tm_lift"))
        if counts.count() <= FEW:
            shifts = F.broadcast(shifts)
        run = join_on(placed, shifts, ["tm_part", *keys]).withColumns({"tm_rank": F.col("tm_at") + F.col("tm_shift"), "tm_hits": F.col("tm_pos") + F.col("tm_lift")})
        above = F.sum(F.when(F.col("tm_y") == 1, F.col("tm_rank") - F.col("tm_hits")).otherwise(0))
        whole = run.groupBy(*keys).agg(F.sum("tm_y").alias("tm_p"), F.count("*").alias("tm_n"), above.alias("tm_above"), F.avg(F.when(F.col("tm_y") == 1, F.col("tm_hits") / F.col("tm_rank"))).alias("tm_ap"))
        tied = run.where("tm_tied").groupBy(*keys, "tm_s").agg(F.sum("tm_y").alias("p"), F.count("*").alias("n"), above.alias("above"), F.min("tm_rank").alias("r"), F.min(F.col("tm_hits") - F.col("tm_y")).alias("h"))
        half = F.col("p") * (F.col("n") - F.col("p")) / 2.0 - (F.col("above") - F.col("p") * (F.col("r") - 1 - F.col("h")))
        out = join_on(whole, tied.groupBy(*keys).agg(F.sum(half).alias("tm_half")), keys, "left")
        pairs = (F.col("tm_p") * (F.col("tm_n") - F.col("tm_p"))).cast("double")
        area = F.try_divide(pairs - F.col("tm_above") - F.coalesce("tm_half", F.lit(0.0)), pairs)
        return fetched(out.select(*keys, area.alias("roc_auc"), F.coalesce("tm_ap", F.lit(0.0)).alias("average_precision")))
    finally:
        release(table)


def all_metrics(df: DataFrame, keys: list[str], order: str, target: str = "label", chosen: str = "selected", score: str = "score") -> DataFrame:
    """Confusion, ROC area and average precision side by side (a row for each key, computed at once)."""
    return fetched(confusion(df, keys, target, chosen)).join(curve_areas(df, keys, order, target, score), keys)


METRICS = ("roc_auc", "average_precision", "precision", "recall", "f1", "accuracy", "selected_rate", "positive_rate")


def run_metrics(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics of each run and split, pooled metrics of each split with the means over runs as ``mean_*``).

    ``predictions`` has run, split, label, selected, ranking_score and row_id. Areas
    and precisions of one class alone are NULL.
    """
    def of(df: DataFrame, keys: list[str]) -> DataFrame:
        rows = all_metrics(df, keys, "row_id", score="ranking_score")
        single = (F.col("tp") + F.col("fn") == 0) | (F.col("fp") + F.col("tn") == 0)
        return rows.withColumn("average_precision", F.when(~single, F.col("average_precision")))

    per_run = of(predictions, ["run", "split"])
    means = per_run.groupBy("split").agg(*[F.avg(c).alias(f"mean_{c}") for c in METRICS])
    pooled = of(predictions, ["split"]).join(means, "split").select(F.lit("AGGREGATE").alias("run"), "*")
    return per_run.orderBy("run", "split"), pooled.orderBy("split")


def pooled_and_mean(per_run: DataFrame, split: str = "split") -> DataFrame:
    """An aggregate row for each split: summed counts with their rates, and mean rates over runs."""
    s = lambda c: F.sum(c).cast("double")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pooled = per_run.groupBy(split).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "rows")], share(s("tp"), s("tp") + s("fp")).alias("precision"), share(s("tp"), s("tp") + s("fn")).alias("recall"), *[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "accuracy", "f1")])
    return pooled.withColumn("run", F.lit("AGGREGATE"))

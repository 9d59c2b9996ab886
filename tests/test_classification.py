"""Areas of curves by one sort, against plain counts; what long runs leave on the disk."""

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import classification, ranking


def plain(rows):
    """ROC area by all pairs, and mean precision at positives by falling score and order."""
    pos, neg = ([r["score"] for r in rows if (r["label"] == 1) == side] for side in (True, False))
    area = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    hits, found = 0, []
    for k, r in enumerate(sorted(rows, key=lambda r: (-r["score"], r["row_id"])), 1):
        hits += r["label"] == 1
        found += [hits / k] if r["label"] == 1 else []
    return area, sum(found) / len(found) if found else 0.0


@pytest.mark.parametrize("scores", [3, 50, 100_000])
def test_areas_equal_plain_counts(spark, scores):
    """Many ties, some, and nearly none, over partitions and batches that cut groups of equal scores."""
    rng = np.random.default_rng(scores)
    rows = [(k, "abc"[int(rng.integers(3))], float(rng.integers(scores)), int(rng.integers(2))) for k in range(900)]
    rows += [(900 + k, "only", float(k % 2), 1) for k in range(4)] + [(904, None, 1.0, 1), (905, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "row_id long, run string, score double, label int").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["run"]: (r["roc_auc"], r["average_precision"]) for r in classification.curve_areas(df, ["run"], "row_id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = [r.asDict() for r in df.collect()]
    want = {run: plain([r for r in own if r["run"] == run]) for run in {r["run"] for r in own}}
    assert got.keys() == want.keys()
    for run, (area, precision) in want.items():
        assert got[run][0] == (None if area is None else pytest.approx(area, abs=1e-12)) and got[run][1] == pytest.approx(precision, abs=1e-12)


def test_one_ranking_gives_both(spark):
    df = spark.range(400).selectExpr("id as row_id", "id % 3 as fold", "cast(id * 7919 % 50 as double) as score", "id as other")
    held = []
    both = ranking.ranked_and_flagged(df, 0.35, ["row_id", "fold"], held)
    want = ranking.rank_percent(ranking.flag_selected(df, 0.35)).select("row_id", "fold", "rank_pct", "selected")
    assert sorted(map(tuple, both.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert len(held) == 1


def test_metrics_of_runs_leave_no_long_tables(spark):
    """The metrics are there as a few rows, and the tables that they were made from are gone from the shared folder."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(shared) for f in names}

    n = 20_000
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("run"), F.when(F.col("id") % 2 == 0, "test").otherwise("validation").alias("split"), (F.hash("id") % 2 == 0).cast("int").alias("label"), (F.col("id") % 5 == 0).cast("int").alias("selected"), F.rand(1).alias("ranking_score"))
    before = files()
    per_run, pooled = classification.run_metrics(df)
    assert per_run.count() == 6 and pooled.count() == 2
    assert sum(os.path.getsize(f) for f in files() - before) < n  # less than a byte a row

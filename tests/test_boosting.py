"""Boosted trees against a plain statement of second-order boosting."""

import threading
import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.boosting import BoostConfig
from tidemark.operators.model import side_by_side


def table(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.normal(size=n).round(1), rng.integers(0, 2, n), np.zeros(n)], axis=1)
    y = (x[:, 0] + 3 * x[:, 2] + rng.normal(size=n) > 7).astype(float)
    w = 1 + rng.integers(0, 4, n).astype(float)
    rows = [(k, [float(v) for v in x[k]], float(w[k]), bool(k % 4 == 0), int(y[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "k int, x array<double>, weight double, tm_valid boolean, label int").withColumn("features", array_to_vector("x"))
    return x, y, w, np.arange(n) % 4 == 0, df.repartition(5, "k")


def plain_tree(x, g, h, cfg, edges):
    """Splits of one tree, tried edge by edge: {path: (feature, threshold)}, and the value of every row."""
    out, value = {}, np.zeros(len(x))
    score = lambda a, b: np.sign(a) * max(abs(a) - cfg.l1, 0)

    def grow(rows, path):
        best = None
        for f in range(x.shape[1]):
            for cut in edges[f].tolist():
                left, right = rows[x[rows, f] < cut], rows[x[rows, f] >= cut]
                sums = [(g[r].sum(), h[r].sum()) for r in (left, right, rows)]
                if min(sums[0][1], sums[1][1]) < cfg.min_child_weight:
                    continue
                gain = sum(s * score(a, b) ** 2 / (b + cfg.l2) for s, (a, b) in zip((1, 1, -1), sums, strict=True))
                if gain > 1e-6 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, cut, left, right)
        if best is None or len(path) == cfg.depth:
            a, b = g[rows].sum(), h[rows].sum()
            value[rows] = -score(a, b) / (b + cfg.l2) * cfg.rate if path else 0
            return
        out[path] = best[1:3]
        grow(best[3], (*path, 0))
        grow(best[4], (*path, 1))

    grow(np.arange(len(x)), ())
    return out, value


def splits_of(tree):
    out, stack = {}, [(0, ())]
    while stack:
        node, path = stack.pop()
        if tree["feature"][node] >= 0:
            out[path] = (tree["feature"][node], tree["threshold"][node])
            stack += [(tree["left"][node], (*path, 0)), (tree["left"][node] + 1, (*path, 1))]
    return out


@pytest.mark.parametrize(("l1", "l2", "weight"), [(0.0, 1.0, 2.0), (3.0, 0.5, 9.0)])
def test_first_trees_equal_plain_boosting(spark, l1, l2, weight):
    x, y, w, valid, df = table(spark)
    cfg = BoostConfig(trees=3, depth=3, rate=0.3, subsample=1.0, columns=1.0, l1=l1, l2=l2, min_child_weight=weight)
    model = boosting.fit_boosted(df.withColumn("tm_valid", F.lit(False)), "label", cfg)
    margin, edges = np.zeros(len(x)), boosting.quantile_edges(df)
    for f in (0, 2, 3):  # all values of these features but the smallest
        assert edges[f].tolist() == sorted(set(x[:, f]))[1:]
    for k in range(3):
        p = 1 / (1 + np.exp(-margin))
        splits, value = plain_tree(x, w * (p - y), w * p * (1 - p), cfg, edges)
        assert splits_of(model.trees[k]) == splits and splits
        margin += value
    got = {r["k"]: r["probability"][1] for r in model.transform(df).collect()}
    assert np.allclose([got[k] for k in range(len(x))], 1 / (1 + np.exp(-margin)))


def test_validation_rows_stop_the_trees_and_teach_nothing(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 3)
    x, y, w, valid, df = table(spark, 240, 2)
    cfg = BoostConfig(trees=60, depth=4, rate=0.8, subsample=0.7, columns=0.75, patience=5, min_child_weight=0.5)
    model = boosting.fit_boosted(df, "label", cfg)
    assert 0 < len(model.trees) < 55
    scored = model.transform(df).select("k", "probability").collect()
    p = np.array([r["probability"][1] for r in sorted(scored, key=lambda r: r["k"])])
    loss = lambda q: -np.log(np.where(y > 0, q, 1 - q))[valid].mean()
    assert loss(p) < loss(np.full(len(y), 0.5)) * 0.8
    other = boosting.fit_boosted(df.withColumn("weight", F.when(F.col("tm_valid"), 99.0).otherwise(F.col("weight"))), "label", cfg)
    assert other.trees == model.trees  # weights of validation rows play no part
    importances = model.featureImportances
    assert abs(importances.values.sum() - 1) < 1e-9 and importances[3] == 0 and importances[1] == min(importances.values)


def test_stored_trees_score_alike(spark, tmp_path):
    from pyspark.ml import PipelineModel

    *_, df = table(spark, 100)
    model = boosting.fit_boosted(df, "label", BoostConfig(trees=4, depth=2))
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    a, b = ([r["probability"] for r in m.transform(df).orderBy("k").collect()] for m in (model, back))
    assert a == b


def test_work_runs_side_by_side(spark):
    """Jobs overlap, are bounded in number, run in pools of their own, and give what one after another gives."""
    running, most, pools, lock = [0], [0], set(), threading.Lock()

    def work(k):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            pools.add(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        time.sleep(0.3)
        total = spark.range(1000).where(F.col("id") % (k + 2) == 0).count()
        with lock:
            running[0] -= 1
        return k, total

    together = side_by_side(spark, list(range(5)), work, 2)
    assert most[0] == 2 and pools == {"tidemark-0", "tidemark-1"}
    assert together == side_by_side(spark, list(range(5)), work, 1)


def test_rows_are_held_in_blocks(spark):
    x, y, w, valid, df = table(spark)
    blocks = boosting.binned(df, boosting.quantile_edges(df), "label")
    assert blocks.count() <= df.rdd.getNumPartitions()
    assert blocks.agg(F.sum("n")).first()[0] == 600


def test_a_feature_of_all_distinct_values_keeps_its_last_bin(spark):
    """64 edges make 65 bins; the last one must not run into the next feature, or past the end."""
    rng = np.random.default_rng(5)
    x = np.stack([rng.permutation(4000) * 1.0, rng.permutation(4000) * 1.0], axis=1)
    y = (x[:, 1] >= 2000).astype(int)
    rows = [([float(v) for v in x[k]], 1.0, False, int(y[k])) for k in range(len(x))]
    df = spark.createDataFrame(rows, "x array<double>, weight double, tm_valid boolean, label int").withColumn("features", array_to_vector("x"))
    edges = boosting.quantile_edges(df)
    assert [len(e) for e in edges] == [64, 64]
    cfg = BoostConfig(trees=1, depth=1, subsample=1.0, columns=1.0)
    tree = boosting.fit_boosted(df, "label", cfg).trees[0]
    assert tree["feature"][0] == 1 and abs(tree["threshold"][0] - 2000) <= 63


def test_joined_features_cover_all_in_bounds():
    bins = [2, 64, 65, 2, 11, 9, 1, 5000]
    groups = boosting.joined_features(bins)
    assert sorted(f for g in groups for f in g) == list(range(len(bins)))
    assert all(len(g) == 1 or np.prod([bins[f] for f in g]) <= boosting.JOINT for g in groups)


def test_leaves_of_small_and_large_trees():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 60, (5, 700)).astype(np.uint8)
    for splits in (20, 200):
        tree, open_nodes = boosting.Tree(), [0]
        for _ in range(splits):
            node = open_nodes.pop(0)
            open_nodes += tree.split(node, int(rng.integers(5)), int(rng.integers(60)), 1.0, (float(rng.normal()), float(rng.normal())))
        want = []
        for row in cells.T:
            node = 0
            while tree.feature[node] >= 0:
                node = tree.left[node] + int(row[tree.feature[node]] > tree.bin[node])
            want.append(node)
        assert tree.leaves(cells).tolist() == want


def test_plain_columns_have_the_values_of_the_encoder(spark):
    """Nulls, unknown texts and constant columns are numbers, bins and scores as the encoder's vectors give them."""
    from tidemark.operators import model

    rows = [(k, k % 3 == 0 if k % 7 else None, float(k % 11) if k % 5 else None, "ab"[k % 2] if k % 13 else None, "c", k % 2 if k % 9 else 1 - k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, flag boolean, size double, kind string, same string, label_positive int").drop("k").repartition(3)
    pipe, numeric = model.encoder(df, "label_positive")
    encode = pipe.fit(model.prepared(df, numeric))
    inputs = boosting.ColumnInputs(numeric, model.labels_of(encode))
    later = df.unionByName(df.limit(5).withColumn("kind", F.lit("new")))
    vectors = encode.transform(model.prepared(later, numeric)).select(F.posexplode(boosting.vector_to_array("features")).alias("f", "x")).groupBy("f").agg(F.sum("x").alias("x")).orderBy("f").collect()
    batch = later.select(*[c.alias(f"x{k}") for k, c in enumerate(inputs.columns)]).toArrow().combine_chunks()
    got = inputs.matrix([c.chunk(0) for c in batch.columns], len(vectors))
    assert got.sum(axis=1).tolist() == [r["x"] for r in vectors]
    ready = encode.transform(model.prepared(df, numeric)).withColumns({"weight": F.lit(1.0), "tm_valid": F.lit(False)})
    assert [e.tolist() for e in inputs.edges(df)] == [e.tolist() for e in boosting.quantile_edges(ready)]
    cfg = BoostConfig(trees=3, depth=3, subsample=1.0, rate=0.3)
    a = boosting.fit_boosted(ready, "label_positive", cfg)
    b = boosting.fit_boosted(df.withColumns({"weight": F.lit(1.0), "tm_valid": F.lit(False)}), "label_positive", cfg, inputs)
    assert a.trees[0]["feature"] == b.trees[0]["feature"] and np.allclose(a.trees[-1]["value"], b.trees[-1]["value"])


def test_folds_are_parts_of_the_walk_forward_table(spark):
    from tidemark.operators import dataset

    df = spark.range(500).selectExpr("id as row_id", "case when id % 50 <> 7 then date_add(date'2024-01-01', cast(id % 40 as int)) end as trade_date")
    bounds, folds = dataset.fold_dates(df)
    whole = dataset.walk_forward(df)
    assert folds == sorted({r["fold"] for r in whole.collect()})
    parts = [sorted(map(tuple, dataset.in_fold(df, bounds, f).select("row_id", "fold", "split").collect())) for f in folds]
    assert parts == [sorted(map(tuple, whole.where(F.col("fold") == f).select("row_id", "fold", "split").collect())) for f in folds]
    assert "hashpartitioning" not in whole._jdf.queryExecution().executedPlan().toString()

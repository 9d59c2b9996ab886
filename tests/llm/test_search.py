"""Lexical search, whitening and curve search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import curve_search, lexical_search, storage, whitening

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked_by_force(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = Counter(x for _, t in own for x in set(t))
    asked = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, []).extend(terms(text))
    out = []
    for item, query in asked.items():
        found = []
        for doc_id, t in own:
            tf, m, score = Counter(t), 25 + 75 * len(t) * n_docs // max(1, n_terms), 0
            for x in query:
                if x in tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    score += w * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 2) for _ in range(r.randint(1, 60)))) for i in range(300)]
    rows += [(1000 + i, "copy of the same text") for i in range(40)] + [(7, "a row with a known id"), (7, "a row with a known id")]
    rows += [(2000, None), (2001, ""), (2002, ".,;!"), (2003, "x" * 200_000 + " a"), (2004, "word " * 30_000), (None, "copy a copy"), (2005, "Éa ÉA éa K İ x y"), (2006, "tab\x00nul_under`tick{brace")]
    return rows


@pytest.mark.parametrize("shard_bytes", [1, 5000, 8 << 20])
def test_ranking_equals_brute_force(spark, corpus, monkeypatch, shard_bytes):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 3)
    items = [(1, "a b c a"), (2, "copy of the same text"), (3, "unknown words"), (4, None), (5, ""), (6, "KK éa ÉA"), (6, "aa bb"), (1, "a b c a"), (None, "word x y nul tick"), (8, " ".join("abcdefghijklmnop" * 300))]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in corpus], "doc_id long, text string, score string, Rank int").repartition(3)
    found = lexical_search.search(docs, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == ranked_by_force(corpus, items)


def test_ranking_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.selectExpr("doc_id", "'..' AS text"), items).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == [(1, 1, 1, 287 * (1_000_000_000 // (1000 + 8 * 100)))]


def test_tasks_hold_few_shards(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 200)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(bound)
    index = lexical_search.build_index(spark.createDataFrame(corpus, "doc_id long, text string").coalesce(1))
    files = [r["count"] for r in index.shards.groupBy(F.input_file_name()).count().collect()]
    assert sum(files) > 20 and max(files) <= lexical_search.FILE_SHARDS
    assert int(spark.conf.get(bound)) == storage.BATCH_BYTES


def test_best_keeps_all_ties():
    scores, ids = np.array([5, 9, 5, 5, 1]), np.array([40, 7, 3, 20, 1])
    assert ids[lexical_search.best(scores, ids, 3)].tolist() == [7, 3, 20]


def vector_rows(n, dims, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dims)) * np.linspace(0.2, 2, dims)
    return x.astype(np.float32).astype(float).tolist()


def odd_vectors(dims):
    one = [1.0] * dims
    return [None, [], [None, *one[1:]], [float("nan"), *one[1:]], [float("inf"), *one[1:]], [*one, 2.0], [2.0**57, *one[1:]]]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_by_plain_numpy(spark, kind):
    good = vector_rows(400, 6)
    rows = [(i, v) for i, v in enumerate(good)] + [(5, good[5]), (None, good[6])]
    odd = [(9000 + i, v) for i, v in enumerate(odd_vectors(6))]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows + odd], f"vec_id long, embedding array<{kind}>, whitened double, Component string").repartition(5)
    found = whitening.whiten(df, components=4)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = found.toPandas()
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    z = x - sums / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    want = z @ axes / np.sqrt(values)
    assert len(got) == 4 * n and set(got.n) == {n}
    assert np.allclose(got.groupby("component").explained.first(), values / np.trace(z.T @ z / n), rtol=1e-9)
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    ids = [i for i, _ in rows]
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    for c in range(1, 5):
        own = got[got.component == c]
        for k in (0, 17, 399):
            row = own[own.vec_id == ids[k]].iloc[0]
            assert abs(abs(row.whitened) - abs(want[k, c - 1])) < 1e-9 and row.deviation == deviation[k]
    assert (got.vec_id == 5).sum() == 8 and got.vec_id.isna().sum() == 4


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], schema)).toPandas()
    assert set(flat.component) == {1} and np.allclose(flat.explained, 1)


def test_deviations_that_fit_no_long(spark):
    rows = [(0, [2.0**50, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got.deviation.isna().all() and set(got.n) == {3}
    centre = whitening.Centre(3, np.array([10, 10]), np.array([1, 2]))
    big = np.array([[10 + (1 << 40), 10], [11, 12]])
    assert centre.exact(big) == [None, (3 * 1 - 1) ** 2 + (3 * 2 - 2) ** 2]


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_the_curve_visits_neighbouring_cells(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
    index = curve_search.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def nearest_by_force(rows, every=20, k=20):
    out = []
    x = np.array([v for _, v in rows])
    for q, (i, v) in enumerate(rows):
        if i % every == 0:
            s = (x * np.array(v)).sum(axis=1)
            others = sorted((-s[j], rows[j][0]) for j in range(len(rows)) if j != q)[:k]
            out += [(i, r, j, -d) for r, (d, j) in enumerate(others, 1)]
    return Counter(out)


def test_curve_search_is_exact_in_a_window_with_copies_and_odd_rows(spark):
    good = vector_rows(200, 5)
    rows = [(i, v) for i, v in enumerate(good)] + [(1000 - i, good[20]) for i in range(70)] + [(40, good[41]), (60, good[60]), (60, good[60])]
    rows += [(300 + i, [3.0 * (i % 3 == k) for k in range(5)]) for i in range(60)] + [(400, [-0.0, 1.0, 0.0, 0.0, 0.0]), (401, [0.0, 1.0, 0.0, 0.0, 0.0])]
    odd = [(2000 + 20 * i, v) for i, v in enumerate([*odd_vectors(5), [0.0] * 5])] + [(None, good[0])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, Score double, query_id int").repartition(5)
    found = curve_search.search(df)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == nearest_by_force(rows)


def test_curve_search_finds_nine_tenths_in_narrow_windows(spark, monkeypatch):
    for name, value in (("LEAST_WINDOW", 40), ("LEAST_TILE", 32), ("MOST_TILE", 64), ("STEP", 16)):
        monkeypatch.setattr(curve_search, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(30, size=3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    found, true = Counter(tuple(r) for r in curve_search.search(df).collect()), nearest_by_force(rows)
    assert len(found) == len(true)
    pairs = {(q, v) for q, _, v, _ in true}
    hits = sum((q, v) in pairs for q, _, v, _ in found) / len(true)
    assert 0.9 <= hits
    assert all(abs(s - float((x[q] * x[v]).sum())) < 1e-12 for q, _, v, s in found)


def test_curve_search_of_nothing(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, [1.0]), (2, [2.0])], [(20, [1.0])], [(20, None)], [(20, [0.0])]):
        assert curve_search.search(spark.createDataFrame(rows, schema)).count() == 0
    pair = curve_search.search(spark.createDataFrame([(20, [1.0]), (3, [-2.0])], schema))
    assert [tuple(r) for r in pair.collect()] == [(20, 1, 3, -2.0)]

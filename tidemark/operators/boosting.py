"""Boosted trees for two classes by second-order histogram boosting.

Numbers become bins of their quantiles once. A level of a tree is one aggregation
of gradients and hessians by node, feature and bin, of which the tasks send partial
sums; the driver sees a histogram, never rows, and chooses the splits. Rows are held
in compressed blocks, feature by feature, which a task takes as arrays. They keep the
margin of earlier trees, and a task finds their places in the open tree anew, so no
state is written between levels.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.tables import materialise

#: Bins of a feature, and trees after which the rows' margins are stored.
BINS, STORE_EVERY = 64, 10
#: Rows and bytes of bins of a block, bytes of compressed blocks that a task is given at once, and joint bins of features that are summed together.
BLOCK_ROWS, BLOCK_BYTES, BATCH_BYTES, JOINT = 1 << 14, 1 << 22, 1 << 20, 1 << 12
#: Table of blocks: the first row's number, rows, packed columns (bins, target, validation, weight), packed margins (none: all 0).
_BLOCKS = "first long, n long, data binary, margin binary"
#: Gains closer than this share count as equal (the first feature and bin wins), so that the order of sums decides nothing.
TIE = 1e-9


@dataclass(frozen=True)
class BoostConfig:
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


_SHARES = [k / BINS for k in range(1, BINS)]


def quantile_edges(train: DataFrame) -> list[np.ndarray]:
    """Ascending inner edges of the bins of each feature; a value's bin is the number of edges up to it."""
    cells = train.select(F.posexplode(vector_to_array("features")).alias("f", "x"))
    found = cells.groupBy("f").agg(F.percentile_approx("x", _SHARES, 10_000).alias("q"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("f").collect()  # a row for each feature
    # the largest value is an edge too: what few rows hold can still be split off
    return [np.array(sorted(({*r["q"], r["high"]}) - {r["low"]})) for r in found]


class VectorInputs:
    """Features that are there as the vectors of a column."""

    @property
    def columns(self) -> list[Column]:
        return [vector_to_array("features")]

    def edges(self, train: DataFrame) -> list[np.ndarray]:
        return quantile_edges(train)

    def matrix(self, arrays: list[pa.Array], features: int) -> np.ndarray:
        """Features of a batch, feature by feature."""
        return arrays[0].flatten().to_numpy(zero_copy_only=False).reshape(len(arrays[0]), features).T


class ColumnInputs:
    """Features of plain columns, in the order and with the values that an encoder gives them.

    Numbers come first (0 for null), then for each text one place for each label and one for other
    values. Tasks are sent the columns as they are and spread them out in arrays.
    """

    def __init__(self, numeric: list[str], labels: dict[str, list[str]]):
        self.numeric, self.labels = numeric, labels

    @property
    def columns(self) -> list[Column]:
        return [*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.numeric], *map(F.col, self.labels)] or [F.lit(0.0)]

    def edges(self, train: DataFrame) -> list[np.ndarray]:
        own = dict(enumerate(self.columns[: len(self.numeric)]))
        asked = [F.count("*").alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(self.labels)]]
        for i, x in own.items():
            asked += [F.percentile_approx(x, _SHARES, 10_000).alias(f"q{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        r = train.agg(*asked).first()
        out = [np.array(sorted({*(r[f"q{i}"] or []), r[f"h{i}"]} - {r[f"l{i}"]})) for i in own]
        for i, known in enumerate(self.labels.values()):
            other = r[f"c{i}"] < r["n"]  # a place that all or no rows have has no edge
            out += [np.array([1.0] if other or len(known) > 1 else [])] * len(known) + [np.array([1.0] if other else [])]
        return out

    def matrix(self, arrays: list[pa.Array], features: int) -> np.ndarray:
        """Features of a batch, feature by feature."""
        x = np.zeros((features, len(arrays[0])))
        for k in range(len(self.numeric)):
            x[k] = arrays[k].to_numpy(zero_copy_only=False)
        if np.isnan(x).any():
            raise ValueError("features must not be NaN")
        at = len(self.numeric)
        for array, known in zip(arrays[len(self.numeric) :], self.labels.values(), strict=False):
            code = pc.fill_null(pc.index_in(array, value_set=pa.array(known, array.type)), len(known)).to_numpy(zero_copy_only=False)
            x[at + code, np.arange(len(code))] = 1.0
            at += len(known) + 1
        return x


def packed(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(c.tobytes() for c in columns), "zstd", asbytes=True)


def block_of(first: int, cells: np.ndarray, y: np.ndarray, valid: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """A block of consecutive rows; ``cells`` has a row for each feature."""
    data = packed(cells, (y > 0).astype(np.uint8), valid.astype(np.uint8), w.astype(np.float64))
    return pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "n": pa.array([len(y)], pa.int64()), "data": pa.array([data], pa.binary()), "margin": pa.array([b""], pa.binary())})


def unpacked(batches, features: int):
    """(first, bins by feature, target, validation, weight, margin, data as stored) of every block."""
    for batch in batches:
        for first, n, data, margin in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            raw = pa.decompress(data, n * (features + 10), "zstd", asbytes=True)
            cells = np.frombuffer(raw, np.uint8, n * features).reshape(features, n)
            y, valid = (np.frombuffer(raw, np.uint8, n, n * (features + k)) for k in (0, 1))
            w = np.frombuffer(raw, np.float64, n, n * (features + 2))
            m = np.frombuffer(pa.decompress(margin, 8 * n, "zstd", asbytes=True), np.float64).copy() if margin else np.zeros(n)
            yield first, cells, y, valid.astype(bool), w, m, data


def binned(rows: DataFrame, edges: list[np.ndarray], target: str, inputs: VectorInputs | ColumnInputs | None = None) -> DataFrame:
    """Blocks of rows with features, weight, tm_valid and the target (0 or 1)."""
    features, inputs = len(edges), inputs or VectorInputs()
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, features)))

    def run(batches):
        first, held, n = 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not n:
                first = batch.column(0)[0].as_py()
            x = inputs.matrix(batch.columns[4:], features)
            cells = np.empty(x.shape, np.uint8)
            for f, e in enumerate(edges):
                cells[f] = (x[f] >= e[0]) if len(e) == 1 else np.searchsorted(e, x[f], "right")
            held.append((cells, *[batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 3, 2)]))
            n += batch.num_rows
            if n >= most:  # rows of a partition are numbered without gaps
                cells, y, valid, w = (np.concatenate(c, axis=-1) for c in zip(*held, strict=True))
                for at in range(0, n, most):
                    cut = slice(at, at + most)
                    yield block_of(first + at, cells[:, cut], y[cut], valid[cut], w[cut])
                held, n = [], 0
        if n:
            yield block_of(first, *(np.concatenate(c, axis=-1) for c in zip(*held, strict=True)))

    own = rows.select(F.monotonically_increasing_id().alias("id"), F.col(target).cast("double").alias("y"), F.col("weight").alias("w"), F.col("tm_valid").alias("valid"), *[c.alias(f"x{k}") for k, c in enumerate(inputs.columns)])
    return own.mapInArrow(run, _BLOCKS)


class Tree:
    """Nodes as lists: feature (-1: leaf), bin (left up to it), left child (right is the next one), value, gain."""

    def __init__(self):
        self.feature, self.bin, self.left, self.value, self.gain = [-1], [0], [-1], [0.0], [0.0]

    def split(self, node: int, feature: int, at: int, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        k = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, at, k, gain
        for v in values:
            self.feature.append(-1), self.bin.append(0), self.left.append(-1), self.value.append(v), self.gain.append(0.0)
        return k, k + 1

    def leaves(self, cells: np.ndarray) -> np.ndarray:
        """Leaf of every column of bins (a row for each feature)."""
        n = cells.shape[1]
        if len(self.feature) <= 256:  # bytes, node by node: parents come before their children
            at = np.zeros(n, np.uint8)
            for node, f in enumerate(self.feature):
                if f >= 0:
                    step = (cells[f] > self.bin[node]).view(np.uint8)
                    step += np.uint8(self.left[node] - node)
                    step *= (at == node).view(np.uint8)
                    at += step
            return at
        at, feature, left, cut = np.zeros(n, np.int64), np.array(self.feature), np.array(self.left), np.array(self.bin)
        while len(go := np.flatnonzero(feature[at] >= 0)):
            node = at[go]
            at[go] = left[node] + (cells[feature[node], go] > cut[node])
        return at

    def values(self, cells: np.ndarray) -> np.ndarray:
        """Value of every column of bins."""
        return np.array(self.value)[self.leaves(cells)]


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_split(g: np.ndarray, h: np.ndarray, columns: np.ndarray, cfg: BoostConfig) -> tuple | None:
    """(gain, feature, bin, left value, right value) of a node's histograms (feature, bin); None without a gain."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    score = lambda a, b: _shrunk(a, cfg.l1) ** 2 / (b + cfg.l2)
    gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
    allowed = (left_h >= cfg.min_child_weight) & (all_h - left_h >= cfg.min_child_weight)
    gain = np.where(allowed & np.isin(np.arange(len(g)), columns)[:, None], gain, -np.inf)
    top = gain.max(initial=-np.inf)
    if not top > 1e-6:
        return None
    f, b = np.unravel_index(int(np.argmax(gain >= top * (1 - TIE))), gain.shape)
    value = lambda a, c: float(-_shrunk(a, cfg.l1) / (c + cfg.l2) * cfg.rate)
    return float(gain[f, b]), int(f), int(b), value(left_g[f, b], left_h[f, b]), value(all_g - left_g[f, b], all_h - left_h[f, b])


def chance(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for every row of a tree."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def joined_features(bins: list[int]) -> list[list[int]]:
    """Features in groups, so that the bins of a group have at most ``JOINT`` combinations (or it is one feature)."""
    groups, size = [], JOINT + 1
    for f in sorted(range(len(bins)), key=lambda f: (bins[f], f)):
        if size * bins[f] > JOINT:
            groups, size = [*groups, []], 1
        groups[-1].append(f)
        size *= bins[f]
    return groups


def level_histogram(rows: DataFrame, past: list[Tree], tree: Tree, nodes: list[int], number: int, bins: list[int], cfg: BoostConfig) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Sums of gradients and hessians by (node, feature, bin), and the validation part's sum of losses and its rows.

    ``bins`` has the number of bins of each feature. Features of few bins are summed together, by combinations.
    """
    features, groups, width = len(bins), joined_features(bins), max(bins)
    place = np.full(len(tree.feature), -1)
    place[nodes] = np.arange(len(nodes))

    def run(batches):
        sums = [np.zeros((2, len(nodes) * int(np.prod([bins[f] for f in group])))) for group in groups]
        lost = np.zeros(2)
        for first, cells, y, valid, w, margin, _ in unpacked(batches, features):
            for t in past:
                margin += t.values(cells)
            p = 1 / (1 + np.exp(-margin))
            if valid.any():
                q = np.clip(np.where(y > 0, p, 1 - p)[valid], 1e-16, 1)
                lost += (-np.log(q).sum(), valid.sum())
            at = place[tree.leaves(cells)]
            out = valid | (at < 0) | (chance(np.arange(first, first + len(y)), cfg.seed * 1_000_003 + number) >= cfg.subsample)
            w = np.where(out, 0.0, w)
            at[out] = 0
            g, h = w * (p - y), w * p * (1 - p)
            for group, total in zip(groups, sums, strict=True):
                where = at
                for f in group:
                    where = where * bins[f] + cells[f]
                total[0] += np.bincount(where, g, total.shape[1])
                total[1] += np.bincount(where, h, total.shape[1])
        full = np.zeros((2, len(nodes), features, width))
        for group, total in zip(groups, sums, strict=True):
            shape = total.reshape(2, len(nodes), *[bins[f] for f in group])
            for k, f in enumerate(group):
                full[:, :, f, : bins[f]] = shape.sum(axis=tuple(a for a in range(2, 2 + len(group)) if a != 2 + k))
        full = full.reshape(2, -1)
        used = np.flatnonzero(full.any(axis=0))
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.append(used, -1)), "g": pa.array(np.append(full[0, used], lost[0])), "h": pa.array(np.append(full[1, used], lost[1]))})

    # not more than nodes x features x bins rows
    found = rows.mapInArrow(run, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    cell, g, h = (found.column(c).to_numpy() for c in ("cell", "g", "h"))
    out = np.zeros((2, len(nodes) * features * width))
    out[0, cell[cell >= 0]], out[1, cell[cell >= 0]] = g[cell >= 0], h[cell >= 0]
    shape = (len(nodes), features, width)
    return out[0].reshape(shape), out[1].reshape(shape), float(g[cell < 0].sum()), float(h[cell < 0].sum())


def with_margins(rows: DataFrame, past: list[Tree], features: int) -> DataFrame:
    """The blocks with the values of some trees added to their margins."""

    def run(batches):
        for first, cells, y, _, _, margin, data in unpacked(batches, features):
            for t in past:
                margin += t.values(cells)
            yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "n": pa.array([len(y)], pa.int64()), "data": pa.array([data], pa.binary()), "margin": pa.array([packed(margin)], pa.binary())})

    return rows.mapInArrow(run, _BLOCKS)


def bound_batches(spark: SparkSession) -> None:
    """Give Python workers a few blocks at a time where the session sets no bound of its own."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))


def fit_boosted(ready: DataFrame, target: str, cfg: BoostConfig, inputs: VectorInputs | ColumnInputs | None = None) -> BoostedTreesModel:
    """Fit on rows with features (or what ``inputs`` reads), weight, tm_valid and the target (0 or 1).

    Rows marked as validation take no part in the trees; the number of trees with
    their smallest mean loss is kept, and fitting ends ``patience`` trees after it.
    Every tree sees a part of the rows, by a hash of their number, and of the features.
    """
    edges = (inputs or VectorInputs()).edges(ready.where("not tm_valid"))
    features, rng = len(edges), np.random.default_rng(cfg.seed)
    bins = [len(e) + 1 for e in edges]
    bound_batches(ready.sparkSession)
    rows = materialise(binned(ready, edges, target, inputs))
    trees: list[Tree] = []
    past: list[Tree] = []  # trees that the stored margins don't hold
    best, kept, watched = np.inf, 0, False
    while len(trees) <= cfg.trees and features:
        columns = np.sort(rng.permutation(features)[: max(1, int(cfg.columns * features))])
        tree, nodes = Tree(), [0]
        for level in range(cfg.depth):
            g, h, loss, valid = level_histogram(rows, past, tree, nodes, len(trees), bins, cfg)
            if level == 0:
                watched = valid > 0
                if watched and loss / valid < best:
                    best, kept = loss / valid, len(trees)
                if len(trees) == cfg.trees or watched and len(trees) - kept >= cfg.patience:
                    nodes = []
                    break
            grown = []
            for k, node in enumerate(nodes):
                split = best_split(g[k], h[k], columns, cfg)
                if split is not None:
                    gain, f, b, low, high = split
                    grown += tree.split(node, f, b, gain, (low, high))
            nodes = grown
            if not nodes:
                break
        if len(trees) == cfg.trees or watched and len(trees) - kept >= cfg.patience:
            break
        trees.append(tree)
        past = [*past, tree]
        if len(past) == STORE_EVERY and len(trees) < cfg.trees:
            rows, past = materialise(with_margins(rows, past, features)), []
    trees = trees[:kept] if watched else trees
    shown = [{"feature": t.feature, "left": t.left, "value": t.value, "gain": t.gain, "threshold": [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin, strict=True)]} for t in trees]
    return BoostedTreesModel(json.dumps({"features": features, "trees": shown}))


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (vector of both classes) to a table with ``features``; stored as JSON with its pipeline."""

    forest = Param(Params._dummy(), "forest", "trees with their thresholds, as JSON")

    def __init__(self, forest: str | None = None):
        super().__init__()
        if forest is not None:
            self._set(forest=forest)

    @property
    def trees(self) -> list[dict]:
        return json.loads(self.getOrDefault("forest"))["trees"]

    @property
    def featureImportances(self) -> SparseVector:  # noqa: N802  the name that other tree models have
        """Mean gain of a feature's splits as a share of all features'."""
        size, sums = json.loads(self.getOrDefault("forest"))["features"], {}
        for t in self.trees:
            for f, gain in zip(t["feature"], t["gain"], strict=True):
                if f >= 0:
                    a, n = sums.get(f, (0.0, 0))
                    sums[f] = (a + gain, n + 1)
        means = {f: a / n for f, (a, n) in sums.items()}
        return SparseVector(size, {f: v / sum(means.values()) for f, v in means.items()})

    def scores(self, inputs: VectorInputs | ColumnInputs) -> Column:
        """Probability of the second class."""
        forest, size = [{k: np.array(v) for k, v in t.items()} for t in self.trees], json.loads(self.getOrDefault("forest"))["features"]

        @F.arrow_udf("double")
        def scored(row: pa.Array) -> pa.Array:
            x = inputs.matrix(row.flatten(), size)
            margin = np.zeros(len(row))
            for t in forest:
                at = np.zeros(len(row), np.int64)
                while len(go := np.flatnonzero(t["feature"][at] >= 0)):
                    node = at[go]
                    at[go] = t["left"][node] + (x[t["feature"][node], go] >= t["threshold"][node])
                margin += t["value"][at]
            return pa.array(1 / (1 + np.exp(-margin)))

        return scored(F.struct(*[c.alias(f"x{k}") for k, c in enumerate(inputs.columns)]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        both = dataset.withColumn("tm_p", self.scores(VectorInputs()))
        return both.withColumn("probability", array_to_vector(F.array(1.0 - F.col("tm_p"), F.col("tm_p")))).drop("tm_p")

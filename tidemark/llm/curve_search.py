"""Approximate nearest neighbours along several shifted Hilbert curves.

1. Equal vectors become one node, so copies cost one row each from here on.
2. Vectors get one coordinate more, which makes the largest inner product the
   smallest distance on a sphere. Each curve projects them by its own random
   orthonormal axes onto a shifted grid and orders them by their Hilbert index;
   Spark's range partitioning sorts all curves at once and gives every node its
   place on each.
3. A bounded sample of queries is compared with all vectors. How far these queries
   lie from their true neighbours on the nearest curve gives the width of the
   windows: the smallest one that finds ``RECALL`` of them.
4. The curves are cut into tiles. A query goes to the tiles that its window
   touches; a task reads one tile and streams the queries past it, a matrix product
   for every batch. What the tiles find is ranked again by exact scores, and copies
   are put back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_unique
from .storage import stored
from .vectors import element_type, matrix, usable, usual_length

#: Curves, projected dimensions, bits of a grid coordinate.
CURVES, AXES, BITS = 16, 8, 7
#: Vectors that the grid is laid over, queries that the windows are measured with: bounded samples by smallest hashes.
GRID_ROWS, PROBES = 4096, 256
#: Share of the sampled queries' true neighbours that lie in the windows.
RECALL = 0.95
#: Least places on either side of a query; least and most places of a tile.
LEAST_WINDOW, LEAST_TILE, MOST_TILE = 512, 512, 16_384
#: Queries that are compared with a tile, and vectors that get their keys, at once.
STEP = 512
SEED = 20_260


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of grid coordinates below 2**bits.

    From the highest bit down, coordinates are turned into the frame of the
    subcube they lie in; a Gray code of all bits gives the order of the subcubes.
    """
    axes = [c.copy() for c in cells.T.astype(np.int64)]
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in axes:
            high = -((axis >> bit) & 1)  # all bits set where the cell lies in the upper half
            swapped = (axes[0] ^ axis) & below & ~high
            axes[0] ^= (below & high) | swapped
            axis ^= swapped if axis is not axes[0] else 0
    for before, axis in zip(axes, axes[1:], strict=False):
        axis ^= before
    flips = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        flips ^= ((1 << bit) - 1) & -((axes[-1] >> bit) & 1)
    index = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            index = (index << 1) | (((axis ^ flips) >> bit) & 1)
    return index


@dataclass(frozen=True)
class Curves:
    """Axes (curve, dims + 1, AXES), lower edges and cells of the grids (curve, AXES), longest vector's length."""

    axes: np.ndarray
    low: np.ndarray
    cell: np.ndarray
    longest: float

    def points(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit points whose distance falls as the inner product of a query and a vector rises."""
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        if query:
            return np.hstack([x / size, np.zeros_like(size)])
        return np.hstack([x, np.sqrt(np.maximum(self.longest**2 - size**2, 0))]) / self.longest

    def keys(self, points: np.ndarray, curve: int) -> np.ndarray:
        cells = ((points @ self.axes[curve] - self.low[curve]) / self.cell[curve]).clip(0, (1 << BITS) - 1)
        return hilbert_index(cells.astype(np.int64), BITS)


def lay_curves(sample: np.ndarray, longest: float, count: int) -> Curves:
    """Random axes, and grids over the sample's spread with up to a fifth of it as a shift."""
    rng, dims = np.random.default_rng(SEED), sample.shape[1]
    own = min(AXES, dims + 1)
    axes = np.zeros((count, dims + 1, AXES))
    for k in range(count):
        axes[k, :, :own] = np.linalg.qr(rng.normal(size=(dims + 1, own)))[0]
    bare = Curves(axes, np.zeros(0), np.zeros(0), longest)
    spread = bare.points(sample, False) @ axes  # (curve, rows, AXES)
    low, high = np.quantile(spread, 0.002, axis=1), np.quantile(spread, 0.998, axis=1)
    width = np.maximum((high - low) * 1.25, 1e-9)
    return Curves(axes, low - rng.uniform(0, 0.2, low.shape) * width, width / (1 << BITS), longest)


def curve_places(vectors: DataFrame, curves: Curves, nodes: int) -> DataFrame:
    """(curve, at, node, asks) of all nodes (asks: false) and of those with queries once more (asks: true)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8 * STEP):
                part = batch.slice(at, 8 * STEP)
                x, asks = matrix(part.column(2), np.dtype(np.float64)), part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for own, query in ((part.column(0), False), (part.column(0).filter(part.column(1)), True)):
                    if len(own):
                        points = curves.points(x[asks] if query else x, query)
                        for k in range(len(curves.axes)):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(curves.keys(points, k)), own, pa.array(np.full(len(own), query))], ["curve", "key", "node", "asks"])

    keyed = vectors.select("node", "asks", "vec").mapInArrow(run, "curve int, key long, node long, asks boolean")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "key", "node", "asks"]
    placed = stored(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "places")
    part = F.shiftright("id", 33)
    before, starts = 0, []
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        starts.append((row["part"], before))
        before += row["count"]
    starts = vectors.sparkSession.createDataFrame(starts, "part long, start long")
    place = F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1) - F.col("curve") * F.lit(nodes)
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select("curve", place.alias("at"), "node", "asks")


def nearest(queries: np.ndarray, own: np.ndarray, x: np.ndarray, nodes: np.ndarray, low: np.ndarray, k: int):
    """The k nearest rows of ``x`` for every query: (query, row, score) arrays, ties by ``low`` and node.

    A matrix product chooses, with room for its rounding; the scores are sums in a fixed order.
    """
    rough = queries @ x.T
    rough[own[:, None] == nodes[None, :]] = -np.inf
    if len(nodes) > k:
        last = np.partition(rough, len(nodes) - k, axis=1)[:, len(nodes) - k]
        size = np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
        who, row = np.nonzero(rough >= np.where(np.isfinite(last), last - 1e-12 * size, -np.inf)[:, None])
    else:
        who, row = np.nonzero(np.ones_like(rough, bool))
    real = np.isfinite(rough[who, row])
    who, row = who[real], row[real]
    score = (queries[who] * x[row]).sum(axis=1)
    order = np.lexsort((nodes[row], low[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    return who[place < k], row[place < k], score[place < k]


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query, node, low, score) for every query, found more than once or not."""
    once = found.groupBy("query", "node").agg(F.max("score").alias("score"), F.min("low").alias("low"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "low", "node"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


_FOUND = "query long, node long, low long, score double"


def true_neighbours(vectors: DataFrame, probes: np.ndarray, own: np.ndarray, k: int) -> DataFrame:
    """The k nearest nodes of a bounded set of queries, among all vectors."""

    def run(batches):
        held = [[np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64)]]
        for batch in batches:
            for at in range(0, batch.num_rows, 8 * STEP):
                part = batch.slice(at, 8 * STEP)
                nodes, low = part.column(0).to_numpy(), part.column(1).to_numpy()
                who, row, score = nearest(probes, own, matrix(part.column(2), np.dtype(np.float64)), nodes, low, k)
                held.append([who, nodes[row], low[row], score])
                both = [np.concatenate(c) for c in zip(*held, strict=True)]
                order = np.lexsort((both[1], both[2], -both[3], both[0]))
                both = [c[order] for c in both]
                keep = np.arange(len(order)) - np.searchsorted(both[0], both[0]) < k
                held = [[c[keep] for c in both]]
        who, *rest = held[0]
        yield pa.RecordBatch.from_arrays([pa.array(own[who]), *map(pa.array, rest)], ["query", "node", "low", "score"])

    return best_of(vectors.select("node", "low", "vec").mapInArrow(run, _FOUND), k)


def window_width(places: DataFrame, vectors: DataFrame, k: int) -> int:
    """Places on either side of a query within which ``RECALL`` of a sample's true neighbours lie on some curve."""
    sample = vectors.where("asks").orderBy(F.xxhash64("node"), "node").limit(PROBES).select("node", "vec").toArrow().combine_chunks()
    if not sample.num_rows:
        return LEAST_WINDOW
    own = sample.column("node").to_numpy()
    column = sample.column("vec").combine_chunks()
    true = true_neighbours(vectors, matrix(column, np.dtype(np.float64)), own, k).select("query", "node").toArrow()  # PROBES * k rows at most
    query, node = true.column("query").to_numpy(), true.column("node").to_numpy()
    if not len(query):
        return LEAST_WINDOW
    wanted = vectors.sparkSession.createDataFrame([(int(x),) for x in np.unique(np.concatenate([query, node]))], "node long")
    at = places.join(F.broadcast(wanted), "node").toArrow()
    curve, place, who, asks = (at.column(c).to_numpy() for c in ("curve", "at", "node", "asks"))
    known = [dict(zip(zip(curve[asks == s].tolist(), who[asks == s].tolist(), strict=True), place[asks == s].tolist(), strict=True)) for s in (False, True)]
    curves = sorted(set(curve.tolist()))
    far = [min(abs(known[1][c, q] - known[0][c, x]) for c in curves) for q, x in zip(query.tolist(), node.tolist(), strict=True)]
    return max(LEAST_WINDOW, int(np.quantile(far, RECALL, method="higher")))


def tile_of(width: int) -> int:
    """Places of a tile: half a window, within bounds."""
    return min(MOST_TILE, max(LEAST_TILE, width // 2))


def search_windows(places: DataFrame, vectors: DataFrame, width: int, k: int) -> DataFrame:
    """The k nearest of every query in its windows on all curves: (query, node, low, score)."""
    tile = tile_of(width)

    def cell(at: Column) -> Column:
        return F.floor(at / tile).cast("long")

    touched = F.when(F.col("asks"), F.sequence(F.greatest(cell(F.col("at") - width), F.lit(0)), cell(F.col("at") + width))).otherwise(F.array(cell(F.col("at"))))
    rows = places.join(vectors.select("node", "low", "vec"), "node").select("curve", F.explode(touched).alias("tile"), "asks", "node", "low", "vec")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = rows.repartition(parts, "curve", "tile").sortWithinPartitions("curve", "tile", "asks")

    def run(batches):
        key, open_ = None, []  # the open tile: its number, (nodes, low, vectors) of its batches

        def ask(part):
            nonlocal open_
            if len(open_) > 1:
                open_ = [tuple(np.concatenate(c) for c in zip(*open_, strict=True))]
            nodes, low, x = open_[0]
            own = part.column(3).to_numpy()
            for at in range(0, len(own), STEP):
                who, row, score = nearest(matrix(part.column(5).slice(at, STEP), np.dtype(np.float64)), own[at : at + STEP], x, nodes, low, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[at : at + STEP][who]), pa.array(nodes[row]), pa.array(low[row]), pa.array(score)], ["query", "node", "low", "score"])

        for batch in batches:
            heads = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part, own = batch.slice(a, b - a), tuple(heads[a, :2].tolist())
                if own != key:
                    key, open_ = own, []
                if not heads[a, 2]:
                    open_.append((part.column(3).to_numpy(), part.column(4).to_numpy(), matrix(part.column(5), np.dtype(np.float64))))
                elif open_:  # the last tiles that a window touches may be empty
                    yield from ask(part)

    return best_of(tiles.mapInArrow(run, _FOUND), k)


def search(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest rows found for each row whose key is divisible by ``every``: query_id, rank, <key>, score.

    Nearness is the inner product in double precision, largest first, ties by smaller
    key. Candidates are all rows but the query's own; equal vectors are all candidates,
    repeated rows too, and a repeated query row gets its result repeated. Rows take no
    part whose key is null or whose vector is null, empty, all zero, holds null or
    non-finite entries or ones of 2**56 and over, or has another length than most
    have. The search is approximate: windows are measured to hold ``RECALL`` of a sample's
    neighbours, what they hold is ranked exactly. With at most ``LEAST_WINDOW`` different
    vectors it is exact. Tables without queries or candidates give no rows.
    """
    spark, kind = vectors.sparkSession, element_type(vectors, column)
    schema = f"query_id long, rank int, `{key}` long, score double"

    def doubles(batches):
        for batch in batches:
            x = matrix(batch.column(2), kind)
            size = (x * x).sum(axis=1)
            wide = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 8 * x.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            columns = [batch.column(0), wide, pa.array(size), batch.column(3), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vec", "size", "h", "g"]).filter(pa.array(size > 0))

    checked = usable(vectors, key, column, digests=True).where("id is not null")
    dims = usual_length(checked)
    if not dims:
        return spark.createDataFrame([], schema)
    rows = stored(checked.where(F.col("dims") == dims).mapInArrow(doubles, "id long, vec binary, size double, h long, g long"), "vectors")
    asking = F.col("id") % every == 0
    classes = rows.groupBy("h", "g").agg(F.min("id").alias("low"), F.count("*").alias("rows"), F.count_if(asking).alias("queries"), F.max("size").alias("size"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes, asks, longest = classes.agg(F.count("*"), F.count_if(F.col("queries") > 0), F.max("size")).first()
    if not asks:
        return spark.createDataFrame([], schema)

    once = rows.select(F.col("id").alias("low"), "h", "g", "vec").dropDuplicates(["h", "g", "low"])
    points = stored(once.join(classes.select("h", "g", "low", "node", (F.col("queries") > 0).alias("asks")), ["h", "g", "low"]).select("node", "low", "asks", "vec"), "points")
    sample = points.select("vec").orderBy(F.xxhash64("node")).limit(GRID_ROWS).toArrow().column("vec").combine_chunks()
    curves = lay_curves(matrix(sample, np.dtype(np.float64)), float(np.sqrt(longest)), CURVES)
    places = curve_places(points, curves, nodes + asks)
    found = search_windows(places, points, window_width(places, points, k), k)

    # the query's own node holds its copies
    self_ = classes.where("queries > 0").select(F.col("node").alias("query"), "node", "low", F.col("size").alias("score"))
    found = stored(found.select("query", "node", "score").union(self_.select("query", "node", "score")), "found")
    copied = join_unique(rows.select("h", "g", "id"), classes.where("rows > 1").select("h", "g", "node", F.col("rows").alias("n")), ["h", "g"])
    first = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    copied = copied.withColumn("place", first).where(F.col("place") <= k + 1).groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    counts = found.groupBy("node").agg(F.count("*").alias("n"))
    ids = stored(counts.join(classes.select("node", "low"), "node").join(copied, "node", "left").select("node", "n", F.coalesce("ids", F.array("low")).alias("ids")), "ids")
    near = join_unique(found, ids, ["node"])
    entries = near.select("query", F.explode("ids").alias("id"), "score", (F.col("query") == F.col("node")).alias("own"))
    lists = entries.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((0 - F.col("score")).alias("far"), "id", "own"))), 1, k + 1).alias("near"))
    answers = stored(classes.where("queries > 0").select("h", "g", F.col("node").alias("query"), F.col("queries").alias("n")).join(lists, "query").drop("query"), "answers")
    asked = join_unique(rows.where(asking).select("h", "g", "id"), answers, ["h", "g"])
    me = F.array_position(F.transform("near", lambda e: e["own"] & (e["id"] == F.col("id"))), True)
    others = F.slice(F.filter("near", lambda e, i: i + 1 != F.col("me")), 1, k)
    listed = asked.withColumn("me", me).select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "e"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias(key), (0 - F.col("e.far")).alias("score"))

"""Near duplicates: bottom-k sketches of one hash function, exact Jaccard at the end.

1. Every text becomes its set of word-shingle hashes; the set's digest, size and
   its k smallest values (the sketch) are kept. Texts with equal sets make one
   class, so copies cost one row each from here on.
2. Retained values are ordered by how many classes retain them. A pair that
   reaches the similarity shares at least ``t`` retained values, so it shares one
   among the first k - t + 1 of each in this order. Inverted lists of these values
   give the overlaps; values of passages that many texts share come last in the
   order and make few lists. Only classes in such lists keep their full sets.
3. In every list all members are first compared with the list's most central
   member only. Union sketches filter the pairs and the full sets decide. The
   links make components.
4. A completion step, exact and not by sketches: classes of lists that hold
   several components are joined once more, by prefixes of their full sets in the
   order of their frequency. Pairs within a component and pairs whose places in
   the order rule the similarity out are never made. The full sets decide again.

Frequent values find what belongs to them in broadcast copies of bounded size,
and long lists and central nodes are cut into blocks, so none fills one task.

``t`` lies 5.5 standard deviations under the expected number of shared values
(k * similarity), so a pair at the similarity is missed with a probability of
about 1e-8; texts with fewer than about 0.7 k shingles are handled exactly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import shingle_sets
from .skew import attach_large, join_unique
from .storage import drop, stored
from .subword import byte_view, steps, text_column

SKETCH = 64
STEP_BYTES = 2 << 20
#: Members of a class of an exact prefix list that meet as many of another class in one task.
LIST_BLOCK = 1000


def least_shared(k: int, percent: int) -> int:
    """Shared values of two sketches of size k below which a pair can't reach the similarity."""
    p = percent / 100
    return max(1, math.floor(k * p - 5.5 * math.sqrt(k * p * (1 - p))))


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(doc_id, n, digest, sketch) of every row; a text without words has n = 0 and no digest."""

    def run(batches):
        for batch in batches:
            texts = text_column(batch.column(1))
            for at, part in steps(texts, STEP_BYTES):
                n, digests, values, ends = [], [], [], [0]
                for x in shingle_sets(*byte_view(part), width):
                    n.append(len(x))
                    digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                    values.append(x[:k])
                    ends.append(ends[-1] + len(values[-1]))
                sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), sketch], ["doc_id", "n", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n int, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(digest, hashes) of every row with words; hashes holds the sorted set as 64-bit integers."""

    def run(batches):
        for batch in batches:
            for _, part in steps(text_column(batch.column(0)), STEP_BYTES):
                own = [x.tobytes() for x in shingle_sets(*byte_view(part), width) if len(x)]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in own], pa.binary()), pa.array(own, pa.binary())], ["digest", "hashes"])

    return docs.select("text").mapInArrow(run, "digest binary, hashes binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Keep the pairs (a, b) that reach the similarity; sets: (node, hashes).

    The union sketch, the k smallest values of both sets, comes first; the full
    sets are compared only where it does not rule the similarity out.
    """
    least = least_shared(k, percent)

    def shared(x: np.ndarray, y: np.ndarray, most: int | None = None) -> tuple[int, int]:
        """(values in both, values in either), over the ``most`` smallest of the union."""
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        again = both[1:] == both[:-1]
        if most is not None and len(both) - int(again.sum()) > most:
            first = np.flatnonzero(np.cumsum(np.append(True, ~again)) > most)[0]
            return int(again[: first - 1].sum()), most
        return int(again.sum()), len(both) - int(again.sum())

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both, either = shared(x[:k], y[:k], k)
                if either == k and both < least:
                    keep.append(False)
                    continue
                both, either = shared(x, y)
                keep.append(100 * both >= percent * either)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(pairs, "pairs")
    for key, other, name in (("a", "b", "x"), ("b", "a", "y")):
        counts = stored(pairs.groupBy(key).agg(F.count("*").alias("n")), "counts")
        rows = attach_large(pairs if key == "a" else rows, counts, sets.select(F.col("node").alias(key), F.col("hashes").alias(name)), key, other)
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def ordered_values(entries: DataFrame) -> DataFrame:
    """Values (v, node) that several nodes hold, as (node, vs): structs (df, v) by rising frequency, and their sum."""
    often = stored(entries.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").withColumn("df", F.col("n")), "values")
    return join_unique(entries, often, ["v"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("weight"))


def prefix_lists(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Inverted lists of sketches: (v, node, n, weight), of at least two members each."""
    t = least_shared(k, percent)
    shared = ordered_values(reps.select("node", F.explode("sketch").alias("v")))
    need = F.least(F.lit(t), F.ceil(F.col("n") * F.lit(percent) / 100)).cast("int")
    sizes = reps.select("node", "n", F.least(F.col("n"), F.lit(k)).alias("size"), need.alias("need"))
    # values that no other class holds come first in the order and leave less room in the prefix
    room = F.col("size") - F.col("need") + 1 - (F.col("size") - F.size("vs"))
    rows = shared.join(sizes, "node").withColumn("room", room).where("room > 0")
    lists = rows.select("node", "n", "weight", F.explode(F.slice("vs", 1, F.col("room"))).alias("e")).select(F.col("e.v").alias("v"), "node", "n", "weight")
    return lists


def class_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of list members that can hold a pair at the similarity and of different components.

    A class of a list holds the members of one set size and one place of the
    list's value. ``rows`` is (v, node, root, size, place). Returns v, and
    for both classes (x before y by size and place) size, place and m (members).
    """
    each = rows.groupBy("v", "size", "place").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
    # sizes at the similarity lie in the same class of sizes or in neighbouring ones
    step = F.floor(F.log("size") / math.log(100 / percent * 1.05)).cast("int")
    sides = lambda c: [F.col(k).alias(f"{c}_{k}") for k in ("size", "place", "m", "low", "high")]
    each = stored(each.withColumn("step", step), "classes")
    x = each.select("v", "step", *sides("x"))
    y = each.select("v", F.explode(F.array(F.col("step"), F.col("step") - 1)).alias("step"), *sides("y"))
    order = lambda c: F.struct(f"{c}_size", f"{c}_place")
    most = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    rule = most * (100 + percent) >= percent * (F.col("x_size") + F.col("y_size"))  # shared values of a pair at the similarity
    rule &= (order("x") < order("y")) | ((order("x") == order("y")) & (F.col("x_m") > 1))
    rule &= F.least("x_low", "y_low") != F.greatest("x_high", "y_high")
    return x.join(y, ["v", "step"]).where(rule).select("v", *[f"{c}_{k}" for c in "xy" for k in ("size", "place", "m")])


def cross_pairs(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that the exact prefixes of their full sets leave possible.

    ``sets`` holds (node, hashes) and ``roots`` (node, root) of the same nodes.
    Members of a list meet by classes of size and place, so pairs that these rule
    out are never made; members of large classes meet in blocks.
    """

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                nodes, own = batch.column(0).slice(at, 256).to_numpy(), [x.as_buffer() for x in batch.column(1).slice(at, 256)]
                values = np.concatenate([np.frombuffer(x, np.int64) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, [x.size // 8 for x in own])), pa.array(values)], ["node", "v"])

    n = (F.length("hashes") / 8).cast("int")
    shared = ordered_values(sets.select("node", "hashes").mapInArrow(spread, "node long, v long"))
    need = F.ceil(F.col("n") * F.lit(percent) / 100).cast("int")
    rows = shared.join(sets.select("node", n.alias("n")), "node").join(roots, "node")
    own = F.col("n") - F.size("vs")
    rows = rows.select("node", "root", "n", own.alias("own"), F.posexplode(F.slice("vs", 1, F.greatest(F.col("n") - need + 1 - own, F.lit(0)))).alias("at", "e"))
    rows = stored(rows.select(F.col("e.v").alias("v"), "node", "root", F.col("n").alias("size"), (F.col("own") + F.col("at")).alias("place")), "prefixes")
    live = stored(class_pairs(rows, percent), "classes")

    def members(side: str, other: str) -> DataFrame:
        """Members of the side's classes, each in its own block of every pair of classes and in all blocks of the other side."""
        pair = F.struct(*[f"{c}_{k}" for c in "xy" for k in ("size", "place", "m")])
        classes = live.groupBy("v", F.col(f"{side}_size").alias("size"), F.col(f"{side}_place").alias("place"))
        classes = stored(classes.agg(F.first(f"{side}_m").alias("n"), F.collect_list(pair).alias("pairs")), "classes")
        found = join_unique(rows, classes, ["v", "size", "place"]).select("v", "node", "root", F.explode("pairs").alias("p"))
        blocks = lambda c: F.ceil(F.col(f"p.{c}_m") / LIST_BLOCK)
        mine = F.pmod(F.xxhash64("node"), blocks(side)).cast("int")
        keys = [F.col(f"p.{c}_{k}").alias(f"{c}_{k}") for c in "xy" for k in ("size", "place")]
        return found.select("v", *keys, mine.alias(f"{side}_block"), F.explode(F.sequence(F.lit(0), (blocks(other) - 1).cast("int"))).alias(f"{other}_block"), F.col("node").alias(f"{side}_node"), F.col("root").alias(f"{side}_root"))

    both = members("x", "y").join(members("y", "x"), ["v", "x_size", "x_place", "y_size", "y_place", "x_block", "y_block"])
    twice = (F.col("x_size") == F.col("y_size")) & (F.col("x_place") == F.col("y_place")) & (F.col("x_node") >= F.col("y_node"))
    found = both.where(~twice & (F.col("x_root") != F.col("y_root")))
    return found.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """Group near duplicates by shared word shingles.

    Rows are linked when 100 * |A and B| >= percent * |A or B| for their shingle
    sets. Returns one row for each input row: doc_id, n_shingles, component_id
    (smallest doc_id reachable, itself included), kept (doc_id = component_id).
    Texts that are null or have no word have an empty set and are linked with
    nothing. Texts of fewer than ``width`` words have one shingle. Repeated rows
    are linked like other copies. A null doc_id is ignored in the minimum; a row
    whose whole component has null ids is kept. An empty table gives no rows.
    """
    made = stored(sketches(docs, width, k).withColumn("row", F.monotonically_increasing_id()), "sketches")
    rows = stored(made.drop("sketch"), "rows")
    classes = stored(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")), "classes")
    reps = stored(made.join(classes.select("node"), made["row"] == F.col("node"), "left_semi").select(F.col("row").alias("node"), "n", "sketch"), "reps")
    drop(made)
    raw = stored(prefix_lists(reps, k, percent), "lists")
    drop(reps)
    hubs = stored(raw.groupBy("v").agg(F.max(F.struct("weight", "n", "node")).alias("h"), F.count("*").alias("m")).where("m > 1").select("v", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("m").alias("n")), "hubs")
    lists = stored(join_unique(raw.withColumnRenamed("n", "size"), hubs, ["v"]), "lists")
    drop(raw)

    nodes = lists.select("node").distinct()
    wanted = stored(nodes.join(classes, "node").select("node", "digest"), "wanted")
    ids = rows.join(wanted, rows["row"] == wanted["node"], "left_semi").select(F.col("doc_id").alias("id")).distinct()
    # merged at every size: the ids grow with the corpus
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    # a repeated doc_id may bring further texts; their digests are not wanted
    sets = stored(full_sets(texts, width).join(wanted, "digest").dropDuplicates(["node"]).select("node", "hashes"), "sets")

    near = F.least("size", "hub_n") * 100 >= F.greatest("size", "hub_n") * percent
    first = lists.where((F.col("node") != F.col("hub")) & near).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = stored(confirm(first, sets, percent, k), "links")
    roots = connected_components(links)

    placed = lists.select("v", "node").join(roots.withColumnRenamed("root", "known"), "node", "left").withColumn("root", F.coalesce("known", "node"))
    mixed = stored(placed.groupBy("v").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("n")).where("r1 <> r2").select("v", "n"), "mixed")
    open_nodes = stored(join_unique(placed.select("v", "node", "root"), mixed, ["v"]).select("node", "root").distinct(), "open")
    second = cross_pairs(sets.join(open_nodes.select("node"), "node", "left_semi"), open_nodes, percent)
    more = stored(confirm(second, sets, percent, k), "links")
    final = roots if more.isEmpty() else connected_components(links.select("a", "b").union(more.select("a", "b")))
    for table in (lists, hubs, wanted, sets, mixed, open_nodes):
        drop(table)

    linked = classes.join(final, "node", "left").select("digest", "low", F.coalesce("root", "node").alias("root"))
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = linked.join(lows, "root").select("digest", "component_id")
    out = rows.drop("row").join(labels, "digest", "left")
    label = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), label.alias("component_id"), F.col("doc_id").eqNullSafe(label).alias("kept"))

"""Ranked lexical search over document shards.

A shard is one row: the inverted lists of some megabytes of documents in
compressed sparse rows (terms, bounds, document numbers, integer impacts). The
impact of a posting is the part of its score that depends on the document, so a
score is the sum of impacts times query weights, and an index stays right when
only document frequencies change. A search takes a block of queries through every
shard: term at a time into one dense accumulator, then a partial selection that
keeps ties; tasks carry their best documents from shard to shard, and what the
tasks found is merged in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bound_batches, drop, stored
from .subword import byte_view, text_column

#: Bytes of text after which a shard is full; a longer text makes its own shard.
SHARD_BYTES = 4 << 20
#: Shards of a file: a task holds no more of them at once, however large its part of the index is.
FILE_SHARDS = 4
#: Queries, and distinct terms of theirs, that go through the index at once (one query at least).
BLOCK_ITEMS, BLOCK_TERMS = 1000, 200_000

#: Weights of terms and of lengths (fixed values of the score).
WEIGHT, IMPACT, TF, LENGTH = 1000, 1_000_000_000, 1000, 8
FLAT, SLOPE = 25, 75

#: Bytes that are in no term become spaces, A-Z lower case; bytes of other letters are over 127.
_FOLD = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_FOLD_TABLE = np.frombuffer(_FOLD, np.uint8)


def postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, bounds of their lists, documents, frequencies, length of every document)."""
    raw, bounds = byte_view(texts)
    low = _FOLD_TABLE[raw]
    inside = low != 32
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    opens[edges] = inside[edges]
    starts = np.flatnonzero(opens)
    first = np.searchsorted(starts, bounds)
    own = np.append(np.flatnonzero(opens[inside]), int(inside.sum()))
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(own.astype(np.int64)), pa.py_buffer(low[inside])]).dictionary_encode()
    n = np.diff(first)
    pairs = words.indices.to_numpy().astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), n)
    pairs, times = np.unique(pairs, return_counts=True)
    bound = np.searchsorted(pairs, np.arange(len(words.dictionary) + 1) * len(texts))
    return words.dictionary, bound, (pairs % len(texts)).astype(np.int32), times.astype(np.int32), n


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def _numbers(column: pa.Array, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)


_SHARD = ["ids", "lengths", "terms", "bounds", "docs", "counts"]
_SHARD_SCHEMA = "ids array<long>, lengths binary, terms binary, bounds binary, docs binary, counts binary"


def build_shards(docs: DataFrame) -> DataFrame:
    """Shards of (doc_id, text), with term frequencies in ``counts``. A null text has no terms."""

    def shard(ids: list[pa.Array], texts: list[pa.Array]) -> pa.RecordBatch:
        terms, bounds, where, times, n = postings(pa.concat_arrays(texts))
        names = pa.array([b" ".join(terms.to_pylist())], pa.binary())
        numbers = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(ids))
        return pa.RecordBatch.from_arrays([numbers, _binary(n), names, _binary(bounds), _binary(where), _binary(times)], _SHARD)

    def run(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            column = text_column(batch.column(1))
            ends = np.cumsum(np.diff(byte_view(column)[1]))
            at = 0
            while at < len(column):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + SHARD_BYTES - held, "right")))
                if to == at + 1 and held and held + int(ends[at]) - done > SHARD_BYTES:  # doesn't fit into the open shard
                    yield shard(ids, texts)
                    ids, texts, held = [], [], 0
                    continue
                ids.append(batch.column(0).slice(at, to - at))
                texts.append(column.slice(at, to - at))
                held, at = held + int(ends[to - 1]) - done, to
                if held >= SHARD_BYTES:
                    yield shard(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield shard(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SHARD_SCHEMA)


@dataclass(frozen=True)
class LexicalIndex:
    """Shards with impacts in ``counts``'s place, document frequencies (term, df), documents with terms and all their terms."""

    shards: DataFrame
    frequencies: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame) -> LexicalIndex:
    """Index all rows of (doc_id, text); every row is a document, whatever its id."""
    bound_batches(docs.sparkSession)
    raw = stored(build_shards(docs), "shards", file_rows=FILE_SHARDS)

    def lists(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                if len(batch.column(1)[k].as_buffer()):
                    yield pa.RecordBatch.from_arrays([pa.array(batch.column(0)[k].as_py().split(b" "), pa.binary()), pa.array(np.diff(_numbers(batch.column(1), k, np.int64)))], ["term", "df"])

    def sizes(batches):
        for batch in batches:
            n = [_numbers(batch.column(0), k, np.int64) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in n], pa.int64()), pa.array([int(x.sum()) for x in n], pa.int64())], ["documents", "terms"])

    sums = raw.select("lengths").mapInArrow(sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = sums[0] or 0, sums[1] or 0
    held = raw.where(F.length("terms") > 0)
    frequencies = stored(held.select("terms", "bounds").mapInArrow(lists, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")

    def weigh(batches):
        for batch in batches:
            columns = dict(zip(_SHARD, batch.columns, strict=True))
            out = []
            for k in range(batch.num_rows):
                n, tf = _numbers(columns["lengths"], k, np.int64), _numbers(columns["counts"], k, np.int32).astype(np.int64)
                if int(n.max()) * SLOPE * documents < 1 << 63:
                    m = FLAT + SLOPE * n * documents // terms
                else:
                    m = np.array([FLAT + SLOPE * x * documents // terms for x in n.tolist()], np.int64)
                out.append((IMPACT * tf // (TF * tf + LENGTH * m[_numbers(columns["docs"], k, np.int32)])).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], _SHARD)

    shards = stored(held.mapInArrow(weigh, _SHARD_SCHEMA).drop("lengths"), "impacts", file_rows=FILE_SHARDS)
    drop(raw)
    return LexicalIndex(shards, frequencies, documents, terms)


def weighted_terms(index: LexicalIndex, items: DataFrame) -> DataFrame:
    """(item_id, asked) of items with a term of the index; asked holds structs (term, weight times repeats)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                terms, bounds, _, times, _ = postings(text_column(batch.column(1).slice(k, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).slice(k, 1).to_pylist() * len(terms), pa.int64()), terms.cast(pa.binary()), pa.array(times.astype(np.int64))], ["item_id", "term", "times"])

    found = items.select(F.col("item_id").cast("long"), "text").distinct().mapInArrow(run, "item_id long, term binary, times long")
    found = found.groupBy("item_id", "term").agg(F.sum("times").alias("times")).join(index.frequencies, "term")
    weight = F.floor(F.lit(float(WEIGHT)) * F.log(F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double")))
    return found.groupBy("item_id").agg(F.collect_list(F.struct("term", (weight * F.col("times")).alias("weight"))).alias("asked"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by ascending id."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        places = np.flatnonzero(scores >= least)  # all ties of the last place
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def search_block(index: LexicalIndex, block: list[tuple[int | None, list[tuple[bytes, int]]]], k: int) -> DataFrame:
    """(item, doc_id, score, part): the best documents of every task for every item, by the item's place in the block."""
    asked = index.shards.sparkSession.sparkContext.broadcast([terms for _, terms in block])

    def run(batches):
        none = np.iinfo(np.int64).max  # stands for a null id: last of equal scores
        top = {}
        for batch in batches:
            for row in range(batch.num_rows):
                column = dict(zip(batch.schema.names, batch.columns, strict=True))
                place = {t: i for i, t in enumerate(column["terms"][row].as_py().split(b" "))}
                bounds = _numbers(column["bounds"], row, np.int64).tolist()
                docs, impacts = _numbers(column["docs"], row, np.int32), _numbers(column["counts"], row, np.int32).astype(np.int64)
                ids = column["ids"][row].values
                ids = ids.fill_null(none).to_numpy(zero_copy_only=False)
                sums = np.zeros(len(ids), np.int64)
                for item, terms in enumerate(asked.value):
                    sums[:] = 0
                    for term, weight in terms:
                        at = place.get(term)
                        if at is not None:
                            a, b = bounds[at], bounds[at + 1]
                            sums[docs[a:b]] += impacts[a:b] * weight
                    scores, own = top.get(item, (None, None))
                    least = max(1, int(scores[-1])) if scores is not None and len(scores) == k else 1
                    near = np.flatnonzero(sums >= least)
                    if not len(near):
                        continue
                    both = (sums[near], ids[near]) if scores is None else (np.concatenate([scores, sums[near]]), np.concatenate([own, ids[near]]))
                    kept = best(*both, k)
                    top[item] = (both[0][kept], both[1][kept])
        for item, (scores, own) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item, np.int32)), pa.array(own, mask=own == none), pa.array(scores)], ["item", "doc_id", "score"])

    found = index.shards.mapInArrow(run, "item int, doc_id long, score long").withColumn("part", F.spark_partition_id() % 64)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    ids = found.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")
    return found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def _blocks(rows: Iterator) -> Iterator[list]:
    block, size = [], 0
    for row in rows:
        terms = [(bytes(t["term"]), t["weight"]) for t in row["asked"]]
        if block and (len(block) >= BLOCK_ITEMS or size + len(terms) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, index: LexicalIndex | None = None) -> DataFrame:
    """Each item's k highest-scoring documents with a score above 0: item_id, rank, doc_id, score.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns play no part.
    Equal scores are ranked by ascending doc_id, a null doc_id last. Every row of ``docs``
    is a document: repeated rows are ranked side by side. Null, empty and termless texts
    are no documents and no queries. Rows of ``items`` that are equal are one query; the
    texts of one item_id (null is an id too) are one query together. Empty tables give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    index = index or build_index(docs)
    out = None
    if index.terms:
        for block in _blocks(weighted_terms(index, items).toLocalIterator()):
            found = stored(search_block(index, block, k), "found")
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out

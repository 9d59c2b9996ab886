"""Token counts from distinct pre-tokens.

The corpus is split into pre-tokens twice. The first pass collects the distinct
pre-tokens with their frequencies; each is encoded once and only its number of
pieces is kept. The second pass makes per-document pre-token frequencies and
joins them to these numbers. The pre-tokens that make up most of the corpus are
joined inside the map tasks, from a copy of bounded size; all others are joined
through a shuffle. A pre-token that isn't in the copy is about as rare as
``FREQUENT_ENTRIES`` others at least, so no key of the shuffle is frequent. Long
pre-tokens are joined by a 128-bit digest. No id sequence of a document is made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .subword import byte_view, distinct_pretokens, piece_table, pretoken_bounds, steps, text_column

#: Most entries of the copy that every map task holds.
FREQUENT_ENTRIES = 100_000
#: Bytes of the longest pre-token that is its own key.
KEY_BYTES = 64
#: Distinct pre-tokens that a map task of the first pass holds before it hands them on.
HELD_ENTRIES = 200_000


def _split(part: pa.Array, vocabulary: str) -> tuple[np.ndarray, pa.Array, np.ndarray, list[int]]:
    """(number of every pre-token, distinct ones, texts' bounds, texts to encode whole)."""
    raw, bounds = byte_view(part)
    odd = piece_table(vocabulary).whole_only(raw, bounds)
    marks, firsts = pretoken_bounds(raw, bounds)
    if len(marks) == 1:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(len(part) + 1, np.int64), odd
    number, distinct = distinct_pretokens(raw, marks)
    return number, distinct, firsts, odd


def distinct_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Distinct pre-tokens of all texts: (pretoken, freq)."""

    def run(batches):
        held: list[pa.Table] = []
        size = 0

        def merged():
            return pa.concat_tables(held).group_by("pretoken").aggregate([("freq", "sum")]).select(["pretoken", "freq_sum"]).rename_columns(["pretoken", "freq"])

        for batch in batches:
            texts = text_column(batch.column(0))
            for _, part in steps(texts):
                number, distinct, _, _ = _split(part, vocabulary)
                held.append(pa.table({"pretoken": distinct.cast(pa.binary()), "freq": np.bincount(number, minlength=len(distinct))}))
                size += len(distinct)
                if size > HELD_ENTRIES:
                    held = [merged()]
                    size = held[0].num_rows
                    if size > HELD_ENTRIES // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from merged().to_batches()

    found = docs.select("text").mapInArrow(run, "pretoken binary, freq long")
    return found.groupBy("pretoken").agg(F.sum("freq").alias("freq"))


def keys(pretokens: list[bytes]) -> list[bytes]:
    """Keys of pre-tokens: themselves, or a digest after byte 255, which is in no UTF-8 text."""
    return [p if len(p) <= KEY_BYTES else b"\xff" + hashlib.blake2b(p, digest_size=16).digest() for p in pretokens]


def piece_counts(distinct: DataFrame, vocabulary: str) -> DataFrame:
    """(key, freq, pieces) of every distinct pre-token, each encoded once."""

    def run(batches):
        table = piece_table(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                own = batch.column(0).slice(k, 20_000).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(keys(own), pa.binary()), batch.column(1).slice(k, 20_000), pa.array(table.count_pieces(own).astype(np.int32))], ["key", "freq", "pieces"])

    return distinct.mapInArrow(run, "key binary, freq long, pieces int")


def frequent_pieces(pieces: DataFrame) -> pa.Table:
    """(key, pieces) of the most frequent pre-tokens, ``FREQUENT_ENTRIES`` at most.

    Frequencies are counted in classes a twelfth of an octave wide first, and only
    entries of whole classes are fetched.
    """
    size = F.floor(F.log2("freq") * 12)
    taken, least = 0, None
    for row in pieces.groupBy(size.alias("c")).count().orderBy(F.desc("c")).collect():  # some hundred rows
        taken += row["count"]
        if taken > FREQUENT_ENTRIES:
            break
        least = row["c"]
    return pieces.where(size >= least if least is not None else F.lit(False)).select("key", "pieces").toArrow()


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (no tokens). Rows are told apart by position, so
    repeated rows and null ids each get their own result. An empty table gives
    no rows.
    """
    pieces = stored(piece_counts(distinct_counts(docs, vocabulary), vocabulary), "pieces")
    frequent = frequent_pieces(pieces)
    shared = docs.sparkSession.sparkContext.broadcast((frequent["key"].to_pylist(), frequent["pieces"].to_numpy().astype(np.int64)))

    def run(batches):
        names, values = shared.value
        known = dict(zip(names, values.tolist(), strict=True))
        tokenizer = piece_table(vocabulary).tokenizer
        for batch in batches:
            texts = text_column(batch.column(1))
            for at, part in steps(texts):
                number, distinct, firsts, odd = _split(part, vocabulary)
                own = keys(distinct.to_pylist())
                each = np.array([known.get(x, 0) for x in own], np.int64)
                owner = np.repeat(np.arange(len(part)), np.diff(firsts))
                sums = np.bincount(owner, each[number], len(part)).astype(np.int64)
                rare = each[number] == 0
                rare[np.isin(owner, odd)] = False
                for k in odd:
                    sums[k] = len(tokenizer.encode(part[k].as_py(), add_special_tokens=False).ids)
                # per-document frequencies of the others
                key, times = np.unique(owner[rare] * len(distinct) + number[rare], return_counts=True)
                which = pa.array(own, pa.binary()).take(pa.array(key % max(1, len(distinct))))
                left = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(key // max(1, len(distinct)), np.arange(len(part) + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([which, pa.array(times.astype(np.int32))], ["key", "times"]),
                )
                n_bytes = pa.array(np.diff(byte_view(part)[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), n_bytes, pa.array(sums), left], ["doc_id", "n_bytes", "known", "rare"])

    base = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, known long, rare array<struct<key:binary,times:int>>")
    base = stored(base.withColumn("row", F.monotonically_increasing_id()), "counts")
    rare = base.select("row", F.inline("rare")).join(pieces.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return base.drop("rare").join(rare, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))

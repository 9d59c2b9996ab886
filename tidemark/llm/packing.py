"""Packing documents into sequences: bounded-space online best fit.

A packer keeps a fixed number of open sequences. They are indexed by their free
space in one bitset, so the tightest sequence that still holds a piece is a shift
and a lowest-bit query away. When no open sequence holds the piece and all are in
use, the fullest one is closed first.

Every partition packs the documents that it reads. The pieces of the sequences
that are open at its end are packed once more, those of ``MERGE`` partitions
together. Only these pieces are shuffled; what is then left open is a part in
``MERGE`` of what the partitions leave.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .subword import piece_table, steps, text_column

#: Partitions whose open sequences are packed together, and open sequences of the packer that does.
MERGE, MERGE_OPEN = 64, 4096


class BestFit:
    """Open bins of one capacity, found by free space. ``closed`` collects the numbers of the bins that take no more."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit s is set while a bin with s places free is open
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0
        self.closed: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """Place a piece of 1 to ``capacity`` and return (bin, offset there)."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.open_bins:
                self.closed.append(self._take((self.free & -self.free).bit_length() - 1))  # the fullest
            space, number = self.capacity, self.made
            self.made += 1
        if space > size:
            self.bins[space - size].append(number)
            self.free |= 1 << (space - size)
            self.open += 1
        else:
            self.closed.append(number)
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        number = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        self.open -= 1
        return number


def piece_sizes(tokens: int, capacity: int) -> list[int]:
    """Sizes of a document's pieces: one, or full ones after a first that may be shorter."""
    if tokens <= capacity:
        return [tokens]
    first = tokens % capacity
    return [first] * bool(first) + [capacity] * (tokens // capacity)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"


class _Sequences:
    """Rows of the pieces of open sequences, handed on when their sequence closes."""

    def __init__(self, packer: BestFit, base: int):
        self.packer, self.base = packer, base
        self.waiting: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def add(self, row: tuple, size: int, ids: bytes | None) -> None:
        number, offset = self.packer.place(size)
        self.waiting.setdefault(number, []).append((*row, self.base + number, offset, ids))
        for closed in self.packer.closed:
            self.done += self.waiting.pop(closed)
        self.packer.closed.clear()

    def take(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], [f.split()[0] for f in _PIECE.split(", ")])

    def closed(self, least: int = 0):
        """Batches of the rows of closed sequences, once there are more than ``least``."""
        if len(self.done) > least:
            yield self.take(self.done)
            self.done = []

    def open(self):
        """Rows of the sequences that are still open."""
        return [row for rows in self.waiting.values() for row in rows]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, open_bins: int = 512, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset and, if asked for, ids (little-endian 32-bit). A null text is an empty
    one and packs its end id alone; a null ``doc_id`` stays null; repeated rows
    are packed each time; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        from pyspark import TaskContext

        table, part_id = piece_table(vocabulary), TaskContext.get().partitionId()
        out = _Sequences(BestFit(capacity, open_bins), part_id << 40)
        for batch in batches:
            texts = text_column(batch.column(1))
            for at, part in steps(texts):
                ids, bounds = table.encode(part)
                raw = memoryview(np.insert(ids, bounds[1:], end_id).astype("<u4").tobytes())
                ends = (bounds + np.arange(len(bounds))).tolist()
                for k, doc_id in enumerate(batch.column(0).slice(at, len(part)).to_pylist()):
                    start = 0
                    for piece, size in enumerate(piece_sizes(ends[k + 1] - ends[k], capacity)):
                        own = raw[4 * (ends[k] + start) : 4 * (ends[k] + start + size)]
                        out.add((doc_id, piece, start, size, zlib.crc32(own)), size, bytes(own) if with_ids else None)
                        start += size
                yield from out.closed()
        if left := out.open():
            # the partition's number stands in for the offset of pieces without a place
            yield out.take([(*r[:5], None, part_id, r[7]) for r in left])

    def merge(batches):
        from pyspark import TaskContext

        out = _Sequences(BestFit(capacity, MERGE_OPEN), 1 << 62 | TaskContext.get().partitionId() << 40)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.add(row[:5], row[3], row[7])
            yield from out.closed(10_000)
        if out.done or out.waiting:
            yield out.take(out.done + out.open())

    first = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECE), "pieces")
    left = first.where("sequence_id is null")
    groups = (left.agg(F.max("offset")).first()[0] or 0) // MERGE + 1
    # a group's pieces in one fixed order, so that a repeated task gives the same places
    together = left.repartition(groups, F.floor(F.col("offset") / MERGE)).sortWithinPartitions("offset", "doc_id", "piece", "start", "ids_crc32")
    packed = first.where("sequence_id is not null").unionAll(together.mapInArrow(merge, _PIECE))
    return packed if with_ids else packed.drop("ids")

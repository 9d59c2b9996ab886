"""Token ids in a compact binary form: static range asymmetric numeral coding.

One frequency table is made from the ids of the whole corpus and shared by all
blocks. A block holds whole documents, in ascending ``doc_id`` order, and is
coded by interleaved lanes, each with a 64-bit state and 32-bit renormalisation.
Every ``CHECKPOINT_STEPS`` steps the lane states and the word position are kept,
so any segment of a block can be decoded by itself; every segment carries a
checksum of its ids and every block one of its bytes.

Block layout (little endian): magic ``TMR1``, u32 crc32 of all that follows,
u32 lanes, u32 tokens, u32 documents, u32 segments, u32 words; then per document
i64 id, u8 id-present flag and u32 length; per segment u32 word position, u32
crc32 of its ids and u64 states of all lanes; then the u32 words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, new_path, stored
from .subword import piece_table, steps, text_column

LANES = 32
CHECKPOINT_STEPS = 256
BLOCK_TOKENS = 1 << 16
#: Blocks that are coded side by side by one array operation.
SIDE_BY_SIDE = 16
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIIII")


def frequency_table(counts: np.ndarray, bits: int) -> np.ndarray:
    """Scale counts to frequencies that sum to ``2 ** bits``; every id that occurs gets at least 1.

    An empty table stays empty. Raises ValueError if more ids occur than fit.
    """
    counts = np.asarray(counts, np.int64)
    total, room = int(counts.sum()), 1 << bits
    present = counts > 0
    if not total:
        return np.zeros(len(counts), np.uint32)
    if present.sum() > room:
        raise ValueError(f"{int(present.sum())} ids do not fit {bits} bits")
    freq = np.where(present, np.maximum(1, np.floor(counts * (room / total))), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    spare = room - int(freq.sum())
    at = 0
    while spare:  # the most frequent ids take what rounding left over or took too much
        k = order[at]
        step = spare if spare > 0 else -min(-spare, int(freq[k]) - 1)
        freq[k] += step
        spare -= step
        at += 1
    return freq.astype(np.uint32)


class Coder:
    """Encoder and decoder for one shared frequency table."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = np.uint64(bits), freq.astype(np.uint64)
        self.low = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.filler = int(np.argmax(freq))
        self.top = (_LOW >> self.bits) << np.uint64(32)
        self.mask = np.uint64((1 << bits) - 1)

    def encode(self, blocks: list[np.ndarray], lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> list[tuple]:
        """Code blocks of ids: per block (segment states, segment word positions, words)."""
        order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
        lengths = [-(-len(blocks[k]) // lanes) for k in order]
        longest = lengths[0] if lengths else 0
        ids = np.full((len(blocks), longest * lanes), self.filler, np.uint32)
        for row, k in enumerate(order):
            ids[row, : len(blocks[k])] = blocks[k]
        ids = ids.reshape(len(blocks), longest, lanes)
        state = np.full((len(blocks), lanes), _LOW, np.uint64)
        words = np.zeros((longest, len(blocks), lanes), np.uint32)
        sent = np.zeros((longest, len(blocks), lanes), bool)
        kept = {}
        alive = np.searchsorted(-np.array(lengths), -np.arange(longest), "left")  # blocks longer than t steps
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            symbols = ids[:n, t]
            f, x = self.freq[symbols], state[:n]
            full = x >= self.top * f
            words[t, :n], sent[t, :n] = x, full  # the low 32 bits
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[:n] = (q << self.bits) + (x - q * f) + self.low[symbols]
            if t % every == 0:
                kept[t] = state.copy()
        out: list = [None] * len(blocks)
        for row, k in enumerate(order):
            marks = range(0, lengths[row], every)
            per_step = sent[: lengths[row], row].sum(axis=1)
            position = np.concatenate([[0], np.cumsum(per_step)]).astype(np.uint32)
            states = np.array([kept[t][row] for t in marks], np.uint64).reshape(-1, lanes)
            out[k] = (states, position[list(marks)], words[: lengths[row], row][sent[: lengths[row], row]])
        return out

    def decode(self, segments: list[tuple[np.ndarray, int, int]], words: np.ndarray, lanes: int) -> list[np.ndarray]:
        """Decode segments side by side; each is (states, first word, number of ids)."""
        if not segments:
            return []
        order = sorted(range(len(segments)), key=lambda k: -segments[k][2])
        lengths = np.array([-(-segments[k][2] // lanes) for k in order])
        state = np.array([segments[k][0] for k in order], np.uint64).reshape(len(order), lanes)
        at = np.array([segments[k][1] for k in order], np.int64)
        words = np.append(words, np.uint32(0))
        longest = int(lengths[0])
        ids = np.zeros((len(order), longest, lanes), np.uint32)
        alive = np.searchsorted(-lengths, -np.arange(longest), "left")
        for t in range(longest):
            n = alive[t]
            x = state[:n]
            slot = x & self.mask
            symbols = self.symbol[slot]
            ids[:n, t] = symbols
            x = self.freq[symbols] * (x >> self.bits) + slot - self.low[symbols]
            short = x < _LOW
            rank = np.cumsum(short, axis=1)
            new = words[np.minimum(at[:n, None] + rank - 1, len(words) - 1)]
            state[:n] = np.where(short, (x << np.uint64(32)) | new, x)
            at[:n] += rank[:, -1]
        out: list = [None] * len(order)
        for row, k in enumerate(order):
            out[k] = ids[row].reshape(-1)[: segments[k][2]]
        return out


def pack_block(doc_ids: list, lengths: list[int], ids: np.ndarray, coded: tuple, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    """Serialise one coded block."""
    states, positions, words = coded
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[k : k + lanes * every].tobytes()) for k in range(0, len(raw), lanes * every)]
    body = b"".join(
        (
            struct.pack("<IIIII", lanes, len(ids), len(doc_ids), len(positions), len(words)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], "u1").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            positions.astype("<u4").tobytes(),
            np.array(sums, "<u4").tobytes(),
            states.astype("<u8").tobytes(),
            words.astype("<u4").tobytes(),
        )
    )
    return b"TMR1" + struct.pack("<I", zlib.crc32(body)) + body


def unpack_block(blob: bytes) -> tuple[list, np.ndarray, int, list[tuple[np.ndarray, int, int]], np.ndarray, np.ndarray]:
    """Read a block: (doc ids, lengths, lanes, segments, segment checksums, words). Raises ValueError on damage."""
    magic, crc, lanes, tokens, docs, segments, n_words = _HEAD.unpack_from(blob)
    if magic != b"TMR1" or zlib.crc32(memoryview(blob)[8:]) != crc:
        raise ValueError("damaged block")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(blob, kind, n, at)
        at += got.nbytes
        return got

    doc_ids, present, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    positions, sums = take("<u4", segments), take("<u4", segments)
    states, words = take("<u8", segments * lanes).reshape(segments, lanes), take("<u4", n_words)
    size = lanes * CHECKPOINT_STEPS
    parts = [(states[k], int(positions[k]), min(size, tokens - k * size)) for k in range(segments)]
    return [int(d) if p else None for d, p in zip(doc_ids, present, strict=True)], lengths, lanes, parts, sums, words


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64())])


def token_table(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Tokenise whole texts: (doc_id, ids as little-endian integers, n), the end id appended to each.

    Ids take two bytes where the vocabulary fits them, else four. A null text is
    an empty one; a null ``doc_id`` stays null.
    """

    def encode(batches):
        table = piece_table(vocabulary)
        kind = "<u2" if table.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            texts = text_column(batch.column(1))
            for at, part in steps(texts):
                ids, bounds = table.encode(part)
                n = len(part)
                with_end = np.insert(ids, bounds[1:], end_id).astype(kind)
                ends = (bounds + np.arange(n + 1)) * with_end.itemsize
                blob = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(with_end)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), blob, pa.array(np.diff(bounds) + 1)], schema=_IDS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary, n long")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    width = np.dtype(kind).itemsize
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // width
    data = column.buffers()[2]
    return np.frombuffer(data, kind)[bounds[0] : bounds[-1]] if data and data.size else np.zeros(0, kind), bounds - bounds[0]


def count_ids(tokens: DataFrame, kind: str, size: int) -> np.ndarray:
    """Count every id of a token table; the result has one entry for each id of the vocabulary."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), kind)[0], minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["id", "count"])

    out = np.zeros(size, np.int64)
    counted = tokens.select("ids").mapInArrow(count, "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))
    for row in counted.collect():  # one row for each id of the vocabulary at most
        out[row["id"]] = row["count"]
    return out


def write_blocks(docs: DataFrame, path: str, vocabulary: str, vocabulary_size: int, bits: int = 18, partitions: int | None = None, end_id: int = 0) -> None:
    """Encode a corpus into the block format below ``path``.

    ``path/table`` holds the shared table and ``path/blocks`` the blocks, in files
    in ascending ``doc_id`` order (a null id first, equal ids by their token ids).
    An empty corpus makes an empty table and no block.
    """
    spark = docs.sparkSession
    kind = "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    tokens = stored(token_table(docs, vocabulary, end_id), "tokens")
    freq = frequency_table(count_ids(tokens, kind, vocabulary_size), bits)
    spark.createDataFrame([(bits, bytearray(freq.astype("<u4").tobytes()))], "bits int, freq binary").coalesce(1).write.parquet(f"{path}/table")
    shared = freq.astype("<u4").tobytes()

    def encode(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        coder = Coder(np.frombuffer(shared, "<u4"), bits)
        waiting: list[tuple[list, list, list]] = []
        doc_ids, lengths, pieces, held = [], [], [], 0

        def flush():
            nonlocal block, start, waiting
            flat = [np.concatenate(p) for _, _, p in waiting]
            rows = []
            for (d, n, _), ids, coded in zip(waiting, flat, coder.encode(flat), strict=True):
                rows.append((part, block, start, len(ids), pack_block(d, n, ids, coded)))
                block, start = block + 1, start + len(ids)
            waiting = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "block", "start", "n", "blob"])

        for batch in batches:
            ids, bounds = _flat(batch.column(1), kind)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                doc_ids.append(doc_id)
                pieces.append(ids[bounds[k] : bounds[k + 1]].astype(np.uint32))
                lengths.append(len(pieces[-1]))
                held += lengths[-1]
                if held >= BLOCK_TOKENS:
                    waiting.append((doc_ids, lengths, pieces))
                    doc_ids, lengths, pieces, held = [], [], [], 0
                    if len(waiting) == SIDE_BY_SIDE or sum(sum(n) for _, n, _ in waiting) > 2 * SIDE_BY_SIDE * BLOCK_TOKENS:
                        yield flush()
        if doc_ids:
            waiting.append((doc_ids, lengths, pieces))
        if waiting:
            yield flush()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = tokens.select("doc_id", "ids").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    ranged.mapInArrow(encode, "part int, block long, start long, n long, blob binary").write.option("compression", "none").parquet(f"{path}/blocks")
    drop(tokens)


def read_blocks(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a corpus written by ``write_blocks``.

    One row per document: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, if asked for, ids as little-endian 32-bit integers.
    Every checksum is verified; damage raises ValueError.
    """
    tables = spark.read.parquet(f"{path}/table").collect()  # a single row
    bits, shared = tables[0]["bits"], bytes(tables[0]["freq"])
    blocks = spark.read.schema("part int, block long, start long, n long, blob binary").parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each written partition
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def decode(batches) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(shared, "<u4"), bits)
        for batch in batches:
            for lo in range(0, batch.num_rows, SIDE_BY_SIDE):
                rows = batch.slice(lo, SIDE_BY_SIDE).to_pylist()
                read = [unpack_block(r["blob"]) for r in rows]
                shift, segments = 0, []
                for _, _, lanes, parts, _, words in read:
                    segments += [(s, at + shift, size) for s, at, size in parts]
                    shift += len(words)
                got = coder.decode(segments, np.concatenate([r[5] for r in read]), read[0][2])
                at, out = 0, []
                for row, (doc_ids, lengths, _, parts, sums, _) in zip(rows, read, strict=True):
                    own = got[at : at + len(parts)]
                    at += len(parts)
                    if any(zlib.crc32(x.tobytes()) != c for x, c in zip(own, sums.tolist(), strict=True)):
                        raise ValueError("damaged segment")
                    raw = memoryview(np.concatenate(own).astype("<u4").tobytes())
                    ends = 4 * np.cumsum(lengths)
                    for d, n, end in zip(doc_ids, lengths.tolist(), ends.tolist(), strict=True):
                        own_ids = raw[end - 4 * n : end]
                        out.append((d, row["part"], row["start"] + end // 4 - n, n, zlib.crc32(own_ids), bytes(own_ids) if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "part", "local", "n_tokens", "ids_crc32", "ids"])

    rows = blocks.select("part", "start", "blob").mapInArrow(decode, "doc_id long, part int, local long, n_tokens long, ids_crc32 long, ids binary")
    out = rows.join(before, "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def encode_decode(docs: DataFrame, vocabulary: str, vocabulary_size: int) -> DataFrame:
    """Write a corpus into a new folder of the shared storage and return it read back.

    One row for each input row, as ``read_blocks`` gives it: a null text counts as
    empty and has its end id alone, a null doc_id comes first, repeated rows come
    one after another, other columns are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = new_path(spark, "rans")
    write_blocks(docs, path, vocabulary, vocabulary_size)
    return read_blocks(spark, path)

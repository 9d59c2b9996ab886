"""Batch tokenisation on executors: vectorised pre-token split, library piece ids.

The split of the byte-level pattern is computed with array operations over a
whole batch, the distinct pre-tokens of a batch are found by Arrow's dictionary
encoding, and each distinct pre-token is given to the tokenizers library once
per worker. The ids equal those of encoding every text as a whole; texts that
hold a special string are given to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

from .shingles import mix

#: Longest text, in bytes, that one step of the vectorised split handles at once (a longer single text makes its own step).
STEP_BYTES = 2 << 20
#: Distinct pre-tokens remembered by one worker before it starts over.
CACHE_ENTRIES = 500_000

#: Base of the polynomial hash of a pre-token (a fixed value).
_BASE = np.uint64(0x9E3779B97F4A7C15)

_OTHER, _LETTER, _NUMBER, _SPACE, _END, _NEWER = range(6)


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other.

    Libraries carry different Unicode versions. A letter or number that was not
    assigned in version 3.2 gets a class of its own; texts that hold one are
    given to the library whole.
    """
    import regex
    from unicodedata import ucd_3_2_0

    table = np.zeros(0x110000, np.uint8)
    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, whole):
            a, b = ord(whole[m.start()]), ord(whole[m.end() - 1])
            table[a : b + 1] = kind
    for cp in np.flatnonzero((table == _LETTER) | (table == _NUMBER)).tolist():
        if ucd_3_2_0.category(chr(cp)) == "Cn":
            table[cp] = _NEWER
    return table


def text_column(column: pa.Array) -> pa.Array:
    """Return the column as large strings without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Return (bytes of all texts one after another, their n + 1 bounds)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, limit: int = STEP_BYTES):
    """Cut a text column into slices of at most ``limit`` bytes, one text at least."""
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def pretoken_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split texts into pre-tokens.

    Returns the byte bounds of all pre-tokens (they cover the bytes without
    gaps) and, for each text, the number of its first pre-token (n + 1 values).
    """
    if not len(raw):
        return np.zeros(1, np.int64), np.zeros(len(bounds), np.int64)
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at_byte = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
    kind = code_point_classes()[code]
    firsts = np.searchsorted(at_byte, bounds[:-1][bounds[:-1] < bounds[1:]])
    before = np.empty_like(kind)
    before[1:], before[0] = kind[:-1], _END
    before[firsts] = _END
    after = np.empty_like(kind)
    after[:-1], after[-1] = kind[1:], _END
    after[firsts[1:] - 1] = _END
    opens = kind != before
    blank = code == 32
    follows_blank = np.zeros(len(kind), bool)
    follows_blank[1:] = blank[:-1]
    follows_blank[firsts] = False
    space = kind == _SPACE
    start = np.where(space, opens | ((after != _SPACE) & (after != _END)), opens & ~follows_blank)
    quotes = np.flatnonzero((code == 39) & start)
    if len(quotes):
        ends = np.append(firsts[1:], len(code))
        end = ends[np.searchsorted(firsts, quotes, "right") - 1]
        one = np.where(quotes + 1 < end, code[np.minimum(quotes + 1, len(code) - 1)], 0)
        two = np.where(quotes + 2 < end, code[np.minimum(quotes + 2, len(code) - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, length in ((short, 2), (long, 3)):
            q = quotes[hit]
            start[q + 1] = False
            nxt = q + length
            start[nxt[nxt < end[hit]]] = True
    starts = at_byte[start]
    marks = np.append(starts, len(raw)).astype(np.int64)
    return marks, np.searchsorted(starts, bounds).astype(np.int64)


def distinct_pretokens(raw: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number every pre-token among the distinct ones: (numbers, distinct byte strings)."""
    pieces = pa.Array.from_buffers(pa.large_binary(), len(marks) - 1, [None, pa.py_buffer(marks), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def spans(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of spans one after another, each given by its first place and its size."""
    ends = np.cumsum(sizes)
    return np.repeat(firsts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def piece_hashes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; no span may be empty."""
    size = np.diff(ends)
    powers = np.cumprod(np.full(int(size.max()), _BASE, np.uint64), dtype=np.uint64)
    place = np.arange(len(raw)) - np.repeat(ends[:-1], size)
    return mix(np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[place], ends[:-1]))


def _room(held: np.ndarray, least: int) -> np.ndarray:
    """The array with space for ``least`` values, doubled where it has too little."""
    return held if least <= len(held) else np.resize(held, 2 * least)


class PieceTable:
    """Piece ids of distinct pre-tokens, each encoded once while it is remembered."""

    def __init__(self, path: str):
        # tasks are the parallelism: threads of the library beside them cost more CPU time than they save
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same model behind a plain split, for pre-tokens that are already written in the byte-level alphabet
        self.by_line = Tokenizer.from_file(path)
        self.by_line.no_truncation()
        self.by_line.no_padding()
        self.by_line.encode_special_tokens = True
        self.by_line.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on;
        # byte 255, which is in no UTF-8 text, separates pre-tokens
        self.alphabet = np.arange(256, dtype="<u4")
        self.alphabet[hidden] = 256 + np.arange(len(hidden))
        self.alphabet[255] = ord("\n")
        # bytes that each id stands for
        self.width = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.tokenizer.get_vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.count = 0  # remembered pre-tokens; row k holds ids[ends[k] : ends[k + 1]] and the bytes text[text_ends[k] : text_ends[k + 1]]
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 18, np.int64)
        self.text = np.zeros(1 << 21, np.uint8)
        self.text_ends = np.zeros(1 << 18, np.int64)
        self.hashes, self.row_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes and their rows

    def learn(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode pre-tokens, at least one, given by their bytes and n + 1 bounds; remember their ids and return their rows."""
        n, row = len(ends) - 1, self.count
        data, at = raw.tobytes(), ends.tolist()
        lines = []
        for k in range(0, n, 500):
            pieces = [data[i:j] for i, j in pairwise(at[k : k + 501])]
            lines.append(self.alphabet[np.frombuffer(b"\xff".join(pieces), np.uint8)].tobytes().decode("utf-32-le"))
        new = np.concatenate([np.array(got.ids, np.uint32) for got in self.by_line.encode_batch_fast(lines, add_special_tokens=False)])
        used, said = int(self.ends[row]), int(self.text_ends[row])
        self.ids = _room(self.ids, used + len(new))
        self.text = _room(self.text, said + len(raw))
        self.ends, self.text_ends = _room(self.ends, row + n + 1), _room(self.text_ends, row + n + 1)
        self.ids[used : used + len(new)] = new
        self.text[said : said + len(raw)] = raw
        self.ends[row + 1 : row + 1 + n] = used + np.searchsorted(np.cumsum(self.width[new]), ends[1:]) + 1
        self.text_ends[row + 1 : row + 1 + n] = said + ends[1:]
        self.count += n
        return np.arange(row, row + n)

    def rows(self, pieces: pa.Array) -> np.ndarray:
        """Rows of distinct pre-tokens (large binary); those not remembered are encoded first.

        Hashes find candidates and the bytes decide; of different pre-tokens with
        equal hashes all but one are encoded each time.
        """
        raw, ends = byte_view(pieces)
        if not len(pieces):
            return np.zeros(0, np.int64)
        size = np.diff(ends)
        own = piece_hashes(raw, ends)
        row = np.full(len(pieces), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            candidate = self.row_of[at]
            hit = np.flatnonzero((self.hashes[at] == own) & (self.text_ends[candidate + 1] - self.text_ends[candidate] == size))
            candidate, length = candidate[hit], size[hit]
            same = self.text[spans(self.text_ends[candidate], length)] == raw[spans(ends[hit], length)]
            good = np.logical_and.reduceat(same, np.cumsum(length) - length) if len(hit) else np.zeros(0, bool)
            row[hit[good]] = candidate[good]
        new = np.flatnonzero(row < 0)
        if len(new) and self.count > CACHE_ENTRIES:
            self.forget()
            new = np.arange(len(pieces))
        if len(new):
            row[new] = self.learn(raw[spans(ends[new], size[new])], np.append(0, np.cumsum(size[new])))
            new = new[np.argsort(own[new], kind="stable")]
            at = np.searchsorted(self.hashes, own[new])
            self.hashes, self.row_of = np.insert(self.hashes, at, own[new]), np.insert(self.row_of, at, row[new])
        return row

    def count_pieces(self, pieces: list[bytes] | pa.Array) -> np.ndarray:
        """Number of ids of each distinct pre-token."""
        row = self.rows(pa.array(pieces, pa.large_binary()) if isinstance(pieces, list) else pieces.cast(pa.large_binary()))
        return self.ends[row + 1] - self.ends[row]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their n + 1 bounds."""
        raw, bounds = byte_view(column)
        odd = self.whole_only(raw, bounds)
        marks, firsts = pretoken_bounds(raw, bounds)
        if len(marks) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        number, distinct = distinct_pretokens(raw, marks)
        row = self.rows(distinct)
        size = self.ends[row + 1] - self.ends[row]
        ends = np.append(0, np.cumsum(size))
        own = self.ids[np.repeat(self.ends[row] - ends[:-1], size) + np.arange(ends[-1])]
        flat = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(4 * ends), pa.py_buffer(own)]).take(pa.array(number))
        ids = np.frombuffer(flat.buffers()[2], np.uint32)
        ends = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1] >> 2
        ids, bounds = ids[: ends[-1]], ends[firsts]
        if odd:
            whole = [ids[bounds[k] : bounds[k + 1]] for k in range(len(column))]
            for k in odd:
                whole[k] = np.array(self.tokenizer.encode(column[k].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, bounds = np.concatenate(whole), np.append(0, np.cumsum([len(x) for x in whole]))
        return ids, bounds

    def whole_only(self, raw: np.ndarray, bounds: np.ndarray) -> list[int]:
        """Numbers of the texts to encode whole: those with a special string or a newer letter."""
        data, odd = raw.tobytes(), set()
        for special in self.specials:
            at = data.find(special)
            while at >= 0:
                odd.add(int(np.searchsorted(bounds, at, "right")) - 1)
                at = data.find(special, at + 1)
        high = np.flatnonzero(raw >= 0xC8)  # the first letters that are newer than version 3.2 start with this byte
        if len(high):
            owners = np.unique(np.searchsorted(bounds, high, "right") - 1)
            for k in owners.tolist():
                code = np.frombuffer(data[bounds[k] : bounds[k + 1]].decode("utf-8").encode("utf-32-le"), np.uint32)
                if (code_point_classes()[code] == _NEWER).any():
                    odd.add(k)
        return sorted(odd)


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    """The worker's table for a vocabulary file."""
    return PieceTable(path)


def forget() -> None:
    """Drop what this worker remembers of vocabularies and pre-tokens; the next use reads it anew."""
    piece_table.cache_clear()


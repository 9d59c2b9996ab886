"""Media columns for ISO base media files.

``probe`` walks the nested boxes of a file, decodes the sample tables and gives
codec, duration and the byte ranges of the key frames of every track. Payload
bytes are never decoded: only box headers and the ``moov`` tables are read.
``mux`` writes the counterpart, a one-track file of fixed-size 8-bit frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .subword import text_column

#: Boxes that hold other boxes on the way to the sample tables (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}
FRAME_SIDE = 24  # a frame of 24 x 24 samples of 8 bits takes 576 bytes
FRAME_BYTES = FRAME_SIDE * FRAME_SIDE
TIMESCALE, TICKS = 25, 1
KEY_EVERY = 12
#: Containers inside one another; well-formed files have five.
MOST_DEPTH = 16


def boxes(data: memoryview, at: int, end: int):
    """Yield (kind, start of content, end) of the boxes in a range. Raises ValueError where sizes do not nest."""
    while at < end:
        if end - at < 8:
            raise ValueError(f"box header cut off at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError(f"box header cut off at {at}")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has size {size}")
        yield kind, at + head, at + size
        at += size


def _tree(data: memoryview, at: int, end: int, depth: int = 0) -> dict[bytes, list]:
    if depth > MOST_DEPTH:
        raise ValueError(f"boxes nest deeper than {MOST_DEPTH}")
    found: dict[bytes, list] = {}
    for kind, a, b in boxes(data, at, end):
        found.setdefault(kind, []).append(_tree(data, a, b, depth + 1) if kind in CONTAINERS else (a, b))
    return found


def _array(data: memoryview, box: tuple[int, int], columns: int, skip: int = 0) -> np.ndarray:
    """The table of big-endian 32-bit numbers in a full box that starts with its number of entries."""
    a, b = box
    (n,) = struct.unpack_from(">I", data, a + 4 + skip)
    if a + 8 + skip + 4 * columns * n > b:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, ">u4", n * columns, a + 8 + skip).astype(np.int64).reshape(n, columns)


def _one(tree: dict, *kinds: bytes):
    for kind in kinds:
        tree = tree[kind][0]
    return tree


def _track(data: memoryview, trak: dict) -> dict:
    mdia = _one(trak, b"mdia")
    a, _ = _one(mdia, b"mdhd")
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, _ = _one(mdia, b"hdlr")
    handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
    stbl = _one(mdia, b"minf", b"stbl")
    a, b = _one(stbl, b"stsd")
    kind, _, _ = next(boxes(data, a + 8, b))
    a, b = _one(stbl, b"stsz")
    same, count = struct.unpack_from(">II", data, a + 4)
    if same:
        if same * count > len(data):
            raise ValueError(f"{count} samples of {same} bytes are more than the file holds")
        sizes = np.full(count, same, np.int64)
    else:
        sizes = _array(data, (a, b), 1, 4)[:, 0]
    if b"co64" in stbl:
        a, b = stbl[b"co64"][0]
        (n,) = struct.unpack_from(">I", data, a + 4)
        if a + 8 + 8 * n > b:
            raise ValueError("a sample table is cut off")
        chunks = np.frombuffer(data, ">u8", n, a + 8).astype(np.int64)
    else:
        chunks = _array(data, _one(stbl, b"stco"), 1)[:, 0]
    runs = _array(data, _one(stbl, b"stsc"), 3)
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any()):
        raise ValueError("runs of chunks are out of order")
    per_chunk = np.zeros(len(chunks), np.int64)
    for k, (first, samples, _) in enumerate(runs.tolist()):
        per_chunk[first - 1 : int(runs[k + 1, 0]) - 1 if k + 1 < len(runs) else None] = min(samples, len(sizes))
    upto = np.cumsum(per_chunk)  # samples of a chunk and all before it
    if len(sizes) and (not len(upto) or upto[-1] < len(sizes)):
        raise ValueError("chunks hold fewer samples than the size table")
    number = np.arange(len(sizes))
    owner = np.searchsorted(upto, number, "right")
    ends = np.cumsum(sizes)
    base = np.append(0, ends)[np.minimum(upto - per_chunk, len(sizes))]
    offsets = chunks[owner] + (ends - sizes) - base[owner]
    if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("samples lie outside the file")
    times = _array(data, _one(stbl, b"stts"), 2)
    keys = _array(data, stbl[b"stss"][0], 1)[:, 0] - 1 if b"stss" in stbl else np.arange(len(sizes))
    return {
        "handler": handler,
        "codec": kind.decode("latin-1"),
        "timescale": timescale,
        "duration": duration,
        "samples": len(sizes),
        "ticks": int((times[:, 0] * times[:, 1]).sum()),
        "offsets": offsets,
        "sizes": sizes,
        "keys": keys[(keys >= 0) & (keys < len(sizes))],
    }


def parse(data: bytes) -> list[dict]:
    """Tracks of a file.

    Raises ValueError where the bytes are no well-formed file with a ``moov`` box
    (sizes, counts, nesting and byte ranges must fit the file), or a fragmented
    one, whose samples aren't in ``moov``.
    """
    view = memoryview(data)
    try:
        top = _tree(view, 0, len(view))
        if b"moof" in top or b"mvex" in top[b"moov"][0]:
            raise ValueError("fragmented media files are not read")
        return [_track(view, trak) for trak in top[b"moov"][0].get(b"trak", [])]
    except (KeyError, IndexError, struct.error, StopIteration) as e:
        raise ValueError(f"not a complete media file: {e!r}") from e


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return b"".join((struct.pack(">I4s", size, kind), *parts))


def _table(kind: bytes, rows: list[tuple[int, ...]]) -> bytes:
    flat = [x for row in rows for x in row]
    return _box(kind, struct.pack(f">II{len(flat)}I", 0, len(rows), *flat))


def mux(payload: bytes) -> bytes:
    """Store frames of 576 bytes as a one-track file of uncompressed 8-bit grey video."""
    frames, rest = divmod(len(payload), FRAME_BYTES)
    if rest or not frames:
        raise ValueError(f"{len(payload)} bytes are no positive multiple of {FRAME_BYTES}")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    span = frames * TICKS
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0), b"isommp41")
    start = len(head) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    wide = start + len(payload) >= 1 << 32
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", FRAME_SIDE, FRAME_SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    chunk = _box(b"co64", struct.pack(">IIQ", 0, 1, start)) if wide else _table(b"stco", [(start,)])
    stbl = _box(
        b"stbl",
        _box(b"stsd", struct.pack(">II", 0, 1), entry),
        _table(b"stts", [(frames, TICKS)]),
        _table(b"stss", [(k + 1,) for k in range(0, frames, KEY_EVERY)]),
        _table(b"stsc", [(1, frames, 1)]),
        _box(b"stsz", struct.pack(">III", 0, FRAME_BYTES, frames)),
        chunk,
    )
    minf = _box(b"minf", _box(b"vmhd", struct.pack(">I", 1), bytes(8)), _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))), stbl)
    mdhd = _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, TIMESCALE, span, 0x55C4, 0))
    hdlr = _box(b"hdlr", bytes(8), b"vide", bytes(12), b"frames\0")
    tkhd = _box(b"tkhd", struct.pack(">IIIIII", 7, 0, 0, 1, 0, span), bytes(16), matrix, struct.pack(">II", FRAME_SIDE << 16, FRAME_SIDE << 16))
    mvhd = _box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, TIMESCALE, span), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if start - len(head) == 16 else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return b"".join((head, mdat, payload, _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))))


TRACKS = "array<struct<handler:string,codec:string,timescale:long,duration:long,samples:long,key_ranges:array<struct<offset:long,size:long>>>>"


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """Add ``tracks`` and ``media_error`` to a table with a binary column.

    tracks: for each track handler, codec, timescale, duration, samples and the
    byte ranges of its key frames. Null or malformed bytes give null tracks; the
    reason is in ``media_error`` (null: none); a file without tracks gives an
    empty array. Input columns of these two names
    are replaced. Other columns, repeated rows and empty tables pass unchanged.
    """
    keep = [c for c in media.columns if c not in ("tracks", "media_error")]

    @F.pandas_udf(f"tracks {TRACKS}, media_error string")
    def read(blobs):
        import pandas as pd

        rows = []
        for blob in blobs:
            try:
                if blob is None:
                    raise ValueError("no bytes")
                tracks = [{c: t[c] for c in ("handler", "codec", "timescale", "duration", "samples")} | {"key_ranges": [{"offset": int(t["offsets"][k]), "size": int(t["sizes"][k])} for k in t["keys"]]} for t in parse(blob)]
                rows.append((tracks, None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["tracks", "media_error"], dtype=object)

    return media.select(*keep, read(F.col(column)).alias("tm_read")).select(*keep, "tm_read.tracks", "tm_read.media_error")


def store_texts(docs: DataFrame) -> DataFrame:
    """Store every whole text as a media file in a table of the shared folder: (doc_id, n_bytes, media).

    The payload is the text's UTF-8 bytes (null: none) and bytes 255 up to a
    positive multiple of 576.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), text_column(batch.column(1))
            for at in range(0, batch.num_rows, 256):
                raw = [t.as_py().encode() for t in texts.slice(at, 256)]
                media = [mux(t + b"\xff" * (-len(t) % FRAME_BYTES if t else FRAME_BYTES)) for t in raw]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def text_media_digests(docs: DataFrame) -> DataFrame:
    """Store texts as media, read the stored bytes back and compute digests and features.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and feature (codec, duration in seconds, samples and
    key-frame ranges as offset+size). Equal texts give equal values; a null text
    equals an empty one.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, n_bytes, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = memoryview(blob.as_buffer())
                (track,) = parse(media)
                first, last = int(track["offsets"][0]), int(track["offsets"][-1] + track["sizes"][-1])
                payload = media[first:last]
                if int(track["sizes"].sum()) != len(payload):
                    raise ValueError("samples are not contiguous")
                keys = track["keys"]
                ranges = ",".join(f"{o}+{s}" for o, s in zip(track["offsets"][keys].tolist(), track["sizes"][keys].tolist(), strict=True))
                feature = f"{track['codec'].strip()};{track['duration'] / track['timescale']:.3f}s;{track['samples']};{ranges}"
                out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return store_texts(docs).mapInArrow(run, schema)

"""Vector columns as fixed-length binary rows, checked in batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of at least this size don't fit the 64-bit integers that are made of them.
TOO_LARGE = 2.0**56


def element_type(df: DataFrame, column: str) -> np.dtype:
    """float32 for a column of floats, else float64."""
    return np.dtype(np.float32 if df.schema[column].dataType.simpleString() == "array<float>" else np.float64)


def matrix(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """The rows of a binary column of equal lengths as a float64 matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind) if len(column) else np.zeros(0, kind)
    return flat.reshape(len(column), -1 if len(column) else 1).astype(np.float64)


def usable(df: DataFrame, key: str, column: str, digests: bool = False) -> DataFrame:
    """(id, dims, vec) of the rows whose vector can be computed with.

    Left out are vectors that are null or empty and those with an entry that is
    null, not finite or at least 2**56 in size. ``vec`` holds the entries' bytes
    (see ``element_type``), a negative zero as zero. With ``digests``, the two halves
    ``h`` and ``g`` of a 128-bit digest of the vector follow.
    """
    kind = element_type(df, column)
    wanted = F.col(f"`{column}`").cast(f"array<{'float' if kind.itemsize == 4 else 'double'}>")

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values = lists.values.to_numpy(zero_copy_only=False).astype(kind, copy=False) + kind.type(0)
            ends = lists.offsets.to_numpy()
            bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < TOO_LARGE))])
            size = np.diff(ends)
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & (bad[ends[1:]] == bad[ends[:-1]])
            own = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
            keep = pa.array(good)
            own = own.filter(keep)
            columns = [batch.column(0).filter(keep), pa.array(size[good].astype(np.int32)), own]
            if digests:
                raw = b"".join(hashlib.blake2b(v.as_buffer(), digest_size=16).digest() for v in own)
                halves = np.frombuffer(raw, np.int64).reshape(-1, 2)
                columns += [pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "dims", "vec", *(["h", "g"] if digests else [])]
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), wanted.alias("vec")).mapInArrow(run, "id long, dims int, vec binary" + (", h long, g long" if digests else ""))


def usual_length(rows: DataFrame) -> int:
    """The length that most vectors have (the smaller of equals), 0 without vectors."""
    most = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    return most["dims"] if most else 0

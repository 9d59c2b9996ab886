"""Language identification by nearest centroids.

Texts become TF-IDF vectors of hashed byte n-grams (one to three bytes of the
lower-cased letters, words apart), scaled to length one. Every language has
several centroids, found by spherical k-means over its training texts. A text
takes the language of the centroid with the largest cosine; it is rejected where
even that centroid is further away than training texts of its size are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import REST, carried, restored
from .subword import byte_view, forget, steps, text_column

DIMS = 4096
CENTROIDS = 4
#: Most distinct training texts, over all languages. Languages have equal parts of it; what small ones leave goes to the others.
#: Of a language, those with the smallest hashes are taken. A language always has one text at least.
TRAIN_ROWS = 3000
STEP_BYTES = 1 << 20
#: Training texts whose vectors the driver makes at once.
BLOCK = 256
#: Upper bounds, in letters, of the size classes that have a rejection distance of their own.
SIZES = (20, 60, 200, 1000)
#: A text is rejected below this share of the smallest cosine that training texts of its size class reach.
SLACK = 0.5


def vectors(part: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts (texts x dims, float32) and letters of each text."""
    import pyarrow.compute as pc

    words = pc.utf8_lower(pc.replace_substring_regex(part, r"[^\pL]+", " "))
    raw, bounds = byte_view(words)
    n = len(part)
    owner = np.repeat(np.arange(n), np.diff(bounds)).astype(np.int64)
    letters = np.bincount(owner, (raw != 32) & ((raw & 0xC0) != 0x80), n).astype(np.int64)
    code = raw.astype(np.uint32)
    out = np.zeros(n * dims, np.float32)
    gram = code
    for size in (1, 2, 3):
        if size > 1:
            gram = (gram[:-1] << np.uint32(8)) | code[size - 1 :]
        if not len(gram):
            break
        slot = ((gram * np.uint32(2654435761) + np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(20)).astype(np.int64) % dims
        whole = owner[: len(gram)] == owner[size - 1 :]
        out += np.bincount((owner[: len(gram)] * dims + slot)[whole], minlength=n * dims).astype(np.float32)
    return out.reshape(n, dims), letters


def scale(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF-IDF at length one; a row without n-grams stays zero."""
    x = np.log1p(counts) * idf
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length one; the start is the mean and then the texts furthest from all chosen so far."""
    k = min(k, len(x))
    first = x.mean(axis=0)
    centres = [first / max(np.linalg.norm(first), 1e-12)]
    while len(centres) < k:
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(k):
            if (own == j).any():
                mean = x[own == j].mean(axis=0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


@dataclass
class LanguageModel:
    """Centroids of all languages with the weights and distances they were made with."""

    languages: list[str]
    owner: np.ndarray  # language number of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    nearest: np.ndarray  # smallest training cosine of each size class

    def classify(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, cosine, rejected) of each text."""
        counts, letters = vectors(part, len(self.idf))
        if not len(self.centroids):
            return np.full(len(part), -1), np.zeros(len(part)), np.ones(len(part), bool)
        cosine = scale(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        language = np.where(letters > 0, self.owner[best], -1)
        far = score < SLACK * self.nearest[np.searchsorted(SIZES, letters, "left")]
        return language, np.where(letters > 0, score, 0), far | (letters == 0)


def language_parts(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Number of training texts of each language: all it has, or an equal part of what smaller ones leave."""
    out = {}
    for k, (name, count) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(count, max(1, rows // (len(counts) - k)))
        rows -= out[name]
    return out


def training_counts(train: DataFrame, dims: int, rows: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(n-gram counts, letters, languages) of the training texts, by hash; counts are pairs of used places and what they hold.

    Copies of a row count once and texts are taken whole, whatever their length;
    only the counts reach the driver.
    """
    usable = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    counts = {r["lang"]: r["count"] for r in usable.select("lang", "h").distinct().groupBy("lang").count().collect()}
    parts = language_parts(counts, rows)
    # hashes are uniform, so few more texts than needed lie below these bounds
    bounds = [(name, (n + 6 * n**0.5 + 10) / counts[name]) for name, n in parts.items()]
    limit = train.sparkSession.createDataFrame(bounds, "lang string, bound double")
    near = usable.join(F.broadcast(limit), "lang").where(F.col("h") / 2.0**64 + 0.5 <= F.col("bound"))
    chosen = near.groupBy("lang", "h").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            for at, part in steps(text_column(batch.column(2)), STEP_BYTES):
                for lo in range(0, len(part), 512):
                    some = part.slice(lo, 512)
                    found, letters = vectors(some, dims)
                    places = [np.flatnonzero(x).astype(np.uint16) for x in found]  # few places of a text are used
                    counts = [x[at_].tobytes() for x, at_ in zip(found, places, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at + lo, len(some)) for c in (0, 1)), pa.array(letters), pa.array([x.tobytes() for x in places], pa.binary()), pa.array(counts, pa.binary())], ["lang", "h", "letters", "places", "counts"])

    got = chosen.select("lang", "h", "text").mapInArrow(run, "lang string, h long, letters long, places binary, counts binary").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    langs, seen, take = got["lang"].to_pylist(), dict.fromkeys(parts, 0), []
    for k, name in enumerate(langs):
        seen[name] += 1
        if seen[name] <= parts[name]:
            take.append(k)
    found = [(np.frombuffer(got["places"][k].as_buffer(), np.uint16), np.frombuffer(got["counts"][k].as_buffer(), np.float32)) for k in take]
    return found, got["letters"].to_numpy()[take], np.array([langs[k] for k in take])


def unpacked(counts: list[tuple[np.ndarray, np.ndarray]], dims: int) -> np.ndarray:
    """Texts x dims of what ``training_counts`` gives."""
    out = np.zeros((len(counts), dims), np.float32)
    for row, (places, times) in zip(out, counts, strict=True):
        row[places] = times
    return out


def training_vectors(train: DataFrame, dims: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``training_counts`` with the counts as one array (texts x dims)."""
    counts, letters, langs = training_counts(train, dims, rows)
    return unpacked(counts, dims), letters, langs


def _scaled(counts: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Vectors of length one, made block by block."""
    out = np.empty((len(counts), len(idf)), np.float32)
    for lo in range(0, len(counts), BLOCK):
        out[lo : lo + BLOCK] = scale(unpacked(counts[lo : lo + BLOCK], len(idf)), idf)
    return out


def fit(train: DataFrame, dims: int = DIMS, centroids: int = CENTROIDS, rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on distinct (text, lang); at most ``rows`` are used, of every language as many as ``language_parts`` says.

    Null texts and languages are left out. Without training rows the model has
    no language and rejects every text. Languages are ordered by name. The driver
    holds the vectors of one language, then of ``BLOCK`` texts.
    """
    counts, letters, langs = training_counts(train, dims, rows)
    if not len(counts):
        return LanguageModel([], np.zeros(0, int), np.zeros((0, dims), np.float32), np.ones(dims, np.float32), np.zeros(len(SIZES) + 1))
    used = np.zeros(dims, np.int64)
    for places, _ in counts:
        used[places] += 1
    idf = np.log((1 + len(counts)) / (1 + used)).astype(np.float32) + np.float32(0.1)
    names = sorted(set(langs.tolist()))
    parts = [spherical_kmeans(_scaled([counts[k] for k in np.flatnonzero(langs == name)], idf), centroids) for name in names]
    owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    c = np.concatenate(parts).astype(np.float32)
    top = np.concatenate([(_scaled(counts[lo : lo + BLOCK], idf) @ c.T).max(axis=1) for lo in range(0, len(counts), BLOCK)])
    kind = np.searchsorted(SIZES, letters, "left")
    nearest = np.array([top[(kind == k) & (letters > 0)].min() if ((kind == k) & (letters > 0)).any() else 0.0 for k in range(len(SIZES) + 1)])
    return LanguageModel(names, owner, c, idf, nearest)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add lang_pred (string), lang_score (0 to 1) and lang_rejected (boolean) to a table with a text column.

    A text that is null or has no letter gets ``und``, 0 and true. Input columns
    of these three names, in any case, are replaced; all others, whatever their
    names, repeated rows and empty tables pass unchanged.
    """
    added = ["lang_pred", "lang_score", "lang_rejected"]
    own_docs = carried(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x dims numbers

    def run(batches):
        forget()  # an earlier tokenisation in this worker; nothing here reads it
        own = shared.value
        names = pa.array([*own.languages, "und"])
        for batch in batches:
            texts = text_column(batch.column(0))
            for at, part in steps(texts, STEP_BYTES):
                for lo in range(0, len(part), 512):
                    some = part.slice(lo, 512)
                    language, score, rejected = own.classify(some)
                    rest = [c.slice(at + lo, len(some)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*rest, names.take(pa.array(np.where(language < 0, len(own.languages), language))), pa.array(score.astype(np.float64)), pa.array(rejected)], ["text", REST, *added])

    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL("lang_pred string, lang_score double, lang_rejected boolean")
    found = own_docs.mapInArrow(run, StructType([*own_docs.schema.fields, *kinds.fields]))
    return restored(found, docs.columns, ["text"], added)

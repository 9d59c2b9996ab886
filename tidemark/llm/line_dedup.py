"""Line dedup by overlapping windows of consecutive lines.

Every window of three consecutive lines gets a 128-bit hash. The first place of
a window in the corpus, by (doc_id, line), stays; all later places are removed.
The removed places of a document are merged: a line goes if any later window
covers it. Windows are counted with map-side sums, and those that are frequent
find their first place in a broadcast copy of bounded size, so a window that a
third of all rows hold fills no task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import carried, restored
from .skew import join_unique
from .storage import stored

WIDTH = 3


def window_hashes(lines: Column, width: int) -> Column:
    """128-bit hashes of all windows of an array column of lines, as structs of two longs."""

    def one(at: Column) -> Column:
        own = [F.element_at(lines, at + k) for k in range(1, width + 1)]
        # the differing first argument seeds two independent hashes; lengths keep the line bounds apart
        sizes = [F.length(x) for x in own]
        return F.struct(F.xxhash64(F.lit(1), *sizes, *own).alias("h1"), F.xxhash64(F.lit(2), *own, *sizes).alias("h2"))

    n = F.size(lines)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), one)).otherwise(F.array().cast("array<struct<h1:bigint,h2:bigint>>"))


def later_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, at): the windows that occur earlier in the corpus, by the number of their first line."""
    # the lines are a column of their own: inside a lambda the text would be split again for every window
    split = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("tm_lines"))
    each = split.select("doc_id", "text_hash", F.posexplode(window_hashes(F.col("tm_lines"), width)).alias("at", "h")).select("doc_id", "text_hash", "at", "h.h1", "h.h2")
    place = F.struct("doc_id", "at", "text_hash")
    firsts = stored(each.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "windows")
    return join_unique(each, firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "at")


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Remove later occurrences of repeated windows of ``width`` lines.

    Returns the columns of ``docs`` with ``text`` rewritten, ``n_chars`` (where
    the table has it) recounted for changed texts, and ``lines_removed`` (int,
    last; an input column of that name, in any case, is replaced). Other columns
    pass unchanged, whatever their names. Lines are what ``\\n``
    separates, compared exactly. Texts of fewer than ``width`` lines, empty and
    null texts stay as they are. No row is dropped: a text all of whose lines go
    becomes empty. Rows with equal doc_id and text count as one document. A null
    doc_id comes before all others. An empty table gives no rows.
    """
    every, plain = docs.columns, ["doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    docs = carried(docs, *plain)
    later = later_windows(docs.select("doc_id", "text"), width)
    spots = later.distinct().groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("at")).alias("tm_at"))  # a number for each line at most
    spots = spots.withColumnsRenamed({"doc_id": "tm_id", "text_hash": "tm_hash"})
    columns = docs.columns
    same = F.col("doc_id").eqNullSafe(F.col("tm_id")) & (F.xxhash64("text") == F.col("tm_hash"))
    at = F.col("tm_at")
    # merged at every size: the removed places grow with the corpus
    joined = docs.select(columns).join(spots.hint("merge"), same, "left").withColumn("tm_lines", F.when(at.isNotNull(), F.split("text", "\n", -1)))
    lines = F.col("tm_lines")

    def before(place: Column, k: Column) -> Column:
        """Lines between the end of the previous removed window and this one."""
        end = F.when(k == 0, 0).otherwise(F.element_at(at, F.greatest(k, F.lit(1))) + width)
        return F.slice(lines, end + 1, F.greatest(place - end, F.lit(0)))

    tail = F.slice(lines, F.element_at(at, -1) + (width + 1), F.size(lines))
    rest = F.flatten(F.concat(F.transform(at, before), F.array(tail)))
    joined = joined.withColumn("tm_rest", F.when(at.isNotNull(), rest)).withColumn("lines_removed", F.coalesce(F.size(lines) - F.size("tm_rest"), F.lit(0)))
    joined = joined.withColumn("lines_removed", F.when(at.isNotNull(), F.col("lines_removed")).otherwise(0))
    new = {"text": F.when(at.isNotNull(), F.array_join("tm_rest", "\n")).otherwise(F.col("text"))}
    if "n_chars" in columns:
        new["n_chars"] = F.when(at.isNotNull(), F.length(F.array_join("tm_rest", "\n")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    out = joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns], "lines_removed")
    return restored(out, every, plain, ["lines_removed"])

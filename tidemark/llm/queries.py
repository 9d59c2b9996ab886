"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curve_search, decision_list, isomedia, langid, lexical_search, license_join, line_dedup, mixing, near_dup, packing, rans, token_counts, whitening

BYTE_BPE, BYTE_BPE_SIZE = "byte_bpe_50k.json", 50_257


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as range-coded blocks and read back."""
    return rans.encode_decode(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), BYTE_BPE_SIZE)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for target weights of the labelled domains."""
    return mixing.mix(_documents(spark, sf_dir), mixing.label_domains(_labels(spark, sf_dir)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later occurrences of repeated three-line windows."""
    return line_dedup.dedup_lines(_documents(spark, sf_dir)).select("doc_id", "lines_removed", F.col("text").alias("text_left"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as media files, read back and probed."""
    return isomedia.text_media_digests(_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on all documents."""
    judged = decision_list.judge(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all documents."""
    return license_join.scan(_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, by four-word shingles."""
    return near_dup.near_duplicates(_documents(spark, sf_dir), width=4)


def held_out() -> F.Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from two thirds of the labelled ones."""
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical_search.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first 32 whitened components."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of all embeddings for every twentieth one."""
    return curve_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: SQL twin of op3: windows by their text, the first by (doc_id, line), removed lines merged.
OP3_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS h
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM f WHERE k > 1),
own AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS t FROM d),
rest AS (SELECT l.doc_id, count(g.line) AS n, string_agg(CASE WHEN g.line IS NULL THEN l.t END, chr(10) ORDER BY l.line) AS t
         FROM own l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT doc_id, CAST(n AS INTEGER) AS lines_removed, coalesce(t, '') AS text_left FROM rest
"""

#: SQL twin of op4's columns can't be given: DuckDB has no crc32 and writes no media boxes.


#: SQL twin of op11: postings of the asked terms only, statistics over all terms.
OP11_SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM low WHERE t IS NOT NULL),
sizes AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM words),
asked AS (SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
held AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM words)
         WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, sizes GROUP BY term),
hits AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS impact FROM held JOIN weights USING (term), sizes),
sums AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM asked JOIN hits USING (term) GROUP BY item_id, doc_id HAVING sum(times * impact) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sums) WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_rans, op2_mixing, op3_line_dedup, op4_media, op5_packing, op6_decision_list, op7_licenses, op8_token_counts, op9_near_dup, op10_language, op11_lexical_search, op12_whitening, op13_curve_search)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op11_lexical_search": OP11_SQL}

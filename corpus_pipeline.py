"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes every
stage's result as Parquet in the shared folder and gives it to the next one.
All but the last return the columns of ``documents``. Stages work on whole
tables and texts. Further columns, whatever their names (dots, other cases of a
name that a stage uses), pass unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, line_dedup, mixing, near_dup, packing
from tidemark.llm.columns import carried, restored
from tidemark.llm.storage import bound_batches, drop, scratch, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: null texts, no letters, or far from all centroids.

    Learned from the rows with a lang. Repeated rows share their fate.
    """
    bound_batches(spark)
    plain = ["doc_id", "text", "lang"]
    own = carried(docs, *plain)
    found = langid.identify(own, langid.fit(own))
    return restored(found.where(~F.col("lang_rejected")), docs.columns, plain)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of repeated three-line windows; every row stays, n_chars is recounted.

    Null, empty and short texts stay as they are; rows with equal doc_id and text
    are one document and get equal texts.
    """
    plain = ["doc_id", "text", "n_chars"]
    return restored(line_dedup.dedup_lines(carried(docs, *plain)), docs.columns, plain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8).

    Null and empty texts have no duplicates and stay. Of rows with equal doc_id
    and text one stays.
    """
    bound_batches(spark)
    own = carried(docs, "doc_id", "text")
    groups = near_dup.near_duplicates(own.select("doc_id", "text"))
    kept = groups.where("kept").select(F.col("doc_id").alias("tm_id")).distinct()
    survivors = own.join(kept, F.col("doc_id").eqNullSafe(F.col("tm_id")), "left_semi")
    return restored(survivors.dropDuplicates(["doc_id", "text"]), docs.columns, ["doc_id", "text"])


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that expected tokens of the labelled domains meet the target weights.

    Rates are at most 1, so no row is taken twice. Texts of the wanted domain keep
    rates at or near 1. A null text has no token and the prior's rate; repeated
    rows are taken together.
    """
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = ["doc_id", "text"]
    return restored(mixing.mix(carried(docs, *plain), labels, keep=[*plain, "tm_doc"]).where("taken"), docs.columns, plain)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into sequences of 2048 tokens, one row for each piece.

    A null text packs its end id alone; repeated rows are packed each time.
    """
    bound_batches(spark)
    return packing.pack(carried(docs, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dup", drop_near_duplicates),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Hashing, learned models and tokenisation are not expressible in SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents`` and return the packed pieces.

    What a stage needed on the way, its input included, is deleted when its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        result: list[DataFrame] = []
        with scratch(spark, result):
            result.append(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            drop(before)
        docs = before = result[0]
    return docs

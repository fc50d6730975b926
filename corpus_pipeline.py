"""The corpus pipeline: quality rules, language identification, exact duplicates, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last return the columns
of documents. run() writes each stage's rows in the shared folder and reads them back as the next one's docs.

Stages of models have no SQL; tests hold the whole against brute force. Null texts, empty tables, repeated rows and
further columns are handled as the operators of the stages say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.llm import exact_dedup, language_id, near_dedup, packing, quality
from trialforge.llm._common import raw_text, read, stored

#: A document is rejected by its language if it has no letter, or is less like any language than this cosine: four times
#: the standard deviation 1 / sqrt(DIMENSIONS) of a text's cosine with a language that has nothing in common with it.
LEAST_COSINE = 4 / language_id.DIMENSIONS**0.5
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the trees keep."""
    return quality.judged(docs, read(spark, sf_dir, "labels")).where("kept").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are in one of the languages learned from the rows' own labels; without any label, rows that have a letter."""
    languages, prototypes = language_id.train(docs)
    if not languages:
        return docs.where(F.pandas_udf(language_id.has_letter, "boolean")(raw_text(F.col("text"))))
    sure = (F.col("told.lang_pred") != "und") & (F.col("told.score") >= LEAST_COSINE)
    told = language_id.predicted(languages, prototypes)(raw_text(F.col("text")))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), told.alias("told")).where(sure).select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.distinct_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates (five words, 0.8)."""
    return near_dedup.distinct_rows(docs, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 4096 tokens, with their ids and the CRC-32 of these."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality_rules", quality_rules), ("language", language), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

"""A corpus pipeline: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns; the last returns
packed pieces. What a stage returns is written as Parquet in the shared folder and read again by the next.

Null and empty texts pass all stages but the first, where they score the share of good labels; rows that repeat both
doc_id and text are one row from the second stage on; null doc_ids are compared like any other there, told by their text
in the third, and stay null. All columns of documents are kept, whatever further ones there are and whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, neardup, packing, pii, quality, queries
from tessera.llm.common import Scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; without labels all of them."""
    return quality.keep_good(docs, queries.quality_model(spark, sf_dir), least=0.7)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: the one of the least doc_id, then hash of the text."""
    return neardup.keep_one(docs, n=5, percent=80)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item."""
    return decontam.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data; n_chars, where it is a column, follows the text."""
    replaced = pii.replace_pii(docs, key=queries.PII_KEY)
    n = F.when(F.col(replaced.columns[-1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", n).select(docs.columns) if "n_chars" in docs.columns else replaced.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens; a null or empty text is one piece of one token."""
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    keep = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = keep.write(stage(spark, docs, sf_dir))
        if before is not None:
            keep.drop(before)
        before = docs
    return docs

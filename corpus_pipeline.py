"""The corpus pipeline: language ID, exact and near deduplication, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from quarry.llm.common import crc_fold, documents, free_names, materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language: null texts and texts without a letter, and all if no row has a language.

    Other columns may be null and have any names; a null doc_id counts as fold 0; repeated rows and an empty table pass through.
    """
    training = docs.where(crc_fold(F.col("doc_id")) != 0).select("doc_id", "text", "lang")
    lang, score = free_names(docs, "lang_pred", "lang_score")
    found = language_id.predict(docs, language_id.train(training), lang_as=lang, score_as=score)
    return found.where(F.col(lang) != language_id.UND).drop(lang, score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of equal texts (white space counts as one space).

    A null text is empty; a null id comes last; rows that repeat id and text stay once; an empty table stays empty.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each near-duplicate class (weighted similarity of 0.8 or more).

    Blank and null texts are no copies of each other; a null id comes last; rows that repeat id and text stay once.
    """
    return near_dedup.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (edit similarity of 0.8 or more).

    Null and blank texts hold none; an empty benchmark keeps all; repeated rows are judged alike.
    """
    return decontamination.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens; a null text has its end token alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Sampling, edit distances and the tokenizer are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs

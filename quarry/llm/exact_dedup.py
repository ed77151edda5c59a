"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Texts are equal when they are identical after every run of ASCII white space became one space.
A text is cut at content-defined places into chunks. Each distinct chunk gets an identifier that is
verified: chunks that share the short hash but not the digest get a longer identifier. Texts are then
compared by their ordered lists of identifiers, so the text itself is read once and never shuffled.

Defined cases: a null text counts as empty; all empty texts are equal; of rows that tie on doc_id one
row stays; a null doc_id sorts after every other; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, free_names, materialise

#: White-space runs other than a single space; single spaces already have the wanted form.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: A chunk ends after punctuation and a space, not before 256 and not after 2048 characters.
_CHUNK = r"(?s).{256,2048}?(?<=[.,;:!?]\x20)|.{1,2048}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_tag, text_sha256, recipe) with recipe = ordered (short hash, digest) of the chunks."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    chunks = F.regexp_extract_all("norm", F.lit(_CHUNK), F.lit(0))
    return norm.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_tag"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks, lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d"))).alias("recipe"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    recipes = materialise(chunk_recipes(docs, id_col, text_col))
    parts = recipes.select("row_tag", F.explode("recipe").alias("r")).select("row_tag", "r.h", "r.d")
    collided = materialise(parts.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("h"))
    list_of = lambda one: F.sha2(F.array_join(F.transform("recipe", one), ","), 256)
    ids = list_of(lambda r: F.hex(r["h"]))
    if not collided.isEmpty():
        long = list_of(lambda r: F.concat_ws(":", F.hex(r["h"]), F.hex(r["d"])))
        flagged = parts.join(collided, "h", "left_semi").select("row_tag").distinct().withColumn("long_ids", F.lit(True))
        recipes, ids = recipes.join(flagged, "row_tag", "left"), F.when(F.col("long_ids"), long).otherwise(ids)
    # A list of identifiers is compared as its digest, so copies of a long text move as little as others.
    listed = recipes.select("doc_id", "row_tag", "text_sha256", ids.alias("ids"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_tag"))
    groups = listed.groupBy("ids").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    return listed.join(groups, "ids").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_tag") == F.col("first.row_tag")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat both id and text stay once, rows that repeat the id alone all stay. Extra columns may have any names."""
    groups = exact_groups(docs, id_col, text_col)
    stay_id, stay_sha, again_id, again_sha = free_names(docs, "stay_id", "stay_sha", "again_id", "again_sha")
    sha, key = F.sha2(normalised(F.col(text_col)), 256), F.col(id_col)
    stay = groups.where("kept").select(F.col("doc_id").alias(stay_id), F.col("text_sha256").alias(stay_sha))
    kept = docs.join(stay, key.eqNullSafe(F.col(stay_id)) & (sha == F.col(stay_sha)), "left_semi")
    repeated = groups.groupBy("doc_id", "text_sha256").count().where("count > 1")
    again = repeated.select(F.col("doc_id").alias(again_id), F.col("text_sha256").alias(again_sha))
    same = key.eqNullSafe(F.col(again_id)) & (sha == F.col(again_sha))
    twice = kept.join(again, same, "left_semi").withColumn(stay_sha, sha).dropDuplicates([id_col, stay_sha]).drop(stay_sha)
    return kept.join(again, same, "left_anti").unionByName(twice)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), s AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM n),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM s GROUP BY text_sha256)
SELECT s.doc_id, g.keep_id, g.group_size, s.doc_id = g.keep_id AS kept, s.text_sha256
FROM s JOIN g USING (text_sha256)
"""

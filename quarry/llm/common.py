"""Shared helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.lineage import discard, materialise

__all__ = ["blocks", "crc_fold", "discard", "documents", "free_names", "largest", "materialise"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` (whatever its case) has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def largest(df: DataFrame, value: str, most: int) -> DataFrame:
    """The rows of the greatest values, down to a limit that at most ``most`` rows reach: found by counts of values on
    a log scale, so no task sorts all rows. Rows with one value stay or go together. Where more than ``most`` rows share
    the top level, that level is cut into finer ones; rows of one value that are more than ``most`` are left out as a
    whole, and so is all below them."""
    for fine in (64, 1 << 12, 1 << 20):
        level = F.floor(F.log2(value) * fine)
        sizes = df.where(F.col(value) > 0).groupBy(level.alias("level")).count()
        # Of the finer levels only the highest are needed; a table of few levels comes whole.
        top = sizes.orderBy(F.desc("level")).limit(1 << 14).collect()
        total, least = 0, None
        for r in top:
            total += r["count"]
            if total > most:
                break
            least = r["level"]
        if least is not None or not top:
            break
    return df.where(level >= least if least is not None else F.lit(False))


def blocks(rows: int, per_block: int) -> int:
    """How many blocks of about ``per_block`` rows hold ``rows`` rows; at least one."""
    return max(1, -(-int(rows) // per_block))


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the decimal doc_id, modulo ``folds``; 0 where doc_id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))

"""Seeded sampling and splits: order by md5 of key and seed, so any engine gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(*cols: Column | str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", *cols, F.lit(seed)))


def per_category(df: DataFrame, category: str, key: str, n: Column | int, seed: int = 42) -> DataFrame:
    """n random rows of each category; ``n`` may be a column of the row."""
    order = Window.partitionBy(category).orderBy(order_key(key, seed=seed), key)
    return df.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= n).drop("_turn")


#: The sample size of a category below each count; ``None`` stands for the caller's ``low``, and 5 for all others.
STRATA = ((10, 0), (100, None), (500, 3), (1000, 4))


def stratum_size(count: Column, low: Column | int = 1) -> Column:
    """Sample size by category count: none, 1 or 2, 3, 4, 5."""
    out = F
    for below, size in STRATA:
        out = out.when(count < below, low if size is None else size)
    return out.otherwise(5)


def split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """(key, split) over distinct keys: each key falls by its own hash, so no task ranks all of them."""
    u = F.conv(F.substring(order_key(key, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    total, out = 0.0, None
    for name, share in shares.items():
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return df.select(key).distinct().withColumn("split", out.otherwise(name))


def graded_sample(runs: DataFrame, gold: DataFrame, top: int = 10, near: int = 5, far: int = 10, seed: int = 42) -> DataFrame:
    """(qid, doc_id, label): gold 2; ``near`` of the runs' top documents 1; ``far`` of the rest 0."""
    pool = runs.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank")).join(gold.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    turn = Window.partitionBy("qid").orderBy(order_key("qid", "doc_id", seed=seed), "doc_id")
    ones = pool.where(F.col("rank") <= top).withColumn("t", F.row_number().over(turn)).where(F.col("t") <= near).select("qid", "doc_id", F.lit(1).alias("label"))
    zeros = pool.join(ones, ["qid", "doc_id"], "left_anti").where(F.col("rank") > top).withColumn("t", F.row_number().over(turn)).where(F.col("t") <= far).select("qid", "doc_id", F.lit(0).alias("label"))
    return gold.select("qid", "doc_id", F.lit(2).alias("label")).unionByName(ones).unionByName(zeros)


def hard_and_easy(candidates: DataFrame, hard: int = 70, total: int = 100, rank: int = 100, seed: int = 42) -> DataFrame:
    """``hard`` negatives under ``rank``, filled up to ``total`` with others (or with more hard ones)."""
    flag = (F.col("rank") < rank).alias("is_hard")
    ranked = candidates.select("*", flag).withColumn("t", F.row_number().over(Window.partitionBy("qid", "is_hard").orderBy(order_key("qid", "doc_id", seed=seed), "doc_id")))
    # Rows of the quota first, then the other kind, then hard ones beyond their quota.
    tier = F.when(F.col("is_hard") & (F.col("t") <= hard), 0).when(~F.col("is_hard"), 1).otherwise(2)
    fill = F.row_number().over(Window.partitionBy("qid").orderBy("tier", "t"))
    return ranked.withColumn("tier", tier).withColumn("n", fill).where(F.col("n") <= total).select("qid", "doc_id", "rank", "is_hard")

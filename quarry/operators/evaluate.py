"""Ranking metrics. Missing queries, gain and ties differ by metric and are named, never implied."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ideal(qrels: DataFrame, k: int, gain: str = "exponential") -> DataFrame:
    g = F.pow(F.lit(2.0), F.col("rel")) - 1 if gain == "exponential" else F.col("rel").cast("double")
    order = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    top = qrels.where("rel > 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return top.groupBy("qid").agg(F.sum(g / F.log2(F.col("r") + 1.0)).alias("idcg"))


def ndcg(run: DataFrame, qrels: DataFrame, k: int, gain: str = "exponential", missing: str = "zero") -> DataFrame:
    """(qid, ndcg) with the ideal from the judgements; judged queries that the run misses count 0 or are left out."""
    g = F.pow(F.lit(2.0), F.col("rel")) - 1 if gain == "exponential" else F.col("rel").cast("double")
    hits = run.where(F.col("rank") <= k).join(qrels.where("rel > 0"), ["qid", "doc_id"])
    dcg = hits.groupBy("qid").agg(F.sum(g / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    base = ideal(qrels, k, gain)
    if missing == "skip":
        base = base.join(run.select("qid").distinct(), "qid", "left_semi")
    return base.join(dcg, "qid", "left").select("qid", (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"))


def ndcg_tie_averaged(scored: DataFrame, k: int) -> DataFrame:
    """(qid, ndcg) over rows (qid, score, rel): linear gain, ties share their mean discount, ideal over the rows given."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"))
    ranked = scored.withColumn("r", F.row_number().over(order))
    discount = F.when(F.col("r") <= k, 1 / F.log2(F.col("r") + 1.0)).otherwise(0.0)
    ties = ranked.groupBy("qid", "score").agg(F.sum(discount).alias("d"), F.avg("rel").alias("g"))
    dcg = ties.groupBy("qid").agg(F.sum(F.col("d") * F.col("g")).alias("dcg"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel")))).withColumn("d", discount)
    full = best.groupBy("qid").agg(F.sum(F.col("d") * F.col("rel")).alias("idcg"))
    return full.join(dcg, "qid").select("qid", F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg"))


def recall(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, recall) over judged queries; missing ones count 0."""
    relevant = qrels.where("rel > 0")
    found = run.where(F.col("rank") <= k).join(relevant.select("qid", "doc_id"), ["qid", "doc_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    return relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).join(found, "qid", "left").select("qid", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"))


def recall_of_retrieved(labelled: DataFrame, k: int) -> DataFrame:
    """(qid, recall) over the positives that were retrieved at all; 0 where there are none."""
    hits = F.count_if((F.col("rel") > 0) & (F.col("rank") <= k))
    return labelled.groupBy("qid").agg(F.coalesce(F.try_divide(hits, F.count_if(F.col("rel") > 0)), F.lit(0.0)).alias("recall"))


def reciprocal_rank(run: DataFrame, qrels: DataFrame) -> DataFrame:
    first = run.join(qrels.where("rel > 0").select("qid", "doc_id"), ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    return qrels.where("rel > 0").select("qid").distinct().join(first, "qid", "left").select("qid", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def average_precision(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    relevant = qrels.where("rel > 0")
    hits = run.where(F.col("rank") <= k).join(relevant.select("qid", "doc_id"), ["qid", "doc_id"])
    nth = hits.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    total = nth.groupBy("qid").agg(F.sum(F.col("nth") / F.col("rank")).alias("total"))
    n = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return n.join(total, "qid", "left").select("qid", (F.coalesce("total", F.lit(0.0)) / F.least("n", F.lit(k))).alias("ap"))


def evaluator_order(run: DataFrame) -> DataFrame:
    """Ranks as the common evaluation tool takes them: by score, then document id, both descending."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id"))
    return run.withColumn("rank", F.row_number().over(order))


def summary(metric: DataFrame, value: str) -> DataFrame:
    return metric.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))


def compare(baseline: DataFrame, reranked: DataFrame) -> DataFrame:
    """(metric, baseline, reranked, change, change_pct): rounded to 2 places, 0 % where the baseline is 0."""
    change = F.col("reranked") - F.col("baseline")
    both = baseline.select("metric", F.col("value").alias("baseline")).join(reranked.select("metric", F.col("value").alias("reranked")), "metric")
    return both.select("metric", "baseline", "reranked", F.round(change, 2).alias("change"), F.round(F.coalesce(F.try_divide(change * 100, "baseline"), F.lit(0.0)), 2).alias("change_pct"))


def coverage(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """Judged queries, how many of them the run lacks, and the share it has."""
    asked = qrels.select("qid").distinct()
    have = run.select("qid").distinct().withColumn("there", F.lit(1))
    return asked.join(have, "qid", "left").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("there").isNull()).alias("missing"), (F.count("there") * 100.0 / F.count(F.lit(1))).alias("coverage_pct")
    )


def precision_at(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, accuracy, precision): any relevant document, and the share of relevant ones, among the first k; over judged queries."""
    hits = run.where(F.col("rank") <= k).join(qrels.where("rel > 0").select("qid", "doc_id").distinct(), ["qid", "doc_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("h"))
    judged = qrels.where("rel > 0").select("qid").distinct().join(hits, "qid", "left").fillna(0, ["h"])
    return judged.select("qid", (F.col("h") > 0).cast("double").alias("accuracy"), (F.col("h") / k).alias("precision"))


def metric_table(values: DataFrame, row: str, column: str, names: list[str], value: str = "value") -> DataFrame:
    """One row per ``row`` with the mean value of each named ``column`` (a metric by version report)."""
    return values.groupBy(row).pivot(column, names).agg(F.avg(value))


def relative_to_first(values: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``relative``: the value in percent of the first row's by ``order``."""
    first = values.agg(F.min_by(value, order).alias("_first"))
    return values.crossJoin(F.broadcast(first)).withColumn("relative", F.try_divide(F.col(value) * 100.0, F.col("_first"))).drop("_first")

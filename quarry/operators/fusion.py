"""Fusion and reranking of runs (qid, doc_id, rank, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(runs: DataFrame, k: int = 60, weights: dict[str, float] | None = None, limit: int = 1000, least_score: float | None = None, variant: str = "variant") -> DataFrame:
    """Sum of weight / (k + rank) over variants, with provenance. A dropped score still uses up its rank; ties go
    to the least (variant, rank)."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col(variant) == name, w).otherwise(weight)
    kept = runs if least_score is None else runs.where(F.col("score") >= least_score)
    fused = kept.groupBy("qid", "doc_id").agg(
        F.sum(weight / (k + F.col("rank"))).alias("fused"),
        F.countDistinct(variant).alias("n_variants"),
        F.array_sort(F.collect_list(F.struct(variant, "rank", "score"))).alias("sources"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("fused"), F.col("sources")[0][variant], F.col("sources")[0]["rank"], "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def combine_scores(runs: DataFrame, how: str = "sum") -> DataFrame:
    """CombSUM or CombMNZ."""
    total = F.sum("score")
    return runs.groupBy("qid", "doc_id").agg((total * F.count(F.lit(1)) if how == "mnz" else total).alias("score"))


def max_score_fusion(runs: DataFrame, limit: int = 1000) -> DataFrame:
    best = runs.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fusion_statistics(runs: DataFrame, variant: str = "variant") -> DataFrame:
    """Per query: unique documents, those in all and in one variant, mean variants, share of duplicates."""
    n = runs.groupBy("qid").agg(F.countDistinct(variant).alias("variants"), F.count(F.lit(1)).alias("rows"))
    per_doc = runs.groupBy("qid", "doc_id").agg(F.countDistinct(variant).alias("held"))
    return per_doc.join(n, "qid").groupBy("qid").agg(
        F.count(F.lit(1)).alias("unique_docs"),
        F.count_if(F.col("held") == F.col("variants")).alias("in_all"),
        F.count_if(F.col("held") == 1).alias("in_one"),
        F.avg("held").alias("avg_variants"),
        (1 - F.count(F.lit(1)) / F.first("rows")).alias("duplicate_share"),
    )


def rerank_by(run: DataFrame, feature: DataFrame, value: str, keep_rank: bool = False) -> DataFrame:
    """Order by a document feature, then the old rank; documents without it go. ``keep_rank`` keeps old ranks."""
    joined = run.withColumnRenamed("rank", "old_rank").drop("score").join(feature.select("doc_id", F.col(value).alias("score")), "doc_id")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "old_rank")
    return joined.withColumn("rank", F.col("old_rank") if keep_rank else F.row_number().over(order))


def concatenate(runs: DataFrame, first: int | None = None) -> DataFrame:
    """Runs with ``priority``, one after the other; a document keeps its first place."""
    kept = runs if first is None else runs.where(F.col("rank") <= first)
    best = kept.groupBy("qid", "doc_id").agg(F.min(F.struct("priority", "rank")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at", "doc_id")
    return best.select("qid", "doc_id", F.col("at.priority").alias("priority"), F.row_number().over(order).alias("rank"))


def rewritten_scores(run: DataFrame) -> DataFrame:
    """Scores 5, 4, 3, 2, 1, 1 ... by position."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc_id")) - 1
    return run.withColumn("score", F.greatest(F.lit(5.0) - place, F.lit(1.0)))


def windows(ranks: Column, size: int = 20, stride: int = 10, end: int = 1000) -> Column:
    """Start ranks of the listwise windows that hold a rank, last window first."""
    low = F.greatest(F.lit(0), F.ceil((ranks - size) / stride).cast("int"))
    high = F.least(F.lit((end - size) // stride), F.floor((ranks - 1) / stride).cast("int"))
    return F.when(high >= low, F.reverse(F.transform(F.sequence(low, high), lambda i: i * stride + 1))).otherwise(F.array().cast("array<int>"))


def listwise_requests(run: DataFrame, queries: DataFrame, docs: DataFrame, size: int = 20, stride: int = 10, end: int = 100, cap: int = 1500) -> DataFrame:
    """(qid, window, query, candidates): what a listwise model gets; the call itself is a plug-in."""
    placed = run.where(F.col("rank") <= end).withColumn("window", F.explode(windows(F.col("rank"), size, stride, end)))
    told = placed.join(docs.select("doc_id", F.substring("text", 1, cap).alias("passage")), "doc_id").join(queries, "qid")
    return told.groupBy("qid", "window", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "passage"))).alias("candidates"))


def window_ends(n: int, size: int = 20, stride: int = 10) -> list[tuple[int, int]]:
    """(start, end) of the windows over ``n`` places from the back to the front; the last one starts at 0."""
    out, end = [], n
    while end > 0:
        out.append((max(0, end - size), end))
        if end <= size:
            break
        end -= stride
    return out


def completed_order(order, n: int) -> list[int]:
    """A permutation of n places from a model's answer: the first mention counts, what it leaves out follows as it was."""
    said = list(dict.fromkeys(int(i) for i in order if 0 <= int(i) < n))
    return said + [i for i in range(n) if i not in set(said)]


def sequential_rerank(run: DataFrame, model, columns: list[str], size: int = 20, stride: int = 10, depth: int = 1000, together: int = 64, query: str = "qid", doc: str = "doc_id") -> DataFrame:
    """(qid, doc_id, rank, error): the first ``depth`` ranks of each query reordered by listwise windows in sequence.

    Windows go from the back to the front, and each gets what the one before it has left in its places. The list of
    a query, ``depth`` rows at most, is one record, and all its windows are run in one task; ``model`` is called with
    the windows that ``together`` queries have at that step, as lists of dicts of ``columns``, and answers with one
    order (places, best first) for each. An incomplete answer is completed. Where a call fails, its windows are tried
    alone; a query whose window fails alone gives one row with the error and no documents, and stops nobody else.

    Ranks start at 1 and follow the order of ``rank``, then ``doc``; a null rank is left out.
    """
    import pyarrow as pa

    item = F.struct(F.col("rank"), F.col(doc).alias("doc"), *[F.col(c).alias(f"in_{k}") for k, c in enumerate(columns)])
    lists = run.where(F.col("rank") <= depth).groupBy(F.col(query).alias("qid")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    kinds = dict(run.dtypes)

    def answers(windows: list[list[dict]]) -> list:
        try:
            found = list(model(windows))
            if len(found) == len(windows):
                return found
            raise ValueError(f"{len(found)} answers to {len(windows)} windows")
        except Exception as e:
            return [e] if len(windows) == 1 else [answers([w])[0] for w in windows]

    def apply(batches):
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1).to_pylist()
            rows: list[list[tuple]] = [[] for _ in lists]
            for first in range(0, len(lists), together):
                part = range(first, min(first + together, len(lists)))
                plans = {q: window_ends(len(lists[q]), size, stride) for q in part}
                failed: dict[int, str] = {}
                for step in range(max(map(len, plans.values()))):
                    now = [q for q in part if step < len(plans[q]) and q not in failed]
                    asked = [[{c: x[f"in_{k}"] for k, c in enumerate(columns)} for x in lists[q][slice(*plans[q][step])]] for q in now]
                    for q, order in zip(now, answers(asked) if asked else [], strict=True):
                        a, b = plans[q][step]
                        if isinstance(order, Exception):
                            failed[q] = f"{type(order).__name__}: {order}"
                        else:
                            lists[q][a:b] = [lists[q][a + i] for i in completed_order(order, b - a)]
                for q in part:
                    rows[q] = [(None, None, failed[q])] if q in failed else [(x["doc"], k + 1, None) for k, x in enumerate(lists[q])]
            which = [q for q, own in enumerate(rows) for _ in own]
            docs, ranks, errors = zip(*(r for own in rows for r in own), strict=True) if which else ((), (), ())
            doc_type = batch.schema.field("items").type.value_type.field("doc").type
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(which, pa.int64())), pa.array(docs, doc_type), pa.array(ranks, pa.int32()), pa.array(errors, pa.string())], names=["qid", "doc_id", "rank", "error"])

    return lists.mapInArrow(apply, f"qid {kinds[query]}, doc_id {kinds[doc]}, rank int, error string")


def missing_batches(queries: DataFrame, done: DataFrame, size: int = 50) -> DataFrame:
    """First indexes of the batches of ``size`` that have a query which is not done."""
    return queries.join(done, "qid", "left_anti").select((F.floor(F.col("idx") / size) * size).alias("batch")).distinct()


def pooled_terms(own: DataFrame, related: DataFrame, k: int = 20, by: float = 1.5) -> DataFrame:
    """(key, term, score, rank): the k best terms of a target's own scores times ``by`` and those of related texts."""
    both = own.select("key", "term", (F.col("score") * by).alias("score")).unionByName(related.select("key", "term", "score"))
    best = both.groupBy("key", "term").agg(F.max("score").alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "term")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scored_by_model(pairs: DataFrame, model, columns: list[str], as_: str = "score") -> DataFrame:
    """``pairs`` with the number that ``model(frame of the columns)`` gives each row: a batched cross-encoder hook.

    ``model`` is called once per worker batch with a pandas frame; what it needs travels with it as a closure.
    """
    import pandas as pd
    from pyspark.sql import types as T

    kept = pairs.drop(as_)

    def run(frames):
        for frame in frames:
            yield frame.assign(**{as_: pd.Series(model(frame[columns]), index=frame.index, dtype="float64")})

    return kept.mapInPandas(run, T.StructType([*kept.schema.fields, T.StructField(as_, T.DoubleType())]))

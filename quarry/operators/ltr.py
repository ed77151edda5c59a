"""Learning-to-rank features, audits and simple linear rankers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_features(sparse: DataFrame, dense: DataFrame, absent_rank: int = 999) -> DataFrame:
    """Seven features of (qid, doc_id) pairs in either run: scores, log scores, reciprocal ranks, best rank.
    A pair absent from a run has rank 999 and score 0."""
    a = sparse.select("qid", "doc_id", F.col("score").alias("s"), F.col("rank").alias("sr"))
    b = dense.select("qid", "doc_id", F.col("score").alias("d"), F.col("rank").alias("dr"))
    both = a.join(b, ["qid", "doc_id"], "full_outer").fillna(0.0, ["s", "d"]).fillna(absent_rank, ["sr", "dr"])
    return both.select(
        "qid", "doc_id", F.col("s").alias("f1"), F.col("d").alias("f2"), F.log1p("s").alias("f3"), F.log1p(F.col("d") + 1).alias("f4"),
        (1.0 / (F.col("sr") + 1)).alias("f5"), (1.0 / (F.col("dr") + 1)).alias("f6"), F.least("sr", "dr").cast("double").alias("f7"),
    )


def query_min_max(df: DataFrame, value: str, as_: str, epsilon: float = 1e-8) -> DataFrame:
    """Per query, with 0 among the values."""
    w = Window.partitionBy("qid")
    low, high = F.least(F.min(value).over(w), F.lit(0.0)), F.greatest(F.max(value).over(w), F.lit(0.0))
    return df.withColumn(as_, (F.col(value) - low) / (high - low + epsilon))


def z_score(df: DataFrame, value: Column, as_: str, population: bool = False) -> DataFrame:
    """Global z-score of an expression; rows where it is NULL stay NULL."""
    std = F.stddev_pop if population else F.stddev_samp
    stats = df.select(value.alias("v")).agg(F.avg("v").alias("_m"), std("v").alias("_s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(as_, (value - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def parse_svmrank(lines: DataFrame, col: str = "value") -> DataFrame:
    """``label qid:Q 1:v 2:v # docid``; blank and comment lines go."""
    line = F.trim(F.col(col))
    parts = F.split(F.trim(F.substring_index(line, "#", 1)), r"\s+")
    return lines.where((line != "") & ~line.startswith("#")).select(
        parts[0].try_cast("int").alias("label"), F.substring_index(parts[1], ":", -1).alias("qid"),
        F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.split(x, ":")[1].try_cast("double")).alias("features"),
        F.when(line.contains("#"), F.trim(F.substring_index(line, "#", -1))).alias("doc_id"),
    )


def format_svmrank(df: DataFrame, features: list[str], digits: int | None = 6) -> DataFrame:
    shown = [F.concat(F.lit(f"{k}:"), F.format_string(f"%.{digits}f", F.col(f).cast("double")) if digits is not None else F.col(f).cast("string")) for k, f in enumerate(features, 1)]
    return df.select(F.concat_ws(" ", F.col("label").cast("string"), F.concat(F.lit("qid:"), F.col("qid")), *shown, F.concat(F.lit("# "), F.col("doc_id"))).alias("value"))


def audit(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, min, max, mean, std, constant) over all rows, in one pass."""
    out = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_pop))])
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{c}").cast("double").alias(n) for n in ("min", "max", "avg", "std")]) for c in features]
    return out.select(F.explode(F.array(*rows)).alias("r")).select("r.*", (F.col("r.std") < 1e-6).alias("constant"))


def linear_scores(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * w
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return df.withColumn("score", total).withColumn("rank", F.row_number().over(order))


def gathered(df: DataFrame, features: list[str]) -> DataFrame:
    """(qid, label, x, row): the rows of a query as arrays, in order of doc_id; a query's list is one record."""
    row = F.struct("doc_id", F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("label"), F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("x"))
    return df.groupBy("qid").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("qid", "rows.label", F.flatten("rows.x").alias("x"))


def mean_ndcg(lists: DataFrame, weights: np.ndarray, k: int = 10) -> np.ndarray:
    """The mean NDCG@k of each row of ``weights``, all of them in one job; queries without a positive label are left out.

    Scores are rounded to 9 places, ties keep the order of the documents, and the sums are those of whole numbers, so
    they do not depend on how queries are dealt to tasks. The driver gets one number for each weight vector.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(weights), np.int64), 0
        for batch in batches:
            for label, x in zip(batch.column("label"), batch.column("x"), strict=True):
                label = label.values.to_numpy()
                gain = 2.0**label - 1
                discount = 1 / np.log2(np.arange(min(k, len(gain))) + 2)
                ideal = (np.sort(gain)[::-1][:k] * discount).sum()
                if ideal <= 0:
                    continue
                score = np.round(x.values.to_numpy().reshape(len(label), -1) @ weights.T, 9)
                top = np.argsort(-score, axis=0, kind="stable")[:k]
                total += np.rint((gain[top] * discount[:, None]).sum(axis=0) / ideal * 2.0**40).astype(np.int64)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights))), pa.array(total), pa.array(np.full(len(weights), n))], names=["v", "total", "n"])

    rows = lists.select("label", "x").mapInArrow(judged, "v long, total long, n long").groupBy("v").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(weights))
    out[rows.column("v").to_numpy()] = rows.column("total").to_numpy() / 2.0**40 / np.maximum(rows.column("n").to_numpy(), 1)
    return out


def coordinate_ascent(df: DataFrame, features: list[str], rounds: int = 100, restarts: int = 10, step: float = 0.1, tolerance: float = 1e-4, k: int = 10, seed: int = 42) -> tuple[dict[str, float], float]:
    """(weights, mean NDCG@k) of a linear ranker of rows (qid, doc_id, label, features), by coordinate ascent.

    All restarts go side by side: in a round every one of them tries each feature's weight up and down by the step, two
    and four steps, all these vectors are judged in one job, and each restart takes its best move. One that gains less
    than ``tolerance`` halves its step, three times at most. The first restart begins with equal weights, the others
    with seeded ones; weights are scaled to a sum of sizes of 1.
    """
    from quarry.operators.lineage import cut

    lists = cut(gathered(df, features))
    scaled = lambda w: w / np.maximum(np.abs(w).sum(axis=-1, keepdims=True), 1e-12)
    d = len(features)
    at = scaled(np.vstack([np.ones((1, d)), np.random.default_rng(seed).uniform(-1, 1, (max(0, restarts - 1), d))]))
    best, steps, halved = mean_ndcg(lists, at, k), np.full(len(at), step), np.zeros(len(at), int)
    moves = np.concatenate([np.eye(d) * m for m in (1, -1, 2, -2, 4, -4)])
    for _ in range(rounds):
        open_ = np.flatnonzero(halved <= 3)
        if not len(open_):
            break
        tried = scaled((at[open_, None, :] + moves[None] * steps[open_, None, None]).reshape(-1, d)).reshape(len(open_), -1, d)
        value = mean_ndcg(lists, tried.reshape(-1, d), k).reshape(len(open_), -1)
        for row, r in enumerate(open_.tolist()):
            move = int(value[row].argmax())
            if value[row, move] > best[r] + tolerance:
                at[r], best[r] = tried[row, move], value[row, move]
            else:
                steps[r], halved[r] = steps[r] / 2, halved[r] + 1
    top = int(best.argmax())
    return dict(zip(features, at[top].tolist(), strict=True)), float(best[top])


def pairwise_ranker(df: DataFrame, features: list[str], iterations: int = 20):
    """A linear ranker from differences of pairs of one query, by logistic regression: it stands in for boosted
    trees, which this environment has no library for. Weights by feature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    better = df.where("label > 0").select("qid", F.col("label").alias("lb"), *[F.col(f).alias(f"b_{f}") for f in features])
    pairs = better.join(df.select("qid", "label", *features), "qid").where("lb > label")
    diffs = pairs.select(*[(F.col(f"b_{f}") - F.col(f)).alias(f) for f in features]).withColumn("y", F.lit(1.0))
    both = diffs.unionByName(diffs.select(*[(-F.col(f)).alias(f) for f in features], F.lit(0.0).alias("y")))
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=iterations, fitIntercept=False).fit(VectorAssembler(inputCols=features, outputCol="x").transform(both))
    return dict(zip(features, model.coefficients.toArray().tolist(), strict=True))


def pair_features_scaled(both: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """Second feature set of (qid, doc_id, s, d, sr, dr): scores scaled per query, logarithms over the greatest one's,
    reciprocal ranks, and how far the best rank is from 1,000."""
    w = Window.partitionBy("qid")
    scaled = lambda c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + epsilon)
    logs = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) / F.log1p(F.greatest(F.max(c).over(w), F.lit(0.0)) + 1)
    return both.select(
        "qid", "doc_id", scaled("s").alias("f1"), scaled("d").alias("f2"), logs("s").alias("f3"), logs("d").alias("f4"),
        (1.0 / (F.col("sr") + 1)).alias("f5"), (1.0 / (F.col("dr") + 1)).alias("f6"), F.greatest((1000 - F.least("sr", "dr")) / 1000.0, F.lit(0.0)).alias("f7"),
    )


def document_features(both: DataFrame, documents: DataFrame) -> DataFrame:
    """Third feature set: scores, ranks, log views and rank score of (doc_id, views, pagerank); missing ones are 0."""
    joined = both.join(documents, "doc_id", "left").fillna(0, ["views", "pagerank"])
    return joined.select("qid", "doc_id", F.col("s").alias("f1"), F.col("d").alias("f2"), F.col("sr").alias("f3"), F.col("dr").alias("f4"), F.log1p("views").alias("f5"), F.col("pagerank").alias("f6"))


def tree_features(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Five features: dense score as it is, sparse score over 100 and words within 10 to 1,000 scaled to 0 ... 1,
    z-scores of views and rank score over all documents. A pair without its document is an error of the input."""
    stats = documents.agg(*[f(c).alias(f"{n}_{c}") for c in ("views", "pagerank") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0))
    return required(pairs, documents, "doc_id").crossJoin(F.broadcast(stats)).select(
        "qid", "doc_id", F.col("dense").alias("f1"), clamp(F.col("sparse"), 0, 100).alias("f2"), clamp(F.col("words").cast("double"), 10, 1000).alias("f3"), z("views").alias("f4"), z("pagerank").alias("f5"))


def required(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """An inner join that fails when a row has no partner, at the row and not by a count."""
    found = df.join(lookup.withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return found.where(checked).drop("_found")


def label_counts(df: DataFrame) -> DataFrame:
    """(queries, positives, negatives, least, most, average rows of a query)."""
    per = df.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") > 0).alias("p"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("average"))


def triplets(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(qid, positive, negative): every negative of a query with each of its positives."""
    return positives.select("qid", F.col("doc_id").alias("positive")).join(negatives.select("qid", F.col("doc_id").alias("negative")), "qid")


def search(df: DataFrame, grid: dict[str, list], fit, score, share: float = 0.8, tries: int | None = None, seed: int = 42) -> list[tuple[dict, float]]:
    """(settings, value) of all settings of ``grid``, or ``tries`` seeded ones, best first. Queries, not rows, are
    split: ``fit(train, **settings)`` learns on ``share`` of them and ``score(model, rest)`` judges on the rest."""
    import itertools
    import random

    from quarry.operators.sampling import split

    parts = split(df, "qid", {"train": share, "rest": 1 - share}, seed)
    train, rest = (df.join(parts.where(F.col("split") == name).select("qid"), "qid", "left_semi") for name in ("train", "rest"))
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    chosen = every if tries is None else random.Random(seed).sample(every, min(tries, len(every)))
    return sorted(((s, score(fit(train, **s), rest)) for s in chosen), key=lambda x: -x[1])

"""Boosted trees against a plain trainer, and against the linear stand-in on held-out queries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import boosting, ltr

FEATURES = ["a", "b", "c"]


def rows(queries, seed, size=14):
    """The label is high where a is in the middle of its range and b is not tiny: no linear score tells that."""
    rng = random.Random(seed)
    out = []
    for q in range(queries):
        for d in range(rng.randint(size // 2, size)):
            a, b, c = rng.random(), rng.random(), rng.random()
            label = int(0.3 < a < 0.6) + int(0.3 < a < 0.6 and b > 0.5)
            out.append((q, d, label, round(a, 2), round(b, 2), None if rng.random() < 0.1 else round(c, 2)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "qid long, doc_id long, label int, a double, b double, c double")


def plain_trees(data, hashed, cuts, rounds, rate, depth, least, pull, objective):
    """The same trees by plain loops over rows, pairs and splits."""
    x = [[-math.inf if v is None else v for v in r[3:]] for r in data]
    score = [0.0] * len(data)
    trees = []
    for _ in range(rounds):
        g, h = [0] * len(data), [0] * len(data)
        by = {}
        for i, r in enumerate(data):
            by.setdefault(r[0], []).append(i)
        for own in by.values():
            order = sorted(own, key=lambda i: (-score[i], hashed[i]))
            rank = {i: k for k, i in enumerate(order)}
            ideal = sum((2.0 ** v - 1) / math.log2(k + 2) for k, v in enumerate(sorted((data[i][2] for i in own), reverse=True)))
            for i in own:
                for j in own:
                    if data[i][2] == data[j][2]:
                        continue
                    sign = 1 if data[i][2] > data[j][2] else -1
                    p = 1 / (1 + math.exp(sign * (score[i] - score[j])))
                    w = 1.0
                    if objective == "ndcg":
                        w = abs(2.0 ** data[i][2] - 2.0 ** data[j][2]) * abs(1 / math.log2(rank[i] + 2) - 1 / math.log2(rank[j] + 2)) / ideal
                    g[i] += round(-sign * p * w * 2**boosting.SCALE)
                    h[i] += round(p * (1 - p) * w * 2**boosting.SCALE)

        def node(ids, level):
            total_g, total_h = sum(g[i] for i in ids) / 2**boosting.SCALE, sum(h[i] for i in ids) / 2**boosting.SCALE
            best = (0.0, None, None)
            for f in range(3):
                for cut in [-math.inf, *cuts[f]]:
                    left = [i for i in ids if x[i][f] <= cut]
                    lg, lh = sum(g[i] for i in left) / 2**boosting.SCALE, sum(h[i] for i in left) / 2**boosting.SCALE
                    if lh < least or total_h - lh < least:
                        continue
                    gain = 0.5 * (lg**2 / (lh + pull) + (total_g - lg) ** 2 / (total_h - lh + pull) - total_g**2 / (total_h + pull))
                    if gain > best[0] + 1e-8:
                        best = (gain, f, cut)
            value = -rate * total_g / (total_h + pull)
            if best[1] is None or level == depth:
                for i in ids:
                    score[i] += value
                return ("leaf", value)
            _, f, cut = best
            return (f, cut, node([i for i in ids if x[i][f] <= cut], level + 1), node([i for i in ids if x[i][f] > cut], level + 1))

        trees.append(node(list(range(len(data))), 0))
    return trees


def nested(tree, at=0):
    if tree.feature[at] < 0:
        return ("leaf", tree.value[at])
    return (tree.feature[at], tree.cut[at], nested(tree, tree.left[at]), nested(tree, tree.left[at] + 1))


def same(a, b):
    if a[0] == "leaf" or b[0] == "leaf":
        return a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-9)
    return a[0] == b[0] and a[1] == pytest.approx(b[1]) and same(a[2], b[2]) and same(a[3], b[3])


@pytest.mark.parametrize(("objective", "chunk"), [("pairwise", 4096), ("ndcg", 4096), ("ndcg", 5)])
def test_trees_equal_a_plain_trainer(spark, objective, chunk):
    data = rows(8, 3)
    df = frame(spark, data).repartition(3)
    model = boosting.train(df, FEATURES, rounds=3, depth=2, least=0.05, row_share=1.0, column_share=1.0, bins=16, objective=objective, chunk=chunk)
    cuts = [c.tolist() for c in boosting.cut_points(df, FEATURES, 16)]
    hashes = {(r.qid, r.doc_id): r.h for r in df.select("qid", "doc_id", F.xxhash64(F.col("qid").cast("string"), F.col("doc_id").cast("string")).alias("h")).collect()}
    wanted = plain_trees(data, [hashes[r[0], r[1]] for r in data], cuts, 3, 0.1, 2, 0.05, 1.0, objective)
    assert all(same(nested(t), w) for t, w in zip(model.trees, wanted, strict=True))
    assert any(t.feature[0] >= 0 for t in model.trees)
    again = boosting.Ensemble.from_json(model.to_json())
    assert [r.score for r in boosting.scored(df, again).orderBy("qid", "doc_id").collect()] == [r.score for r in boosting.scored(df, model).orderBy("qid", "doc_id").collect()]


def ndcg(ranked, k=10):
    by = {}
    for r in ranked.select("qid", "rank", "label").collect():
        by.setdefault(r.qid, []).append((r.rank, r.label))
    out = []
    for own in by.values():
        ideal = sum((2.0 ** v - 1) / math.log2(i + 2) for i, v in enumerate(sorted((v for _, v in own), reverse=True)[:k]))
        if ideal:
            out.append(sum((2.0 ** v - 1) / math.log2(r + 1) for r, v in own if r <= k) / ideal)
    return sum(out) / len(out)


def test_beats_the_linear_ranker_on_held_out_queries(spark):
    df = frame(spark, rows(60, 9, 20)).fillna(0.0)
    train, rest = df.where("qid % 3 <> 0").cache(), df.where("qid % 3 = 0").cache()
    model = boosting.train(train, FEATURES, rounds=12, rate=0.3, depth=3, bins=32, seed=7)
    trees, line = ndcg(boosting.scored(rest, model)), ndcg(ltr.linear_scores(rest, ltr.pairwise_ranker(train, FEATURES)))
    assert trees > 0.9 and trees > line + 0.1
    assert max(model.importance(), key=model.importance().get) == "a"


def test_no_rows_or_no_pairs(spark):
    none = frame(spark, [])
    flat = frame(spark, [(1, k, 1, 0.1 * k, 0.0, None) for k in range(6)] + [(1, 5, None, None, 0.0, None)] * 2)
    for df in (none, flat.where("label is not null")):
        model = boosting.train(df, FEATURES, rounds=2, depth=2)
        assert all(t.feature == [-1] and t.value == [0.0] for t in model.trees)
        assert boosting.scored(df, model).count() == df.count()
    assert np.isfinite(boosting.train(flat, FEATURES, rounds=1, depth=1, row_share=1.0).predict(np.array([[np.nan] * 3]))).all()

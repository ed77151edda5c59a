"""p-values by known values, string ratios by a plain programme, coordinate ascent by a grid."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import entities, ltr, stats


def t_tail(t, v):
    """Two-sided tail of the t distribution by Simpson's rule."""
    n, h = 20_000, abs(t) / 20_000
    f = lambda x: math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - (v + 1) / 2 * math.log1p(x * x / v)) / math.sqrt(v * math.pi)
    return 1 - 2 * h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * h) for i in range(n + 1))


def test_p_of_a_correlation(spark):
    cases = [(r, n) for r in (0.0, 0.05, -0.3, 0.5, 0.9, -0.99) for n in (3, 4, 6, 20, 250)] + [(0.01, 60_000)]
    df = spark.createDataFrame([*cases, (1.0, 9), (0.5, 2)], "r double, n long")
    got = {(r.r, r.n): r.p for r in df.withColumn("p", stats.pearson_p(F.col("r"), F.col("n"))).collect()}
    for r, n in cases:
        assert got[r, n] == pytest.approx(t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2), abs=1e-9)
    t = 0.3 / math.sqrt(1 - 0.09)
    assert got[-0.3, 3] == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
    assert got[1.0, 9] == 0 and got[0.5, 2] is None
    z = spark.createDataFrame([(x,) for x in (0.0, 0.1, 1.0, -1.96, 1.99, 2.01, 4.5, 8.0)], "z double")
    assert all(r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-9) for r in z.withColumn("p", stats.normal_p(F.col("z"))).collect())


def test_matrix_and_kendall(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (120, 3)).astype(float)
    x[:, 1] += x[:, 0]
    df = spark.createDataFrame([(*v, 1.0, None if i % 2 else float(v[0])) for i, v in enumerate(x.tolist())], "a double, b double, c double, flat double, half double")
    got = {(r.x, r.y): r for r in stats.correlation_matrix(df, ["a", "b", "c", "flat", "half"]).collect()}
    assert len(got) == 25 and got["a", "b"].r == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) and got["b", "a"].r == got["a", "b"].r
    assert got["a", "b"].stars == "***" and got["a", "flat"].r is None and got["a", "flat"].stars == "" and got["a", "half"].n == 60
    row = stats.kendall_p(df, "a", "b").first()
    sign = lambda v: np.sign(v[:, None] - v[None, :])[np.triu_indices(len(v), 1)]
    s, ties = float((sign(x[:, 0]) * sign(x[:, 1])).sum()), [np.unique(x[:, k], return_counts=True)[1].astype(float) for k in (0, 1)]
    n, (t, u) = 120.0, ties
    v = (n * (n - 1) * (2 * n + 5) - sum((k * (k - 1) * (2 * k + 5)).sum() for k in ties)) / 18 + (t * (t - 1)).sum() * (u * (u - 1)).sum() / (2 * n * (n - 1)) + (t * (t - 1) * (t - 2)).sum() * (u * (u - 1) * (u - 2)).sum() / (9 * n * (n - 1) * (n - 2))
    assert row.z == pytest.approx(s / math.sqrt(v)) and row.p == pytest.approx(math.erfc(abs(row.z) / math.sqrt(2)), rel=1e-6)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        fresh = [0]
        for j, d in enumerate(b, 1):
            fresh.append(row[j - 1] + 1 if c == d else max(row[j], fresh[-1]))
        row = fresh
    return row[-1]


def test_common_subsequences_equal_a_plain_programme():
    rng = random.Random(4)
    draw = lambda: "".join(rng.choice("abé 中🙂") for _ in range(rng.choice((0, 1, 5, 30, 63, 64, 65, 130, 200))))
    pairs = [(draw(), draw()) for _ in range(250)] + [("", ""), ("a" * 128, "a" * 129)]
    assert entities.common_subsequence(*map(list, zip(*pairs))).tolist() == [plain_common(a, b) for a, b in pairs]


def test_ratios(spark):
    cases = [("new york mets", "new york meats", 96, 96), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 91, 101), ("same", "same", 101, 101), ("abc", "xyz", 0, 0), ("", "", 101, 101)]
    df = spark.createDataFrame([(a, b) for a, b, *_ in cases] + [(None, "a")], "a string, b string")
    got = df.select("a", entities.ratio_score(F.col("a"), F.col("b")).alias("r"), entities.token_sort_score(F.col("a"), F.col("b")).alias("s"), entities.token_set_score(F.col("a"), F.col("b")).alias("t")).collect()
    assert [(r.r, r.s) for r in got] == [(r, s) for *_, r, s in cases] + [(None, 0)]
    assert got[1].t == 101 and got[3].t == 0 and got[4].t == 0
    sets = spark.createDataFrame([("mariners vs angels", "los angeles angels at seattle mariners")], "a string, b string")
    words = ("angels mariners", "angels mariners vs", "angels mariners at los angeles seattle")
    best = max(round(200 * plain_common(x, y) / (len(x) + len(y))) for x, y in ((words[0], words[1]), (words[0], words[2]), (words[1], words[2])))
    assert sets.select(entities.token_set_score(F.col("a"), F.col("b")).alias("t")).first().t == best
    titles, aliases = spark.createDataFrame([(1, "the Beetles")], "title_id long, title string"), spark.createDataFrame([(7, "the Beatles"), (8, "the Badgers")], "doc_id long, alias string")
    near = spark.createDataFrame([(1, 7), (1, 8)], "title_id long, doc_id long")
    found = entities.resolve(titles, aliases, near, scorer=entities.ratio_score).collect()
    assert [(r.doc_id, r.strategy, r.score) for r in found] == [(7, 2, 91.0)]


def test_ascent_reaches_the_best_of_a_grid_with_one_job_a_round(spark):
    rng = random.Random(1)
    rows = [(q, d, int(rng.random() < 0.3), rng.random(), rng.random()) for q in range(12) for d in range(8)]
    rows = [(q, d, y, a + 0.4 * y, b - 0.3 * y) for q, d, y, a, b in rows]
    df = spark.createDataFrame(rows, "qid long, doc_id long, label int, a double, b double").repartition(3)
    lists = ltr.gathered(df, ["a", "b"])
    grid = np.array([(math.cos(t), math.sin(t)) for t in np.linspace(0, 2 * math.pi, 721)])
    weights, value = ltr.coordinate_ascent(df, ["a", "b"], rounds=20, restarts=10, step=0.2, tolerance=1e-6, k=5)
    assert value >= ltr.mean_ndcg(lists, grid, 5).max() - 0.01 and value == pytest.approx(ltr.mean_ndcg(lists, np.array([[weights["a"], weights["b"]]]), 5)[0])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("round", "one round")
    ltr.mean_ndcg(lists.cache(), grid, 5)
    assert lists.count() == 12
    spark.sparkContext.setJobGroup("again", "one round")
    ltr.mean_ndcg(lists, grid, 5)
    stages = len(tracker.getJobIdsForGroup("again"))
    assert stages <= 2  # a shuffle's map side and its result, under adaptive execution
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

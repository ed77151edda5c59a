"""Principal components, all-pairs search, walks, set joins and listwise windows against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import fusion, graph, setjoin, vector


def vectors(n, d, seed=1):
    return np.round(np.random.default_rng(seed).standard_normal((n, d)) * np.linspace(2, 0.5, d), 3)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)


def plain_knn(x, k, digits=6, with_self=True):
    score = np.round(x @ x.T, digits)
    out = set()
    for i in range(len(x)):
        order = [j for j in sorted(range(len(x)), key=lambda j: (-score[i, j], j)) if with_self or j != i][:k]
        out |= {(i, j, r + 1, round(score[i, j], 6)) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("block_bytes", [1 << 30, 900])
@pytest.mark.parametrize("with_self", [True, False])
def test_grid_finds_the_nearest_of_all_rows(spark, block_bytes, with_self):
    x = vectors(60, 4)
    x[10:14] = x[9]  # ties
    df = frame(spark, x).unionByName(spark.createDataFrame([(99, None)], "id long, vector array<double>"))
    got = vector.knn_grid(df, 7, block_bytes=block_bytes, with_self=with_self)
    assert {(r["query"], r.neighbor, r["rank"], round(r.score, 6)) for r in got.collect()} == plain_knn(x, 7, with_self=with_self)
    assert vector.knn_grid(df.limit(0), 3).count() == 0
    assert vector.knn_grid(frame(spark, x[:2]), 5).count() == 4


def test_a_row_is_sent_once_to_each_cell_of_its_block(spark):
    x = vectors(200, 8)
    blocks = -(-200 * (8 * 8 + 64) // 4000)
    plan = vector.knn_grid(frame(spark, x), 3, block_bytes=4000)
    sent = plan._jdf.queryExecution().analyzed().toString()
    assert f"{blocks - 1}" in sent and plan.count() == 600


def test_components_equal_a_plain_decomposition(spark):
    x = vectors(300, 6)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pca = vector.fit_pca(frame(spark, x).repartition(40), "vector", fan_in=4)
    values, turned = np.linalg.eigh(np.cov(unit.T, bias=True))
    assert np.allclose(pca.values, values[::-1], atol=1e-12) and np.allclose(np.abs(pca.components.T @ turned[:, ::-1]), np.eye(6), atol=1e-8)
    assert (pca.components[np.abs(pca.components).argmax(0), range(6)] > 0).all()
    rows = pca.scree(spark).collect()
    assert [r.component for r in rows] == [1, 2, 3, 4, 5, 6] and rows[-1].cumulative == pytest.approx(1)
    wanted = (unit - unit.mean(0)) @ pca.components[:, :3]
    wanted /= np.linalg.norm(wanted, axis=1, keepdims=True)
    got = vector.project(frame(spark, x), "vector", pca, 3).orderBy("id").collect()
    assert np.allclose([r.projected for r in got], wanted, atol=1e-9)
    assert vector.fit_pca(frame(spark, x).limit(0), "vector").values.size == 0


def test_projections_of_many_rows_and_of_odd_ones(spark):
    """20,000 rows of 64 entries: lengths and products that are worked out anew for each entry take many minutes."""
    x = vectors(20_000, 64)
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    odd = spark.createDataFrame([(-1, None), (-2, [1.0]), (-3, [None] + [1.0] * 63), (-4, [])], "id long, vector array<float>")
    start = time.perf_counter()
    pca = vector.fit_pca(df, "vector")
    got = {r.id: r.projected for r in vector.project(df.union(odd), "vector", pca, 3).select("id", "projected").collect()}
    assert time.perf_counter() - start < 60
    x = x.astype(np.float32).astype(float)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    want = (x / np.where(length == 0, 1, length) - pca.mean) @ pca.components[:, :3]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-9) and [got[-k] for k in (1, 2, 3, 4)] == [None] * 4
    from quarry.functions import vectors as V

    unit = df.where("id < 8").select(V.normalise(F.col("vector")).alias("u")).collect()
    assert np.allclose([r.u for r in unit], x[:8] / np.where(length[:8] == 0, 1, length[:8]))
    assert odd.where("id = -1").select(V.normalise(F.col("vector")).alias("u")).first().u is None


def test_postings_and_passages_meet_in_products(spark):
    """Equal to brute force over copies, ties and odd rows; the plans hold no join of queries with all rows."""
    from quarry.operators import retrieval

    rng = np.random.default_rng(4)
    w = np.round(rng.random((90, 12)) * (rng.random((90, 12)) < 0.4), 2)
    w[40:50] = w[39]
    rows = [(i, f"t{j}", float(w[i, j])) for i in range(90) for j in range(12) if w[i, j]]
    postings = spark.createDataFrame([*rows, (500, "elsewhere", 1.0)], "doc_id long, term string, weight double").repartition(6)
    asked = postings.where("doc_id % 10 = 0 or doc_id = 39").withColumnRenamed("doc_id", "qid")
    got = {(r.qid, r["rank"]): (r.doc_id, round(r.score, 6)) for r in retrieval.index_top(asked, postings, 6, query_rows=3).collect()}
    for q in [*range(0, 90, 10), 39]:
        best = sorted((-round(s, 6), i) for i, s in enumerate(w @ w[q]) if s > 0)[:6]
        assert [got[q, k + 1] for k in range(len(best))] == [(i, -s) for s, i in best]
    assert got[500, 1] == (500, 1.0) and retrieval.index_top(asked.limit(0), postings, 6).count() == 0

    x = vectors(60, 5)
    passages = spark.createDataFrame([*((i % 4, v.tolist()) for i, v in enumerate(x)), (0, None), (1, [1.0]), (2, [None] * 5)], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([*((i, x[i].tolist()) for i in range(9)), (9, None)], "qid long, q_vector array<double>")
    pairs = spark.createDataFrame([(d, q) for d in range(6) for q in range(11) if (d + q) % 3] + [(0, 1)], "doc_id long, qid long")
    scored = vector.max_passage_scores(pairs, passages, queries, cell_rows=4)
    want = {(d, q): max((float(x[i] @ x[q]) for i in range(d, 60, 4)), default=-100) if d < 4 and q < 9 else -100 for d in range(6) for q in range(11) if (d + q) % 3}
    found = {(r.doc_id, r.qid): r.score for r in scored.collect()}
    assert scored.count() == len(want) and found == pytest.approx(want)
    assert "aggregate(" not in scored._jdf.queryExecution().analyzed().toString()


def test_blocks_of_the_grid_have_a_bounded_number_of_rows(spark):
    x = np.round(vectors(900, 3), 1)
    x[100:300] = x[99]
    got = vector.knn_grid(frame(spark, x), 3, block_rows=250)
    assert {(r["query"], r.neighbor, r["rank"], round(r.score, 6)) for r in got.collect()} == plain_knn(x, 3)
    assert "RepartitionByExpression [i" in got._jdf.queryExecution().analyzed().toString()


def dense_walk(n, edges, p, alpha=0.85):
    w = np.zeros((n, n))
    for a, b, v in edges:
        w[a, b] += v
    out = w.sum(1)
    move = np.divide(w, out[:, None], where=out[:, None] > 0, out=np.zeros_like(w))
    x = p.copy()
    for _ in range(400):
        x = (1 - alpha) * p + alpha * (x @ move + x[out == 0].sum() * p)
    return x


def test_pushed_walks_equal_dense_ones_and_stay_sparse(spark):
    rng = random.Random(3)
    links = {(rng.randrange(30), rng.randrange(28)): rng.randint(1, 4) for _ in range(90)}
    links = {(a, b): v for (a, b), v in links.items() if a != 5 and b != 5} | {(40, 41): 2}  # 5 is alone, 40 far off
    edges = spark.createDataFrame([(a, b, v) for (a, b), v in links.items()], "src long, dst long, weight long")
    run = [(0, d, 1.0, r) for r, d in enumerate((1, 2, 3, 5))] + [(1, d, 1.0, r) for r, d in enumerate((40, 41))] + [(2, 5, 1.0, 1)]
    got = graph.rerank_by_walk(spark.createDataFrame(run, "qid long, doc_id long, score double, rank int"), edges, alpha=0.5, tolerance=1e-7).collect()
    starts = np.zeros(42)
    starts[[1, 2, 3]] = 1 / 3
    want = dense_walk(42, [(a, b, v) for (a, b), v in links.items()], starts, 0.5)
    first = sorted((r for r in got if r.qid == 0), key=lambda r: r["rank"])
    assert {r.doc_id for r in first} == {1, 2, 3} and [r.doc_id for r in first] == sorted((1, 2, 3), key=lambda d: -want[d])
    assert all(r.score == pytest.approx(want[r.doc_id], abs=2e-5) for r in first)  # 1e-7 x (links + nodes)
    assert {r.doc_id for r in got if r.qid == 1} == {40, 41} and not [r for r in got if r.qid == 2]
    reached = graph.personalized_pagerank_push(edges, spark.createDataFrame([(1, 40, 1.0)], "qid long, id long, p double"), alpha=0.5, tolerance=1e-3).collect()
    assert {r.id for r in reached} == {40, 41} and 1 - 1e-3 * 4 < sum(r.score for r in reached) <= 1


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_set_join_equals_all_pairs(spark, threshold):
    rng = random.Random(7)
    sets = {i: {rng.randrange(25) for _ in range(rng.randint(1, 8))} for i in range(70)}
    sets |= {100 + i: {0, 1, 2} for i in range(5)} | {200 + i: {0, 500 + i} for i in range(30)}
    rows = [(i, m) for i, s in sets.items() for m in s]
    found = setjoin.similar_sets(spark.createDataFrame([*rows, *rows[:9], (None, 1), (7, None)], "src long, dst long"), threshold)
    classes = {r.set_id: r.class_id for r in found.classes.collect()}
    assert set(classes) == set(sets) and all(sets[i] == sets[c] and c <= i for i, c in classes.items())
    names = sorted(set(classes.values()))
    want = {(a, b, len(sets[a] & sets[b])) for k, a in enumerate(names) for b in names[k + 1:] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    assert {(r.a, r.b, r.common) for r in found.pairs.collect()} == want
    links = {r.set_id: (r.copies, r.links) for r in found.links().collect()}
    near = {i: sum(j != i and classes[j] != classes[i] and ((min(classes[i], classes[j]), max(classes[i], classes[j])) in {(a, b) for a, b, _ in want}) for j in sets) for i in sets}
    assert all(links[i][1] == near[i] and links[i][0] == sum(classes[j] == classes[i] for j in sets) - 1 for i in sets)


def test_a_hub_of_a_third_of_all_links_makes_no_pairs(spark):
    links = [(i, 0) for i in range(600)] + [(i, 10_000 + i) for i in range(600)] + [(i, 20_000 + i) for i in range(600)]
    found = setjoin.similar_sets(spark.createDataFrame(links, "src long, dst long"), 0.5)
    assert found.pairs.count() == 0 and found.classes.count() == 600
    text = found.pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def plain_windows(items, order, size, stride):
    items, end = list(items), len(items)
    while end > 0:
        start = max(0, end - size)
        items[start:end] = order(items[start:end])
        if start == 0:
            break
        end -= stride
    return items


def test_windows_hand_their_order_on(spark):
    rng = random.Random(2)
    rows = [(q, d, d + 1, rng.randrange(10_000)) for q, n in ((0, 1000), (1, 95), (2, 20), (3, 3), (4, 1)) for d in range(n)] + [(5, 1, None, 3)]
    run = spark.createDataFrame(rows, "qid long, doc_id long, rank int, v long").repartition(3)
    got = fusion.sequential_rerank(run, lambda windows: [sorted(range(len(w)), key=lambda i: -w[i]["v"]) for w in windows], ["v"]).collect()
    for q in range(5):
        own = [(r[1], r[3]) for r in rows if r[0] == q]
        assert [r.doc_id for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] == [d for d, _ in plain_windows(own, lambda w: sorted(w, key=lambda x: -x[1]), 20, 10)]
    assert not [r for r in got if r.qid == 5] and all(r.error is None for r in got)
    assert fusion.window_ends(45) == [(25, 45), (15, 35), (5, 25), (0, 15)]
    assert fusion.completed_order([2, 2, 9, -1, 0], 4) == [2, 0, 1, 3]


def test_a_failing_query_stops_nobody_else(spark):
    def fails_on_two(windows):
        if any(x["v"] == 2 for w in windows for x in w):
            raise RuntimeError("no answer")
        return [list(range(len(w)))[::-1] for w in windows]

    run = spark.createDataFrame([(q, d, d, q) for q in range(4) for d in range(1, 4)], "qid long, doc_id long, rank int, v int").coalesce(1)
    got = fusion.sequential_rerank(run, fails_on_two, ["v"]).collect()
    assert [(r.qid, r.doc_id, r.error) for r in got if r.error] == [(2, None, "RuntimeError: no answer")]
    assert sorted((r.qid, r["rank"], r.doc_id) for r in got if not r.error) == [(q, k, 4 - k) for q in (0, 1, 3) for k in (1, 2, 3)]


def test_walks_of_a_graph_reached_as_a_whole_settle_in_few_steps(spark, monkeypatch):
    """From no score at all it would take about 100 steps until alpha alone has made the residuals small."""
    rng = random.Random(8)
    links = {(a, rng.randrange(60)): 1 for a in range(60) for _ in range(12)}
    edges = spark.createDataFrame([(a, b, v) for (a, b), v in links.items()], "src long, dst long, weight long")
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or cut(df))
    got = {r.id: r.score for r in graph.personalized_pagerank_push(edges, spark.createDataFrame([(1, 3, 0.5), (1, 4, 0.5)], "qid long, id long, p double")).collect()}
    starts = np.zeros(60)
    starts[[3, 4]] = 0.5
    want = dense_walk(60, [(a, b, v) for (a, b), v in links.items()], starts)
    assert max(abs(want[i] - got[i]) for i in range(60)) < 1e-6 and len(written) < 40

"""Walks over blocks of nodes: what they shuffle, and reranking by them."""

import numpy as np
import pytest

from quarry.operators import graph as G


def dense(n, links, start, alpha=0.85):
    m = np.zeros((n, n))
    for s, d, w in links:
        m[d, s] += w
    total = m.sum(axis=0)
    m[:, total > 0] /= total[total > 0]
    m[:, total == 0] = start[:, None]
    return np.linalg.solve(np.eye(n) - alpha * m, (1 - alpha) * start)


@pytest.mark.parametrize("ends", [False, True])
def test_reranking_in_blocks_gives_exact_walks(spark, monkeypatch, ends):
    monkeypatch.setattr(G, "BLOCK_NODES", 8)
    monkeypatch.setattr(G, "MOVES", 16)
    n = 30
    links = [(i, (i * 7 + j * 5 + 1) % n, 1 + j) for i in range(n - 3 * ends) for j in range(4)]
    edges = spark.createDataFrame(links, "src long, dst long, weight long")
    rows = [(q, d, 1.0, k) for q in range(5) for k, d in enumerate((q, 2 * q + 11, 28, 900 + q))]
    got = {(r.qid, r.doc_id): (r.score, r.rank) for r in G.rerank_by_walk(spark.createDataFrame(rows, "qid long, doc_id long, score double, rank int"), edges, alpha=0.5, width=2, digits=9).collect()}
    assert set(got) == {(q, d) for q, d, *_ in rows if d < n}
    for q in range(5):
        own = [d for p, d, *_ in rows if p == q and d < n]
        start = np.zeros(n)
        start[own] = 1 / len(own)
        want = dense(n, links, start, 0.5).round(9)
        assert all(abs(got[q, d][0] - want[d]) < 2e-8 for d in own)
        assert [got[q, d][1] for d in sorted(own, key=lambda d: (-got[q, d][0], d))] == list(range(1, len(own) + 1))


def test_a_vector_is_sent_once_to_a_block_of_nodes(spark, monkeypatch):
    """Forty links from each of twenty nodes, all to one block: a step sends twenty vectors, not eight hundred."""
    edges = spark.createDataFrame([(s, (s + 1 + j) % 60, 1) for s in range(20) for j in range(40)], "src long, dst long, weight long")
    walk = G.BlockWalk(edges, spark.createDataFrame([(q, i, 0.05) for q in range(3) for i in range(20)], "qid long, id long, p double"), 0.85, 64)
    assert walk.first().where("kind >= 0").count() == 20 and walk.links.count() == 20 and walk.parts == 1

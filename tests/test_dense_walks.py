"""Walks of many queries, with one vector for each node and block of queries."""

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.plans import graphs


def test_dense_walks_give_the_rows_of_walks_by_rows(spark):
    links = [(i, (i * 7 + j * 5) % 40, 1 + j) for i in range(34) for j in range(3)]  # 34 to 39 have no links
    edges = spark.createDataFrame([x for x in links if x[0] != x[1]], "src long, dst long, weight long")
    starts = [(q, i, 0.5) for q in range(7) for i in (q, 33 + q)]
    teleport = spark.createDataFrame(starts, "qid long, id long, p double")
    nodes = spark.range(41)
    for rounds in (1, 2, 3):
        want = {(r.qid, r.id): r.score for r in G.personalized_pagerank(nodes, edges, teleport, iterations=rounds).collect()}
        for width in (3, 64):
            rows = G.personalized_pagerank_dense(edges, teleport, iterations=rounds, width=width).collect()
            got = {(r.qid, r.id): r.score for r in rows}
            assert len(rows) == len(got) and got.keys() == want.keys()
            assert all(abs(got[k] - want[k]) < 1e-14 for k in want)


def test_personalized_pagerank_moves_a_row_a_block_of_queries(spark, tmp_path, monkeypatch):
    spark.range(1, 121).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.range(3000).select(F.floor(F.col("id") / 4).alias("l_orderkey"), (F.col("id") * 37 % 120 + 1).alias("l_partkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    moved = []
    monkeypatch.setattr(G, "personalized_pagerank", lambda *_, **__: moved.append("rows"))
    result = graphs.ppr(spark, str(tmp_path))
    # Before, a link moved one row for each of the 50 queries.
    assert not moved and set(result.columns) == {"qid", "id", "score"}
    assert "MapInArrow" in result._jdf.queryExecution().toString() and result.where("score is null").isEmpty()

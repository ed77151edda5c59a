"""Graph queries: parts are articles, orders are other pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.plans import tables as t


def articles(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"))


def node_table(spark, d):
    id_map = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Q"), "p_partkey").alias("entity"))
    return G.dense_ids(G.article_nodes(t.pages(spark, d), id_map), "id", "node_id")


def edge_list(spark, d):
    nodes = node_table(spark, d).select("id", "node_id")
    edges = G.edges_between(t.links(spark, d), nodes)
    src, dst = nodes.select(F.col("id").alias("src"), F.col("node_id").alias("src_id")), nodes.select(F.col("id").alias("dst"), F.col("node_id").alias("dst_id"))
    return edges.join(src, "src").join(dst, "dst").select("src", "dst", "src_id", "dst_id")


def one_hop(spark, d):
    return G.one_hop(t.links(spark, d), articles(spark, d))


def two_hop(spark, d):
    middles = t.pages(spark, d).where("namespace <> 0 or is_redirect <> '0'")
    return G.two_hop(t.links(spark, d).distinct(), articles(spark, d), middles)


def shared_target(spark, d):
    targets = t.pages(spark, d).where("namespace <> 0").select("id", F.col("namespace").alias("kind"))
    return G.shared_target(t.links(spark, d), targets)


def category_shared(spark, d):
    """Orders of a customer as pages of a category; the target key is text that may not be a number."""
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.when(F.col("o_custkey") % 11 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("target"))
    edges = o.select("src", F.col("target").try_cast("long").alias("dst")).where("dst is not null")
    return G.shared_target(edges, edges.select(F.col("dst").alias("id"), F.lit(1).alias("kind")).distinct()).where("src < dst")


def touching(spark, d):
    return G.edges_touching(t.links(spark, d), articles(spark, d))


def merged(spark, d):
    plinks = t.part_links(spark, d)
    hop = plinks.select("src", "dst")
    return G.merge([(plinks, 1.0), (hop, 0.5), (plinks.select("src", "dst", F.lit(0.25).alias("score")), 0.1)])


def not_isolated(spark, d):
    return G.drop_isolated(t.pages(spark, d), t.links(spark, d)).select("id", "namespace")


def degree(spark, d):
    return G.degrees(t.pages(spark, d), t.links(spark, d))


def centrality(spark, d):
    return G.degree_centrality(articles(spark, d), t.part_links(spark, d)).select("id", F.round("in_centrality", 8).alias("in_centrality"), F.round("out_centrality", 8).alias("out_centrality"))


def degree_distribution(spark, d):
    return G.degrees(articles(spark, d), t.part_links(spark, d)).groupBy("in_degree").agg(F.count(F.lit(1)).alias("nodes"))


def degree_summary(spark, d):
    g = G.degrees(articles(spark, d), t.part_links(spark, d))
    return g.agg(*[f(c).cast("double").alias(f"{n}_{c[:2]}") for c in ("in_degree", "out_degree") for n, f in (("min", F.min), ("max", F.max))], F.round(F.avg("in_degree"), 6).alias("avg_in"), F.round(F.stddev("in_degree"), 6).alias("std_in"), F.count_if(F.col("in_degree") == 0).alias("no_in"))


def pagerank(spark, d):
    return G.pagerank(articles(spark, d), t.part_links(spark, d), iterations=4).select("id", F.round("score", 9).alias("score"))


def pagerank_converged(spark, d):
    return G.pagerank(articles(spark, d), t.part_links(spark, d), tolerance=1e-8)


def ppr(spark, d):
    """Every part starts the walks of its size, 50 queries in all; three rounds, as SQL must unroll them."""
    p = t.table(spark, d, "part").select(F.col("p_size").cast("long").alias("qid"), F.col("p_partkey").alias("id"))
    seeds = p.withColumn("p", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("qid")))
    return G.personalized_pagerank_dense(t.part_links(spark, d), seeds, iterations=3).select("qid", "id", F.round("score", 9).alias("score"))


def hits(spark, d):
    return G.hits(articles(spark, d), t.part_links(spark, d), iterations=3).select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


def component_sizes(spark, d):
    """Customers linked to the next one of their nation and segment."""
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    edges = c.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("id")).alias("dst")).where("dst is not null")
    return G.components(c.select("id"), edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


_N = t.PART_LINKS_SQL + ", nodes AS (SELECT p_partkey AS id FROM part)"
_DEG = "deg AS (SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM nodes LEFT JOIN (SELECT dst AS id, count(*) AS i FROM {e} GROUP BY dst) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM {e} GROUP BY src) USING (id))"


def _walk(rounds: int, teleport: str) -> str:
    """Unrolled rounds over (qid, id, p) in ``teleport``."""
    out = f"WITH {_N}, tel AS ({teleport}), mv AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM plinks), s0 AS (SELECT qid, id, p AS score FROM tel)"
    for k in range(rounds):
        out += f""", l{k} AS (SELECT qid, sum(CASE WHEN id IN (SELECT src FROM plinks) THEN 0 ELSE score END) AS loose FROM s{k} GROUP BY qid),
f{k} AS (SELECT s.qid, m.dst AS id, sum(s.score * m.p) AS flow FROM s{k} s JOIN mv m ON m.src = s.id GROUP BY ALL),
s{k + 1} AS (SELECT qid, id, 0.85 * coalesce(flow, 0) + coalesce((0.15 + 0.85 * loose) * p, 0) AS score FROM f{k} FULL JOIN (SELECT qid, id, p, loose FROM tel JOIN l{k} USING (qid)) USING (qid, id))"""
    return out


def _hits_sql(rounds: int) -> str:
    out = f"WITH {_N}, h0 AS (SELECT id, 1.0 / count(*) OVER () AS v FROM nodes)"
    for k in range(rounds):
        out += f""", a{k} AS (SELECT id, v / sum(v) OVER () AS v FROM (SELECT dst AS id, sum(weight * v) AS v FROM plinks JOIN h{k} ON src = id GROUP BY dst)),
h{k + 1} AS (SELECT id, v / sum(v) OVER () AS v FROM (SELECT src AS id, sum(weight * v) AS v FROM plinks JOIN a{k} ON dst = id GROUP BY src))"""
    return out + f" SELECT id, round(coalesce(h.v, 0), 9) AS hub, round(coalesce(a.v, 0), 9) AS authority FROM nodes LEFT JOIN h{rounds} h USING (id) LEFT JOIN a{rounds - 1} a USING (id)"


_NODES = "nt AS (SELECT p_partkey AS id, 'Q' || p_partkey AS entity, row_number() OVER (ORDER BY p_partkey) - 1 AS node_id FROM part)"

QUERIES = {
    "node_table": (node_table, f"WITH {_NODES} SELECT id, entity, node_id FROM nt"),
    "edge_list": (edge_list, f"WITH {t.LINKS_SQL}, {_NODES} SELECT DISTINCT l.src, l.dst, a.node_id AS src_id, b.node_id AS dst_id FROM links_t l JOIN nt a ON a.id = l.src JOIN nt b ON b.id = l.dst"),
    "motif_one_hop": (one_hop, f"WITH {t.LINKS_SQL} SELECT DISTINCT src, dst, CAST(1 AS BIGINT) AS weight FROM links_t WHERE src <> dst AND src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part)"),
    "motif_two_hop": (two_hop, f"""WITH {t.LINKS_SQL}, e AS (SELECT DISTINCT src, dst FROM links_t), {t.PAGES_SQL}, m AS (SELECT id FROM pages_t WHERE namespace <> 0 OR is_redirect <> '0')
SELECT a.src, b.dst, count(*) AS weight FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND a.dst IN (SELECT id FROM m) AND a.src IN (SELECT p_partkey FROM part) AND b.dst IN (SELECT p_partkey FROM part) GROUP BY ALL"""),
    "motif_shared_target": (shared_target, f"""WITH {t.LINKS_SQL}, e AS (SELECT DISTINCT src, dst FROM links_t WHERE dst IN (SELECT o_orderkey + 10000000 FROM orders)), s AS (SELECT * FROM e)
SELECT a.src, b.src AS dst, 14 AS kind, count(*) AS weight FROM s a JOIN s b USING (dst) WHERE a.src <> b.src GROUP BY a.src, b.src"""),
    "category_shared_target": (category_shared, """WITH e AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_custkey % 11 <> 0), s AS (SELECT * FROM e)
SELECT a.src, b.src AS dst, 1 AS kind, count(*) AS weight FROM s a JOIN s b USING (dst) WHERE a.src < b.src GROUP BY a.src, b.src"""),
    "edges_touching": (touching, f"WITH {t.LINKS_SQL} SELECT DISTINCT src, dst FROM links_t WHERE src IN (SELECT p_partkey FROM part) OR dst IN (SELECT p_partkey FROM part)"),
    "graph_merge": (merged, f"WITH {_N} SELECT src, dst, weight + 0.75 AS weight FROM plinks".replace("weight + 0.75", "CAST(weight + 0.5 + 0.25 AS DOUBLE)")),
    "drop_isolated": (not_isolated, f"WITH {t.LINKS_SQL}, {t.PAGES_SQL}, e AS (SELECT * FROM links_t) SELECT id, namespace FROM pages_t WHERE id IN (SELECT src FROM e) OR id IN (SELECT dst FROM e)"),
    "degrees": (degree, f"WITH {t.LINKS_SQL}, {t.PAGES_SQL}, nodes AS (SELECT id FROM pages_t), {_DEG.format(e='links_t')} SELECT id, in_degree, out_degree FROM deg"),
    "degree_centrality": (centrality, f"WITH {_N}, {_DEG.format(e='plinks')} SELECT id, round(in_degree / (SELECT count(*) - 1 FROM nodes), 8) AS in_centrality, round(out_degree / (SELECT count(*) - 1 FROM nodes), 8) AS out_centrality FROM deg"),
    "degree_distribution": (degree_distribution, f"WITH {_N}, {_DEG.format(e='plinks')} SELECT in_degree, count(*) AS nodes FROM deg GROUP BY in_degree"),
    "degree_summary": (degree_summary, f"""WITH {_N}, {_DEG.format(e='plinks')} SELECT CAST(min(in_degree) AS DOUBLE) AS min_in, CAST(max(in_degree) AS DOUBLE) AS max_in, CAST(min(out_degree) AS DOUBLE) AS min_ou, CAST(max(out_degree) AS DOUBLE) AS max_ou,
round(avg(in_degree), 6) AS avg_in, round(stddev(in_degree), 6) AS std_in, count(*) FILTER (in_degree = 0) AS no_in FROM deg"""),
    "pagerank": (pagerank, _walk(4, "SELECT 0 AS qid, id, 1.0 / count(*) OVER () AS p FROM nodes") + " SELECT id, round(score, 9) AS score FROM s4"),
    "pagerank_converged": (pagerank_converged, None),
    "personalized_pagerank": (ppr, _walk(3, "SELECT p_size::BIGINT AS qid, p_partkey AS id, 1.0 / count(*) OVER (PARTITION BY p_size) AS p FROM part") + " SELECT qid, id, round(score, 9) AS score FROM s3"),
    "hits": (hits, _hits_sql(3)),
    "components": (component_sizes, "SELECT min(c_custkey) AS component, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment"),
}

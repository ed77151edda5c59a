"""Fixture tables in the roles that the library queries need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.lineage import cut
from quarry.operators.retrieval import containing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, text, ...) of documents, dealt out where the files make fewer scan tasks than there are cores."""
    df, cores = table(spark, sf_dir, "documents").select("doc_id", "text", *more), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, "doc_id")


def queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def containment_qrels(spark, sf_dir):
    """(qid, doc_id, rel): the document holds the item as it stands; written once."""
    found = containing(texts(spark, sf_dir), queries(spark, sf_dir))
    return cut(found.distinct().select("qid", "doc_id", F.lit(1).alias("rel")))


def links(spark, sf_dir):
    """Links part -> order and order -> part (orders are numbered from 10,000,000 on), and part -> next part of an order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    order = F.col("l_orderkey") + 10_000_000
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    part = li.select(F.col("l_partkey").alias("src"), following.alias("dst")).where("dst is not null")
    return li.select(F.col("l_partkey").alias("src"), order.alias("dst")).union(li.select(order.alias("src"), F.col("l_partkey").alias("dst"))).union(part)


def part_links(spark, sf_dir):
    """Links between parts that follow each other in an order; the weight counts them."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = li.select(F.col("l_partkey").alias("src"), following.alias("dst")).where("dst is not null and src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def pages(spark, sf_dir):
    """Parts are articles; orders are pages of namespace 14, every second one a redirect."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("namespace"), F.lit("0").alias("is_redirect"))
    o = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select((o + 10_000_000).alias("id"), F.lit(14).alias("namespace"), F.when(o % 2 == 0, "1").otherwise("0").alias("is_redirect"))
    return parts.union(orders)


PAGES_SQL = """pages_t AS (
  SELECT p_partkey AS id, 0 AS namespace, '0' AS is_redirect FROM part
  UNION ALL SELECT o_orderkey + 10000000, 14, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END FROM orders)"""
NEXT_SQL = """nxt AS (SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)"""
LINKS_SQL = NEXT_SQL + """, links_t AS (
  SELECT l_partkey AS src, l_orderkey + 10000000 AS dst FROM lineitem
  UNION ALL SELECT l_orderkey + 10000000, l_partkey FROM lineitem
  UNION ALL SELECT src, dst FROM nxt WHERE dst IS NOT NULL)"""
PART_LINKS_SQL = NEXT_SQL + """, plinks AS (SELECT src, dst, count(*) AS weight FROM nxt WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""
QRELS_SQL = """qrels AS (SELECT item_id AS qid, doc_id, 1 AS rel FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""


def bm25_sql(k1: float, b: float, name: str = "bm25", docs: str = "SELECT doc_id, text FROM documents", queries: str = "SELECT item_id AS qid, text FROM benchmark") -> str:
    """CTEs that end in ``name``(qid, doc_id, score)."""
    cut_text = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
    return f"""{name}_tok AS (SELECT doc_id, unnest({cut_text}) AS term FROM ({docs})),
{name}_dl AS (SELECT doc_id, len({cut_text}) AS dl FROM ({docs})),
{name}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_dl),
{name}_q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({cut_text}) AS term FROM ({queries})) GROUP BY ALL),
{name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM {name}_tok WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT q.qid, t.doc_id, sum(q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * ({k1} + 1) / (t.tf + {k1} * (1 - {b} + {b} * l.dl / s.avgdl))) AS score
  FROM {name}_q q JOIN {name}_tf t USING (term) JOIN {name}_df d USING (term) JOIN {name}_dl l ON l.doc_id = t.doc_id CROSS JOIN {name}_st s GROUP BY ALL)"""


def run_sql(scores: str, name: str, k: int) -> str:
    """CTE ``name``(qid, doc_id, score, rank): the k best by the score rounded to 6 places."""
    return f"""{name} AS (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM {scores} QUALIFY rank <= {k})"""


def t_test_sql(source: str, keep: str) -> str:
    """``keep`` columns and p of the correlations (r, n) in ``source``: the t density by Simpson's rule."""
    return f"""SELECT {keep}, CASE WHEN abs(r) >= 1 THEN 0 ELSE greatest(0, 1 - 2 * h / 3 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - (v + 1) / 2 * ln(1 + pow(i * h, 2) / v)) / sqrt(pi() * v))) END AS p
FROM (SELECT *, n - 2.0 AS v, least(abs(r) * sqrt((n - 2) / greatest(1 - r * r, 1e-300)), 60) / 4000 AS h FROM {source}) CROSS JOIN (SELECT unnest(range(4001)) AS i) GROUP BY {keep}, r, n, v, h"""

"""Retrieval, fusion and evaluation queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import evaluate as E
from quarry.operators import fusion as U
from quarry.operators import retrieval as R
from quarry.operators.lineage import cut
from quarry.plans import tables as t


def bm25_runs(spark, d, settings, k=100):
    """(variant, qid, doc_id, score, rank): the runs of several settings of (k1, b), from one pass over the texts; written once."""
    return cut(R.bm25_runs(t.texts(spark, d), t.queries(spark, d), settings, k).select("qid", "doc_id", "variant", "score", "rank"))


def bm25_run(spark, d, k=100, k1=0.8, b=1.0):
    return bm25_runs(spark, d, {"run": (k1, b)}, k).drop("variant")


_RUN = t.bm25_sql(0.8, 1.0) + ",\n" + t.run_sql("bm25", "run", 100)


def variants(spark, d, k=100):
    return bm25_runs(spark, d, {"v0": (0.8, 1.0), "v1": (1.2, 0.75), "v2": (2.0, 0.3)}, k)


_VARIANTS = ",\n".join([
    t.bm25_sql(0.8, 1.0, "b0"), t.run_sql("b0", "r0", 100), t.bm25_sql(1.2, 0.75, "b1"), t.run_sql("b1", "r1", 100), t.bm25_sql(2.0, 0.3, "b2"), t.run_sql("b2", "r2", 100),
    "runs AS (SELECT *, 'v0' AS variant FROM r0 UNION ALL SELECT *, 'v1' FROM r1 UNION ALL SELECT *, 'v2' FROM r2)",
])


def bm25_top(spark, d):
    return bm25_run(spark, d).select("qid", "doc_id", F.round("score", 2).alias("score"), "rank")


def bm25_pairs(spark, d):
    q = t.queries(spark, d)
    pairs = t.containment_qrels(spark, d).select("qid", "doc_id")
    return R.bm25(t.texts(spark, d), q, 1.2, 0.75, pairs=pairs).select("qid", "doc_id", F.round("score", 4).alias("score"))


def bm25_eval(spark, d):
    run, qrels = bm25_run(spark, d), t.containment_qrels(spark, d)
    n10, n100 = E.ndcg(run, qrels, 10), E.ndcg(run, qrels, 100)
    r = E.recall(run, qrels, 100).join(E.reciprocal_rank(run, qrels), "qid")
    all_items = t.queries(spark, d).select("qid")
    return all_items.join(n10.withColumnRenamed("ndcg", "ndcg_10"), "qid", "left").join(n100.withColumnRenamed("ndcg", "ndcg_100"), "qid", "left").join(r, "qid", "left").select(
        "qid", *[F.round(F.coalesce(c, F.lit(0.0)), 5).alias(c) for c in ("ndcg_10", "ndcg_100", "recall", "rr")])


def ndcg_sql(k, gain):
    return f"""WITH {_RUN}, {t.QRELS_SQL},
hit AS (SELECT qid, sum({gain} / log2(rank + 1)) AS dcg FROM run JOIN qrels USING (qid, doc_id) WHERE rank <= {k} GROUP BY qid),
best AS (SELECT qid, sum({gain} / log2(r + 1)) AS idcg FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM qrels) WHERE r <= {k} GROUP BY qid)
SELECT qid, round(coalesce(dcg, 0) / idcg, 5) AS ndcg FROM best LEFT JOIN hit USING (qid)"""


def ndcg_linear(spark, d):
    return E.ndcg(bm25_run(spark, d), t.containment_qrels(spark, d), 10, "linear").select("qid", F.round("ndcg", 5).alias("ndcg"))


def map_query(spark, d):
    return E.average_precision(bm25_run(spark, d), t.containment_qrels(spark, d), 100).select("qid", F.round("ap", 5).alias("ap"))


def tie_averaged(spark, d):
    run = bm25_run(spark, d).join(t.containment_qrels(spark, d), ["qid", "doc_id"], "left").select("qid", F.floor("score").alias("score"), F.coalesce("rel", F.lit(0)).alias("rel"))
    return E.ndcg_tie_averaged(run, 10).select("qid", F.round("ndcg", 5).alias("ndcg"))


def summaries(spark, d):
    run, qrels = bm25_run(spark, d), t.containment_qrels(spark, d)
    parts = [("recall_100", E.summary(E.recall(run, qrels, 100), "recall")), ("rr", E.summary(E.reciprocal_rank(run, qrels), "rr"))]
    out = None
    for name, one in parts:
        one = one.select(F.lit(name).alias("metric"), F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def labelled_recall(spark, d):
    run = bm25_run(spark, d).join(t.containment_qrels(spark, d), ["qid", "doc_id"], "left").fillna(0, ["rel"])
    return E.recall_of_retrieved(run, 10).select("qid", F.round("recall", 5).alias("recall"))


def evaluator_rr(spark, d):
    run = E.evaluator_order(bm25_run(spark, d).withColumn("score", F.round("score", 1)).drop("rank"))
    return E.reciprocal_rank(run, t.containment_qrels(spark, d)).select("qid", F.round("rr", 5).alias("rr"))


def deltas(spark, d):
    qrels, out = t.containment_qrels(spark, d), []
    runs = bm25_runs(spark, d, {"x": (0.8, 1.0), "y": (1.2, 0.75)})
    for v in ("x", "y"):
        run = runs.where(F.col("variant") == v).drop("variant")
        one = E.summary(E.recall(run, qrels, 10), "recall").select(F.lit("recall_10").alias("metric"), F.round("mean", 5).alias("value"))
        out.append(one.unionByName(E.summary(E.reciprocal_rank(run, qrels), "rr").select(F.lit("rr").alias("metric"), F.round("mean", 5).alias("value"))))
    return E.compare(*out)


def qrel_coverage(spark, d):
    strong = bm25_run(spark, d).where("score >= 150")
    return E.coverage(t.containment_qrels(spark, d), strong).select("queries", "missing", F.round("coverage_pct", 4).alias("coverage_pct"))


def negatives(spark, d):
    return R.first_negatives(bm25_run(spark, d), t.containment_qrels(spark, d), 30).select("qid", "doc_id", "rank")


def rrf(spark, d, weights=None):
    return U.reciprocal_rank_fusion(variants(spark, d), weights=weights).where("rank <= 50").select("qid", "doc_id", F.round("fused", 6).alias("fused"), "n_variants")


def fusion_stats(spark, d):
    return U.fusion_statistics(variants(spark, d)).select("qid", "unique_docs", "in_all", "in_one", F.round("avg_variants", 4).alias("avg_variants"), F.round("duplicate_share", 4).alias("duplicate_share"))


def comb(spark, d, how):
    return U.combine_scores(variants(spark, d), how).select("qid", "doc_id", F.round("score", 1).alias("score"))


def max_fusion(spark, d):
    return U.max_score_fusion(variants(spark, d), 50).select("qid", "doc_id", F.round("score", 2).alias("score"), "rank")


def rerank_length(spark, d, keep=False):
    feature = t.table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return U.rerank_by(bm25_run(spark, d), feature, "n_chars", keep).select("qid", "doc_id", "rank", "score")


def concatenated(spark, d):
    runs = variants(spark, d).withColumn("priority", F.substring("variant", 2, 1).cast("int"))
    return U.concatenate(runs, 20).select("qid", "doc_id", "priority", "rank")


def rewritten(spark, d):
    return U.rewritten_scores(bm25_run(spark, d, 10)).select("qid", "doc_id", "rank", "score")


def listwise(spark, d):
    q = t.queries(spark, d).withColumnRenamed("text", "query")
    out = U.listwise_requests(bm25_run(spark, d), q, t.table(spark, d, "documents"), 20, 10, 100)
    return out.select("qid", "window", F.size("candidates").alias("n"), F.array_join(F.transform("candidates", lambda c: c["doc_id"].cast("string")), ",").alias("docs"), F.aggregate("candidates", F.lit(0), lambda a, c: a + F.length(c["passage"])).alias("chars"))


def batches(spark, d):
    q = t.queries(spark, d).select("qid", F.col("qid").alias("idx"))
    return U.missing_batches(q, q.where("qid % 7 <> 0"), 10)


_RR = "SELECT qid, coalesce(1.0 / min(rank), 0) AS rr FROM (SELECT DISTINCT qid FROM qrels) LEFT JOIN (SELECT qid, rank FROM {run} JOIN qrels USING (qid, doc_id)) USING (qid) GROUP BY qid"
_RECALL = "SELECT qid, count(r.doc_id) / count(*) AS recall FROM qrels q LEFT JOIN (SELECT qid, doc_id FROM {run} WHERE rank <= {k}) r USING (qid, doc_id) GROUP BY qid"

QUERIES = {
    "bm25_top": (bm25_top, f"WITH {_RUN} SELECT qid, doc_id, round(score, 2) AS score, CAST(rank AS INTEGER) AS rank FROM run"),
    "bm25_pairs": (bm25_pairs, f"WITH {t.bm25_sql(1.2, 0.75)}, {t.QRELS_SQL} SELECT qid, doc_id, round(score, 4) AS score FROM bm25 JOIN qrels USING (qid, doc_id)"),
    "bm25_eval": (bm25_eval, f"""WITH {_RUN}, {t.QRELS_SQL},
hit AS (SELECT qid, sum(1 / log2(rank + 1)) AS d100, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS d10, min(rank) AS f, count(*) AS c FROM run JOIN qrels USING (qid, doc_id) GROUP BY qid),
best AS (SELECT qid, count(*) AS n, sum(CASE WHEN r <= 100 THEN 1 / log2(r + 1) ELSE 0 END) AS i100, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) AS i10 FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS r FROM qrels) GROUP BY qid)
SELECT item_id AS qid, round(coalesce(d10 / i10, 0), 5) AS ndcg_10, round(coalesce(d100 / i100, 0), 5) AS ndcg_100, round(coalesce(c / n, 0), 5) AS recall, round(coalesce(1.0 / f, 0), 5) AS rr
FROM benchmark LEFT JOIN best ON best.qid = item_id LEFT JOIN hit ON hit.qid = item_id"""),
    "ndcg_linear": (ndcg_linear, ndcg_sql(10, "rel")),
    "average_precision": (map_query, f"""WITH {_RUN}, {t.QRELS_SQL}, h AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM run JOIN qrels USING (qid, doc_id)),
s AS (SELECT qid, sum(nth / rank) AS total FROM h GROUP BY qid) SELECT qid, round(coalesce(total, 0) / least(n, 100), 5) AS ap FROM (SELECT qid, count(*) AS n FROM qrels GROUP BY qid) LEFT JOIN s USING (qid)"""),
    "ndcg_tie_averaged": (tie_averaged, f"""WITH {_RUN}, {t.QRELS_SQL}, l AS (SELECT qid, floor(score) AS s, coalesce(rel, 0) AS rel FROM run LEFT JOIN qrels USING (qid, doc_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC) AS r, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS ir FROM l),
g AS (SELECT qid, s, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) * avg(rel) AS d FROM a GROUP BY qid, s),
i AS (SELECT qid, sum(CASE WHEN ir <= 10 THEN rel / log2(ir + 1) ELSE 0 END) AS i FROM a GROUP BY qid)
SELECT qid, round(CASE WHEN i.i = 0 THEN 0 ELSE sum(d) / i.i END, 5) AS ndcg FROM g JOIN i USING (qid) GROUP BY qid, i.i"""),
    "metric_summary": (summaries, f"""WITH {_RUN}, {t.QRELS_SQL}, a AS ({_RECALL.format(run='run', k=100)}), b AS ({_RR.format(run='run')})
SELECT 'recall_100' AS metric, round(avg(recall), 5) AS mean, round(stddev_pop(recall), 5) AS std, count(*) AS n FROM a UNION ALL SELECT 'rr', round(avg(rr), 5), round(stddev_pop(rr), 5), count(*) FROM b"""),
    "recall_of_retrieved": (labelled_recall, f"""WITH {_RUN}, {t.QRELS_SQL} SELECT qid, round(coalesce(count(rel) FILTER (rank <= 10) / nullif(count(rel), 0), 0), 5) AS recall FROM run LEFT JOIN qrels USING (qid, doc_id) GROUP BY qid"""),
    "evaluator_rr": (evaluator_rr, f"""WITH {_RUN}, {t.QRELS_SQL}, o AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 1) DESC, doc_id DESC) AS rank FROM run), b AS ({_RR.format(run='o')}) SELECT qid, round(rr, 5) AS rr FROM b"""),
    "metric_deltas": (deltas, f"""WITH {t.bm25_sql(0.8, 1.0, 'x')}, {t.run_sql('x', 'rx', 100)}, {t.bm25_sql(1.2, 0.75, 'y')}, {t.run_sql('y', 'ry', 100)}, {t.QRELS_SQL},
a AS (SELECT 'recall_10' AS metric, round(avg(recall), 5) AS v FROM ({_RECALL.format(run='rx', k=10)}) UNION ALL SELECT 'rr', round(avg(rr), 5) FROM ({_RR.format(run='rx')})),
b AS (SELECT 'recall_10' AS metric, round(avg(recall), 5) AS v FROM ({_RECALL.format(run='ry', k=10)}) UNION ALL SELECT 'rr', round(avg(rr), 5) FROM ({_RR.format(run='ry')}))
SELECT metric, a.v AS baseline, b.v AS reranked, round(b.v - a.v, 2) AS change, round(CASE WHEN a.v = 0 THEN 0 ELSE (b.v - a.v) * 100 / a.v END, 2) AS change_pct FROM a JOIN b USING (metric)"""),
    "qrel_coverage": (qrel_coverage, f"""WITH {_RUN}, {t.QRELS_SQL} SELECT count(*) AS queries, count(*) FILTER (h.qid IS NULL) AS missing, round(count(h.qid) * 100.0 / count(*), 4) AS coverage_pct
FROM (SELECT DISTINCT qid FROM qrels) q LEFT JOIN (SELECT DISTINCT qid FROM run WHERE score >= 150) h ON h.qid = q.qid"""),
    "first_negatives": (negatives, f"""WITH {_RUN}, {t.QRELS_SQL}, n AS (SELECT qid, doc_id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM run ANTI JOIN qrels USING (qid, doc_id)) SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM n WHERE k <= 30"""),
    "rrf": (rrf, f"""WITH {_VARIANTS}, f AS (SELECT qid, doc_id, sum(1 / (60 + rank)) AS fused, count(DISTINCT variant) AS n_variants, min({{'v': variant, 'r': rank}}) AS s FROM runs GROUP BY ALL)
SELECT qid, doc_id, round(fused, 6) AS fused, n_variants FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY fused DESC, s.v, s.r, doc_id) <= 50"""),
    "rrf_weighted": (partial(rrf, weights={"v1": 2.0}), f"""WITH {_VARIANTS}, f AS (SELECT qid, doc_id, sum(CASE WHEN variant = 'v1' THEN 2.0 ELSE 1.0 END / (60 + rank)) AS fused, count(DISTINCT variant) AS n_variants, min({{'v': variant, 'r': rank}}) AS s FROM runs GROUP BY ALL)
SELECT qid, doc_id, round(fused, 6) AS fused, n_variants FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY fused DESC, s.v, s.r, doc_id) <= 50"""),
    "fusion_statistics": (fusion_stats, f"""WITH {_VARIANTS}, n AS (SELECT qid, count(DISTINCT variant) AS v, count(*) AS c FROM runs GROUP BY qid), p AS (SELECT qid, doc_id, count(DISTINCT variant) AS h FROM runs GROUP BY ALL)
SELECT qid, count(*) AS unique_docs, count(*) FILTER (h = v) AS in_all, count(*) FILTER (h = 1) AS in_one, round(avg(h), 4) AS avg_variants, round(1 - count(*) / any_value(c), 4) AS duplicate_share FROM p JOIN n USING (qid) GROUP BY qid"""),
    "comb_sum": (partial(comb, how="sum"), f"WITH {_VARIANTS} SELECT qid, doc_id, round(sum(score), 1) AS score FROM runs GROUP BY ALL"),
    "comb_mnz": (partial(comb, how="mnz"), f"WITH {_VARIANTS} SELECT qid, doc_id, round(sum(score) * count(*), 1) AS score FROM runs GROUP BY ALL"),
    "max_score_fusion": (max_fusion, f"WITH {_VARIANTS}, m AS (SELECT qid, doc_id, max(score) AS score FROM runs GROUP BY ALL) SELECT qid, doc_id, round(score, 2) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY m.score DESC, doc_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 50"),
    "rerank_by_feature": (rerank_length, f"WITH {_RUN} SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY n_chars DESC, r.rank) AS INTEGER) AS rank, CAST(n_chars AS DOUBLE) AS score FROM run r JOIN documents USING (doc_id)"),
    "rerank_keep_rank": (partial(rerank_length, keep=True), f"WITH {_RUN} SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, CAST(n_chars AS DOUBLE) AS score FROM run JOIN documents USING (doc_id)"),
    "concatenated_runs": (concatenated, f"""WITH {_VARIANTS}, m AS (SELECT qid, doc_id, min({{'p': CAST(variant[2:2] AS INTEGER), 'r': rank}}) AS a FROM runs WHERE rank <= 20 GROUP BY ALL)
SELECT qid, doc_id, a.p AS priority, CAST(row_number() OVER (PARTITION BY qid ORDER BY a.p, a.r, doc_id) AS INTEGER) AS rank FROM m"""),
    "rewritten_scores": (rewritten, f"WITH {_RUN} SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, CAST(greatest(6 - rank, 1) AS DOUBLE) AS score FROM run WHERE rank <= 10"),
    "listwise_requests": (listwise, f"""WITH {_RUN}, w AS (SELECT r.*, i.i * 10 + 1 AS win FROM run r JOIN (SELECT unnest(range(9)) AS i) i ON r.rank BETWEEN i.i * 10 + 1 AND i.i * 10 + 20)
SELECT qid, CAST(win AS INTEGER) AS "window", CAST(count(*) AS INTEGER) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS docs, CAST(sum(least(length(text), 1500)) AS INTEGER) AS chars FROM w JOIN documents USING (doc_id) GROUP BY qid, win"""),
    "missing_batches": (batches, "SELECT DISTINCT CAST(floor(item_id / 10) * 10 AS BIGINT) AS batch FROM benchmark WHERE item_id % 7 = 0"),
}

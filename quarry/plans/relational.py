"""Filters, set operations, orders, summaries, resolution and feature queries over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vectors as V
from quarry.operators import entities as N
from quarry.operators import evaluate as E
from quarry.operators import fusion as U
from quarry.operators import graph as G
from quarry.operators import ltr as L
from quarry.operators import quality as Q
from quarry.operators import retrieval as R
from quarry.operators import sampling as S
from quarry.operators import stats as A
from quarry.operators import vector as K
from quarry.plans import tables as t
from quarry.plans.files import a_run


def docs(spark, d):
    return t.table(spark, d, "documents")


def by_price(spark, d):
    """A second run over the same orders: parts by extended price."""
    li = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_extendedprice").alias("score"))
    best = li.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    return R.top_k(best, 5)


def first_run(spark, d):
    """The first run with each part once an order."""
    return R.top_k(a_run(spark, d).groupBy("qid", "doc_id").agg(F.max("score").alias("score")), 5)


def returned(spark, d):
    """Judgements: parts of an order that came back."""
    li = t.table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.lit(1).alias("rel")).distinct()


_A = "fa AS (SELECT l_orderkey AS qid, l_partkey AS doc_id, max(l_quantity) AS score FROM lineitem GROUP BY ALL), ra AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fa QUALIFY rank <= 5)"
_B = "fb AS (SELECT l_orderkey AS qid, l_partkey AS doc_id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), rb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fb QUALIFY rank <= 5)"
_R = "rel AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS doc_id FROM lineitem WHERE l_returnflag = 'R')"
_BOTH = f"{_A}, {_B}, bo AS (SELECT qid, doc_id, coalesce(ra.score, 0) AS s, coalesce(rb.score, 0) AS d, coalesce(ra.rank, 999) AS sr, coalesce(rb.rank, 999) AS dr FROM ra FULL JOIN rb USING (qid, doc_id))"
_EMB = "e AS (SELECT vec_id AS id, embedding AS v, label AS topic FROM embeddings)"


def both_runs(spark, d):
    a, b = (f(spark, d).select("qid", "doc_id", F.col("score").cast("double").alias(s), F.col("rank").alias(r)) for f, s, r in ((first_run, "s", "sr"), (by_price, "d", "dr")))
    return a.join(b, ["qid", "doc_id"], "full_outer").fillna(0.0, ["s", "d"]).fillna(999, ["sr", "dr"])


def rounded(df, digits=5):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else c for c, k in df.dtypes])


def chosen_values(spark, d):
    return t.table(spark, d, "nation").where(F.col("n_name").isin("NATION_1", "NATION_3") | F.col("n_regionkey").isin(0, 2)).select("n_nationkey", "n_name")


def reversed_edges(spark, d):
    return G.edges_between(t.links(spark, d), t.table(spark, d, "part").select(F.col("p_partkey").alias("id"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def knn_graph(spark, d):
    """Neighbour lists of five passages of the same topic as edges, reversed, without loops."""
    base = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[(F.col("vec_id") + k * (k - 1)) for k in range(4)]).alias("neighbors"), F.array(*[F.lit(1.0 / (k + 1)) for k in range(4)]).alias("scores"))
    return G.knn_edges(base, 2).select("src", "dst", F.round("score", 4).alias("score"), "rank")


def seeded_share(spark, d):
    u = F.conv(F.substring(S.order_key(F.col("doc_id"), seed=42), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return docs(spark, d).where(u < 0.1).select("doc_id")


def eligible(spark, d):
    """Documents whose words reach the first quartile and at most 5,000, and whose views reach the 80th percentile."""
    base = docs(spark, d).select("doc_id", X.word_count(F.col("text")).alias("words"), F.col("n_chars").alias("views"))
    low, high = (A.truncated_percentiles(base, c, [p]).select(F.col("value").alias(f"{c}_at")) for c, p in (("words", 25), ("views", 80)))
    kept = base.crossJoin(F.broadcast(low)).crossJoin(F.broadcast(high)).where("words is not null and views is not null and words >= words_at and words <= 5000 and views >= views_at")
    return kept.select("doc_id", "words", "views")


def no_outliers(spark, d):
    return t.table(spark, d, "orders").where(~((F.col("o_totalprice") >= 300000) & (F.col("o_custkey") < 50))).select("o_orderkey")


def over_threshold(spark, d):
    fused = U.reciprocal_rank_fusion(first_run(spark, d).withColumn("variant", F.lit("a")).unionByName(by_price(spark, d).withColumn("variant", F.lit("b"))))
    return fused.where("fused >= 0.03").select("qid", "doc_id", F.round("fused", 6).alias("fused"))


def sources_alone(spark, d):
    return G.degrees(t.pages(spark, d), t.links(spark, d)).where("in_degree = 0").select("id", "out_degree")


def query_slice(spark, d):
    """The 101st to 150th distinct query, by number."""
    q = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid")).distinct()
    return G.dense_ids(q, "qid", "place").where("place between 100 and 149").select("qid", "place")


def query_shards(spark, d):
    q = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid")).distinct()
    return G.dense_ids(q, "qid", "place").select("qid", (F.col("place") % 48).cast("long").alias("shard"))


def scores_by_entity(spark, d):
    ids = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Q"), "p_partkey").alias("entity"))
    scores = G.degree_centrality(ids.select("id"), t.part_links(spark, d)).select("id", "in_centrality")
    return scores.join(ids, "id").select("entity", F.round("in_centrality", 8).alias("score"))


def passages_and_rest(spark, d):
    """Best passage of documents with passages, and those without in a side output."""
    e = t.table(spark, d, "embeddings").select((F.col("vec_id") % 150).alias("doc_id"), F.element_at("embedding", 1).cast("double").alias("x"))
    wanted = docs(spark, d).select("doc_id")
    best = wanted.join(e, "doc_id").groupBy("doc_id").agg(F.round(F.max("x"), 5).alias("best"))
    return best.unionByName(wanted.join(e, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("double").alias("best")))


def checked_lookup(spark, d):
    names = t.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    return L.required(first_run(spark, d), names, "doc_id").select("qid", "doc_id", "p_name")


def largest_groups(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(5)


def quantile_steps(spark, d):
    q = A.approximate_quantiles(t.table(spark, d, "orders"), "o_totalprice", [k / 20 for k in range(21)], 1 << 24)
    return q.select("k", F.round("value", 2).alias("value"))


def topic_counts(spark, d):
    e = t.table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return e.crossJoin(F.broadcast(e.agg(F.sum("n").alias("all")))).select("label", "n", F.round(F.col("n") * 100.0 / F.col("all"), 4).alias("pct"))


def batch_summary(spark, d):
    """Totals of a batch of fused runs from its per-query statistics."""
    runs = first_run(spark, d).withColumn("variant", F.lit("a")).unionByName(by_price(spark, d).withColumn("variant", F.lit("b")))
    s = U.fusion_statistics(runs)
    return s.agg(F.count(F.lit(1)).alias("queries"), F.sum("unique_docs").alias("documents"), F.round(F.avg("unique_docs"), 4).alias("average"), F.sum("in_all").alias("in_all"), F.round(F.avg("duplicate_share"), 4).alias("duplicates"))


def label_audit(spark, d):
    rows = first_run(spark, d).join(returned(spark, d), ["qid", "doc_id"], "left").select("qid", F.coalesce("rel", F.lit(0)).alias("label"))
    return rounded(L.label_counts(rows), 4)


def top_and_bottom(spark, d):
    """The five greatest, and the five least but zero, by views."""
    base = docs(spark, d).select("doc_id", F.col("n_chars").alias("views"))
    top = base.orderBy(F.desc("views"), "doc_id").limit(5).withColumn("part", F.lit("top"))
    return top.unionByName(base.where("views <> 0").orderBy("views", "doc_id").limit(5).withColumn("part", F.lit("bottom")))


def passage_run(spark, d):
    hits = a_run(spark, d).select((F.col("qid") % 10).alias("qid"), F.concat_ws("_", (F.col("doc_id") % 40).cast("string"), "rank").alias("passage"), F.col("score"))
    return K.best_passage_run(hits, 20).select("qid", "doc_id", "score", "rank")


def most_confident(spark, d):
    return docs(spark, d).select("doc_id", "lang", (F.col("n_chars") / 1000.0).alias("confidence")).orderBy(F.desc("confidence"), "doc_id").limit(25)


def numeric_order(spark, d):
    """Text keys in the order of their numbers, told by their places."""
    keys = docs(spark, d).select(F.col("doc_id").cast("string").alias("key"))
    return G.dense_ids(keys.select("key", F.col("key").cast("long").alias("id")), "id", "place").select("key", "place")


def cast_union(spark, d):
    a = t.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").cast("double").alias("value"))
    b = t.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_acctbal").cast("double").alias("value"))
    return a.unionByName(b)


def pairs_of_runs(spark, d):
    one = lambda df: df.select("qid", "doc_id")
    return one(first_run(spark, d)).unionByName(one(by_price(spark, d))).unionByName(one(returned(spark, d))).distinct()


def merged_index(spark, d):
    """Two inverted indexes as one: terms with their postings by weight."""
    p = a_run(spark, d).select(F.col("qid").alias("term"), "doc_id", F.col("score").alias("weight"))
    merged = R.merge_indexes(p.where("doc_id % 2 = 0"), p.where("doc_id % 2 = 1"))
    return merged.groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.round(F.sum("weight"), 3).alias("weight"))


def truncated_judgements(spark, d):
    """The first 50 judgements by query and document."""
    return returned(spark, d).orderBy("qid", "doc_id").limit(50).select("qid", "doc_id")


def version_report(spark, d):
    q = returned(spark, d)
    values = None
    for version, run in (("v1", first_run(spark, d)), ("v2", by_price(spark, d))):
        one = E.recall(run, q, 3).select(F.lit("recall_3").alias("metric"), F.col("recall").alias("value")).unionByName(E.reciprocal_rank(run, q).select(F.lit("rr").alias("metric"), F.col("rr").alias("value")))
        one = one.withColumn("version", F.lit(version))
        values = one if values is None else values.unionByName(one)
    return rounded(E.metric_table(values, "metric", "version", ["v1", "v2"]))


def precision_at_three(spark, d):
    return rounded(E.precision_at(first_run(spark, d), returned(spark, d), 3))


def binary_ndcg(spark, d):
    """Queries without judgements are left out."""
    return E.ndcg(first_run(spark, d), returned(spark, d), 3).select("qid", F.round("ndcg", 5).alias("ndcg"))


def relative_scores(spark, d):
    s = t.table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("value"))
    return E.relative_to_first(s, "s_suppkey", "s_suppkey", "value").select("s_suppkey", F.round("relative", 4).alias("relative"))


def scaled_features(spark, d):
    return rounded(L.pair_features_scaled(both_runs(spark, d)), 4)


def viewed(spark, d):
    p = t.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("doc_id"), F.col("p_size").cast("long").alias("views"), (F.col("p_retailprice") / 1000).alias("pagerank"))


def page_features(spark, d):
    return rounded(L.document_features(both_runs(spark, d), viewed(spark, d)), 4)


def tree_features(spark, d):
    p = t.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("words"), F.col("p_size").cast("long").alias("views"), F.col("p_retailprice").alias("pagerank"))
    pairs = both_runs(spark, d).select("qid", "doc_id", F.col("d").alias("dense"), F.col("s").alias("sparse"))
    return rounded(L.tree_features(pairs, p), 4)


def all_negatives(spark, d):
    rel = returned(spark, d).select("qid", "doc_id")
    negatives = pairs_of_runs(spark, d).join(rel, ["qid", "doc_id"], "left_anti")
    return rel.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))


def triplet_rows(spark, d):
    rel = returned(spark, d).select("qid", "doc_id")
    return L.triplets(rel, pairs_of_runs(spark, d).join(rel, ["qid", "doc_id"], "left_anti"))


def depth_of_texts(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", F.round(Q.depth(c, ("the ", "les "), ("tion", "ung")), 4).alias("depth"), Q.identifies(F.lower(c), (r"tion", r"\d", "ung", "que")).alias("identifies"), Q.varied(c).alias("varied"))


def topics_with_fallback(spark, d):
    return docs(spark, d).select("doc_id", Q.confident_topic(F.col("lang"), F.col("n_chars") / 5000.0, F.col("text"), "general").alias("topic"))


def passage_modes(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", *[F.length(X.passage(c, F.col("source"), m)).alias(m) for m in ("full", "first_paragraph", "title_only")])


def random_texts(spark, d):
    words = F.array(*[F.lit(w) for w in ("red", "green", "blue", "small", "large", "old", "new")])
    return t.queries(spark, d).select("qid", X.random_words(F.col("qid"), words, 12).alias("text"))


def numbered_queries(spark, d):
    picked = docs(spark, d).select("doc_id")
    return G.dense_ids(picked, "doc_id", "place").select("doc_id", (F.col("place") + 60000).cast("long").alias("query_id"))


def wide_vectors(spark, d):
    """Vectors as columns and back."""
    wide = V.array_to_wide(t.table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", "emb_", 8)
    return V.wide_to_array(wide, "emb_", "v").select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", F.round("x", 4).alias("x"))


def joined_vectors(spark, d):
    e = t.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("topic"))
    out = e.where("topic = 0")
    for k in range(1, 10):
        out = out.unionByName(e.where(F.col("topic") == k))
    return out


def mean_of_set(spark, d):
    e = t.table(spark, d, "embeddings").select(F.lit(1).alias("set"), F.col("embedding").alias("vector"))
    return V.mean_pool(e, "set", "vector").select(F.posexplode("vector").alias("pos", "x")).select("pos", (F.round("x", 4) + 0.0).alias("x"))


def activations(spark, d):
    """Greatest log(1 + relu(x)) of each position over the passages of a page; small ones go."""
    parts = t.table(spark, d, "embeddings").select((F.col("vec_id") % 30).alias("doc"), F.posexplode("embedding").alias("term", "x"))
    return R.sparse_max_pool(parts.select("doc", "term", F.round(R.activation(F.col("x").cast("double")), 6).alias("weight")), "doc")


def topics_searched(spark, d):
    """Every query searches its own topic and the next one; the hits are merged and ranked."""
    base = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("topic"))
    found = None
    for k in (0, 1):
        one = K.knn(base.where("id % 100 = 0").select("id", "vector", ((F.col("topic") + k) % 10).cast("int").alias("topic")), base, 10, topic="topic")
        found = one if found is None else found.unionByName(one)
    best = R.top_k(found.withColumn("score", F.round("score", 5)), 10, "query", "neighbor")
    return best.select("query", "neighbor", F.round("score", 3).alias("score"))


def title_sets(spark, d):
    a = docs(spark, d).select("doc_id", F.array(F.concat("source", F.lit(" ("), "lang", F.lit(")"))).alias("aliases"))
    return N.titles_of(N.expand_aliases(a)).select("alias", F.size("docs").alias("n"), F.array_join(F.slice("docs", 1, 3), ",").alias("first"))


def spread_run(spark, d):
    li = t.table(spark, d, "lineitem")
    resolved = li.select(F.col("l_orderkey").alias("qid"), F.floor((F.col("l_linenumber") - 1) / 2).cast("int").alias("position"), F.col("l_partkey").alias("doc_id")).distinct()
    return N.spread_titles(resolved, by_price(spark, d)).select("qid", "position", "doc_id", F.round("score", 4).alias("score"))


def titles_of_pages(spark, d):
    e = t.table(spark, d, "events")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("titles"))


def model_answers(spark, d):
    """Titles in answers of the usual shapes."""
    n, r = F.col("n_name"), F.col("n_nationkey") % 4
    answer = F.when(r == 0, F.concat(F.lit('["'), n, F.lit('", "b"]'))).when(r == 1, F.concat(F.lit('[{"title": "'), n, F.lit('", "score": 2}, {"name": "b"}]')))
    answer = answer.when(r == 2, F.concat(F.lit('error in ```json\n{"candidates": ["'), n, F.lit('", "b"]}\n```'))).otherwise(F.concat(F.lit('{"'), n, F.lit('": 0.9, "b": 0.5}')))
    return t.table(spark, d, "nation").select("n_nationkey", F.array_join(N.answer_titles(answer), "|").alias("titles"))


def extracted_parts(spark, d):
    n = F.col("n_name")
    return t.table(spark, d, "nation").select(
        "n_nationkey", X.between_braces(F.concat(F.lit("say {"), n, F.lit("} end"))).alias("braces"), X.code_block(F.concat(F.lit("x ```py\n"), n, F.lit("\n``` y"))).alias("code"),
        F.array_join(N.question_lines(F.concat(F.lit("A: no\nQ: what is "), n, F.lit(". More\nQ: two"))), "|").alias("questions"), N.names_target(F.concat(F.lit("about "), F.lower(n)), n).alias("leaks"))


def pooled_terms(spark, d):
    run = a_run(spark, d).select((F.col("qid") % 20).alias("key"), F.col("doc_id").alias("term"), "score")
    own, other = (run.where(f"term % 3 {op} 0").groupBy("key", "term").agg(F.max("score").alias("score")) for op in ("=", "<>"))
    return U.pooled_terms(own, other).select("key", "term", F.round("score", 2).alias("score"), "rank")


def model_scores(spark, d):
    """A batched scorer in the place of a cross-encoder: characters that the two texts have in common."""
    q = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), F.col("n_name").alias("query"), F.col("n_regionkey"))
    pairs = q.join(t.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("qid", F.col("r_regionkey").alias("doc_id"), "query", F.col("r_name").alias("text"))

    def model(frame):
        return [float(len(set(a) & set(b))) for a, b in zip(frame["query"], frame["text"], strict=True)]

    return U.scored_by_model(pairs, model, ["query", "text"]).select("qid", "doc_id", "score")


def mean_vector_correlation(spark, d):
    """Pearson's r, and its p, of the mean vectors of two sets of queries."""
    e = t.table(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("set"), F.col("embedding").alias("vector"))
    pooled = V.mean_pool(e, "set", "vector").select("set", F.posexplode("vector").alias("pos", "x"))
    one, two = (pooled.where(F.col("set") == k).select("pos", F.col("x").alias(n)) for k, n in ((0, "a"), (1, "b")))
    r = one.join(two, "pos").agg(F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("n"))
    return r.select(F.round("r", 4).alias("r"), "n")


def performance_correlation(spark, d):
    """Recall of a query against the number of its judgements."""
    q = returned(spark, d)
    joined = E.recall(first_run(spark, d), q, 3).join(q.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid")
    return joined.agg(F.round(F.corr("recall", "n"), 5).alias("r"), F.count(F.lit(1)).alias("queries"))


_EXPR = r"list_filter(string_split_regex(trim(coalesce(text, ''), E' \t\n\r\x0b\f'), '\s+'), lambda x: x <> '')"
_PART_EDGES = t.LINKS_SQL + ", pe AS (SELECT DISTINCT src, dst FROM links_t WHERE src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part))"

QUERIES = {
    "chosen_values": (chosen_values, "SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_3') OR n_regionkey IN (0, 2)"),
    "reversed_edges": (reversed_edges, f"WITH {_PART_EDGES} SELECT dst AS src, src AS dst FROM pe"),
    "knn_graph": (knn_graph, "SELECT vec_id + k * (k - 1) AS src, vec_id AS dst, round(1.0 / (k + 1), 4) AS score, CAST(k AS INTEGER) AS rank FROM embeddings CROSS JOIN (SELECT unnest(range(3)) AS k) WHERE k * (k - 1) <> 0"),
    "seeded_share": (seeded_share, "SELECT doc_id FROM documents WHERE ('0x' || md5(doc_id || '|42')[1:8])::BIGINT / 4294967296.0 < 0.1"),
    "eligible": (eligible, f"""WITH b AS (SELECT doc_id, len({_EXPR}) AS words, n_chars AS views FROM documents), l AS (SELECT list_sort(list(words)) AS w, list_sort(list(views)) AS v FROM b)
SELECT doc_id, CAST(words AS INTEGER) AS words, views FROM b CROSS JOIN l WHERE words >= w[least(CAST(floor(0.25 * len(w)) AS BIGINT), len(w) - 1) + 1] AND words <= 5000 AND views >= v[least(CAST(floor(0.8 * len(v)) AS BIGINT), len(v) - 1) + 1]"""),
    "no_outliers": (no_outliers, "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice >= 300000 AND o_custkey < 50)"),
    "over_threshold": (over_threshold, f"WITH {_A}, {_B}, u AS (SELECT qid, doc_id, rank FROM ra UNION ALL SELECT qid, doc_id, rank FROM rb) SELECT qid, doc_id, round(sum(1 / (60 + rank)), 6) AS fused FROM u GROUP BY ALL HAVING sum(1 / (60 + rank)) >= 0.03"),
    "sources_alone": (sources_alone, f"WITH {t.LINKS_SQL}, {t.PAGES_SQL} SELECT id, count(l.src) AS out_degree FROM pages_t LEFT JOIN links_t l ON l.src = id WHERE id NOT IN (SELECT dst FROM links_t) GROUP BY id"),
    "query_slice": (query_slice, "SELECT qid, place FROM (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS place FROM (SELECT DISTINCT l_orderkey AS qid FROM lineitem)) WHERE place BETWEEN 100 AND 149"),
    "query_shards": (query_shards, "SELECT qid, (row_number() OVER (ORDER BY qid) - 1) % 48 AS shard FROM (SELECT DISTINCT l_orderkey AS qid FROM lineitem)"),
    "scores_by_entity": (scores_by_entity, f"WITH {t.PART_LINKS_SQL} SELECT 'Q' || p_partkey AS entity, round(count(dst) / (SELECT count(*) - 1 FROM part), 8) AS score FROM part LEFT JOIN plinks ON dst = p_partkey GROUP BY p_partkey"),
    "passages_and_rest": (passages_and_rest, "SELECT doc_id, round(max(embedding[1]::DOUBLE), 5) AS best FROM documents LEFT JOIN embeddings ON vec_id % 150 = doc_id GROUP BY doc_id"),
    "checked_lookup": (checked_lookup, f"WITH {_A} SELECT qid, doc_id, p_name FROM ra JOIN part ON p_partkey = doc_id"),
    "largest_groups": (largest_groups, "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5"),
    "quantile_steps": (quantile_steps, "SELECT CAST(k AS INTEGER) AS k, round(l[greatest(CAST(ceil(k / 20.0 * len(l)) AS BIGINT), 1)], 2) AS value FROM (SELECT list_sort(list(o_totalprice)) AS l FROM orders) CROSS JOIN (SELECT unnest(range(21)) AS k)"),
    "topic_counts": (topic_counts, "SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM embeddings), 4) AS pct FROM embeddings GROUP BY label"),
    "batch_summary": (batch_summary, f"""WITH {_A}, {_B}, u AS (SELECT qid, doc_id FROM ra UNION ALL SELECT qid, doc_id FROM rb), p AS (SELECT qid, doc_id, count(*) AS h FROM u GROUP BY ALL), q AS (SELECT qid, count(*) AS n, count(*) FILTER (h = 2) AS b, 1 - count(*) / sum(h) AS s FROM p GROUP BY qid)
SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS documents, round(avg(n), 4) AS average, CAST(sum(b) AS BIGINT) AS in_all, round(avg(s), 4) AS duplicates FROM q"""),
    "label_audit": (label_audit, f"WITH {_A}, {_R}, l AS (SELECT r.qid, rel.doc_id IS NOT NULL AS p FROM ra r LEFT JOIN rel USING (qid, doc_id)), q AS (SELECT qid, count(*) AS n, count(*) FILTER (p) AS p FROM l GROUP BY qid) SELECT count(*) AS queries, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n - p) AS BIGINT) AS negatives, min(n) AS least, max(n) AS most, round(avg(n), 4) AS average FROM q"),
    "top_and_bottom": (top_and_bottom, "(SELECT doc_id, n_chars AS views, 'top' AS part FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5) UNION ALL (SELECT doc_id, n_chars, 'bottom' FROM documents WHERE n_chars <> 0 ORDER BY n_chars, doc_id LIMIT 5)"),
    "passage_run": (passage_run, "WITH m AS (SELECT l_orderkey % 10 AS qid, CAST(l_partkey % 40 AS VARCHAR) AS doc_id, max(l_quantity) AS score FROM lineitem GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 20"),
    "most_confident": (most_confident, "SELECT doc_id, lang, n_chars / 1000.0 AS confidence FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25"),
    "numeric_order": (numeric_order, "SELECT CAST(doc_id AS VARCHAR) AS key, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents"),
    "cast_union": (cast_union, "SELECT CAST(c_custkey AS VARCHAR) AS key, c_acctbal AS value FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_acctbal FROM supplier"),
    "pairs_of_runs": (pairs_of_runs, f"WITH {_A}, {_B}, {_R} SELECT qid, doc_id FROM ra UNION SELECT qid, doc_id FROM rb UNION SELECT qid, doc_id FROM rel"),
    "merged_index": (merged_index, "SELECT l_orderkey AS term, count(*) AS postings, round(sum(l_quantity), 3) AS weight FROM lineitem GROUP BY 1"),
    "truncated_judgements": (truncated_judgements, f"WITH {_R} SELECT qid, doc_id FROM rel ORDER BY qid, doc_id LIMIT 50"),
    "version_report": (version_report, f"""WITH {_A}, {_B}, {_R}, m AS (SELECT 'recall_3' AS metric, rel.qid, count(x.doc_id) / count(*) AS a, count(y.doc_id) / count(*) AS b FROM rel LEFT JOIN (SELECT * FROM ra WHERE rank <= 3) x USING (qid, doc_id) LEFT JOIN (SELECT * FROM rb WHERE rank <= 3) y USING (qid, doc_id) GROUP BY ALL
UNION ALL SELECT 'rr', rel.qid, coalesce(1 / min(ra.rank), 0), coalesce(1 / min(rb.rank), 0) FROM rel LEFT JOIN ra USING (qid, doc_id) LEFT JOIN rb USING (qid, doc_id) GROUP BY ALL) SELECT metric, round(avg(a), 5) AS v1, round(avg(b), 5) AS v2 FROM m GROUP BY metric"""),
    "precision_at_three": (precision_at_three, f"WITH {_A}, {_R} SELECT qid, CASE WHEN count(r.doc_id) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy, round(count(r.doc_id) / 3, 5) AS precision FROM rel LEFT JOIN (SELECT * FROM ra WHERE rank <= 3) r USING (qid, doc_id) GROUP BY qid"),
    "binary_ndcg": (binary_ndcg, f"""WITH {_A}, {_R}, h AS (SELECT qid, sum(1 / log2(rank + 1)) AS dcg FROM ra JOIN rel USING (qid, doc_id) WHERE rank <= 3 GROUP BY qid), b AS (SELECT qid, sum(1 / log2(r + 1)) AS best FROM (SELECT qid, row_number() OVER (PARTITION BY qid) AS r FROM rel) WHERE r <= 3 GROUP BY qid)
SELECT qid, round(coalesce(dcg, 0) / best, 5) AS ndcg FROM b LEFT JOIN h USING (qid)"""),
    "relative_scores": (relative_scores, "SELECT s_suppkey, round(s_acctbal * 100.0 / (SELECT arg_min(s_acctbal, s_suppkey) FROM supplier), 4) AS relative FROM supplier"),
    "scaled_features": (scaled_features, f"""WITH {_BOTH} SELECT qid, doc_id, round((s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w + 1e-8), 4) AS f1, round((d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w + 1e-8), 4) AS f2, round(ln(1 + s) / ln(2 + max(s) OVER w), 4) AS f3, round(ln(1 + d) / ln(2 + max(d) OVER w), 4) AS f4,
round(1 / (sr + 1), 4) AS f5, round(1 / (dr + 1), 4) AS f6, round((1000 - least(sr, dr)) / 1000, 4)::DOUBLE AS f7 FROM bo WINDOW w AS (PARTITION BY qid)"""),
    "page_features": (page_features, f"WITH {_BOTH} SELECT qid, doc_id, round(s, 4) AS f1, round(d, 4) AS f2, CAST(sr AS INTEGER) AS f3, CAST(dr AS INTEGER) AS f4, round(ln(1 + coalesce(p_size, 0)), 4) AS f5, round(coalesce(p_retailprice / 1000, 0), 4) AS f6 FROM bo LEFT JOIN part ON p_partkey = doc_id"),
    "tree_features": (tree_features, f"""WITH {_BOTH} SELECT qid, doc_id, round(d, 4) AS f1, round(least(greatest(s / 100, 0), 1), 4) AS f2, round(least(greatest((p_size - 10) / 990, 0), 1), 4) AS f3, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 4) AS f4,
round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 4) AS f5 FROM bo JOIN part ON p_partkey = doc_id"""),
    "all_negatives": (all_negatives, f"WITH {_A}, {_B}, {_R}, u AS (SELECT qid, doc_id FROM ra UNION SELECT qid, doc_id FROM rb) SELECT qid, doc_id, 1 AS label FROM rel UNION ALL SELECT qid, doc_id, 0 FROM u ANTI JOIN rel USING (qid, doc_id)"),
    "triplet_rows": (triplet_rows, f"WITH {_A}, {_B}, {_R}, u AS (SELECT qid, doc_id FROM ra UNION SELECT qid, doc_id FROM rb) SELECT qid, rel.doc_id AS positive, n.doc_id AS negative FROM rel JOIN (SELECT * FROM u ANTI JOIN rel USING (qid, doc_id)) n USING (qid)"),
    "depth_of_texts": (depth_of_texts, rf"""WITH s AS (SELECT doc_id, lower(text) AS t, {_EXPR} AS w, list_filter(list_transform(string_split_regex(lower(text), '[.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 14) AS l FROM documents),
c AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, 'tion|ung'))) AS a, len(list_filter(l, lambda x: regexp_matches(x, 'the |les '))) AS b FROM s)
SELECT doc_id, round(CASE WHEN a + b = 0 THEN 0 ELSE a / (a + b) END, 4)::DOUBLE AS depth, contains(t, 'tion')::INT + regexp_matches(t, '[0-9]')::INT + contains(t, 'ung')::INT + contains(t, 'que')::INT >= 2 AS identifies, len(list_distinct(w)) >= 100 AS varied FROM c"""),
    "topics_with_fallback": (topics_with_fallback, "SELECT doc_id, CASE WHEN n_chars / 5000.0 < 0.1 OR n_chars IS NULL OR lang IS NULL AND false OR length(trim(coalesce(text, ''), ' ')) = 0 THEN 'general' ELSE lang END AS topic FROM documents"),
    "passage_modes": (passage_modes, r"""WITH p AS (SELECT *, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(least(length(text), 1500) AS INTEGER) AS "full", CAST(CASE WHEN len(l) > 1 THEN length(l[1]) ELSE least(length(text), 200) END AS INTEGER) AS first_paragraph, CAST(length(source) AS INTEGER) AS title_only FROM p"""),
    "random_texts": (random_texts, "SELECT item_id AS qid, array_to_string(list_transform(range(1, 13), lambda i: ['red', 'green', 'blue', 'small', 'large', 'old', 'new'][('0x' || md5(item_id || '|' || i || '|42')[1:8])::BIGINT % 7 + 1]), ' ') AS text FROM benchmark"),
    "numbered_queries": (numbered_queries, "SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 59999 AS query_id FROM documents"),
    "wide_vectors": (wide_vectors, "SELECT vec_id, CAST(k AS INTEGER) AS pos, round(embedding[k + 1]::DOUBLE, 4) AS x FROM embeddings CROSS JOIN (SELECT unnest(range(8)) AS k)"),
    "joined_vectors": (joined_vectors, "SELECT vec_id, label AS topic FROM embeddings WHERE label BETWEEN 0 AND 9"),
    "mean_of_set": (mean_of_set, "SELECT CAST(k AS INTEGER) AS pos, round(avg(embedding[k + 1]::DOUBLE), 4) + 0.0 AS x FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS k) GROUP BY k"),
    "activations": (activations, "WITH p AS (SELECT vec_id % 30 AS doc, CAST(k AS INTEGER) AS term, round(ln(1 + greatest(embedding[k + 1]::DOUBLE, 0)), 6) AS w FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS k)) SELECT doc, term, max(w) AS weight FROM p GROUP BY ALL HAVING max(w) > 0.01"),
    "topics_searched": (topics_searched, f"WITH {_EMB}, h AS (SELECT q.id AS query, b.id AS neighbor, round(list_dot_product(q.v, b.v)::DOUBLE, 5) AS score FROM e q JOIN e b ON b.topic IN (q.topic, (q.topic + 1) % 10) WHERE q.id % 100 = 0) SELECT query, neighbor, round(score, 3) AS score FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY h.score DESC, neighbor) <= 10"),
    "title_sets": (title_sets, "WITH a AS (SELECT DISTINCT doc_id, unnest([source || ' (' || lang || ')', source]) AS alias FROM documents) SELECT alias, CAST(count(*) AS INTEGER) AS n, array_to_string(list_sort(list(doc_id))[1:3], ',') AS first FROM a WHERE alias <> '' GROUP BY alias"),
    "spread_run": (spread_run, f"""WITH {_B}, r AS (SELECT DISTINCT l_orderkey AS qid, CAST((l_linenumber - 1) // 2 AS INTEGER) AS position, l_partkey AS doc_id FROM lineitem),
s AS (SELECT r.*, max(position) OVER (PARTITION BY qid) - position + 1 AS base, count(*) OVER w AS m, row_number() OVER (PARTITION BY qid, position ORDER BY rb.score NULLS FIRST, doc_id) AS turn FROM r LEFT JOIN rb USING (qid, doc_id) WINDOW w AS (PARTITION BY qid, position))
SELECT qid, position, doc_id, round(CASE WHEN m > 1 THEN base + turn / (m + 1) ELSE base END, 4)::DOUBLE AS score FROM s"""),
    "titles_of_pages": (titles_of_pages, "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS titles FROM events GROUP BY user_id"),
    "model_answers": (model_answers, "SELECT n_nationkey, n_name || '|b' AS titles FROM nation"),
    "extracted_parts": (extracted_parts, "SELECT n_nationkey, '{' || n_name || '}' AS braces, n_name AS code, 'what is ' || n_name || '|two' AS questions, true AS leaks FROM nation"),
    "pooled_terms": (pooled_terms, """WITH g AS (SELECT l_orderkey % 20 AS key, l_partkey AS term, max(l_quantity) AS score FROM lineitem GROUP BY ALL), m AS (SELECT key, term, score * CASE WHEN term % 3 = 0 THEN 1.5 ELSE 1 END AS score FROM g)
SELECT key, term, round(score, 2)::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY key ORDER BY m.score DESC, term) AS INTEGER) AS rank FROM m QUALIFY rank <= 20"""),
    "model_scores": (model_scores, "SELECT n_nationkey AS qid, r_regionkey AS doc_id, len(list_intersect(list_distinct(string_split(n_name, '')), list_distinct(string_split(r_name, ''))))::DOUBLE AS score FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "mean_vector_correlation": (mean_vector_correlation, "WITH m AS (SELECT k, avg(embedding[k + 1]::DOUBLE) FILTER (vec_id % 2 = 0) AS a, avg(embedding[k + 1]::DOUBLE) FILTER (vec_id % 2 = 1) AS b FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS k) GROUP BY k) SELECT round(corr(a, b), 4) AS r, count(*) AS n FROM m"),
    "performance_correlation": (performance_correlation, f"WITH {_A}, {_R}, q AS (SELECT qid, count(r.doc_id) / count(*) AS recall, count(*) AS n FROM rel LEFT JOIN (SELECT * FROM ra WHERE rank <= 3) r USING (qid, doc_id) GROUP BY qid) SELECT round(corr(recall, n), 5) AS r, count(*) AS queries FROM q"),
}

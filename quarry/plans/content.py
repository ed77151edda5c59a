"""Text, vector, sampling, statistics and feature queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vectors as V
from quarry.operators import entities as N
from quarry.operators import ltr as L
from quarry.operators import quality as Q
from quarry.operators import sampling as S
from quarry.operators import stats as A
from quarry.operators import vector as K
from quarry.plans import ranking
from quarry.plans import tables as t


def docs(spark, d):
    return t.table(spark, d, "documents")


def vecs(spark, d):
    return t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("topic"))


def word_counts(spark, d):
    return docs(spark, d).select("doc_id", X.word_count(F.col("text")).alias("words"), F.round(X.word_count(F.col("text")) * 1.3, 2).alias("tokens"), F.length(X.first_words(F.col("text"), 5)).alias("five"))


def text_shapes(spark, d):
    c = F.col("text")
    return docs(spark, d).select(
        "doc_id", F.size(X.paragraphs(c)).alias("paragraphs"), F.length(X.first_paragraph(c)).alias("first_paragraph"),
        F.length(F.substring("text", 1, 1500)).alias("capped"), F.md5(X.collapse_spaces(c)).alias("collapsed"), Q.unique_words(c).alias("unique_words"),
    )


def density(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", F.round(Q.line_share(c, r"\|.*\|"), 4).alias("table_share"), F.size(Q.sentences(c)).alias("sentences"), Q.hits(F.lower(c), (r"the\b", r"tion\b", "xyz")).alias("hits"), F.round(Q.explanatory_density(c, ("tion", "and")), 4).alias("density"))


#: Rules in the made-up words of the fixture; a text's first sentence is its title.
_VERDICT = Q.Rules(
    list_titles=(r"^the\b", r"^lists?\b"), ambiguous=("idiot", "clown"), contests=("moron", "worthless", "pathetic"), explains=("tion", r"\band\b"), context=(r"\bthe\b", r"\bof\b", "ung", "que"),
    structural=(r"\bthe\b", r"\bdas\b"), descriptive=("tion", "ment", "ver"), identifying=(r"[0-9]", "tion", "ich"),
)
_CHECKS = ("listing", "long", "unique", "explaining", "coherent", "contextual", "well_formed", "deep", "identifying", "good")


def verdicts(spark, d):
    titled = t.texts(spark, d).withColumn("title", X.first_sentence(F.col("text")))
    return Q.judge(titled, "title", "text", _VERDICT).select("doc_id", *_CHECKS)


_RULES = {"film": (["tion", "the"], "ing and", 3), "person": (["der", "und"], "von der", 2), "place": (["que", "los"], "de la", 2)}


def classified(spark, d):
    return docs(spark, d).select("doc_id", Q.keyword_class(F.col("text"), _RULES).alias("kind"))


def topics(spark, d):
    return t.table(spark, d, "part").select("p_partkey", Q.matching_topic(F.concat_ws(" ", "p_type", "p_name"), ["small", "small_red", "economy", "promo_ring"], "general").alias("topic"), X.file_name(F.col("p_name")).alias("file"))


def normalised(spark, d):
    return vecs(spark, d).select("id", F.round(V.norm(V.normalise(F.col("vector"))), 4).alias("norm"), F.round(V.dot(F.col("vector"), F.col("vector")), 4).alias("square"))


def pooled(spark, d):
    passages = vecs(spark, d).withColumn("page", F.substring_index(F.concat_ws("_", F.col("id") % 50, "id"), "_", 1))
    return V.mean_pool(passages, "page", "vector").select("page", F.posexplode("vector").alias("pos", "x")).select("page", "pos", (F.round("x", 4) + 0.0).alias("x"))


def max_pooled(spark, d):
    from quarry.operators.retrieval import sparse_max_pool

    parts = vecs(spark, d).select((F.col("id") % 50).alias("doc"), F.posexplode("vector").alias("term", "weight"))
    return sparse_max_pool(parts.select("doc", "term", F.round(F.log1p(F.greatest("weight", F.lit(0.0))), 6).alias("weight")), "doc")


def knn_all(spark, d, topic=None):
    base = vecs(spark, d)
    return K.knn(base.where("id % 100 = 0"), base, 11, topic=topic).select("query", "neighbor", F.round("score", 4).alias("score"))


def sparse_scores(spark, d):
    from quarry.operators import retrieval as R

    sparse = vecs(spark, d).select(F.col("id").alias("doc_id"), F.map_from_entries(F.transform("vector", lambda x, i: F.struct(i.cast("string"), F.round(x.cast("double"), 4)))).alias("weights"))
    postings = R.inverted_index(sparse)
    asked = postings.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "qid")
    return R.index_top(asked, postings, 20).select("qid", "doc_id", F.round("score", 4).alias("score"))


def passage_max(spark, d):
    base = vecs(spark, d)
    passages = base.select((F.col("id") % 50).alias("doc_id"), "vector")
    asked = base.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q_vector"))
    pairs = asked.select("qid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(50).cast("long"))).alias("doc_id"))
    return K.max_passage_scores(pairs, passages, asked).select("qid", "doc_id", F.round("score", 4).alias("score"))


def token_windows(spark, d):
    w = K.token_windows(X.space_words(F.col("text")), 256, 64)
    return docs(spark, d).select("doc_id", F.posexplode(w).alias("pos", "w")).select("doc_id", "pos", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


def doc_profile(spark, d):
    out = A.profile(docs(spark, d).select(F.col("n_chars").cast("double").alias("v")), "v")
    return out.select(*[F.round(c, 4).alias(c) if k == "double" else c for c, k in out.dtypes])


def percentile_cuts(spark, d):
    return A.truncated_percentiles(docs(spark, d), "n_chars", [25, 50, 80, 95])


def word_histogram(spark, d):
    h = A.histogram(docs(spark, d).select(X.word_count(F.col("text")).alias("v")), "v", [0, 500, 1000, 2500, 5000])
    return h.select("bucket", "n", F.round("pct", 4).alias("pct"))


def regressions(spark, d):
    r = A.regression(t.table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity")
    return r.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


def tau(spark, d):
    return A.kendall_tau_b(t.table(spark, d, "supplier"), "s_nationkey", "s_acctbal").select(F.round("tau", 6).alias("tau"))


def correlation(spark, d):
    r = docs(spark, d).groupBy("lang").agg(F.corr("n_chars", F.length(F.regexp_replace("text", "[^e]", ""))).alias("r"), F.count(F.lit(1)).alias("n"))
    return r.select("lang", F.round("r", 6).alias("r"), A.stars(A.pearson_p(F.col("r"), F.col("n"))).alias("stars"), "n")


def tfidf(spark, d):
    q = t.queries(spark, d)
    return A.tf_idf(q, "qid", X.words(F.col("text"))).select("qid", "term", F.round("weight", 5).alias("weight"))


def category_sample(spark, d):
    base = docs(spark, d).select("doc_id", "source")
    sizes = base.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.per_category(base.join(F.broadcast(sizes), "source"), "source", "doc_id", S.stratum_size(F.col("n"))).select("doc_id", "source")


def splits(spark, d):
    return S.split(docs(spark, d), "doc_id", {"train": 0.75, "dev": 0.15, "test": 0.10})


def crc_sample(spark, d):
    return docs(spark, d).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 100 < 5).select("doc_id")


def graded(spark, d):
    runs = ranking.bm25_run(spark, d, 60).select("qid", "doc_id", "rank")
    return S.graded_sample(runs, t.containment_qrels(spark, d))


def two_runs(spark, d, k):
    runs = ranking.bm25_runs(spark, d, {"x": (0.8, 1.0), "y": (2.0, 0.3)}, k)
    return [runs.where(F.col("variant") == v).drop("variant") for v in ("x", "y")]


def features(spark, d):
    f = L.pair_features(*two_runs(spark, d, 50))
    return f.select("qid", "doc_id", *[F.round(f"f{k}", 2).alias(f"f{k}") for k in range(1, 8)])


def min_max(spark, d):
    f = L.query_min_max(ranking.bm25_run(spark, d, 50), "score", "scaled")
    return f.select("qid", "doc_id", F.round("scaled", 4).alias("scaled"))


def z_scores(spark, d):
    base = docs(spark, d).select("doc_id", "n_chars")
    one = L.z_score(base, F.log1p("n_chars"), "z")
    return L.z_score(one, L.clamp(F.col("n_chars").cast("double"), 10, 1000), "zc", population=True).select("doc_id", F.round("z", 5).alias("z"), F.round("zc", 5).alias("zc"))


def feature_audit(spark, d):
    f = L.pair_features(*two_runs(spark, d, 50))
    return L.audit(f, ["f1", "f2", "f5", "f7"]).select("feature", *[F.round(c, 4).alias(c) for c in ("min", "max", "avg", "std")], "constant")


def svmrank(spark, d):
    f = L.pair_features(*two_runs(spark, d, 20)).withColumn("label", F.lit(0))
    back = L.parse_svmrank(L.format_svmrank(f, ["f5", "f6", "f7"], 4))
    return back.select("label", "qid", "doc_id", F.size("features").alias("n"), F.element_at("features", 3).alias("best"))


def aliases(spark, d):
    a = docs(spark, d).select("doc_id", F.array(F.concat("source", F.lit(" ("), "lang", F.lit(")")), F.upper("lang")).alias("aliases"))
    return N.expand_aliases(a)


def resolved(spark, d, scorer=N.similarity):
    """Every name of a part in four spellings, against the names of all parts; candidates are BM25's ten best."""
    al = t.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("alias"))
    names = al.groupBy("alias").agg(F.min("doc_id").alias("k"))
    n = F.col("alias")
    forms = [n, F.concat(n, F.lit("x")), F.concat(F.upper(F.substring(n, 1, 1)), F.regexp_replace(F.expr("substring(alias, 2)"), " ", "-"), F.lit("!")), F.concat(F.regexp_replace(n, " ", "_ "), F.lit("_"))]
    titles = names.select("k", F.posexplode(F.array(*forms)).alias("form", "title")).select((F.col("k") * 10 + F.col("form")).alias("title_id"), "title")
    out = N.resolve(titles, al, N.bm25_candidates(titles, al), normal=N.bm25_candidates(N.normal_titles(titles), al), scorer=scorer)
    return out.select("title_id", "doc_id", "strategy", F.round("score", 4).alias("score"))


def upsert(spark, d):
    """The latest event of each user and type stays."""
    e = t.table(spark, d, "events")
    order = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("r", F.row_number().over(order)).where("r = 1").select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"))


def json_fields(spark, d):
    e = t.table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.countDistinct("k").alias("kinds"), F.count_if(F.col("k") >= 50).alias("high"))


def metadata_merge(spark, d):
    """Left joins of word counts, views and labels onto the master list; views default to 0, the rest stays NULL."""
    master = docs(spark, d).select("doc_id", "lang")
    views = t.table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("views"))
    labels = t.table(spark, d, "labels").select("doc_id", "quality")
    return master.join(views, "doc_id", "left").join(labels, "doc_id", "left").select("doc_id", "lang", F.coalesce("views", F.lit(0)).alias("views"), "quality")


def valid_ids(spark, d):
    labels = t.table(spark, d, "labels").select("doc_id")
    kept, gone = docs(spark, d).join(labels, "doc_id", "left_semi"), docs(spark, d).join(labels, "doc_id", "left_anti")
    return kept.select("doc_id", F.lit("kept").alias("part")).unionByName(gone.select("doc_id", F.lit("removed").alias("part")))


def search_like(spark, d):
    return t.table(spark, d, "part").where(F.ilike("p_type", F.lit("%small%"))).orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_type")


def variants_of(spark, d):
    c = t.table(spark, d, "conversations").where("role = 'user'")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.length(s["text"]).cast("string")), ",").alias("lengths"))


def metric_pivot(spark, d):
    return docs(spark, d).groupBy("lang").pivot("source", [f"src{k}" for k in range(20)]).agg(F.count(F.lit(1))).fillna(0)


def run_file(spark, d):
    from quarry.sources import sinks

    return sinks.run_lines(ranking.bm25_run(spark, d, 10).withColumn("score", F.round("score", 1)), "bm25", digits=1)


def run_check(spark, d):
    from quarry.sources import sinks

    lines = run_file(spark, d).union(spark.createDataFrame([("q Q0 d x 1.0 r",), ("broken line",)], "value string"))
    return sinks.validate_run(lines)


def windowed_events(spark, d):
    from quarry.streaming.incremental import windowed_counts

    w = windowed_counts(t.table(spark, d, "events"), "ts", "event_type", "value", "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def running_views(spark, d):
    """Totals per key over all files, as the incremental job leaves them."""
    return t.table(spark, d, "events").groupBy("user_id").agg(F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


_W = r"list_filter(string_split_regex(trim(coalesce(text, ''), E' \t\n\r\x0b\f'), '\s+'), lambda x: x <> '')"
_BM = t.bm25_sql(0.8, 1.0, "x") + ", " + t.run_sql("x", "rx", 50) + ", " + t.bm25_sql(2.0, 0.3, "y") + ", " + t.run_sql("y", "ry", 50)
_EMB = "e AS (SELECT vec_id AS id, embedding AS v, label AS topic FROM embeddings)"



def _verdict_sql(r: Q.Rules) -> str:
    any_of = lambda c, ps: "regexp_matches(" + c + ", '" + "|".join(f"(?:{p})" for p in ps) + "')"
    hits = lambda c, ps: "(" + " + ".join(f"regexp_matches({c}, '{p}')::INT" for p in ps) + ")"
    return rf"""WITH l AS (SELECT doc_id, text AS t, lower(text) AS low, lower(coalesce(regexp_extract(text, '^((?s:.*?)[.!?])(\s|$)', 1), '')) AS title, len({_W}) AS n,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 10) AS ls, list_filter(list_transform(string_split_regex(lower(text), '[.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 8) AS told,
  list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM documents),
w AS (SELECT *, list_transform(told, lambda x: len(list_filter(string_split_regex(trim(x, E' \t\n\r\x0b\f'), '\s+'), lambda y: y <> ''))) AS sizes, list_filter(told, lambda x: length(x) >= 15) AS deep_told, CASE WHEN len(ps) < 2 THEN [t] ELSE ps END AS parts FROM l),
k AS (SELECT *, list_filter(list_transform(deep_told, lambda x: CASE WHEN {any_of("x", r.descriptive)} THEN 1 WHEN {any_of("x", r.structural)} THEN 0 END), lambda x: x IS NOT NULL) AS kinds FROM w),
c AS (SELECT doc_id, n, {any_of("title", r.list_titles)} OR coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '^(?:[*#•-]|\d+[.)])'))) / nullif(len(ls), 0), 0) > 0.5 OR coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '\|.*\|'))) / nullif(len(ls), 0), 0) > 0.4 OR {any_of("low", r.ambiguous)} OR {hits("low", r.contests)} >= 2 AS listing,
  length(trim(t, ' ')) >= 200 AS long, len(list_distinct(regexp_extract_all(low, '[\p{{L}}\p{{N}}_]+'))) >= 30 AS "unique",
  n >= 30 AND ({" + ".join(f"len(regexp_extract_all(low, '{p}'))" for p in r.explains)}) * 100.0 / greatest(n, 1) >= CASE WHEN n < 100 THEN 1.5 ELSE 2.5 END AS explaining,
  len(list_filter(parts, lambda p: len(list_filter(string_split_regex(trim(p, E' \t\n\r\x0b\f'), '\s+'), lambda y: y <> '')) >= 15 AND len(list_filter(list_transform(string_split_regex(p, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 8)) >= 1)) > 0 AS coherent,
  {hits("low", r.context)} >= CASE WHEN n < 100 THEN 2 ELSE 3 END AS contextual,
  coalesce(len(sizes) >= CASE WHEN n < 100 THEN 3 ELSE 4 END AND list_sum(sizes) / nullif(len(sizes), 0) BETWEEN 6 AND 35 AND (n < 100 OR len(list_filter(sizes, lambda x: x > 12)) / nullif(len(sizes), 0) >= 0.2), false) AS well_formed,
  coalesce(list_sum(kinds) / nullif(len(kinds), 0) >= 0.4, false) AS deep, {hits("low", r.identifying)} >= 2 AS identifying FROM k)
SELECT doc_id, listing, long, "unique", explaining, coherent, contextual, well_formed, deep, identifying, NOT listing AND long AND "unique" AND explaining::INT + coherent::INT + contextual::INT + well_formed::INT + deep::INT >= CASE WHEN n < 80 AND identifying THEN 1 WHEN n < 100 THEN 2 ELSE 3 END AS good FROM c"""


QUERIES = {
    "word_counts": (word_counts, f"SELECT doc_id, CAST(len(w) AS INTEGER) AS words, round(len(w) * 1.3, 2) AS tokens, CAST(length(array_to_string(w[1:5], ' ')) AS INTEGER) AS five FROM (SELECT doc_id, {_W} AS w FROM documents)"),
    "text_shapes": (text_shapes, r"""SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS paragraphs,
CAST(length(CASE WHEN contains(text, chr(10) || chr(10)) THEN trim(string_split(text, chr(10) || chr(10))[1]) ELSE text[1:500] END) AS INTEGER) AS first_paragraph, CAST(least(length(text), 1500) AS INTEGER) AS capped,
md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS INTEGER) AS unique_words FROM documents"""),
    "quality_density": (density, rf"""WITH l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 10) AS ls, {_W} AS w FROM documents)
SELECT doc_id, round(CASE WHEN len(ls) = 0 THEN 0 ELSE len(list_filter(ls, lambda x: regexp_matches(x, '\|.*\|'))) / len(ls) END, 4) AS table_share, CAST(len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 8)) AS INTEGER) AS sentences,
CAST(regexp_matches(lower(text), 'the\b') AS INTEGER) + CAST(regexp_matches(lower(text), 'tion\b') AS INTEGER) + CAST(contains(text, 'xyz') AS INTEGER) AS hits,
round(CASE WHEN len(w) = 0 THEN 0 ELSE (len(regexp_extract_all(lower(text), 'tion')) + len(regexp_extract_all(lower(text), 'and'))) * 100.0 / len(w) END, 4) AS density FROM l"""),
    "quality_verdict": (verdicts, _verdict_sql(_VERDICT)),
    "keyword_class": (classified, """WITH s AS (SELECT doc_id, contains(lower(text), 'tion')::INT + contains(lower(text), 'the')::INT + 3 * contains(lower(text), 'ing and')::INT AS f, contains(lower(text), 'der')::INT + contains(lower(text), 'und')::INT + 2 * contains(lower(text), 'von der')::INT AS p,
contains(lower(text), 'que')::INT + contains(lower(text), 'los')::INT + 2 * contains(lower(text), 'de la')::INT AS l FROM documents)
SELECT doc_id, CASE WHEN greatest(f, p, l) = 0 THEN 'other' WHEN f = greatest(f, p, l) THEN 'film' WHEN p = greatest(f, p, l) THEN 'person' ELSE 'place' END AS kind FROM s"""),
    "topic_match": (topics, r"""SELECT p_partkey, CASE WHEN contains(x, 'promo') AND contains(x, 'ring') THEN 'promo_ring' WHEN contains(x, 'small') AND contains(x, 'red') THEN 'small_red' WHEN contains(x, 'economy') THEN 'economy' WHEN contains(x, 'small') THEN 'small' ELSE 'general' END AS topic,
regexp_replace(regexp_replace(lower(trim(p_name)), '[^\w\s-]', '', 'g'), '[\s-]+', '_', 'g') AS file FROM (SELECT *, lower(p_type || ' ' || p_name) AS x FROM part)"""),
    "vector_norms": (normalised, f"WITH {_EMB} SELECT id, round(1.0, 4)::DOUBLE AS norm, round(list_dot_product(v::DOUBLE[], v::DOUBLE[]), 4) AS square FROM e"),
    "mean_pool": (pooled, f"WITH {_EMB}, p AS (SELECT CAST(id % 50 AS VARCHAR) AS page, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) SELECT page, CAST(pos AS INTEGER) AS pos, round(avg(x::DOUBLE), 4) + 0.0 AS x FROM p GROUP BY ALL"),
    "sparse_max_pool": (max_pooled, f"WITH {_EMB}, p AS (SELECT id % 50 AS doc, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) SELECT doc, CAST(pos AS INTEGER) AS term, max(round(ln(1 + greatest(x::DOUBLE, 0)), 6)) AS weight FROM p GROUP BY ALL HAVING max(round(ln(1 + greatest(x::DOUBLE, 0)), 6)) > 0.01"),
    "knn_exact": (knn_all, f"WITH {_EMB} SELECT q.id AS query, b.id AS neighbor, round(list_dot_product(q.v, b.v)::DOUBLE, 4) AS score FROM e q CROSS JOIN e b WHERE q.id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, b.v) DESC, b.id) <= 11"),
    "knn_per_topic": (partial(knn_all, topic="topic"), f"WITH {_EMB} SELECT q.id AS query, b.id AS neighbor, round(list_dot_product(q.v, b.v)::DOUBLE, 4) AS score FROM e q JOIN e b USING (topic) WHERE q.id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, b.v) DESC, b.id) <= 11"),
    "sparse_index_scores": (sparse_scores, f"""WITH {_EMB}, p AS (SELECT * FROM (SELECT id, round(unnest(v)::DOUBLE, 4) AS w, generate_subscripts(v, 1) - 1 AS term FROM e) WHERE w > 0.01),
s AS (SELECT q.id AS qid, p.id AS doc_id, round(sum(q.w * p.w), 6) AS score FROM p q JOIN p USING (term) WHERE q.id % 100 = 0 GROUP BY ALL) SELECT qid, doc_id, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s.score DESC, doc_id) <= 20"""),
    "max_passage": (passage_max, f"""WITH {_EMB}, a AS (SELECT q.id AS qid, unnest(range(51)) AS doc_id, q.v FROM e q WHERE q.id % 100 = 0)
SELECT qid, CAST(a.doc_id AS BIGINT) AS doc_id, round(coalesce(max(list_dot_product(a.v::DOUBLE[], e.v::DOUBLE[])), -100.0), 4) AS score FROM a LEFT JOIN e ON e.id % 50 = a.doc_id GROUP BY ALL"""),
    "token_windows": (token_windows, rf"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(greatest(0, CAST(ceil((len(w) - 256) / 192.0) AS BIGINT)) + 1)) AS i FROM w),
x AS (SELECT doc_id, i, w[i * 192 + 1 : i * 192 + 256] AS s FROM c) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, ' ')) AS digest FROM x WHERE len(s) >= 16"""),
    "profile": (doc_profile, "SELECT count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.05), 4) AS p5, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr FROM (SELECT n_chars::DOUBLE AS v FROM documents)"),
    "truncated_percentiles": (percentile_cuts, "WITH s AS (SELECT list_sort(list(n_chars)) AS l FROM documents) SELECT p, l[least(CAST(floor(p / 100 * len(l)) AS BIGINT), len(l) - 1) + 1] AS value FROM s CROSS JOIN (SELECT unnest([25, 50, 80, 95]) AS p)"),
    "range_histogram": (word_histogram, f"WITH w AS (SELECT len({_W}) AS n FROM documents) SELECT CASE WHEN n < 500 THEN 0 WHEN n < 1000 THEN 1 WHEN n < 2500 THEN 2 WHEN n < 5000 THEN 3 ELSE 4 END AS bucket, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM w), 4) AS pct FROM w GROUP BY 1"),
    "regression": (regressions, "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1"),
    "kendall_tau": (tau, "WITH s AS (SELECT * FROM supplier) SELECT round(sum(sign(a.s_nationkey - b.s_nationkey) * sign(a.s_acctbal - b.s_acctbal)) / sqrt(sum(abs(sign(a.s_nationkey - b.s_nationkey))) * sum(abs(sign(a.s_acctbal - b.s_acctbal)))), 6) AS tau FROM s a JOIN s b ON a.s_suppkey < b.s_suppkey"),
    "correlation": (correlation, f"""WITH c AS (SELECT lang, corr(n_chars, length(regexp_replace(text, '[^e]', '', 'g'))) AS r, count(*) AS n FROM documents GROUP BY 1), k AS ({t.t_test_sql("c", "lang, r, n")})
SELECT lang, round(r, 6) AS r, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, n FROM k"""),
    "tf_idf": (tfidf, r"""WITH c AS (SELECT qid, term, count(*) AS tf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL), i AS (SELECT term, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term)
SELECT qid, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY qid)), 5) AS weight FROM c JOIN i USING (term)"""),
    "stratified_sample": (category_sample, "WITH c AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|42'), doc_id) AS r FROM documents) SELECT doc_id, source FROM c WHERE r <= CASE WHEN n < 10 THEN 0 WHEN n < 100 THEN 1 WHEN n < 500 THEN 3 WHEN n < 1000 THEN 4 ELSE 5 END"),
    "split_by_key": (splits, "WITH u AS (SELECT DISTINCT doc_id, ('0x' || md5(doc_id || '|42')[1:8])::BIGINT / 4294967296.0 AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.75 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split FROM u"),
    "crc_sample": (crc_sample, None),
    "graded_sample": (graded, f"""WITH {t.bm25_sql(0.8, 1.0)}, {t.run_sql('bm25', 'run', 60)}, {t.QRELS_SQL}, pool AS (SELECT qid, doc_id, rank FROM run ANTI JOIN qrels USING (qid, doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || '|' || doc_id || '|42'), doc_id) AS t FROM pool WHERE rank <= 10), z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || '|' || doc_id || '|42'), doc_id) AS t FROM pool WHERE rank > 10)
SELECT qid, doc_id, 2 AS label FROM qrels UNION ALL SELECT qid, doc_id, 1 FROM o WHERE t <= 5 UNION ALL SELECT qid, doc_id, 0 FROM z WHERE t <= 10"""),
    "pair_features": (features, f"""WITH {_BM}, f AS (SELECT qid, doc_id, coalesce(a.score, 0) AS s, coalesce(b.score, 0) AS d, coalesce(a.rank, 999) AS sr, coalesce(b.rank, 999) AS dr FROM rx a FULL JOIN ry b USING (qid, doc_id))
SELECT qid, doc_id, round(s, 2) AS f1, round(d, 2) AS f2, round(ln(1 + s), 2) AS f3, round(ln(2 + d), 2) AS f4, round(1 / (sr + 1), 2) AS f5, round(1 / (dr + 1), 2) AS f6, CAST(least(sr, dr) AS DOUBLE) AS f7 FROM f"""),
    "query_min_max": (min_max, f"WITH {_BM} SELECT qid, doc_id, round((score - least(min(score) OVER w, 0)) / (greatest(max(score) OVER w, 0) - least(min(score) OVER w, 0) + 1e-8), 4) AS scaled FROM rx WINDOW w AS (PARTITION BY qid)"),
    "z_scores": (z_scores, "WITH v AS (SELECT doc_id, ln(1 + n_chars) AS a, least(greatest((n_chars - 10) / 990.0, 0), 1) AS b FROM documents) SELECT doc_id, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 5) AS z, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 5) AS zc FROM v"),
    "feature_audit": (feature_audit, f"""WITH {_BM}, f AS (SELECT coalesce(a.score, 0) AS s, coalesce(b.score, 0) AS d, coalesce(a.rank, 999) AS sr, coalesce(b.rank, 999) AS dr FROM rx a FULL JOIN ry b USING (qid, doc_id)),
u AS (SELECT unnest(['f1', 'f2', 'f5', 'f7']) AS feature, unnest([s, d, 1 / (sr + 1), least(sr, dr)::DOUBLE]) AS v FROM f) SELECT feature, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS avg, round(stddev_pop(v), 4) AS std, stddev_pop(v) < 1e-6 AS constant FROM u GROUP BY feature"""),
    "svmrank_round_trip": (svmrank, None),
    "alias_expansion": (aliases, "SELECT DISTINCT doc_id, unnest([source || ' (' || lang || ')', source, upper(lang)]) AS alias FROM documents"),
    "title_resolution": (resolved, f"""WITH al AS (SELECT p_partkey AS doc_id, p_name AS alias FROM part), nm AS (SELECT alias, min(doc_id) AS k FROM al GROUP BY alias),
ti AS (SELECT k * 10 + i AS title_id, CASE i WHEN 0 THEN alias WHEN 1 THEN alias || 'x' WHEN 2 THEN upper(alias[1]) || replace(alias[2:], ' ', '-') || '!' ELSE replace(alias, ' ', '_ ') || '_' END AS title FROM nm CROSS JOIN (SELECT unnest(range(4)) AS i)),
no AS (SELECT title_id, trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g')) AS title FROM ti),
{t.bm25_sql(0.8, 1.0, "c1", "SELECT doc_id, alias AS text FROM al", "SELECT title_id AS qid, title AS text FROM ti")}, {t.run_sql("c1", "r1", 10)},
{t.bm25_sql(0.8, 1.0, "c2", "SELECT doc_id, alias AS text FROM al", "SELECT no.title_id AS qid, no.title AS text FROM no JOIN ti USING (title_id) WHERE no.title <> ti.title")}, {t.run_sql("c2", "r2", 10)},
x AS (SELECT title_id, doc_id, 1 AS strategy, 101.0 AS score FROM ti JOIN al ON alias = title),
p2 AS (SELECT title_id, doc_id, title AS a, alias AS b FROM ti JOIN r1 ON qid = title_id JOIN al USING (doc_id)),
p3 AS (SELECT title_id, doc_id, no.title AS a, trim(regexp_replace(lower(alias), '[^a-z0-9 ]', '', 'g')) AS b FROM no JOIN r1 ON qid = title_id JOIN al USING (doc_id)),
p4 AS (SELECT title_id, doc_id, no.title AS a, trim(regexp_replace(lower(alias), '[^a-z0-9 ]', '', 'g')) AS b FROM no JOIN r2 ON qid = title_id JOIN al USING (doc_id)),
f AS (SELECT *, CASE WHEN a = b THEN 101.0 ELSE 100 * (1 - levenshtein(a, b) / greatest(length(a), length(b), 1)) END AS score FROM (SELECT 2 AS strategy, * FROM p2 UNION ALL SELECT 3, * FROM p3 UNION ALL SELECT 4, * FROM p4)),
g AS (SELECT * FROM f WHERE title_id NOT IN (SELECT title_id FROM x) AND score >= 70 QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY strategy, score DESC, doc_id) = 1)
SELECT title_id, doc_id, strategy, round(score::DOUBLE, 4) AS score FROM x UNION ALL SELECT title_id, doc_id, strategy, round(score::DOUBLE, 4) FROM g"""),
    "keep_latest": (upsert, "SELECT user_id, event_type, event_id, round(value, 2) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
    "json_fields": (json_fields, "WITH k AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, count(DISTINCT k) AS kinds, count(*) FILTER (k >= 50) AS high FROM k GROUP BY 1"),
    "metadata_merge": (metadata_merge, "SELECT d.doc_id, lang, coalesce(v.views, 0) AS views, quality FROM documents d LEFT JOIN (SELECT user_id, count(*) AS views FROM events GROUP BY 1) v ON v.user_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "valid_and_removed": (valid_ids, "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'kept' ELSE 'removed' END AS part FROM documents"),
    "like_search": (search_like, "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%small%' ORDER BY p_retailprice DESC, p_partkey LIMIT 20"),
    "grouped_variants": (variants_of, "SELECT conv_id, count(*) AS n, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY turn, text) AS lengths FROM conversations WHERE role = 'user' GROUP BY 1"),
    "metric_pivot": (metric_pivot, "SELECT lang, " + ", ".join(f"count(*) FILTER (source = 'src{k}') AS src{k}" for k in range(20)) + " FROM documents GROUP BY 1"),
    "run_file": (run_file, f"WITH {t.bm25_sql(0.8, 1.0)}, {t.run_sql('bm25', 'run', 10)} SELECT qid || ' Q0 ' || doc_id || ' ' || rank || ' ' || printf('%.1f', round(score, 1)) || ' bm25' AS value FROM run"),
    "run_validation": (run_check, f"WITH {t.bm25_sql(0.8, 1.0)}, {t.run_sql('bm25', 'run', 10)} SELECT count(*) + 2 AS lines, CAST(1 AS BIGINT) AS bad_fields, CAST(1 AS BIGINT) AS bad_literal, CAST(2 AS BIGINT) AS bad_rank, CAST(1 AS BIGINT) AS bad_score, count(DISTINCT qid) + 2 AS queries, false AS valid FROM run"),
    "windowed_events": (windowed_events, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"),
    "running_totals": (running_views, "SELECT user_id, CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY 1"),
}

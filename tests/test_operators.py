import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate as E
from quarry.operators import fusion as U
from quarry.operators import graph as G
from quarry.operators import ltr as L
from quarry.operators import sampling as S
from quarry.operators import stats as A
from quarry.plans import content


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_fusion_of_six_variants(spark):
    """700 documents shared by six variants and 300 of each alone: 2,500 documents, 1,000 kept."""
    shared = spark.range(6).crossJoin(spark.range(700).withColumnRenamed("id", "k")).select(F.col("id").alias("v"), F.col("k").alias("doc_id"), (F.col("k") + 1).alias("rank"))
    own = spark.range(6).crossJoin(spark.range(300).withColumnRenamed("id", "k")).select(F.col("id").alias("v"), (F.col("id") * 1000 + 10_000 + F.col("k")).alias("doc_id"), (F.col("k") + 701).alias("rank"))
    runs = shared.union(own).select(F.lit("q").alias("qid"), "doc_id", "rank", F.lit(1.0).alias("score"), F.concat(F.lit("v"), "v").alias("variant"))
    assert runs.count() == 6000
    fused = U.reciprocal_rank_fusion(runs)
    assert fused.count() == 1000 and fused.where("n_variants = 6").count() == 700
    assert fused.orderBy("rank").first()["fused"] == pytest.approx(6 / 61)
    stats = U.fusion_statistics(runs).first()
    assert (stats["unique_docs"], stats["in_all"], stats["in_one"]) == (2500, 700, 1800)


def test_fusion_ignores_variant_order(spark):
    runs = spark.createDataFrame([("q", 1, 1, 1.0, "a"), ("q", 2, 2, .5, "a"), ("q", 2, 1, .9, "b")], "qid string, doc_id int, rank int, score double, variant string")
    swapped = runs.withColumn("variant", F.when(F.col("variant") == "a", "b").otherwise("a"))
    one, two = (rows(U.reciprocal_rank_fusion(r).select("doc_id", F.round("fused", 9))) for r in (runs, swapped))
    assert one == two


def test_threshold_uses_up_the_rank(spark):
    runs = spark.createDataFrame([("q", 1, 1, .1, "a"), ("q", 2, 2, .9, "a")], "qid string, doc_id int, rank int, score double, variant string")
    assert rows(U.reciprocal_rank_fusion(runs, least_score=.5).select("doc_id", F.round("fused", 6))) == [(2, round(1 / 62, 6))]


def test_rewritten_scores_tie_from_the_fifth(spark):
    run = spark.createDataFrame([("q", i, i) for i in range(1, 8)], "qid string, doc_id int, rank int")
    assert [r["score"] for r in U.rewritten_scores(run).orderBy("rank").collect()] == [5, 4, 3, 2, 1, 1, 1]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q", "a", 1, 3.0), ("q", "b", 2, 2.0), ("q", "c", 3, 1.0)], "qid string, doc_id string, rank int, score double")
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "x", 1), ("p", "a", 1)], "qid string, doc_id string, rel int")
    ideal = 3 / 1 + 1 / math.log2(3)
    got = dict(E.ndcg(run, qrels, 10).collect())
    assert got == {"q": pytest.approx(3 / math.log2(3) / ideal), "p": 0}
    assert dict(E.ndcg(run, qrels, 10, missing="skip").collect()).keys() == {"q"}
    assert dict(E.recall(run, qrels, 1).collect()) == {"q": 0, "p": 0}
    assert dict(E.recall(run, qrels, 2).collect())["q"] == .5
    assert dict(E.reciprocal_rank(run, qrels).collect()) == {"q": .5, "p": 0}


def test_pagerank_of_a_cycle_and_dangling_mass(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    cycle = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "src long, dst long, weight double")
    assert all(r["score"] == pytest.approx(1 / 3) for r in G.pagerank(nodes, cycle).collect())
    chain = cycle.where("src = 0")
    assert G.pagerank(nodes, chain, iterations=20).agg(F.sum("score")).first()[0] == pytest.approx(1)


def test_knn_edges_keep_the_self_slot(spark):
    knn = spark.createDataFrame([(1, [1, 2, 3, 4], [1.0, .9, .8, .7])], "id long, neighbors array<long>, scores array<double>")
    assert rows(G.knn_edges(knn, 2).select("src", "dst")) == [(2, 1), (3, 1)]


def test_merge_leaves_given_weights_alone(spark):
    a = spark.createDataFrame([(1, 2, 3.0)], "src long, dst long, weight double")
    b = a.select("src", "dst")
    assert rows(G.merge([(a, .5), (b, .25)])) == [(1, 2, 3.25)]
    assert rows(G.merge([(a, .5), (b, .25)], scale_existing=True)) == [(1, 2, 1.75)]


def test_features_of_absent_pairs(spark):
    kind = "qid string, doc_id string, score double, rank int"
    f = L.pair_features(spark.createDataFrame([("q", "a", 2.0, 1)], kind), spark.createDataFrame([("q", "b", .5, 1)], kind))
    got = {r["doc_id"]: r for r in f.collect()}
    assert got["a"]["f2"] == 0 and got["a"]["f4"] == pytest.approx(math.log(2)) and got["a"]["f6"] == pytest.approx(.001) and got["b"]["f5"] == pytest.approx(.001)


def test_quantiles_differ_by_definition(spark):
    df = spark.range(1, 11).select(F.col("id").alias("v"))
    assert A.profile(df, "v").first()["q1"] == 3.25
    assert dict(A.truncated_percentiles(df, "v", [25, 100]).collect()) == {25: 3, 100: 10}


def test_splits_and_samples_are_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = S.split(df, "k", {"train": .75, "dev": .15, "test": .1}), S.split(df.repartition(7), "k", {"train": .75, "dev": .15, "test": .1})
    assert rows(a) == rows(b) and 680 < a.where("split = 'train'").count() < 820
    cand = spark.range(300).select(F.lit("q").alias("qid"), F.col("id").alias("doc_id"), F.col("id").alias("rank"))
    got = S.hard_and_easy(cand)
    assert got.count() == 100 and got.where("is_hard").count() == 70
    assert S.hard_and_easy(cand.where("rank < 90")).count() == 90


def test_coordinate_ascent_and_pairwise_ranker_find_the_good_feature(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("qid"), F.col("id").alias("doc_id"), (F.col("id") >= 48).cast("int").alias("label"), (F.col("id") / 60).alias("a"), F.rand(1).alias("b"))
    weights, best = L.coordinate_ascent(df, ["a", "b"], rounds=20, restarts=3, k=1)
    assert best == 1.0 and weights["a"] > abs(weights["b"])
    learned = L.pairwise_ranker(df, ["a", "b"])
    assert learned["a"] > abs(learned["b"])


def tau_by_pairs(rows):
    sign = lambda a, b: (a > b) - (a < b)
    pairs = [(sign(a[0], b[0]), sign(a[1], b[1])) for k, a in enumerate(rows) for b in rows[:k]]
    return sum(p * q for p, q in pairs) / math.sqrt(sum(p * p for p, _ in pairs) * sum(q * q for _, q in pairs))


@pytest.mark.parametrize("ranges", [1, 4, 256])
def test_kendall_counts_equal_pairs(spark, ranges):
    draw = random.Random(3)
    few = [(draw.randint(0, 6), draw.randint(0, 40) / 4) for _ in range(150)]
    for vector in (few, [(k, (k * 37 % 101) - k / 3) for k in range(101)], [(1, 2.0), (1, 3.0), (2, 2.5)]):
        df = spark.createDataFrame(vector, "x int, y double")
        assert A.kendall_tau_b(df, "x", "y", ranges).first()["tau"] == pytest.approx(tau_by_pairs(vector))
    assert A.kendall_tau_b(spark.createDataFrame([(1, 1.0)], "x int, y double"), "x", "y").first()["tau"] is None
    assert A.kendall_tau_b(spark.createDataFrame([], "x int, y double"), "x", "y").first()["tau"] is None


def test_kendall_query_reads_all_suppliers(spark, tmp_path):
    vector = [(k, draw % 25, float(draw * 7 % 1009)) for k, draw in ((k, k * k % 997) for k in range(1, 401))]
    spark.createDataFrame(vector, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert content.tau(spark, str(tmp_path)).first()["tau"] == pytest.approx(tau_by_pairs([r[1:] for r in vector]), abs=1e-6)


def plain_verdict(title, text, rules):
    import re

    text, title = text or "", (title or "").lower()
    low, n, short = text.lower(), len(text.split()), len(text.split()) < 100
    lines = [x.strip() for x in text.split("\n") if len(x.strip()) > 10]
    hits = lambda ps: sum(bool(re.search(p, low)) for p in ps)
    share = lambda p: sum(bool(re.search(p, x)) for x in lines) / len(lines) if lines else 0
    listing = any(re.search(p, title) for p in rules.list_titles) or share(r"^(?:[*#•-]|\d+[.)])") > 0.5 or share(r"\|.*\|") > 0.4 or hits(rules.ambiguous) > 0 or hits(rules.contests) >= 2
    told = [x.strip() for x in re.split("[.!?]+", low) if len(x.strip()) > 8]
    sizes = [len(x.split()) for x in told]
    kinds = [1 if any(re.search(p, x) for p in rules.descriptive) else 0 for x in told if len(x) >= 15 and any(re.search(p, x) for p in rules.descriptive + rules.structural)]
    paragraphs = [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()]
    paragraphs = paragraphs if len(paragraphs) > 1 else [text]
    checks = [
        n >= 30 and sum(len(re.findall(p, low)) for p in rules.explains) * 100 / n >= (1.5 if short else 2.5),
        any(len(p.split()) >= 15 and any(len(x.strip()) > 8 for x in re.split("[.!?]+", p)) for p in paragraphs),
        hits(rules.context) >= (2 if short else 3),
        len(sizes) >= (3 if short else 4) and 6 <= sum(sizes) / len(sizes) <= 35 and (short or sum(x > 12 for x in sizes) >= 0.2 * len(sizes)),
        bool(kinds) and sum(kinds) / len(kinds) >= 0.4,
    ]
    essential = not listing and len(text.strip()) >= 200 and len(set(re.findall(r"\w+", low))) >= 30
    return essential and sum(checks) >= (1 if n < 80 and hits(rules.identifying) >= 2 else 2 if short else 3)


def test_verdict_equals_a_plain_one(spark):
    import random

    from quarry.operators import quality as Q

    rules = Q.Rules((r"^lists? of",), ("may refer to",), ("round", "heat [12]"), (r"\bbecause\b", r"known as"), ("history", "later", "origin", "role"), ("located", "born"), ("looks like", "known as"), ("[0-9]{4}", "named", "capital"))
    rng = random.Random(3)
    parts = ["Water is known as a liquid because it flows far. ", "It looks like rain over the old town and later it stops there again. ", "The origin and the role of the river are told in its history of 1848. ", "Born in the capital he was named after a king. ", "* item number one of these\n", "a | b | c | d e f\n", "\n\n", "It may refer to this. ", "The first round and heat 2 are over. ", "Located in the north of all lands! ", "Few words here. "]
    texts = [None, "", " "] + ["".join(rng.choice(parts) + (f"extra{rng.randrange(200)} " if rng.random() < 0.7 else "") for _ in range(rng.randint(1, 14))) for _ in range(150)] + ["".join(rng.choice(parts[:4]) + f"w{rng.randrange(900)} more{k} " for k in range(rng.randint(3, 12))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, ["List of x", "x", None][i % 3 if i % 5 == 0 else 1]) for i, t in enumerate(texts)], "id long, text string, title string")
    got = {r.id: r.good for r in Q.judge(df, "title", "text", rules).collect()}
    want = {i: plain_verdict(["List of x", "x", None][i % 3 if i % 5 == 0 else 1], t, rules) for i, t in enumerate(texts)}
    assert got == want and 20 < sum(want.values()) < len(want) - 20


def test_hot_keys_are_spread_and_lose_nothing(spark):
    from quarry.operators.lineage import spread_join

    left = spark.range(500).select((F.col("id") % 7 * (F.col("id") % 3 == 0).cast("int")).alias("k"), F.col("id").alias("a"))
    right = spark.range(30).select((F.col("id") % 7).alias("k"), F.col("id").alias("b"))
    same = lambda df: sorted(map(tuple, df.select("k", "a", "b").collect()))
    assert same(spread_join(left, right, "k", hot=50, parts=4)) == same(left.join(right, "k"))


def test_containing_finds_every_item(spark):
    from quarry.operators.retrieval import containing

    docs = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "two"), (11, "two th"), (12, "two"), (13, ""), (14, None)], "qid long, text string")
    for size in (1, 1 << 20):
        assert sorted(map(tuple, containing(docs, items, size).collect())) == [(10, 1), (10, 2), (11, 1), (12, 1), (12, 2)]


def test_required_rows_must_exist(spark):
    import pytest

    from quarry.operators.ltr import required

    known = spark.createDataFrame([(1, "a")], "k long, v string")
    assert required(spark.createDataFrame([(1,)], "k long"), known, "k").count() == 1
    with pytest.raises(Exception, match="no row for k 2"):
        required(spark.createDataFrame([(2,)], "k long"), known, "k").collect()


def test_pagerank_converges_to_the_power_iteration(spark):
    import numpy as np

    rng = random.Random(3)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(90)}
    edges = spark.createDataFrame([(a, b, float(1 + (a + b) % 3)) for a, b in pairs if a != b], "src long, dst long, weight double")
    nodes = spark.range(30)
    m = np.zeros((30, 30))
    for r in edges.collect():
        m[r.dst, r.src] += r.weight
    out = m.sum(0)
    p = np.full(30, 1 / 30)
    for _ in range(200):
        flow = m @ np.divide(p, out, out=np.zeros(30), where=out > 0)
        p = 0.85 * flow + (0.15 + 0.85 * p[out == 0].sum()) / 30
    got = {r.id: r.score for r in G.pagerank(nodes, edges, tolerance=1e-10).collect()}
    assert all(abs(got[k] - p[k]) < 1e-7 for k in range(30))


def test_crc_sample_and_answers_of_ranked_files(spark, tmp_path):
    import zlib

    df = spark.range(500).select(F.col("id").alias("doc_id"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in content.crc_sample(spark, str(tmp_path)).collect()} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 100 < 5}
    rows = spark.createDataFrame([(2, "q1", "d1", 0.5, 1.25), (0, "q1", "d2", 0.0, -3.0)], "label int, qid string, doc_id string, a double, b double")
    back = {r.doc_id: (r.label, r.qid, r.features) for r in L.parse_svmrank(L.format_svmrank(rows, ["a", "b"], 4)).collect()}
    assert back == {"d1": (2, "q1", [0.5, 1.25]), "d2": (0, "q1", [0.0, -3.0])}


def test_search_judges_on_other_queries(spark):
    df = spark.createDataFrame([(q, d, float(d % 2), d % 2) for q in range(20) for d in range(4)], "qid long, doc_id long, f double, label int")
    seen = []

    def fit(train, weight):
        seen.append({r.qid for r in train.select("qid").distinct().collect()})
        return weight

    found = L.search(df, {"weight": [-1.0, 1.0]}, fit, lambda w, rest: w * rest.count())
    assert found[0][0] == {"weight": 1.0} and found[0][1] > 0 and 0 < len(seen[0]) < 20


def test_word_boundaries_know_ascii_letters_alone(spark):
    """As in SQL: an accented letter or a mark after a word ends it."""
    from quarry.operators import quality as Q

    df = spark.createDataFrame([("the\u0308 x",), ("the\u00e9",), ("the end",), ("them",), ("a\u00e9the",), (None,)], "text string")
    got = [tuple(r) for r in df.select(Q.hits(F.col("text"), (r"the\b",)), Q.explanatory_density(F.col("text"), (r"\bthe\b",)) > 0, F.col("text").rlike(Q.ascii_bounds(r"\\b"))).collect()]
    assert got == [(1, True, False), (1, True, False), (1, True, False), (0, False, False), (1, True, False), (None, False, None)]


def test_runs_of_bm25_send_on_the_best_pairs_alone(spark):
    """Equal to ranking every pair, over copies, null texts and ids, several blocks of queries; few rows are shuffled."""
    from quarry.operators import retrieval as R

    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(6000)]
    texts = [(i, " ".join(words[(i % 230) * 20 : (i % 230) * 20 + rng.choice((20, 5))])) for i in range(700)] + [(900, None), (901, ""), (902, "zz?zz"), (None, "w1 w2")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=8))) for q in range(9)] + [(50, "nowhere"), (51, None), (52, "ZZ zz")], "qid long, text string")
    settings = {"a": (0.8, 1.0), "b": (2.0, 0.3)}
    got = {(r.variant, r.qid, r["rank"]): (r.doc_id, r.score) for r in R.bm25_runs(docs, asked, settings, 12, query_rows=4).collect()}
    every = R.bm25_settings(docs, asked, settings).where("doc_id is not null").collect()
    for v in settings:
        for q in range(60):
            best = sorted(((-round(r[v], 6), r.doc_id) for r in every if r.qid == q))[:12]
            assert [got.pop((v, q, k + 1)) for k in range(len(best))] == [(d, pytest.approx(-s, abs=1e-9)) for s, d in best]
    assert not got
    named = R.bm25_runs(docs.withColumn("doc_id", F.col("doc_id").cast("string")), asked.withColumn("qid", F.col("qid").cast("string")), {"a": (0.8, 1.0)}, 1).where("qid = '52'").collect()
    assert [(r.qid, r.doc_id, r["rank"]) for r in named] == [("52", "902", 1)]
    assert R.bm25_runs(docs.limit(0), asked, settings, 3).count() == 0 == R.bm25_runs(docs, asked.limit(0), settings, 3).count()


def test_a_run_of_bm25_does_not_shuffle_pairs(spark, monkeypatch):
    """The plan that ranks groups nothing by query and document."""
    from quarry.plans import ranking

    plans = []
    monkeypatch.setattr(ranking, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    ranking.variants(spark, "/root/testdata/sf0.001")
    assert "HashAggregate" not in plans[-1] and "WindowGroupLimit" in plans[-1]

import json

from pyspark.sql import functions as F

from quarry.operators import entities as N
from quarry.sources import readers as R
from quarry.sources import sinks as K
from quarry.streaming import incremental as I


def test_run_files_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("1", "d1", 1, 2.5), ("1", "d 2", 2, 1.5), ("2", "d3", 1, .5)], "qid string, doc_id string, rank int, score double")
    K.run_lines(run, "me").write.text(str(tmp_path / "run"))
    back = R.run(spark, str(tmp_path / "run"))
    assert sorted((r["qid"], r["doc_id"], r["rank"], r["score"]) for r in back.collect()) == [("1", "d1", 1, 2.5), ("2", "d3", 1, .5)]
    assert K.validate_run(spark.read.text(str(tmp_path / "run"))).first()["valid"]
    assert K.is_complete(spark, str(tmp_path / "run")) and not K.is_complete(spark, str(tmp_path))


def test_query_files_skip_what_is_malformed(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"query_id": 7, "query": " a "}\n\nnot json\n{"query_id": "8"}\n')
    assert [tuple(r) for r in R.queries(spark, str(p)).collect()] == [("7", "a")]
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"query_id": "1", "query": "x"}, {"query": "y"}]))
    assert R.queries(spark, str(q)).count() == 1


def test_pageviews_and_id_map(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("en.wikipedia A 1 x 5\nen.wikipedia.m B 2 x 5\nen.wikipedia - 3 x 1\nen.wikipedia C null x 1\nen.wikipedia D 4\n")
    assert [tuple(r) for r in R.pageviews(spark, str(p)).collect()] == [("1", "A", 5)]
    m = tmp_path / "m.json"
    m.write_text('{"1": "Q1", "x": "Q2"}')
    assert [tuple(r) for r in R.id_map(spark, str(m)).collect()] == [(1, "Q1")]


def test_answers_in_many_shapes(spark):
    shapes = ['["A", "B"]', '[{"title": "A"}, {"name": "B"}]', '{"title": "A"}', '{"A": 2.0, "B": 1.0}', '{"candidates": ["A", "B"]}', 'error: ```json\n["A", "B"]\n``` end', "nothing"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, s string")
    got = dict(df.select("i", N.answer_titles(F.col("s"))).collect())
    assert got == {0: ["A", "B"], 1: ["A", "B"], 2: ["A"], 3: ["A", "B"], 4: ["A", "B"], 5: ["A", "B"], 6: []}


def test_each_file_counts_once(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    batch = lambda rows: spark.createDataFrame(rows, "k int, v long").coalesce(1).write.mode("append").parquet(src)
    batch([(1, 5), (2, 1)])
    I.running_totals(spark, src, "k int, v long", "k", "v", sink, ck)
    batch([(1, 7)])
    I.running_totals(spark, src, "k int, v long", "k", "v", sink, ck)
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [(1, 12, 2), (2, 1, 1)]
    out = str(tmp_path / "out")
    I.each_once(spark, src, "k int, v long", "k", lambda df: df, out, str(tmp_path / "ck2"))
    I.each_once(spark, src, "k int, v long", "k", lambda df: df, out, str(tmp_path / "ck3"))
    assert spark.read.parquet(out).count() == 2

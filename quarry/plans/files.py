"""Readers and writers on real files: every query writes fixture rows to a scratch folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.lineage import scratch
from quarry.plans import tables as t
from quarry.sources import catalog, readers, schemas, sinks


def _text(df, path, **options):
    df.select("value").write.options(**options).text(path)
    return path


def a_run(spark, d):
    """Line items as a run: orders are queries, parts documents."""
    li = t.table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").alias("score"))


def glob_scan(spark, d):
    path = scratch(spark)
    t.table(spark, d, "documents").select("doc_id", "lang", (F.col("doc_id") % 4).alias("shard")).write.partitionBy("shard").parquet(path)
    return readers.glob(spark, f"{path}/shard=[0-2]/*.parquet", "doc_id long, lang string")


def csv_header(spark, d):
    path = scratch(spark)
    t.table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.csv(path, header=True)
    df = readers.csv_table(spark, path, "p_partkey long, p_name string, p_size int", required=("p_partkey",))
    df.createOrReplaceTempView("imported_parts")
    return spark.sql("SELECT p_partkey, p_name, p_size FROM imported_parts")


def run_positional(spark, d):
    path = _text(sinks.run_lines(a_run(spark, d), "r", "\t", 0, None), scratch(spark))
    return readers.csv_table(spark, path, schemas.RUN, "\t", header=False).select("qid", "doc_id", "rank", "score")


def run_whitespace(spark, d):
    lines = sinks.run_lines(a_run(spark, d), "r", " \t ").union(spark.createDataFrame([("too few fields",), ("",), ("1 Q0 2 3 4 r seven",)], "value string"))
    return readers.run(spark, _text(lines, scratch(spark))).select("qid", "doc_id", "rank", "score", "run_name")


def run_lines_tab_zero(spark, d):
    return sinks.run_lines(a_run(spark, d), "r", "\t", 0, None)


def run_lines_tab_one(spark, d):
    return sinks.run_lines(a_run(spark, d), "r", "\t", 1, 4)


def run_lines_raw(spark, d):
    return sinks.run_lines(a_run(spark, d), "r", " ", 1, None)


def run_lines_valid(spark, d):
    bad = a_run(spark, d).select(
        F.when(F.col("qid") % 97 == 0, F.concat("qid", F.lit(" x"))).otherwise(F.col("qid").cast("string")).alias("qid"),
        F.when(F.col("doc_id") % 89 == 0, None).when(F.col("doc_id") % 83 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("doc_id"), "rank", "score")
    return sinks.run_lines(bad, "r")


def qrels_read(spark, d):
    lines = a_run(spark, d).select(F.concat_ws(" ", "qid", F.lit("0"), "doc_id", (F.col("rank") % 3 - 1).cast("string")).alias("value"))
    lines = lines.union(spark.createDataFrame([("1 0 2",), ("1 0 2 x",)], "value string"))
    return readers.qrels(spark, _text(lines, scratch(spark)), positive=True).select("qid", "doc_id", "rel")


def query_files(spark, d):
    q = t.queries(spark, d).select(F.col("qid").cast("string").alias("query_id"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("query"))
    rows, lines, array = q.select(F.to_json(F.struct("query_id", "query")).alias("value")), scratch(spark, "q.jsonl"), scratch(spark, "q.json")
    _text(rows.union(spark.createDataFrame([("",), ("{broken",), ('{"query_id": "x"}',), ('{"query": "no id"}',)], "value string")), lines)
    _text(q.agg(F.to_json(F.collect_list(F.struct("query_id", "query"))).alias("value")), array)
    one, two = readers.queries(spark, lines), readers.queries(spark, array)
    return one.withColumn("kind", F.lit("lines")).unionByName(two.withColumn("kind", F.lit("array")))


def id_map_file(spark, d):
    n = t.table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))).alias("value"))
    return readers.id_map(spark, _text(n, scratch(spark)))


def corpus_shards(spark, d):
    """Compressed JSON lines to Parquet files of at most 300 rows, summed up by file."""
    lines, out = scratch(spark), scratch(spark)
    docs = t.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("u").alias("url"), "lang", "text")
    docs.select(F.col("id"), "url", F.col("lang").alias("title"), "text").write.json(lines, compression="gzip")
    sinks.write_table(readers.json_lines(spark, lines, schemas.CORPUS), out, rows_per_file=300)
    per = readers.per_file(readers.glob(spark, out, schemas.CORPUS), "file").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return per.agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), (F.max("n") <= 300).alias("bounded"))


def pageview_file(spark, d):
    e = t.table(spark, d, "events")
    domain = F.when(F.col("user_id") % 3 == 0, "en.wikipedia.x").when(F.col("user_id") % 3 == 1, "de.wikipedia").otherwise("en.wikipedia")
    title = F.when(F.col("event_type") == "view", "-").otherwise(F.col("event_type"))
    lines = e.select(F.concat_ws(" ", domain, title, F.col("user_id").cast("string"), F.lit("desktop"), (F.col("event_id") % 100).cast("string"), F.lit("A1")).alias("value"))
    path = _text(lines.union(spark.createDataFrame([("en.wikipedia short 1",)], "value string")), scratch(spark), compression="bzip2")
    return readers.pageviews(spark, path).groupBy("page_id").agg(F.sum("views").alias("views"))


def labels_without_nulls(spark, d):
    labels = t.table(spark, d, "labels")
    return readers.no_nulls(t.table(spark, d, "documents").select("doc_id").join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left"), "doc_id")


def score_file(spark, d):
    lines = a_run(spark, d).where("rank = 1").select(F.concat_ws("\t", "doc_id", "qid", "score").alias("value"))
    return readers.score_triples(spark, _text(lines.union(spark.createDataFrame([("1\t2",), ("1\t2\tx",)], "value string")), scratch(spark)))


def catalog_splits(spark, d):
    known = catalog.Catalog(d, {"dev": catalog.Split("documents.parquet", "benchmark.parquet", "labels.parquet"), "test": catalog.Split("documents.parquet", "benchmark.parquet")})
    out = None
    for preset in ("sample", "test"):
        p = catalog.PRESETS[preset]
        for name in known.register(spark, p.split):
            one = spark.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(preset).alias("preset"), F.lit(name).alias("view"), F.lit(p.depth).alias("depth"), "n")
            out = one if out is None else out.unionByName(one)
    return out


def index_matches_ids(spark, d):
    e = t.table(spark, d, "embeddings")
    return e.agg(F.count("embedding").alias("vectors"), F.countDistinct("vec_id").alias("ids")).select("vectors", "ids", (F.col("vectors") == F.col("ids")).alias("same"))


def csv_per_topic(spark, d):
    folder = scratch(spark)
    for r in range(5):
        t.table(spark, d, "nation").where(F.col("n_regionkey") == r).select("n_nationkey", "n_name").write.csv(f"{folder}/region{r}.csv", header=True)
    df = readers.csv_table(spark, f"{folder}/*.csv", "n_nationkey int, n_name string")
    return readers.per_file(df, pattern=r"([^/]+)\.csv/")


def tsv_queries(spark, d):
    path = scratch(spark)
    t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("query")).write.csv(path, header=True, sep="\t")
    return readers.csv_table(spark, path, schemas.QUERY, "\t", required=("query_id", "query"))


def numeric_ranges(spark, d):
    return readers.ranges(t.table(spark, d, "part"), skip=("p_partkey",))


def first_rows(spark, d):
    """The feature is the limit; the rows are counted, as which ones come first is open."""
    return readers.first_rows(t.table(spark, d, "orders"), 7).agg(F.count(F.lit(1)).alias("n"))


def table_overwritten(spark, d):
    path, part = scratch(spark), t.table(spark, d, "part").select("p_partkey")
    before = sinks.is_complete(spark, path)
    sinks.write_table(part, path, files=2)
    sinks.write_table(part, path, files=3)
    back = readers.per_file(readers.glob(spark, path, "p_partkey long"), "file")
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files")).select("n", "files", F.lit(before).alias("before"), F.lit(sinks.is_complete(spark, path)).alias("complete"))


def run_json(spark, d):
    return sinks.run_to_json(a_run(spark, d))


def run_statistics(spark, d):
    out = sinks.run_statistics(a_run(spark, d))
    return out.select("entries", "queries", F.round("avg", 4).alias("avg"), "min", "max")


def qrel_lines(spark, d):
    """Lines to write, and one row that counts the pairs without an id."""
    pairs = a_run(spark, d).select("qid", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("doc_id")).alias("doc_id"))
    return sinks.qrel_lines(pairs).union(pairs.agg(F.concat(F.lit("skipped "), F.count_if(F.col("doc_id").isNull()))))


def file_per_key(spark, d):
    path = scratch(spark)
    sinks.write_table(t.table(spark, d, "part").select("p_partkey", "p_brand"), path, by=("p_brand",))
    return spark.read.schema("p_partkey long, p_brand string").parquet(path).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def demultiplexed(spark, d):
    run = a_run(spark, d).withColumn("qid", F.col("qid").cast("string"))
    return sinks.demultiplex(run, {"1": "train", "2": "dev", "3": "test"}).where("qid <> ''").select("part", "qid", "doc_id", "rank")


def negatives_file(spark, d):
    return sinks.negatives_json(a_run(spark, d))


def upserted(spark, d):
    e = t.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return sinks.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


def projected_csv(spark, d):
    """Chunks of a table read together and written as one file of two columns."""
    chunks, out = scratch(spark), scratch(spark)
    sinks.write_table(t.table(spark, d, "customer"), chunks, rows_per_file=400)
    spark.read.parquet(chunks).select("c_custkey", "c_name").coalesce(1).write.csv(out, header=True)
    return readers.csv_table(spark, out, "c_custkey long, c_name string")


def pending_rows(spark, d):
    from quarry.streaming.incremental import pending

    labels = t.table(spark, d, "labels")
    return pending(t.table(spark, d, "documents").select("doc_id", "lang"), labels, "doc_id")


def streamed_totals(spark, d):
    """The totals that a file stream leaves in its sink after two runs over the same folder."""
    from quarry.streaming.incremental import running_totals

    source, sink, state = (scratch(spark) for _ in range(3))
    e = t.table(spark, d, "events").select("user_id", (F.col("event_id") % 50).alias("views"))
    for half in (0, 1):
        e.where(F.col("user_id") % 2 == half).write.mode("append").parquet(source)
        running_totals(spark, source, "user_id long, views long", "user_id", "views", sink, state)
    return spark.read.parquet(sink).select("user_id", "total", "n")


def applied_once(spark, d):
    """A job over keys that arrive twice: every key is worked on once."""
    from quarry.streaming.incremental import each_once

    source, sink, state = (scratch(spark) for _ in range(3))
    docs = t.table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    for share in (2, 1):
        docs.where(F.col("doc_id") % share == 0).write.mode("append").parquet(source)
        each_once(spark, source, "doc_id long, n int", "doc_id", lambda df: df.withColumn("twice", F.col("n") * 2), sink, state)
    return spark.read.parquet(sink).select("doc_id", "twice")


_S = "CAST(l_quantity AS VARCHAR)"
_LINE = "SELECT concat_ws({sep}, l_orderkey, 'Q0', l_partkey, l_linenumber{by}, {score}, 'r') AS value FROM lineitem"

QUERIES = {
    "glob_scan": (glob_scan, "SELECT doc_id, lang FROM documents WHERE doc_id % 4 < 3"),
    "csv_header": (csv_header, "SELECT p_partkey, p_name, p_size FROM part"),
    "run_positional": (run_positional, "SELECT CAST(l_orderkey AS VARCHAR) AS qid, CAST(l_partkey AS VARCHAR) AS doc_id, CAST(l_linenumber - 1 AS INTEGER) AS rank, l_quantity AS score FROM lineitem"),
    "run_whitespace": (run_whitespace, "SELECT CAST(l_orderkey AS VARCHAR) AS qid, CAST(l_partkey AS VARCHAR) AS doc_id, l_linenumber AS rank, l_quantity AS score, 'r' AS run_name FROM lineitem"),
    "run_lines_tab_zero": (run_lines_tab_zero, _LINE.format(sep="chr(9)", by=" - 1", score=_S)),
    "run_lines_tab_one": (run_lines_tab_one, _LINE.format(sep="chr(9)", by="", score="printf('%.4f', l_quantity)")),
    "run_lines_raw": (run_lines_raw, _LINE.format(sep="' '", by="", score=_S)),
    "run_lines_valid": (run_lines_valid, _LINE.format(sep="' '", by="", score="printf('%.6f', l_quantity)") + " WHERE l_orderkey % 97 <> 0 AND l_partkey % 89 <> 0 AND l_partkey % 83 <> 0"),
    "qrels_read": (qrels_read, "SELECT CAST(l_orderkey AS VARCHAR) AS qid, CAST(l_partkey AS VARCHAR) AS doc_id, CAST(l_linenumber % 3 - 1 AS INTEGER) AS rel FROM lineitem WHERE l_linenumber % 3 = 2"),
    "query_files": (query_files, "SELECT kind, CAST(item_id AS VARCHAR) AS query_id, trim(text) AS query FROM benchmark CROSS JOIN (SELECT unnest(['lines', 'array']) AS kind)"),
    "id_map_file": (id_map_file, "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS entity FROM nation"),
    "corpus_shards": (corpus_shards, "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, true AS bounded FROM documents"),
    "pageview_file": (pageview_file, "SELECT CAST(user_id AS VARCHAR) AS page_id, CAST(sum(event_id % 100) AS BIGINT) AS views FROM events WHERE user_id % 3 = 2 AND event_type <> 'view' GROUP BY user_id"),
    "labels_without_nulls": (labels_without_nulls, "SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)"),
    "score_file": (score_file, "SELECT CAST(l_partkey AS VARCHAR) AS doc_id, CAST(l_orderkey AS VARCHAR) AS qid, l_quantity AS score FROM lineitem WHERE l_linenumber = 1"),
    "catalog_splits": (catalog_splits, """SELECT preset, v AS "view", CAST(depth AS INTEGER) AS depth, n FROM (SELECT 'sample' AS preset, 'dev_documents' AS v, 100 AS depth, count(*) AS n FROM documents UNION ALL SELECT 'sample', 'dev_queries', 100, count(*) FROM benchmark
UNION ALL SELECT 'sample', 'dev_judgements', 100, count(*) FROM labels UNION ALL SELECT 'test', 'test_documents', 1000, count(*) FROM documents UNION ALL SELECT 'test', 'test_queries', 1000, count(*) FROM benchmark)"""),
    "index_matches_ids": (index_matches_ids, "SELECT count(embedding) AS vectors, count(DISTINCT vec_id) AS ids, count(embedding) = count(DISTINCT vec_id) AS same FROM embeddings"),
    "csv_per_topic": (csv_per_topic, "SELECT n_nationkey, n_name, 'region' || n_regionkey AS topic FROM nation"),
    "tsv_queries": (tsv_queries, "SELECT CAST(s_suppkey AS VARCHAR) AS query_id, s_name AS query FROM supplier"),
    "numeric_ranges": (numeric_ranges, "SELECT min(p_size) AS min_p_size, max(p_size) AS max_p_size, min(p_retailprice) AS min_p_retailprice, max(p_retailprice) AS max_p_retailprice FROM part"),
    "first_rows": (first_rows, "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 7)"),
    "table_overwritten": (table_overwritten, "SELECT count(*) AS n, CAST(3 AS BIGINT) AS files, false AS before, true AS complete FROM part"),
    "run_json": (run_json, f"""SELECT '{{"qid":' || l_orderkey || ',"doc_id":' || l_partkey || ',"rank":' || l_linenumber || ',"score":' || {_S} || '}}' AS value FROM lineitem"""),
    "run_statistics": (run_statistics, "WITH p AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT CAST(sum(n) AS BIGINT) AS entries, count(*) AS queries, round(avg(n), 4) AS avg, min(n) AS min, max(n) AS max FROM p"),
    "qrel_lines": (qrel_lines, "SELECT l_orderkey || ' 0 ' || l_partkey || ' 1' AS value FROM lineitem WHERE l_partkey % 5 <> 0 UNION ALL SELECT 'skipped ' || count(*) FROM lineitem WHERE l_partkey % 5 = 0"),
    "file_per_key": (file_per_key, "SELECT p_brand, count(*) AS n FROM part GROUP BY 1"),
    "demultiplexed": (demultiplexed, "SELECT CASE q[1] WHEN '1' THEN 'train' WHEN '2' THEN 'dev' ELSE 'test' END AS part, q[2:] AS qid, l_partkey AS doc_id, l_linenumber AS rank FROM (SELECT *, CAST(l_orderkey AS VARCHAR) AS q FROM lineitem) WHERE q[1] IN ('1', '2', '3') AND length(q) > 1"),
    "negatives_file": (negatives_file, """SELECT '{"' || l_orderkey || '":["' || string_agg(CAST(l_partkey AS VARCHAR), '","' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) || '"]}' AS value FROM lineitem GROUP BY l_orderkey"""),
    "upserted": (upserted, "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
    "projected_csv": (projected_csv, "SELECT c_custkey, c_name FROM customer"),
    "pending_rows": (pending_rows, "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)"),
    "streamed_totals": (streamed_totals, "SELECT user_id, CAST(sum(event_id % 50) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY user_id"),
    "applied_once": (applied_once, "SELECT doc_id, CAST(length(text) * 2 AS INTEGER) AS twice FROM documents"),
}

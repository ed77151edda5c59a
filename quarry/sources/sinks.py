"""Writers for tables and run files, their validation and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a committed write left its success marker."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def write_table(df: DataFrame, path: str, files: int | None = None, compression: str = "zstd", by: tuple[str, ...] = (), rows_per_file: int | None = None) -> None:
    """Parquet, overwritten; ``by`` gives one folder per key."""
    writer = (df.repartition(files) if files else df).write.mode("overwrite").option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def valid_id(c: Column) -> Column:
    return c.isNotNull() & c.rlike(r"^[^ \t\n\r]+$")


def run_lines(run: DataFrame, name: str, sep: str = " ", base: int = 1, digits: int | None = 6) -> DataFrame:
    """(value): run lines by (qid, rank). A bad qid drops its query, a bad doc_id its row. Ranks come 1-based."""
    qid, doc = F.col("qid").cast("string"), F.col("doc_id").cast("string")
    score = F.col("score").cast("string") if digits is None else F.format_string(f"%.{digits}f", F.col("score").cast("double"))
    line = F.concat_ws(sep, qid, F.lit("Q0"), doc, (F.col("rank") - 1 + base).cast("string"), score, F.lit(name))
    return run.where(valid_id(qid) & valid_id(doc)).repartitionByRange(qid, F.col("rank")).sortWithinPartitions(qid, "rank").select(line.alias("value"))


def qrel_lines(pairs: DataFrame) -> DataFrame:
    return pairs.where("qid is not null and doc_id is not null").select(F.concat_ws(" ", F.col("qid"), F.lit("0"), F.col("doc_id"), F.lit("1")).alias("value"))


def validate_run(lines: DataFrame) -> DataFrame:
    """(lines, bad_fields, bad_literal, bad_rank, bad_score, queries, valid)."""
    f = F.split(F.trim("value"), r"\s+")
    six = F.size(f) == 6
    checks = lines.where(F.trim("value") != "").select(
        six.alias("six"), (six & (F.get(f, F.lit(1)) == "Q0")).alias("literal"), F.coalesce(six & (F.get(f, F.lit(3)).try_cast("int") > 0), F.lit(False)).alias("rank"),
        (six & F.get(f, F.lit(4)).try_cast("double").isNotNull()).alias("score"), F.get(f, F.lit(0)).alias("qid"))
    out = checks.agg(F.count(F.lit(1)).alias("lines"), *[F.count_if(~F.col(c)).alias(n) for c, n in (("six", "bad_fields"), ("literal", "bad_literal"), ("rank", "bad_rank"), ("score", "bad_score"))], F.countDistinct("qid").alias("queries"))
    return out.withColumn("valid", (F.col("lines") > 0) & (F.col("bad_fields") + F.col("bad_literal") + F.col("bad_rank") + F.col("bad_score") == 0))


def run_statistics(run: DataFrame) -> DataFrame:
    per = run.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("queries"), F.avg("n").alias("avg"), F.min("n").alias("min"), F.max("n").alias("max"))


def run_to_json(run: DataFrame) -> DataFrame:
    return run.select(F.to_json(F.struct("qid", "doc_id", "rank", "score")).alias("value"))


def demultiplex(run: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Adds ``part`` by the first character of qid, which goes; rows with other prefixes go."""
    part = None
    for prefix, name in prefixes.items():
        part = F.when(F.substring("qid", 1, 1) == prefix, name) if part is None else part.when(F.substring("qid", 1, 1) == prefix, name)
    return run.withColumn("part", part).where("part is not null").withColumn("qid", F.expr("substring(qid, 2)"))


def negatives_json(run: DataFrame) -> DataFrame:
    """One JSON object per query: {qid: [documents by rank]}."""
    docs = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))), lambda s: s["d"])
    return run.groupBy("qid").agg(docs.alias("docs")).select(F.to_json(F.create_map(F.col("qid").cast("string"), "docs")).alias("value"))


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key."""
    both = table.unionByName(changes, allowMissingColumns=True)
    newest = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("row"))
    return newest.select("row.*")

"""Readers: every one returns a lazy DataFrame with an explicit schema; malformed rows are filtered, not fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import schemas


def csv_table(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, required: tuple[str, ...] = ()) -> DataFrame:
    """Header CSV or TSV; ``required`` columns must be in the schema."""
    df = spark.read.schema(schema).csv(path, header=header, sep=sep, mode="PERMISSIVE", escape='"', multiLine=False)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Lines cut at white space; lines with fewer than ``least`` fields go."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts.alias("f")).where(F.size("f") >= least)


def run(spark: SparkSession, path: str) -> DataFrame:
    """Six-field run lines, any white space."""
    f = F.col("f")
    return fields(spark, path, 6).where(F.size(f) == 6).select(
        f[0].alias("qid"), f[1].alias("q0"), f[2].alias("doc_id"), f[3].try_cast("int").alias("rank"), f[4].try_cast("double").alias("score"), f[5].alias("run_name"))


def qrels(spark: SparkSession, path: str, positive: bool = False) -> DataFrame:
    f = F.col("f")
    out = fields(spark, path, 4).select(f[0].alias("qid"), f[1].alias("iter"), f[2].alias("doc_id"), f[3].try_cast("int").alias("rel")).where("rel is not null")
    return out.where("rel > 0") if positive else out


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or compressed; malformed ones go."""
    bad = "_corrupt"
    df = spark.read.schema(f"{schema}, {bad} string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    return df.where(F.col(bad).isNull()).drop(bad)


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Query files by extension: a JSON array (.json) or JSON lines; rows without an id or text go; text is trimmed."""
    if path.endswith(".json"):
        df = spark.read.schema(schemas.QUERY).json(path, multiLine=True)
    else:
        df = json_lines(spark, path, schemas.QUERY)
    return df.select("query_id", F.trim("query").alias("query")).where("query_id is not null and query <> ''")


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {page id: entity id} as rows."""
    m = F.from_json("value", "map<string,string>")
    return spark.read.text(path, wholetext=True).select(F.explode(m).alias("k", "entity")).select(F.col("k").try_cast("long").alias("id"), "entity").where("id is not null")


def pageviews(spark: SparkSession, path: str, domain: str = "en.wikipedia") -> DataFrame:
    """Space-separated hourly or monthly view files: (page_id, title, views) of one domain."""
    f = F.col("f")
    rows = spark.read.text(path).where(F.col("value").startswith(domain)).select(F.split("value", " ").alias("f")).where((F.size("f") >= 5) & (f[0] == domain))
    named = lambda c: c.isNotNull() & ~c.isin("null", "-", "")
    return rows.where(named(f[1]) & named(f[2])).select(f[2].alias("page_id"), f[1].alias("title"), f[4].try_cast("long").alias("views")).where("views is not null")


def per_file(df: DataFrame, as_: str = "topic", pattern: str = r"([^/]+?)(?:\.[^./]+)?$") -> DataFrame:
    """The file's base name, or the group of ``pattern`` in its path, as a column: one file per topic."""
    return df.withColumn(as_, F.regexp_extract(F.input_file_name(), pattern, 1))


def glob(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All Parquet files that a path pattern with wildcards and character classes names."""
    return spark.read.schema(schema).parquet(pattern)


def no_nulls(df: DataFrame, key: str) -> DataFrame:
    """Numbers without a value become 0; the key becomes text."""
    return df.fillna(0).withColumn(key, F.col(key).cast("string"))


def score_triples(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated doc, qid, score; other lines go."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) == 3).select(f[0].alias("doc_id"), f[1].alias("qid"), f[2].try_cast("double").alias("score")).where("score is not null")


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def ranges(df: DataFrame, skip: tuple[str, ...] = ("id",)) -> DataFrame:
    """Least and greatest value of every numeric column, in one pass."""
    numeric = [c for c, k in df.dtypes if k in ("int", "bigint", "float", "double", "smallint") and c not in skip]
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("min", F.min), ("max", F.max))])

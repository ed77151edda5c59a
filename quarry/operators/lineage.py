"""Cutting the lineage of iterative plans, and scratch tables, in the shared folder that the session names."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether shuffle files go at the end of a query.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local master that names none, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/quarry/{uuid.uuid4().hex}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are made and run within go as soon as they are done, not when the driver happens to
    collect its garbage."""
    before = spark.conf.get(_CLEANED, None)
    try:
        spark.conf.set(_CLEANED, "true")
        yield
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs no recomputation of what lies before this point; the files go when the session ends.
    """
    path = scratch(df.sparkSession)
    with shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that ``materialise`` has made and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``rows`` narrow rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: int = 100_000, parts: int = 64, heavy: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key`` where rows of a key with over ``hot`` rows on the left are dealt to ``parts`` tasks, each
    with its own copy of the key's right rows. There are at most rows / ``hot`` such keys; ``heavy`` names
    them where they are known."""
    if heavy is None:
        heavy = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot)
    heavy = heavy.select(key, F.lit(True).alias("_hot"))
    if heavy.isEmpty():
        return left.join(right, key)
    heavy = broadcast_if_small(heavy)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(parts))).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    one = left.join(heavy, key, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    two = right.join(heavy, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return one.join(two, [key, "_salt"]).drop("_salt")

"""Resumable and streaming processing: offsets and state live in the checkpoint folder of each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.lineage import cut
from quarry.sources.sinks import is_complete


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key the sink does not have yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def running_totals(spark: SparkSession, source: str, schema: str, key: str, value: str, sink: str, checkpoint: str) -> None:
    """Sum ``value`` per key over all files seen so far; each file counts once, across restarts."""
    totals = spark.readStream.schema(schema).parquet(source).groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    write = lambda df, _: df.write.mode("overwrite").parquet(sink)
    totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_once(spark: SparkSession, source: str, schema: str, key: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Apply ``work`` to rows whose key is not in the sink yet and append the results; a batch that runs again
    after a failure adds nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        # The first batch finds no sink; later ones read its key column alone.
        fresh = pending(df, df.sparkSession.read.parquet(sink), key) if is_complete(df.sparkSession, sink) else df
        # Of rows with one key the least stays, so a batch that runs again does the same work.
        first = fresh.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("_row")) if len(df.columns) > 1 else fresh.distinct()
        rows = first.select(key, "_row.*").select(*df.columns) if len(df.columns) > 1 else first
        work(rows).write.mode("append").parquet(sink)

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def split_failures(df: DataFrame, sink: str, dead: str, batch: int | str) -> None:
    """Rows without an ``error`` are appended to ``sink``, the others written to ``dead`` under their batch: a batch that
    runs again puts its failures in the same place. ``df`` is computed once."""
    rows = cut(df)
    rows.where("error is null").drop("error").write.mode("append").parquet(sink)
    rows.where("error is not null").write.mode("overwrite").parquet(f"{dead}/batch={batch}")


def each_once_or_dead(spark: SparkSession, source: str, schema: str, key: str, work: Callable[[DataFrame], DataFrame], sink: str, dead: str, checkpoint: str) -> None:
    """As ``each_once``, for a ``work`` that returns its rows with ``key`` and ``error``: what fails goes to ``dead`` and
    stops nothing else."""

    def batch(df: DataFrame, number: int) -> None:
        fresh = pending(df, df.sparkSession.read.parquet(sink), key) if is_complete(df.sparkSession, sink) else df
        split_failures(work(fresh.dropDuplicates([key])), sink, dead, number)

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def retry_dead(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], sink: str, dead: str, name: str = "retry") -> DataFrame:
    """Runs the failed keys again, and those alone: ``rows`` whose key is in ``dead`` but not in ``sink``. Returns the keys
    that fail still; ``name`` tells one retry from another."""
    spark = rows.sparkSession
    failed = spark.read.parquet(dead).select(key).distinct()
    again = cut(pending(rows.dropDuplicates([key]).join(failed, key, "left_semi"), spark.read.parquet(sink), key))
    split_failures(work(again), sink, dead, name)
    return pending(failed, spark.read.parquet(sink), key)


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: tumbling event-time windows with a watermark; works on streams and tables alike."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")

"""Failures as rows: one bad key stops nobody, and a retry runs it alone."""

from pyspark.sql import functions as F

from quarry.streaming import incremental


def test_failures_go_aside_and_are_retried_alone(spark, tmp_path):
    source, sink, dead, checkpoint = (str(tmp_path / x) for x in ("in", "sink", "dead", "checkpoint"))
    rows = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    rows.where("k < 12").write.parquet(source)
    seen = spark.sparkContext.accumulator(0)

    def work(bad):
        def apply(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame.assign(error=["no answer" if k in bad else None for k in frame["k"]])

        return lambda df: df.mapInPandas(apply, "k long, v long, error string")

    run = lambda bad: incremental.each_once_or_dead(spark, source, "k long, v long", "k", work(bad), sink, dead, checkpoint)
    run({3, 15})
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == [k for k in range(12) if k != 3] and seen.value == 12
    rows.where("k >= 12").write.mode("append").parquet(source)
    run({3, 15})
    assert sorted(r.k for r in spark.read.parquet(dead).collect()) == [3, 15] and seen.value == 20
    left = incremental.retry_dead(spark.read.parquet(source), "k", work({15}), sink, dead)
    assert [r.k for r in left.collect()] == [15] and seen.value == 22
    assert not incremental.retry_dead(spark.read.parquet(source), "k", work(set()), sink, dead, "again").collect()
    assert sorted((r.k, r.v) for r in spark.read.parquet(sink).collect()) == [(k, 10 * k) for k in range(20)]

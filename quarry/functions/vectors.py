"""Column functions over dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column, guard: str = "replace", epsilon: float = 1e-12) -> Column:
    """L2 normalisation. Zero vectors: ``none`` gives NULLs, ``epsilon`` adds to the norm, ``replace`` divides by 1."""
    length = norm(v)
    by = {"none": length, "epsilon": length + epsilon, "replace": F.when(length == 0, 1.0).otherwise(length)}[guard]
    # The length is an element of an array, so that it is worked out once for a vector and not for each entry.
    return F.flatten(F.transform(F.array(by), lambda n: F.transform(v, lambda x: F.try_divide(x.cast("double"), n))))


def mean_pool(df, key: str, vector: str):
    """Mean vector per key, from position averages: no vector is gathered into a list of vectors."""
    parts = df.select(key, F.posexplode(vector).alias("pos", "x"))
    sums = parts.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vector))


def wide_to_array(df, prefix: str, vector: str):
    """Columns ``prefix0``, ``prefix1`` ... as one array."""
    cols = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix):]))
    return df.withColumn(vector, F.array(*cols)).drop(*cols)


def array_to_wide(df, vector: str, prefix: str, size: int):
    return df.select(*[c for c in df.columns if c != vector], *[F.col(vector)[i].alias(f"{prefix}{i}") for i in range(size)])

"""Statistics: profiles, the three kinds of quantiles, regression, correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation, extremes and linearly interpolated percentiles, in one pass over ``value``."""
    points = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}
    cols = [F.percentile(value, p).alias(n) for n, p in points.items()]
    out = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), *cols)
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def truncated_percentiles(df: DataFrame, value: str, points: list[int]) -> DataFrame:
    """sorted[int(p / 100 * n)], clamped: found by the running count of values, not by ranking rows one by one."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranged = counts.withColumn("upto", upto)
    n = counts.agg(F.sum("c").alias("n"))
    wanted = n.select(F.explode(F.array(*[F.lit(p) for p in points])).alias("p"), F.least(F.floor(F.col("p") / 100 * F.col("n")), F.col("n") - 1).alias("at"))
    hit = ranged.join(F.broadcast(wanted), (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
    return hit.select("p", F.col(value).alias("value"))


def approximate_quantiles(df: DataFrame, value: str, points: list[float], accuracy: int = 100) -> DataFrame:
    return df.agg(F.percentile_approx(value, points, accuracy).alias("q")).select(F.posexplode("q").alias("k", "value"))


def histogram(df: DataFrame, value: str, edges: list[int]) -> DataFrame:
    """Counts and percentages of [edge, next edge), the last one open."""
    bucket = F.lit(len(edges) - 1)
    for k in range(len(edges) - 2, -1, -1):
        bucket = F.when(F.col(value) < edges[k + 1], k).otherwise(bucket)
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("bucket", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def regression(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    return df.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def kendall_tau_b(df: DataFrame, x: str, y: str, ranges: int = 256) -> DataFrame:
    """tau with tie correction, for vectors of any length, from counts per distinct (x, y) and no pairs.

    Two ranks of y first differ in one bit: there one row is in the left and the other in the right half of a
    block of ranks. So concordant pairs are, for every bit and right row, the left rows of its block with a
    smaller x: cumulative counts within ``ranges`` ranges of x, on top of the totals of the ranges before.
    Ranges are cut at approximate quantiles, so no task needs all rows; the driver gets their edges.
    """
    counts = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c"))

    def unequal(v: str) -> DataFrame:
        """The number of pairs that differ in ``v``."""
        n = counts.where(F.col(v).isNotNull()).groupBy(v).agg(F.sum("c").cast("double").alias("k"))
        return n.agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias(f"n{v}"))

    points = [k / ranges for k in range(1, ranges)]
    both = counts.where("x is not null and y is not null")
    edges = both.agg(F.percentile_approx("x", points).alias("x"), F.percentile_approx("y", points).alias("y")).first()

    def range_of(v: str):
        return F.size(F.filter(F.array(*map(F.lit, sorted(set(edges[v] or [])))), lambda e: e < F.col(v)))

    ys = both.select("y").distinct().withColumn("part", range_of("y"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ys.groupBy("part").agg(F.count(F.lit(1)).alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("below"), F.sum("k").over(Window.partitionBy()).alias("all"))
    ranks = ys.join(F.broadcast(sizes), "part").select("y", (F.col("below") + F.row_number().over(Window.partitionBy("part").orderBy("y")) - 1).alias("r"), F.length(F.bin(F.col("all") - 1)).alias("bits"))
    bits = both.join(ranks, "y").select("x", "c", "r", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("bit"))
    half, block = F.call_function("shiftright", F.col("r"), F.col("bit")) % 2, F.call_function("shiftright", F.col("r"), F.col("bit") + 1)
    halves = bits.groupBy("bit", block.alias("block"), "x").agg(F.sum(F.when(half == 0, F.col("c")).otherwise(0)).alias("left"), F.sum(F.when(half == 1, F.col("c")).otherwise(0)).alias("right"))
    ranged = halves.withColumn("part", range_of("x"))
    of_block = Window.partitionBy("bit", "block")
    totals = ranged.groupBy("bit", "block", "part").agg(F.sum("left").alias("k")).select(
        "bit", "block", "part",
        F.coalesce(F.sum("k").over(of_block.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("k").over(of_block).alias("all"),
    )
    upto = F.sum("left").over(Window.partitionBy("bit", "block", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    counted = ranged.withColumn("upto", upto).join(totals, ["bit", "block", "part"])
    smaller, larger = F.col("below") + F.col("upto") - F.col("left"), F.col("all") - F.col("below") - F.col("upto")
    s = counted.agg(F.sum((F.col("right") * (smaller - larger)).cast("double")).alias("s"))
    return s.crossJoin(F.broadcast(unequal("x"))).crossJoin(F.broadcast(unequal("y"))).select(F.try_divide("s", F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


#: Lanczos' coefficients for the logarithm of the gamma function (g = 7).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """For x of 0.5 or more."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + k)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def _fraction(steps: Column, term) -> Column:
    """A continued fraction 1 + a1 / (1 + a2 / (1 + ...)) by Lentz' method; ``term`` gives a of a step's number."""
    near = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def step(s: Column, k: Column) -> Column:
        a = term(k)
        d, c = near(1 + a * s["d"]), near(1 + a / s["c"])
        return F.struct((1 / d).alias("d"), c.alias("c"), (s["f"] * c / d).alias("f"))

    start = F.struct(F.lit(0.0).alias("d"), F.lit(1.0).alias("c"), F.lit(1.0).alias("f"))
    return F.aggregate(steps, start, step, lambda s: s["f"])


def incomplete_beta(x: Column, a: Column, b: Column, steps: int = 200) -> Column:
    """The regularised incomplete beta function for x of 0 to 1 and a, b of 0.5 or more, as an expression."""
    swap = x > (a + 1) / (a + b + 2)
    x, y, a, b = F.when(swap, 1 - x).otherwise(x), F.when(swap, x).otherwise(1 - x), F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)

    def term(k: Column) -> Column:
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(y)) / a
    value = F.when(x <= 0, 0.0).otherwise(front / _fraction(F.sequence(F.lit(1), F.lit(steps)), term))
    return F.when(swap, 1 - value).otherwise(value)


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs, by the t distribution of n - 2 degrees; NULL under three pairs."""
    freedom = n - 2
    p = incomplete_beta(1 - r * r, freedom / 2.0, F.lit(0.5))
    return F.when(freedom < 1, None).when(F.abs(r) >= 1, 0.0).otherwise(F.least(p, F.lit(1.0)))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value: the tail of a chi-squared of one degree, by a series or a fraction."""
    x = z * z / 2
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(F.lit(2.0).alias("t"), F.lit(2.0).alias("s")), lambda s, k: F.struct((s["t"] * x / (k + 0.5)).alias("t"), (s["s"] + s["t"] * x / (k + 0.5)).alias("s")), lambda s: s["s"])
    scale = F.exp(-x) * F.sqrt(x) / math.sqrt(math.pi)
    # erfc(sqrt x) = exp(-x) / sqrt(pi x) / (1 + (1/2x) / (1 + (2/2x) / (1 + ...)))
    tail = F.exp(-x) / F.sqrt(math.pi * x) / _fraction(F.sequence(F.lit(1), F.lit(120)), lambda k: k / (2 * x))
    return F.when(x < 2, 1 - scale * series).otherwise(tail)


def _safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r over the rows where both are there; NULL where one of them is constant."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y))))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r, n, p, stars) of all pairs of columns, a column with itself included, in one pass over the rows.

    A pair counts the rows where both are there; a constant column has no r, p or stars.
    """
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = df.agg(*[e for k, (a, b) in enumerate(pairs) for e in (_safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}"), F.count_if(both(a, b)).alias(f"n{k}"))])
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), (F.when(F.col(f"r{k}").isNotNull(), 1.0) if a == b else F.col(f"r{k}")).alias("r"), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(pairs)]
    upper = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    every = upper.unionByName(upper.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "r", "n"))
    return every.withColumn("p", pearson_p(F.col("r"), F.col("n"))).withColumn("stars", F.when(F.col("p").isNull(), "").otherwise(stars(F.col("p"))))


def kendall_p(df: DataFrame, x: str, y: str, ranges: int = 256) -> DataFrame:
    """(tau, n, z, p): tau-b with the normal approximation of its null distribution, its variance corrected for ties.

    The corrections come from counts per distinct value, so nothing here needs pairs either.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("a"), F.col(y).alias("b"))

    def ties(v: str) -> DataFrame:
        t = rows.groupBy(v).agg(F.count(F.lit(1)).cast("double").alias("t"))
        k = F.col("t")
        return t.agg(F.sum(k * (k - 1)).alias(f"{v}_1"), F.sum(k * (k - 1) * (k - 2)).alias(f"{v}_2"), F.sum(k * (k - 1) * (2 * k + 5)).alias(f"{v}_3"), F.sum("t").alias(f"{v}_n"))

    out = kendall_tau_b(rows, "a", "b", ranges).crossJoin(F.broadcast(ties("a"))).crossJoin(F.broadcast(ties("b")))
    n = F.col("a_n")
    pairs = n * (n - 1)
    s = F.col("tau") * F.sqrt((pairs - F.col("a_1")) / 2 * ((pairs - F.col("b_1")) / 2))
    variance = (pairs * (2 * n + 5) - F.col("a_3") - F.col("b_3")) / 18 + F.col("a_1") * F.col("b_1") / (2 * pairs) + F.try_divide(F.col("a_2") * F.col("b_2"), 9 * pairs * (n - 2))
    scored = out.select("tau", n.cast("long").alias("n"), (s / F.sqrt(variance)).alias("z"))
    return scored.withColumn("p", normal_p(F.col("z")))


def stars(p):
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def tf_idf(df: DataFrame, key: str, tokens) -> DataFrame:
    """(key, term, weight): smoothed idf ln((1 + n) / (1 + df)) + 1 and L2-normalised rows."""
    counts = df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    idf = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))

"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, then verified.

Each distinct text becomes a weighted set of five-word shingles (count times inverse document frequency).
Improved consistent weighted sampling draws ``BANDS * ROWS`` samples; two texts agree in a sample with a
probability equal to their weighted Jaccard similarity. Texts that agree in a whole band meet in a bucket.
A bucket is settled by pivots: a pivot is compared with all members of other components at once, the first
one with the whole bucket, then every member outside the largest component, until no pair across components
is untested. So no link that the bands find is lost, and a bucket of n near copies of one text costs about n
comparisons, not all pairs. Buckets of at most ``BUCKET_BYTES`` of text are settled within one task;
larger ones by joins, in rounds with more pivots each, so that no task holds an unbounded group. Pairs whose total weights differ too much for the wanted similarity need no
comparison: the lesser total over the greater bounds it. Every link is verified by the exact weighted Jaccard similarity.

Copies are folded into one text first and unfolded at the end. Defined cases: a blank or null text is in a
class of its own; a text under five words is one shingle; of rows that tie on doc_id one is kept; a null
doc_id sorts last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialise
from quarry.llm.components import connected_components
from quarry.llm.shingles import Frequencies, WordHashes, inverse_frequencies, shingles

BANDS, ROWS = 10, 4
SIMILARITY = 0.8
#: Text bytes of the largest bucket that one task settles.
BUCKET_BYTES = 24 << 20
_BLOCK = 4096


@cache
def _draws() -> tuple[np.ndarray, ...]:
    """Multipliers of the samples and a pool of draws (r, 1/r, beta, ln c - r) shared by all workers."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    r, c = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16)
    beta = rng.random(1 << 16)
    return factors, r.astype(np.float32), (1 / r).astype(np.float32), beta.astype(np.float32), (np.log(c) - r).astype(np.float32)


def weights(h: np.ndarray, counts: np.ndarray, idf: Frequencies) -> np.ndarray:
    return counts * idf(h)


def signature(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit sample for each of the BANDS * ROWS draws."""
    factors, r, inv, beta, c = _draws()
    low = np.full(len(factors), np.inf, np.float32)
    out = np.zeros(len(factors), np.uint64)
    columns = np.arange(len(factors))
    log_w = np.log(w).astype(np.float32)
    for at in range(0, len(h), _BLOCK):
        part = h[at : at + _BLOCK]
        draw = ((part[:, None] * factors) >> np.uint64(48)).astype(np.intp)
        b = beta[draw]
        t = np.floor(log_w[at : at + _BLOCK, None] * inv[draw] + b)
        a = c[draw] - r[draw] * (t - b)
        pick = a.argmin(axis=0)
        value = a[pick, columns]
        better = value < low
        low = np.where(better, value, low)
        sample = part[pick] ^ ((t[pick, columns].astype(np.int64).astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15))
        out = np.where(better, sample, out)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in sample.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted shingles, weights)."""
    total = a[1].sum() + b[1].sum()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (total - both)) if total > both else 1.0


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _banded(shared):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            bands, totals, sizes = [], [], []
            for text in batch.column(3).to_pylist():
                h, counts = shingles(text, words)
                w = weights(h, counts, shared.value)
                bands.append(band_keys(signature(h, w)) if len(h) else [])
                totals.append(float(w.sum()))
                sizes.append(len(text) if text else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bands, pa.list_(pa.int64())), pa.array(totals, pa.float64()), pa.array(sizes, pa.int64())], names=["row_tag", "doc_id", "key", "bands", "total", "chars"])

    return apply


def _verified(shared, least: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = WordHashes(), {}

        def of(key: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if key not in last:
                if len(last) > 64:
                    last.clear()
                h, counts = shingles(text, words)
                last[key] = (h, weights(h, counts, shared.value))
            return last[key]

        for batch in batches:
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            found = [(x, y) for x, y, s, t in zip(a, b, text_a, text_b, strict=True) if weighted_jaccard(of(x, s), of(y, t)) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return apply


def settle(members: list[tuple[np.ndarray, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links that join the components of one bucket, by pivots; members are (sorted shingles, weights)."""
    n = len(members)
    sizes = np.array([len(h) for h, _ in members])
    ids, at = np.unique(np.concatenate([h for h, _ in members]), return_inverse=True)
    w = np.concatenate([x for _, x in members]).astype(np.float64)
    first = np.cumsum(np.r_[0, sizes[:-1]])
    totals = np.add.reduceat(w, first)
    label, links = np.arange(n), []
    dense, tried = np.zeros(len(ids)), np.zeros(n, bool)
    while True:
        counts = np.bincount(label, minlength=n)
        rest = np.flatnonzero((label != counts.argmax()) & ~tried) if tried.any() else np.arange(n)
        if counts.max() == n or not len(rest):
            return links
        pivot = int(rest[0])
        tried[pivot] = True
        own = slice(first[pivot], first[pivot] + sizes[pivot])
        dense[at[own]] = w[own]
        both = np.add.reduceat(np.minimum(dense[at], w), first)
        dense[at[own]] = 0
        for k in np.flatnonzero(both >= least * (totals + totals[pivot] - both)).tolist():
            if label[k] != label[pivot]:
                links.append((pivot, k))
                label[label == label[k]] = label[pivot]


def _settled(shared, least: float):
    """Rows (bucket, key, text) sorted by bucket -> links (a, b)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()

        def links(keys: list[bytes], members: list) -> pa.RecordBatch:
            found = settle(members, least)
            return pa.RecordBatch.from_arrays([pa.array([keys[f[k]] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        now, keys, members = None, [], []
        for batch in batches:
            for bucket_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket_id != now:
                    if len(keys) > 1:
                        yield links(keys, members)
                    now, keys, members = bucket_id, [], []
                h, counts = shingles(text, words)
                keys.append(key)
                members.append((h, weights(h, counts, shared.value)))
        if len(keys) > 1:
            yield links(keys, members)

    return apply


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hot_links(buckets: DataFrame, texts: DataFrame, shared, least: float = SIMILARITY, wide: int = 1024) -> DataFrame:
    """Links of buckets that are too large for one task; ``buckets(bucket, key, total, n)``."""

    def near(a: str, b: str) -> Column:
        return F.least(a, b) >= F.greatest(a, b) * (least - 1e-6)

    def verify(pairs: DataFrame) -> DataFrame:
        one = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
        two = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
        rows = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
        return rows.mapInArrow(_verified(shared, least), "a binary, b binary")

    leaders = buckets.groupBy("bucket").agg(F.min(F.struct("key", "total")).alias("first")).select("bucket", F.col("first.key").alias("a"), F.col("first.total").alias("total_a"))
    pairs = materialise(_ordered(buckets.join(leaders, "bucket").where((F.col("key") != F.col("a")) & near("total", "total_a")).select("a", F.col("key").alias("b"))))
    tested, links = pairs, materialise(verify(pairs))
    open_buckets = materialise(buckets.where("n > 2"))
    done, few = None, 8
    while True:
        if open_buckets.isEmpty():
            return links
        labels = connected_components(links).select(F.col("node").alias("key"), "label")
        here = open_buckets.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        parts = here.groupBy("bucket", "label").count()
        by_size = Window.partitionBy("bucket").orderBy(F.desc("count"), "label")
        rest = parts.withColumn("rank", F.row_number().over(by_size)).where("rank > 1").select("bucket", "label")
        pivots = here.join(rest, ["bucket", "label"])
        if done is not None:
            pivots = pivots.join(done, ["bucket", "key"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
        pivots = materialise(pivots.withColumn("turn", turn).where(F.col("turn") <= F.greatest(F.lit(few), F.lit(wide) / F.col("n"))).select("bucket", "key", "total", "label"))
        few *= 8
        if pivots.isEmpty():
            return links
        done = pivots.select("bucket", "key") if done is None else materialise(done.unionByName(pivots.select("bucket", "key")))
        across = here.select("bucket", F.col("key").alias("b"), F.col("label").alias("other"), F.col("total").alias("total_b")).join(
            pivots.select("bucket", F.col("key").alias("a"), "label", "total"), "bucket").where((F.col("label") != F.col("other")) & near("total", "total_b"))
        fresh = materialise(_ordered(across.select("a", "b")).join(tested, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            tested = materialise(tested.unionByName(fresh))
            links = materialise(links.unionByName(verify(fresh)))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept, text_key."""
    spark = docs.sparkSession
    idf = inverse_frequencies(docs.select(F.col(text_col).alias("text")))
    shared = spark.sparkContext.broadcast(idf)
    rows = docs.select(F.monotonically_increasing_id().alias("row_tag"), F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    banded = materialise(rows.mapInArrow(_banded(shared), f"row_tag long, doc_id {kind}, key binary, bands array<long>, total double, chars long"))
    distinct = banded.groupBy("key").agg(F.first("bands").alias("bands"), F.first("total").alias("total"), F.first("chars").alias("chars"))
    members = distinct.select("key", "total", "chars", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars_all")).where("n > 1")
    buckets = materialise(members.drop("chars").join(sizes, "bucket"))
    hot = buckets.where(F.col("chars_all") > bucket_bytes)
    needed = buckets.select("key").distinct()
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).join(needed, "key", "left_semi")
    texts = materialise(texts.groupBy("key").agg(F.first("text").alias("text")))
    small = buckets.where(F.col("chars_all") <= bucket_bytes).select("bucket", "key").join(texts, "key").select("bucket", "key", "text")
    links = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settled(shared, similarity), "a binary, b binary")
    if not hot.isEmpty():
        links = links.unionByName(hot_links(hot, texts, shared, similarity))
    labels = connected_components(links).select(F.col("node").alias("key"), "label")
    # A blank text stays alone: its row is its label.
    alone = F.when(F.size("bands") == 0, F.col("row_tag")).otherwise(-1)
    placed = banded.withColumn("alone", alone).join(labels, "key", "left").select("row_tag", "doc_id", "key", "alone", F.coalesce("label", "key").alias("label"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_tag"))
    classes = placed.groupBy("label", "alone").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(classes, ["label", "alone"]).select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size",
        (F.col("row_tag") == F.col("first.row_tag")).alias("kept"), F.col("key").alias("text_key"),
    )


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    classes = materialise(near_duplicate_classes(docs, similarity, id_col, text_col))
    key = text_key(F.col(text_col))

    def same(other: DataFrame):
        return docs[id_col].eqNullSafe(other["_id"]) & (key == other["_key"])

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))

    kept = docs.join(stay := keys(classes.where("kept")), same(stay), "left_semi")
    # Rows that repeat id and text are one row of their class.
    again = keys(classes.groupBy("doc_id", "text_key").count().where("count > 1"))
    twice = kept.join(again, same(again), "left_semi").withColumn("_key", key).dropDuplicates([id_col, "_key"]).drop("_key")
    return kept.join(again, same(again), "left_anti").unionByName(twice)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "class_size", "kept")

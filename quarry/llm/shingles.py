"""Five-word shingles of whole texts as 64-bit hashes, with their counts and document frequencies."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5
#: Buckets (as bits of a hash) of the first count of document frequencies, and parts they are summed in.
BITS, PARTS = 22, 64
#: Frequencies are exact from this share of the documents on, and from the total of shingles over ``MOST`` on:
#: so there are at most ``MOST`` such shingles, in a corpus of any size.
SHARE, MOST = 1 / 1024, 1 << 20
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS)], np.uint64)


class WordHashes(dict):
    """word -> 64-bit hash; starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return value


def shingles(text: str | None, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their counts; a shorter text is one shingle, a blank one has none."""
    own = text.split() if text else []
    if not own:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    n = max(1, len(h) - WORDS + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        mixed += h[k : k + n] * _FACTORS[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    first = np.flatnonzero(np.r_[True, mixed[1:] != mixed[:-1]])
    return mixed[first], np.diff(np.r_[first, n])


@dataclass
class Frequencies:
    """ln(1 + documents / documents with the shingle): exact for frequent shingles, one value for all others."""

    bits: int
    hot: np.ndarray  # buckets that hold a frequent shingle, perhaps
    hashes: np.ndarray  # frequent shingles, sorted
    values: np.ndarray
    rest: float

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rest, np.float32)
        if len(self.hashes):
            at = np.flatnonzero(self.hot[bucket(h, self.bits)])
            k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            same = self.hashes[k] == h[at]
            out[at[same]] = self.values[k[same]]
        return out


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """The counts that are not 0, with their places: small for a small partition."""
    at = np.flatnonzero(counts)
    return zlib.compress(np.concatenate(([len(counts)], at, counts[at])).astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    found = np.frombuffer(zlib.decompress(data), "<i8")
    half = len(found) // 2
    return found[1 : half + 1], found[half + 1 :], int(found[0])


def _count(bits: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, docs, size = WordHashes(), np.zeros(1 << bits, np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h, _ = shingles(text, words)
                if len(h):
                    # A document counts once in a bucket: the sum is at least the frequency of each of its shingles.
                    at = bucket(h, bits)
                    total[at[np.flatnonzero(np.append(True, at[1:] != at[:-1]))]] += 1
                    docs += 1
                    size += len(h)
        if docs:
            data = [_packed(p) for p in total.reshape(PARTS, -1)]
            once = lambda n: pa.array([n] + [0] * (PARTS - 1), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(data, pa.binary()), once(docs), once(size)], names=["part", "counts", "docs", "size"])

    return apply


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for part, data, docs, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, counts, width = _unpacked(data)
            held = sums.setdefault(part, [np.zeros(width, np.int64), 0, 0])
            held[0][at] += counts
            held[1] += docs
            held[2] += size
    rows = [(p, _packed(c), d, s) for p, (c, d, s) in sums.items()]
    if rows:
        a, b, c, d = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.binary()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], names=["part", "counts", "docs", "size"])


def _exact(shared, bits: int):
    """(shingle, documents) of the shingles in hot buckets, summed within the task a few millions at a time."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordHashes(), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h, _ = shingles(text, words)
                held.append(h[shared.value[bucket(h, bits)]])
                size += len(held[-1])
                if size > 4_000_000:
                    yield told(held)
                    held, size = [], 0
        if size:
            yield told(held)

    return apply


def inverse_frequencies(texts: DataFrame, bits: int = BITS) -> Frequencies:
    """Document frequencies over all rows of the one text column, in two passes.

    The first counts documents by bucket of the hash; the second counts, exactly and by a grouped sum, the
    shingles of the buckets that reach the threshold. A shingle below it counts as if it were at it.
    """
    schema = "part int, counts binary, docs long, size long"
    counts, docs, size = np.zeros(1 << bits, np.int64), 0, 0
    width = (1 << bits) // PARTS
    for r in texts.mapInArrow(_count(bits), schema).repartition(PARTS, "part").mapInArrow(_add, schema).toLocalIterator():
        at, some, _ = _unpacked(r["counts"])
        counts[r["part"] * width + at] = some
        docs += r["docs"]
        size += r["size"]
    least = max(1, int(docs * SHARE), -(-size // MOST))
    hot = counts >= least
    shared = texts.sparkSession.sparkContext.broadcast(hot)
    exact = texts.mapInArrow(_exact(shared, bits), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    h = exact.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    values = np.log1p(docs / exact.column("n").to_numpy()).astype(np.float32)
    return Frequencies(bits, hot, h[order], values[order], math.log1p(docs / least))

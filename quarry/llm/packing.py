"""Packing token sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows, each a sequence of its own. What is left
of each document, shorter than a window, is packed best-fit decreasing: a segment tree indexed by the
remaining capacity finds the tightest open window for the next longest piece. Pieces are dealt by a hash
of their document to groups of bounded size and every group is packed by itself, so no task grows with
the input; a group of thousands of pieces already fills nearly every window.

Defined cases: a null text is empty and has the end id alone; copies and repeated rows are packed like
any others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import blocks, documents, materialise
from quarry.llm.tokens import WordIds, tokenizer_path

PIECES = "doc_id long, row_tag long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Texts that are tokenized together.
BATCH = 256


class OpenWindows:
    """Windows by remaining capacity, with a segment tree over the capacities that are in use."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def push(self, capacity: int, window_id: int) -> None:
        self.at[capacity].append(window_id)
        self._add(capacity, 1)

    def pop_tightest(self, length: int) -> tuple[int, int] | None:
        """(window, its capacity) with the least capacity of at least ``length``."""
        i = length + self.size
        if not self.count[i]:
            while True:
                if i & (i + 1) == 0:  # the right edge of the tree, or its root
                    return None
                if not i & 1 and self.count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; ``lengths`` must not increase."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    windows, made = OpenWindows(window), 0
    for k, n in enumerate(lengths.tolist()):
        found = windows.pop_tightest(n)
        if found is None:
            found = (made, window)
            made += 1
        where[k], offset[k] = found[0], window - found[1]
        if found[1] > n:
            windows.push(found[1] - n, found[0])
    return where, offset


def cut_pieces(docs: DataFrame, window: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every document and cut it: full windows first, then the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.shared(path)
        for batch in batches:
            rows: list[tuple] = []
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                keys, tags, texts = (part.column(c).to_pylist() for c in range(3))
                for key, tag, ids in zip(keys, tags, words.ids(texts), strict=True):
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        rows.append((key, tag, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_tag"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, window: int = 2048, path: str | None = None, group_pieces: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; sequence ids are unique, offsets gapless from 0."""
    pieces = materialise(cut_pieces(docs, window, path or tokenizer_path(), id_col, text_col))
    rest = pieces.where(F.col("length") < window)
    groups = blocks(rest.count(), group_pieces)

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "row_tag"], ascending=[False, True, True])
        where, offset = best_fit_decreasing(part["length"].to_numpy(), window)
        # Sequences of packed pieces take the odd ids, full windows the even ones.
        out = part.assign(sequence_id=2 * (where * groups + int(key[0])) + 1, offset=offset)
        return out[[f.split()[0] for f in PACKED.split(", ")]]

    short = rest.withColumn("g", F.pmod(F.xxhash64("row_tag"), F.lit(groups))).groupBy("g").applyInPandas(packed, PACKED)
    full = pieces.where(F.col("length") == window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return full.unionByName(short)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language over a bounded sample of labelled documents, at most about
``per_language`` of them for each language, chosen by a hash of doc_id. The matrix of log probabilities
(languages x buckets, a fixed size) is broadcast, and whole texts are scored in numpy.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text when
nothing could be learned; rows without a language are not learned from; ties go to the first language by
name; other columns pass through, but columns named like the two that are added give way to them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import blocks, crc_fold, documents

UND = "und"
BUCKETS = 1 << 17
SIZES = (1, 2, 3)
#: Characters that are handled at once.
SLICE = 1 << 20
_SPACE = 32
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    if "letters" not in _tables:
        table = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
        for c in range(len(table)):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = table
    return _tables["letters"]


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in a row, each followed by two spaces, and where each text starts."""
    joined = "".join(f"{t}  " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
    return _letters()[codes], starts


def _buckets(codes: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each character; n-grams of spaces are in bucket 0."""
    n = len(codes)
    mixed = codes * np.uint32(0x9E3779B1)
    blank = codes == _SPACE
    for k in range(1, size):
        following = np.full(n, _SPACE, np.uint32)
        following[: n - k] = codes[k:]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) + following * np.uint32(0xC2B2AE35)
        blank &= following == _SPACE
    mixed ^= mixed >> np.uint32(13)
    mixed = mixed * np.uint32(0x27D4EB2F) + np.uint32(size)
    out = (mixed >> np.uint32(15)).astype(np.int64) % (BUCKETS - 1) + 1
    out[blank] = 0
    return out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about SLICE characters."""
    first = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= SLICE:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def count_ngrams(texts: list[str]) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for a, b in _slices(texts):
        codes, _ = _code_points(texts[a:b])
        for size in SIZES:
            out += np.bincount(_buckets(codes, size), minlength=BUCKETS)
    out[0] = 0
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages), float32
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, best = [], np.zeros(len(texts))
        plain = [t or "" for t in texts]
        for a, b in _slices(plain):
            codes, starts = _code_points(plain[a:b])
            total = np.zeros((b - a, len(self.languages)))
            for size in SIZES:
                total += np.add.reduceat(self.log_p[_buckets(codes, size)], starts, axis=0, dtype=np.float64)
            known = np.add.reduceat(codes != _SPACE, starts) > 0
            if not self.languages:
                names += [UND] * (b - a)
                continue
            total += self.prior
            top = total.argmax(axis=1)
            names += [self.languages[i] if ok else UND for i, ok in zip(top, known, strict=True)]
            posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            best[a:b] = np.where(known, posterior, 0.0)
        return names, best


def train(labelled: DataFrame, per_language: int = 5_000, alpha: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from at most about ``per_language`` rows of each language of ``labelled``."""
    rows = labelled.where(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col(lang_col) == name, int(min(1.0, per_language / n) * (1 << 20))).otherwise(share)
    sample = rows.where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20)) < share))
    parts = blocks(sum(min(per_language, n) for n in sizes.values()), 1_000)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for name, part in frame.groupby("lang"):
                sums[name] = sums.get(name, 0) + count_ngrams(part["text"].tolist())
        for name, counts in sums.items():
            yield pd.DataFrame({"lang": [name], "counts": [counts.astype("<i8").tobytes()]})

    counts = {name: np.zeros(BUCKETS) for name in languages}
    spread = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).repartition(parts)
    for r in spread.mapInPandas(counted, "lang string, counts binary").toLocalIterator():
        counts[r["lang"]] += np.frombuffer(r["counts"], "<i8")
    table = np.stack([counts[name] for name in languages], axis=1) + alpha
    log_p = np.log(table / table.sum(axis=0))
    log_p[0] = 0
    prior = np.log(np.array([sizes[name] for name in languages]) / sum(sizes.values()))
    return LanguageModel(languages, log_p.astype(np.float32), prior)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*({lang_as, score_as} - {text_col}))
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    at, names = docs.columns.index(text_col), [*docs.columns, lang_as, score_as]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    return docs.mapInArrow(scored, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = crc_fold(F.col("doc_id"))
    model = train(docs.where(fold != 0).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", (fold == 0).alias("held_out"), "text"), model).drop("text")

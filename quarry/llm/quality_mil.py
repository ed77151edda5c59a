"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE`` bytes, and only the document has a label. Every passage is
encoded: its hashed byte trigrams (square roots of their shares, and how many there are) and the shares of classes of
bytes go through a learned layer, h = tanh(W x + b). Gated attention weighs the passages of a document, with weights in proportion to
exp(w (tanh(V h) * sigmoid(U h))), and the weighted sum of h is scored by a logistic output. All parameters are
learned together from the labels of the documents.

The classifier is fitted on a bounded sample: at most about ``per_label`` documents of each label, chosen by a hash
of the id, of at most ``most_passages`` passages each, and ``sample_passages`` passages in all. Rows of the sample
count by the inverse of their share, so the score keeps the balance of the labels at every size of the table. Every
document is scored by all passages of its whole text.

Defined cases: a null or empty text is one empty passage and gets a score like any other; labels that are null are
not learned from; an id with several labels is learned from once for each; with no label at all every score is 0.5;
repeated rows get equal scores; a very long text is encoded a part at a time; an empty table gives an empty result.
Other columns pass through, but columns named like the two that are added give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import crc_fold, documents, materialise

#: Bytes of a passage, and how far its end may move on to a space.
PASSAGE, STRETCH = 600, 64
BUCKETS = 512
#: Classes of bytes: small letters, capitals, digits, blanks, sentence marks, other signs, bytes of other letters.
_CLASSES = np.select([[(97 <= c <= 122) for c in range(256)], [(65 <= c <= 90) for c in range(256)], [(48 <= c <= 57) for c in range(256)], [c in b" \t\n\r" for c in range(256)], [c in b".,;:!?'\"-()" for c in range(256)], [c < 128 for c in range(256)]], range(6), 6)
FEATURES = BUCKETS + 9
#: Bytes that are encoded at once.
SLICE = 1 << 20


def passages_of(text: str | None) -> list[bytes]:
    """The whole text in passages; one at least. A passage ends after a space where one is near."""
    data = (text or "").encode("utf-8", "replace")
    out, at = [], 0
    while at < len(data):
        end = at + PASSAGE
        if end < len(data):
            space = data.find(b" ", end, end + STRETCH)
            end = space + 1 if space >= 0 else end
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append(data[at:end])
        at = end
    return out or [b""]


def encode(passages: list[bytes]) -> np.ndarray:
    """(passages, FEATURES)."""
    size = np.array([len(p) for p in passages]) + 2
    raw = np.frombuffer(b"".join(p + b"\0\0" for p in passages), np.uint8)
    row = np.repeat(np.arange(len(passages)), size)
    wide = raw.astype(np.uint32)
    three = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    bucket = (three * np.uint32(2654435761) >> np.uint32(23)).astype(np.int64)
    inside = (raw[:-2] != 0) & (raw[1:-1] != 0) & (raw[2:] != 0)
    grams = np.bincount((row[:-2] * BUCKETS + bucket)[inside], minlength=len(passages) * BUCKETS).reshape(-1, BUCKETS)
    length = np.maximum(size - 2, 1)[:, None]
    kinds = np.bincount(row * 8 + np.where(raw == 0, 7, _CLASSES[raw]), minlength=len(passages) * 8).reshape(-1, 8)[:, :7] / length
    scale = np.log1p(size[:, None] - 2) / np.log1p(PASSAGE)
    variety = (grams > 0).sum(axis=1, keepdims=True) / length * 3
    return np.concatenate([np.sqrt(grams / length) * 4, kinds * 2, scale, variety], axis=1, dtype=np.float32, casting="same_kind")


def encode_all(passages: list[bytes]) -> Iterator[np.ndarray]:
    """encode() of about SLICE bytes at a time."""
    first = total = 0
    for k, p in enumerate(passages):
        total += len(p) + 2
        if total >= SLICE or k + 1 == len(passages):
            yield encode(passages[first : k + 1])
            first, total = k + 1, 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _by_bag(values: np.ndarray, starts: np.ndarray, ufunc=np.add) -> np.ndarray:
    return ufunc.reduceat(values, starts, axis=0)


@dataclass
class BagModel:
    """Parameters by name; ``None`` when there was nothing to learn from."""

    p: dict[str, np.ndarray] | None

    @classmethod
    def fresh(cls, hidden: int, gates: int, seed: int) -> BagModel:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls({"W": normal(FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": normal(hidden, gates), "U": normal(hidden, gates), "w": normal(gates), "c": normal(hidden), "c0": np.zeros(1, np.float32)})

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["W"] + self.p["b"])

    def attend(self, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Weights of the passages of each bag, and what they come from."""
        t, s = np.tanh(h @ self.p["V"]), _sigmoid(h @ self.p["U"])
        logit = (t * s) @ self.p["w"]
        grown = np.exp(logit - np.repeat(_by_bag(logit, starts, np.maximum), sizes))
        return grown / np.repeat(_by_bag(grown, starts), sizes), t, s

    def forward(self, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each bag, weight of each passage)."""
        alpha, _, _ = self.attend(h, starts, sizes)
        z = _by_bag(alpha[:, None] * h, starts)
        return _sigmoid(z @ self.p["c"] + self.p["c0"][0]), alpha

    def gradient(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the weighted mean of the logistic loss."""
        p, h = self.p, self.hidden(x)
        alpha, t, s = self.attend(h, starts, sizes)
        z = _by_bag(alpha[:, None] * h, starts)
        y = _sigmoid(z @ p["c"] + p["c0"][0])
        loss = -(weight * np.log(np.where(label > 0, y, 1 - y) + 1e-12)).sum() / weight.sum()
        d_out = ((y - label) * weight / weight.sum()).astype(np.float32)
        d_z = np.repeat(d_out[:, None] * p["c"], sizes, axis=0)
        d_alpha = (d_z * h).sum(axis=1)
        d_logit = alpha * (d_alpha - np.repeat(_by_bag(alpha * d_alpha, starts), sizes))
        d_gate = d_logit[:, None] * p["w"]
        d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
        d_h = (alpha[:, None] * d_z + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ d_h, "b": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_s, "w": (t * s).T @ d_logit, "c": z.T @ d_out, "c0": d_out.sum(keepdims=True)}, float(loss)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.p is None:
            return np.full(len(texts), 0.5)
        bags = [passages_of(t) for t in texts]
        sizes = np.array([len(b) for b in bags])
        h = np.concatenate([self.hidden(x) for x in encode_all([p for b in bags for p in b])])
        return self.forward(h, np.cumsum(sizes) - sizes, sizes)[0].astype(np.float64)


def fit_bags(bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, hidden: int = 32, gates: int = 16, epochs: int = 24, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> BagModel:
    """Adam over batches of bags; the same bags in the same order give the same model."""
    if not bags:
        return BagModel(None)
    model, rng = BagModel.fresh(hidden, gates, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = np.array([len(bags[i]) for i in own])
            grad, _ = model.gradient(np.concatenate([bags[i] for i in own]), np.cumsum(sizes) - sizes, sizes, label[own], weight[own])
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in model.p.items():
                g = grad[k].astype(np.float32) + decay * v
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                v -= (pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1_500, most_passages: int = 256, sample_passages: int = 24_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BagModel:
    """Learn from a bounded sample of ``labels`` (one row per labelled document); see the module for the bounds."""
    marked = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not sizes:
        return BagModel(None)
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, min(1.0, per_label / n)).otherwise(share)
    place = F.pmod(F.xxhash64("key", F.lit("quality sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = marked.withColumn("share", share).withColumn("place", place).where(F.col("place") < F.col("share"))
    # About per_label rows of each label at most, so this side of the join has a fixed bound.
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "key")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for place, label, share, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = passages_of(text)
                if len(own) <= most_passages:
                    x = np.concatenate(list(encode_all(own)))
                    out.append((place / share, label, share, len(own), x.astype("<f2").tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["place", "label", "share", "n", "x"])

    bags = materialise(rows.select("place", "label", "share", "text").mapInArrow(encoded, "place double, label int, share double, n int, x binary"))
    total = bags.agg(F.sum("n")).first()[0] or 0
    fits = min(1.0, sample_passages / total) if total else 1.0
    taken = bags.where(F.col("place") < fits).orderBy("place", "label", "n").toArrow()
    x = [np.frombuffer(v, "<f2").astype(np.float32).reshape(-1, FEATURES) for v in taken.column("x").to_pylist()]
    label, share = (taken.column(c).to_numpy().astype(np.float64) for c in ("label", "share"))
    weight = 1 / share if len(share) else share
    return fit_bags(x, label, weight / weight.mean() if len(weight) else weight)


def predict(docs: DataFrame, model: BagModel, threshold: float = 0.7, text_col: str = "text", score_as: str = "score", predicted_as: str = "predicted") -> DataFrame:
    """``docs`` with the score of each document and whether it reaches ``threshold``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*({score_as, predicted_as} - {text_col}))
    schema = T.StructType([*docs.schema.fields, T.StructField(score_as, T.DoubleType()), T.StructField(predicted_as, T.IntegerType())])
    at, names = docs.columns.index(text_col), [*docs.columns, score_as, predicted_as]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(batch.column(at).to_pylist()) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=names)

    return docs.mapInArrow(scored, schema)


def passage_weights(docs: DataFrame, model: BagModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Why a document has its score: doc_id, passage (from 0), bytes (first, end), weight, alone (its score as a document)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = passages_of(text)
                n = np.array([len(own)])
                ends = np.cumsum([len(p) for p in own])
                if model.p is None:
                    weight, alone = np.full(len(own), 1 / len(own)), np.full(len(own), 0.5)
                else:
                    h = np.concatenate([model.hidden(x) for x in encode_all(own)])
                    weight = model.forward(h, np.zeros(1, np.int64), n)[1]
                    alone = _sigmoid(h @ model.p["c"] + model.p["c0"][0])
                keys = pa.array(batch.column(0).slice(k, 1).to_pylist() * len(own), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(np.arange(len(own), dtype=np.int64)), pa.array(ends - [len(p) for p in own]), pa.array(ends), pa.array(weight.astype(np.float64)), pa.array(alone.astype(np.float64))],
                    names=["doc_id", "passage", "first", "end", "weight", "alone"],
                )

    return rows.mapInArrow(weighed, f"doc_id {kind}, passage long, first long, end long, weight double, alone double")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(crc_fold(F.col("doc_id"), 4) != 2))
    held = crc_fold(F.col("doc_id"), 4) == 2
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")

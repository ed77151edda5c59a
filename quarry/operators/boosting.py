"""Boosted regression trees for ranking (LambdaMART), trained by Spark.

Rows are packed by query: one record holds up to ``CHUNK`` rows of a query as arrays (binned features, labels, scores,
gradients). A round has one job that moves the scores on and computes gradients of pairs, and one job for each level of
the tree, in which every record adds its gradients to histograms of (node, feature, bin). Spark sums the histograms and
the driver gets nodes x features x bins sums, however many rows there are, and chooses the splits.

Gradients are rounded to multiples of 2^-SCALE and summed as integers, so a tree does not depend on how the rows are
dealt to tasks. A query of more than ``CHUNK`` rows is several records; its pairs are computed for pairs of records,
each in a task of its own, and their sums meet in a grouped aggregate, so no task holds such a query as a whole.

Pairs are rows of one query with different labels; the loss of a pair is log(1 + exp(s_low - s_high)), weighted, with
``objective="ndcg"``, by the change of NDCG when the two change places.

Defined cases: a null feature counts as lower than all values; a null label as 0; a query whose labels are equal has
no pairs; ties of a gain go to the first feature by order and the lowest cut; with no rows or no pairs the ensemble
has single leaves of value 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.lineage import scratch

#: Rows of a query in one record, and pairs that a task looks at together.
CHUNK, BLOCK = 4096, 1 << 20
#: Bits after the point of a gradient.
SCALE = 36
_MISSING = -np.inf


@dataclass
class Tree:
    """Arrays by node; ``feature`` is -1 at a leaf. A row goes left where its value is at most ``cut``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for name, empty in (("feature", -1), ("cut", 0.0), ("bin", 0), ("left", 0), ("value", 0.0), ("gain", 0.0)):
            getattr(self, name).append(empty)
        return len(self.feature) - 1

    def leaves(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        """The node of each row; ``x`` is (rows, features)."""
        feature, cut, left = np.array(self.feature), np.array(self.bin if binned else self.cut), np.array(self.left)
        at = np.zeros(len(x), np.int64)
        while True:
            moving = np.flatnonzero(feature[at] >= 0)
            if not len(moving):
                return at
            node = at[moving]
            at[moving] = left[node] + (x[moving, feature[node]] > cut[node])


@dataclass
class Ensemble:
    features: list[str]
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), _MISSING, x)
        out = np.zeros(len(x))
        for tree in self.trees:
            out += np.array(tree.value)[tree.leaves(x)]
        return out

    def importance(self) -> dict[str, float]:
        """Sum of the gains of each feature's splits."""
        out = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    out[self.features[f]] += g
        return out

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "trees": [vars(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Ensemble:
        read = json.loads(text)
        return cls(read["features"], [Tree(**t) for t in read["trees"]])


def scored(df: DataFrame, model: Ensemble, query: str = "qid", doc: str = "doc_id") -> DataFrame:
    """``df`` with ``score`` and the ``rank`` of each row in its query; ties of a score go by ``doc``."""
    @F.pandas_udf("double")
    def predicted(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack([c.to_numpy(np.float64) for c in columns], axis=1)))

    order = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return df.withColumn("score", predicted(*[F.col(f).cast("double") for f in model.features])).withColumn("rank", F.row_number().over(order))


def cut_points(df: DataFrame, features: list[str], bins: int = 64, accuracy: int = 10_000) -> list[np.ndarray]:
    """At most ``bins`` - 2 cuts for each feature, at approximate quantiles, in one pass; bin 0 holds missing values."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), shares, accuracy).alias(f"q{k}") for k, f in enumerate(features)]).first()
    return [np.unique(np.array([v for v in row[f"q{k}"] or [] if v is not None], np.float64)) for k in range(len(features))]


def packed(df: DataFrame, features: list[str], cuts: list[np.ndarray], query: str, label: str, doc: str, chunk: int) -> DataFrame:
    """(qid, chunk, n, label, row, bins, ideal): records of the rows of a query, arrays as bytes; ``row`` tells rows apart."""
    row = F.xxhash64(F.col(query).cast("string"), F.col(doc).cast("string"))
    sizes = df.groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / chunk)
    rows = df.select(query, F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("label"), row.alias("row"), *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)])
    rows = rows.join(sizes, query).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit("chunk")), parts))
    levels = rows.groupBy(query, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(query).agg(F.sort_array(F.collect_list(F.struct("label", "n")), asc=False).alias("levels"))
    fields = F.struct("row", "label", *[f"f{k}" for k in range(len(features))])
    records = rows.groupBy(query, "chunk").agg(F.sort_array(F.collect_list(fields)).alias("rows")).join(levels, query)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, levels in zip(batch.column("rows"), batch.column("levels").to_pylist(), strict=True):
                own = rows.values
                x = np.stack([own.field(f"f{k}").to_numpy(zero_copy_only=False) for k in range(len(features))], axis=1)
                which = np.stack([np.where(np.isnan(v), 0, np.searchsorted(c, v, "left") + 1) for v, c in zip(x.T, cuts, strict=True)], axis=1)
                gain = np.concatenate([np.full(v["n"], 2.0 ** v["label"] - 1) for v in levels])
                ideal = float((gain / np.log2(np.arange(len(gain)) + 2)).sum())
                out.append((len(own), own.field("label").to_numpy().tobytes(), own.field("row").to_numpy().tobytes(), which.astype(np.uint8).tobytes(), ideal))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["qid", "chunk", "n", "label", "row", "bins", "ideal"])

    kind = dict(df.dtypes)[query]
    return records.select(F.col(query).alias("qid"), "chunk", "rows", "levels").mapInArrow(pack, f"qid {kind}, chunk long, n int, label binary, row binary, bins binary, ideal double")


def ranks_within(score: np.ndarray, row: np.ndarray, others: np.ndarray, other_rows: np.ndarray) -> np.ndarray:
    """How many of the others come before each row: by score, descending, then by row."""
    order = np.lexsort((other_rows, -others))
    key = np.rec.fromarrays([-others[order], other_rows[order]])
    return np.searchsorted(key, np.rec.fromarrays([-score, row], dtype=key.dtype), "left")


def pair_gradients(label: np.ndarray, score: np.ndarray, label2: np.ndarray, score2: np.ndarray, rank: np.ndarray | None = None, rank2: np.ndarray | None = None, ideal: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, curvature) of each row from its pairs with the others, in blocks; integers of 2^-SCALE."""
    g, h = np.zeros(len(label), np.int64), np.zeros(len(label), np.int64)
    step = max(1, BLOCK // max(1, len(label2)))
    for a in range(0, len(label), step):
        own = slice(a, a + step)
        sign = np.sign(label[own, None] - label2[None, :])
        p = 1 / (1 + np.exp(np.clip(sign * (score[own, None] - score2[None, :]), -500, 500)))
        weight = np.abs(sign)
        if rank is not None:
            gain = np.abs(2.0 ** label[own, None] - 2.0 ** label2[None, :])
            weight = weight * gain * np.abs(1 / np.log2(rank[own, None] + 2.0) - 1 / np.log2(rank2[None, :] + 2.0)) / max(ideal, 1e-12)
        g[own] = np.rint(-sign * p * weight * 2.0**SCALE).astype(np.int64).sum(axis=1)
        h[own] = np.rint(p * (1 - p) * weight * 2.0**SCALE).astype(np.int64).sum(axis=1)
    return g, h


def _f8(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64)


def _i8(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _sum_by_record(parts: DataFrame, columns: list[str]) -> DataFrame:
    """(qid, chunk, sums: structs of ``columns`` by place) from partial sums of the rows of a record."""
    each = parts.select("qid", "chunk", F.posexplode(F.arrays_zip(*columns)).alias("at", "v"))
    summed = each.groupBy("qid", "chunk", "at").agg(*[F.sum(f"v.{c}").alias(c) for c in columns])
    return summed.groupBy("qid", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", *columns))).alias("sums"))


class _Training:
    """The packed table of a training run and its state from round to round."""

    def __init__(self, df: DataFrame, features: list[str], cuts: list[np.ndarray], query: str, label: str, doc: str, objective: str, chunk: int) -> None:
        self.spark, self.cuts, self.objective, self.width = df.sparkSession, cuts, objective, len(features)
        path = scratch(self.spark, "packed")
        packed(df, features, cuts, query, label, doc, chunk).withColumn("score", F.lit(None).cast("binary")).write.parquet(path)
        self.state, self.paths = self.spark.read.parquet(path), [path]
        self.kind = dict(self.state.dtypes)["qid"]
        self.split = not self.state.where("chunk > 0").isEmpty()
        self.schema = f"qid {self.kind}, chunk long, n int, label binary, row binary, bins binary, ideal double, score binary"

    def _moved(self, tree: Tree | None):
        """Adds a tree's values to the scores."""
        width = self.width

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = []
                for n, bins, old in zip(batch.column("n").to_pylist(), batch.column("bins").to_pylist(), batch.column("score").to_pylist(), strict=True):
                    now = np.zeros(n) if old is None else _f8(old)
                    if tree is not None:
                        now = now + np.array(tree.value)[tree.leaves(np.frombuffer(bins, np.uint8).reshape(-1, width), binned=True)]
                    score.append(now.tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(score, pa.binary())], names=batch.schema.names[:8])

        return self.state.select("qid", "chunk", "n", "label", "row", "bins", "ideal", "score").mapInArrow(apply, self.schema)

    def _whole(self, state: DataFrame) -> DataFrame:
        """Gradients where every query is one record."""
        ndcg = self.objective == "ndcg"

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, h = [], []
                for label, row, ideal, score in zip(*(batch.column(c).to_pylist() for c in ("label", "row", "ideal", "score")), strict=True):
                    label, score, row = _f8(label), _f8(score), _i8(row)
                    rank = ranks_within(score, row, score, row) if ndcg else None
                    one = pair_gradients(label, score, label, score, rank, rank, ideal)
                    g.append(one[0].tobytes())
                    h.append(one[1].tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g, pa.binary()), pa.array(h, pa.binary())], names=[*batch.schema.names, "g", "h"])

        return state.mapInArrow(apply, self.schema + ", g binary, h binary")

    def _by_pairs(self, state: DataFrame) -> DataFrame:
        """Gradients where queries are several records: partial sums of all pairs of records."""
        ndcg = self.objective == "ndcg"

        def paired(one: DataFrame, more: list[str]) -> DataFrame:
            cols = ["chunk", "label", "row", "score", *more]
            return one.select("qid", "ideal", *cols).join(one.select("qid", *[F.col(c).alias(f"{c}_2") for c in cols]), "qid")

        def met(pairs: DataFrame, names: list[str], work) -> DataFrame:
            def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = [work(r) for r in batch.to_pylist()]
                    arrays = [pa.array([f[k].tolist() for f in found], pa.list_(pa.int64())) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("chunk"), *arrays], names=["qid", "chunk", *names])

            sums = _sum_by_record(pairs.repartition("qid", "chunk", "chunk_2").mapInArrow(apply, f"qid {self.kind}, chunk long, " + ", ".join(f"{n} array<long>" for n in names)), names)
            return sums.select("qid", "chunk", *[F.col(f"sums.{n}").alias(n) for n in names])

        def before(r: dict) -> tuple:
            return (ranks_within(_f8(r["score"]), _i8(r["row"]), _f8(r["score_2"]), _i8(r["row_2"])).astype(np.int64),)

        def gradients(r: dict) -> tuple:
            ranks = [np.array(r[c]) for c in ("rank", "rank_2")] if ndcg else [None, None]
            return pair_gradients(_f8(r["label"]), _f8(r["score"]), _f8(r["label_2"]), _f8(r["score_2"]), *ranks, r["ideal"])

        ranked = state.join(met(paired(state, []), ["rank"], before), ["qid", "chunk"]) if ndcg else state
        sums = met(paired(ranked, ["rank"] if ndcg else []), ["g", "h"], gradients)

        def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = [pa.array([np.array(v, np.int64).tobytes() for v in batch.column(c).to_pylist()], pa.binary()) for c in ("g", "h")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:8], *both], names=batch.schema.names)

        return state.join(sums, ["qid", "chunk"]).select(*state.columns, "g", "h").mapInArrow(bytes_of, self.schema + ", g binary, h binary")

    def round(self, tree: Tree | None) -> None:
        """Writes the state after ``tree``; what came before it can go once it is there."""
        path = scratch(self.spark, "round")
        moved = self._moved(tree)
        (self._by_pairs(moved) if self.split else self._whole(moved)).write.parquet(path)
        self.state = self.spark.read.parquet(path)
        self.forget()
        self.paths = [path]

    def forget(self) -> None:
        for path in self.paths:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def histograms(self, tree: Tree, open_nodes: list[int], columns: list[int], kept_row) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(node, feature) -> sums of gradients and curvatures by bin."""
        width, slots = self.width, {node: k for k, node in enumerate(open_nodes)}
        most = max((len(c) for c in self.cuts), default=0) + 2

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, len(open_nodes) * width * most), np.int64)
            place = np.full(len(tree.feature), -1)
            place[list(slots)] = list(slots.values())
            for batch in batches:
                for row, bins, g, h in zip(*(batch.column(c).to_pylist() for c in ("row", "bins", "g", "h")), strict=True):
                    x = np.frombuffer(bins, np.uint8).reshape(-1, width).astype(np.int64)
                    slot = place[tree.leaves(x, binned=True)]
                    use = np.flatnonzero((slot >= 0) & kept_row(_i8(row)))
                    for f in columns:
                        at = (slot[use] * width + f) * most + x[use, f]
                        np.add.at(sums[0], at, _i8(g)[use])
                        np.add.at(sums[1], at, _i8(h)[use])
            at = np.flatnonzero(sums.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["at", "g", "h"])

        found = self.state.select("row", "bins", "g", "h").mapInArrow(apply, "at long, g long, h long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        sums = np.zeros((2, len(open_nodes) * width * most), np.int64)
        sums[:, found.column("at").to_numpy()] = found.column("g").to_numpy(), found.column("h").to_numpy()
        sums = sums.reshape(2, len(open_nodes), width, most)
        return {(node, f): (sums[0, k, f], sums[1, k, f]) for node, k in slots.items() for f in columns}


def best_split(histograms: dict[int, tuple[np.ndarray, np.ndarray]], cuts: list[np.ndarray], least: float, pull: float, gamma: float) -> tuple[float, int, int, float, float]:
    """(gain, feature, bin, sum of gradients, of curvatures) from {feature: sums by bin}; feature -1 where none gains."""
    best = (0.0, -1, 0)
    total_g = total_h = 0.0
    for f, (g, h) in sorted(histograms.items()):
        g, h = g.astype(np.float64) / 2.0**SCALE, h.astype(np.float64) / 2.0**SCALE
        total_g, total_h = g.sum(), h.sum()
        left_g, left_h = np.cumsum(g)[: len(cuts[f]) + 1], np.cumsum(h)[: len(cuts[f]) + 1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = 0.5 * (left_g**2 / (left_h + pull) + right_g**2 / (right_h + pull) - total_g**2 / (total_h + pull)) - gamma
        gain = np.where((left_h >= least) & (right_h >= least), np.round(gain, 9), 0.0)
        k = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[k] > best[0] + 1e-9:
            best = float(gain[k]), f, k
    return *best, total_g, total_h


def train(df: DataFrame, features: list[str], query: str = "qid", label: str = "label", doc: str = "doc_id", rounds: int = 100, rate: float = 0.1, depth: int = 6, least: float = 1.0, gamma: float = 0.0, pull: float = 1.0, row_share: float = 0.8, column_share: float = 0.8, bins: int = 64, objective: str = "pairwise", seed: int = 42, chunk: int = CHUNK) -> Ensemble:
    """Boosts ``rounds`` trees; the defaults of rate, depth and shares are those usual for tree rankers.

    Rows of a tree are chosen by a hash of the row and the tree, so the sample is the same for any layout of the data.
    """
    if not 3 <= bins <= 256:
        raise ValueError("bins must be 3 to 256")
    cuts = cut_points(df, features, bins)
    run = _Training(df, features, cuts, query, label, doc, objective, chunk)
    rng = np.random.default_rng(seed)
    trees: list[Tree] = []
    for turn in range(rounds):
        run.round(trees[-1] if trees else None)
        columns = sorted(rng.choice(len(features), max(1, round(column_share * len(features))), replace=False).tolist())
        salt = int(rng.integers(1, 1 << 62))

        def kept_row(row: np.ndarray, salt: int = salt) -> np.ndarray:
            mixed = (row ^ salt).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            return (mixed >> np.uint64(11)).astype(np.float64) < row_share * 2.0**53

        trees.append(grow(run, cuts, columns, kept_row, depth, rate, least, gamma, pull))
    run.forget()
    return Ensemble(list(features), trees)


def grow(run: _Training, cuts: list[np.ndarray], columns: list[int], kept_row, depth: int, rate: float, least: float, gamma: float, pull: float) -> Tree:
    tree, open_nodes = Tree(), [0]
    for level in range(depth + 1):
        found = run.histograms(tree, open_nodes, columns, kept_row)
        following = []
        for node in open_nodes:
            gain, f, k, g, h = best_split({c: found[node, c] for c in columns}, cuts, least, pull, gamma)
            tree.value[node] = -rate * g / (h + pull)
            if f >= 0 and level < depth:
                tree.feature[node], tree.bin[node], tree.gain[node] = f, k, gain
                tree.cut[node] = float(cuts[f][k - 1]) if k else _MISSING
                tree.left[node] = tree.add()
                following += [tree.left[node], tree.add()]
        open_nodes = following
        if not open_nodes:
            break
    return tree

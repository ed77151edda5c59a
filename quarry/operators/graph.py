"""Link graphs: node and edge tables, motifs, merging, and iterative scores.

A graph is a pair of DataFrames: nodes (id, ...) and edges (src, dst[, weight]). Iterative scores cut their
lineage every few rounds and never collect more than one row per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.lineage import broadcast_if_small, cut, discard, materialise, spread_join


def dense_ids(df: DataFrame, key: str, as_: str = "idx") -> DataFrame:
    """0-based contiguous ids in key order: counts per key range give offsets, so no task sorts all rows."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(order), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(sizes), "_part").withColumn(as_, (F.col("_before") + F.col("_local")).cast("long")).drop("_part", "_local", "_before")


def article_nodes(pages: DataFrame, id_map: DataFrame) -> DataFrame:
    """Non-redirect articles of namespace 0 that have an entity, once each. The redirect flag is text."""
    articles = pages.where((F.col("namespace") == 0) & (F.col("is_redirect") == "0")).select("id")
    return articles.join(id_map, "id").distinct()


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with both ends in ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def edges_touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with either end in ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst").union(
        edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    ).distinct()


def one_hop(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct links between two different articles, weight 1."""
    return edges_between(edges.where("src <> dst"), articles).withColumn("weight", F.lit(1).cast("long"))


def two_hop(edges: DataFrame, articles: DataFrame, middles: DataFrame) -> DataFrame:
    """a -> b -> c with a <> c articles and b a middle; the weight is the number of paths."""
    a = articles.select("id")
    m = middles.select("id")
    out_of = edges.join(a.withColumnRenamed("id", "src"), "src", "left_semi").join(m.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", F.col("dst").alias("mid"))
    into = edges.join(m.withColumnRenamed("id", "src"), "src", "left_semi").join(a.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("mid"), "dst")
    return spread_join(out_of, into, "mid").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def shared_target(edges: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """(src, dst, kind, weight): pairs of sources that link to one target. ``most`` leaves out hubs, as a stated
    parameter of the operator: a hub of n links alone gives n squared pairs."""
    into = edges.join(targets.select(F.col("id").alias("dst"), "kind"), "dst").select("src", "dst", "kind").distinct()
    if most is not None:
        small = into.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("dst")
        into = into.join(small, "dst", "left_semi")
    other = into.select(F.col("src").alias("other"), "dst")
    return spread_join(into, other, "dst").where("src <> other").groupBy("src", F.col("other").alias("dst"), "kind").agg(F.count(F.lit(1)).alias("weight"))


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_semi")


def merge(graphs: list[tuple[DataFrame, float]], scale_existing: bool = False) -> DataFrame:
    """Sum of weights over graphs. A missing weight is taken from ``score`` or is 1 times the multiplier; a given
    weight is left as it is unless ``scale_existing``."""
    out = None
    for edges, by in graphs:
        if "weight" not in edges.columns and "score" in edges.columns:
            edges = edges.withColumnRenamed("score", "weight")
        if "weight" not in edges.columns:
            weight = F.lit(by)
        else:
            weight = F.col("weight") * by if scale_existing else F.col("weight")
        one = edges.select("src", "dst", weight.cast("double").alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def knn_edges(knn: DataFrame, k: int, include_self_slot: bool = True, reverse: bool = True) -> DataFrame:
    """Neighbour lists (id, neighbors, scores) as edges. The rank is 0-based and ``rank <= k`` keeps k + 1 slots, one
    of them usually the node itself, which goes as a self-loop."""
    pairs = knn.select("id", F.posexplode(F.arrays_zip("neighbors", "scores")).alias("rank", "x"))
    kept = pairs.where(F.col("rank") <= (k if include_self_slot else k - 1))
    ends = (F.col("x.neighbors").alias("src"), F.col("id").alias("dst")) if reverse else (F.col("id").alias("src"), F.col("x.neighbors").alias("dst"))
    return kept.select(*ends, F.col("x.scores").alias("score"), "rank").where("src <> dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree), 0 for isolated nodes, in one shuffle of the edge ends."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counts = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").join(counts, "id", "left").fillna(0, ["in_degree", "out_degree"])


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees over n - 1."""
    n = nodes.agg((F.count(F.lit(1)) - 1).alias("m"))
    return degrees(nodes, edges).crossJoin(F.broadcast(n)).select("id", F.try_divide("in_degree", "m").alias("in_centrality"), F.try_divide("out_degree", "m").alias("out_centrality"))


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, teleport: DataFrame, alpha: float = 0.85, iterations: int | None = None, tolerance: float = 1e-8, most: int = 100, every: int = 5) -> DataFrame:
    """(qid, id, score) for all queries in one loop. ``teleport`` is (qid, id, p) with p summing to 1 per query.

    Mass of nodes without links goes to the teleport vector. ``iterations`` fixes the rounds; else the loop ends
    when the L1 change per query is below ``tolerance`` times the number of nodes.
    """
    out_weight = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    moves = cut(edges.join(out_weight, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    linked = out_weight.select(F.col("src").alias("id"), F.lit(1).alias("linked"))
    teleport = cut(teleport.select("qid", "id", "p"))
    scores, n, turn = teleport.select("qid", "id", F.col("p").alias("score")), None, 0
    while True:
        turn += 1
        flow = scores.withColumnRenamed("id", "src").join(moves, "src").groupBy("qid", F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        loose = scores.join(linked, "id", "left").groupBy("qid").agg(F.sum(F.when(F.col("linked").isNull(), F.col("score")).otherwise(0.0)).alias("loose"))
        base = teleport.join(loose, "qid").select("qid", "id", ((1 - alpha + alpha * F.col("loose")) * F.col("p")).alias("base"))
        fresh = flow.join(base, ["qid", "id"], "full_outer").select("qid", "id", (alpha * F.coalesce("flow", F.lit(0.0)) + F.coalesce("base", F.lit(0.0))).alias("score"))
        if iterations is not None:
            scores = cut(fresh) if turn % every == 0 else fresh
            if turn >= iterations:
                return scores
            continue
        n = n or nodes.count()
        old, fresh = scores, cut(fresh)
        change = fresh.join(old.withColumnRenamed("score", "old"), ["qid", "id"], "full_outer").groupBy("qid").agg(
            F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("d")).agg(F.max("d")).first()[0]
        scores = fresh
        if turn >= most or (change or 0.0) < tolerance * n:
            return scores


#: Nodes of a block, whose sums a task holds, and moves that it adds up at once.
BLOCK_NODES, MOVES = 1 << 14, 1 << 16

#: What a step reads, by block, source and kind. The block's row (kind -2) has its nodes: twice how many blocks each sends to, and one
#: more if it is watched (``off``), their ids (``by``) and those blocks (``v``). A row of links (kind -1) has places in the
#: block and shares. Vectors have the number of their block of queries as kind; they go along the links of their source, or those they bring.
_ROUTED = "to int, src long, kind int, off binary, by binary, v binary"

#: Blocks that are none: sums of nodes without links, sizes of all, and vectors of watched nodes.
_LOOSE, _SIZES, _WATCHED = -1, -2, -3


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of packed rows, one row after the other, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return data, np.diff(ends) // data.itemsize


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of the packed doubles of all rows."""
    return _flat(column, np.float64)[0].reshape(-1, width)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Packed numbers, ``counts`` of them in each row."""
    ends = np.append(0, np.cumsum(counts * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _packed(blk: np.ndarray, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blk, pa.int32()), pa.array(ids, pa.int64()), _binary(values, np.full(len(values), values.shape[1]))], names=["blk", "id", "v"])


def _routed(to: np.ndarray, src: np.ndarray | None, blk: int, values: np.ndarray) -> pa.RecordBatch:
    n, none = len(to), pa.nulls(len(to), pa.binary())
    own = pa.nulls(n, pa.int64()) if src is None else pa.array(src, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), own, pa.array(np.full(n, blk), pa.int32()), none, none, _binary(values, np.full(n, values.shape[1]))], names=["to", "src", "kind", "off", "by", "v"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            flat, counts = batch.column(2).flatten(), batch.column(2).value_lengths().to_numpy()
            columns = [batch.column(0), batch.column(1), pa.array(np.full(len(counts), -1), pa.int32()), _binary(flat.field("off").to_numpy(), counts), _binary(flat.field("by").to_numpy(), counts), pa.nulls(len(counts), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["to", "src", "kind", "off", "by", "v"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for to, nodes in zip(batch.column(0), batch.column(1), strict=True):
            nodes = nodes.values
            lists = nodes.field("sends")
            counts, sends = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            head = 2 * counts + nodes.field("watched").to_numpy(zero_copy_only=False)
            columns = [pa.array([to.as_py()], pa.int32()), pa.nulls(1, pa.int64()), pa.array([-2], pa.int32()), *(_binary(x, np.array([len(x)])) for x in (head.astype(np.int32), nodes.field("id").to_numpy(), sends.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["to", "src", "kind", "off", "by", "v"])


def _stepped(width: int, last: bool, watch: bool):
    """Sums of what vectors carry along links, a block of nodes at a time; then routed anew, or (blk, id, v) of the last step.
    NaN (no row) adds nothing."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes, sums, known = None, (), {}, {}
        held = np.zeros(0, np.int32), np.zeros(0)

        def told() -> Iterator[pa.RecordBatch]:
            for blk in sums:
                at = np.flatnonzero(known[blk].any(axis=1))
                values = np.where(known[blk], sums[blk], np.nan)[at]
                head, ids, sends = nodes
                if last:
                    yield _packed(np.full(len(at), blk), ids[at], values)
                    continue
                counts = head >> 1
                ends = np.cumsum(counts)
                loose, watched = counts[at] == 0, head[at] & 1 == 1
                yield _routed(np.array([_LOOSE]), None, blk, np.nan_to_num(values[loose]).sum(axis=0)[None, :])
                if watch:
                    yield _routed(np.array([_SIZES]), None, blk, np.abs(np.nan_to_num(values)).sum(axis=0)[None, :])
                    yield _routed(np.full(watched.sum(), _WATCHED), ids[at][watched], blk, values[watched])
                for a in range(0, len(at), 1024):
                    part = at[a : a + 1024]
                    n = counts[part]
                    row = np.repeat(np.arange(len(part)), n)
                    to = sends[np.repeat(ends[part] - np.cumsum(n), n) + np.arange(n.sum())]
                    yield _routed(to, ids[part][row], blk, values[a : a + 1024][row])

        def add(rows: pa.RecordBatch) -> None:
            nonlocal nodes, held
            kind = rows.column(2).to_numpy()
            off, counts = _flat(rows.column(3), np.int32)
            by, _ = _flat(rows.column(4), np.float64)
            # Row 0 are the links of the source that the rows before ended with.
            off, by, counts = np.concatenate([held[0], off]), np.concatenate([held[1], by]), np.append(len(held[0]), counts)
            begins = np.cumsum(counts) - counts
            if kind[0] == -2:
                own = slice(begins[1], begins[1] + counts[1])
                nodes = off[own].copy(), by[own].copy().view(np.int64), np.frombuffer(rows.column(5)[0].as_py(), np.int32)
            link = np.maximum.accumulate(np.append(0, np.where(kind == -1, np.arange(1, len(kind) + 1), 0)))
            own = slice(begins[link[-1]], begins[link[-1]] + counts[link[-1]])
            at = np.flatnonzero(kind >= 0)
            if len(at):
                values = _vectors(rows.column(5).filter(pa.array(kind >= 0)), width)
                real = ~np.isnan(values)
                values = np.where(real, values, 0.0)
                mine = np.where(counts[at + 1] > 0, at + 1, link[at + 1])
                n = counts[mine]
                for blk in np.unique(kind[at]).tolist():
                    if blk not in sums:
                        sums[blk], known[blk] = np.zeros((BLOCK_NODES, width)), np.zeros((BLOCK_NODES, width), bool)
                    few = np.flatnonzero(kind[at] == blk)
                    total = int(n[few].sum())
                    row = np.repeat(few, n[few])
                    place = np.repeat(begins[mine[few]] - (np.cumsum(n[few]) - n[few]), n[few]) + np.arange(total)
                    for a in range(0, total, MOVES):
                        to = off[place[a : a + MOVES]]
                        order = np.argsort(to, kind="stable")
                        to, src = to[order], row[a : a + MOVES][order]
                        first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                        sums[blk][to[first]] += np.add.reduceat(values[src] * by[place[a : a + MOVES]][order][:, None], first, axis=0)
                        known[blk][to[first]] |= np.logical_or.reduceat(real[src], first, axis=0)
            held = off[own].copy(), by[own].copy()

        for batch in batches:
            to = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if to[a] != block:
                    yield from told()
                    block, nodes, sums, known = to[a], (), {}, {}
                    held = np.zeros(0, np.int32), np.zeros(0)
                add(batch.slice(a, b - a))
        yield from told()

    return apply


class BlockWalk:
    """Walks of queries over a graph in blocks of nodes that follow each other by id.

    Queries are dealt to blocks of at most ``width``; a node has one vector of doubles for each block of queries that reaches it,
    with NaN for a query that does not. A step sends a node's vector once to each block of nodes that it links to, not once
    a link, and shuffles once: vectors meet the links of their source there, sorted by source, and are added up for
    the nodes of the block in numpy. A node with any number of links is never held whole. ``start`` is (blk, id, v).
    """

    def __init__(self, edges: DataFrame, teleport: DataFrame, alpha: float, width: int) -> None:
        self.alpha = alpha
        slots = cut(dense_ids(teleport.select("qid").distinct(), "qid", "slot"))
        self.width = width = max(1, min(width, slots.count()))
        self.slots = broadcast_if_small(slots)

        def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    flat, values = batch.column(2).flatten(), np.full((batch.num_rows, width), np.nan)
                    values[batch.column(2).value_parent_indices().to_numpy(), flat.field("at").to_numpy()] = flat.field("p").to_numpy()
                    yield _packed(batch.column(0).to_numpy(), batch.column(1).to_numpy(), values)

        dealt = teleport.join(self.slots, "qid").select(F.floor(F.col("slot") / width).cast("int").alias("blk"), F.col("id").cast("long").alias("id"), F.struct((F.col("slot") % width).cast("int").alias("at"), F.col("p").cast("double").alias("p")).alias("x"))
        start = materialise(dealt.groupBy("blk", "id").agg(F.collect_list("x").alias("x")).mapInArrow(laid, "blk int, id long, v binary"))
        total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
        moves = edges.join(total, "src").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), (alpha * F.col("weight") / F.col("total")).alias("by"))
        moves = materialise(moves)
        seeds = start.select("id").distinct()
        ids = moves.select(F.col("dst").alias("id")).union(seeds).distinct()
        size = F.lit(BLOCK_NODES)
        nodes = dense_ids(ids, "id").select("id", F.floor(F.col("idx") / size).cast("int").alias("to"), (F.col("idx") % size).cast("int").alias("off"))
        nodes = materialise(nodes)
        links = moves.join(nodes.withColumnRenamed("id", "dst"), "dst").groupBy("to", "src").agg(F.collect_list(F.struct("off", "by")).alias("x"))
        self.links = materialise(links.mapInArrow(_links, _ROUTED))
        sends = self.links.groupBy(F.col("src").alias("id")).agg(F.collect_list("to").alias("sends"))
        named = nodes.join(sends, "id", "left").join(seeds.withColumn("watched", F.lit(1)), "id", "left")
        named = materialise(named.select("to", "off", "id", F.coalesce("watched", F.lit(0)).alias("watched"), F.coalesce("sends", F.array().cast("array<int>")).alias("sends")))
        listed = named.groupBy("to").agg(F.sort_array(F.collect_list(F.struct("off", "id", "watched", "sends"))).alias("x"))
        self.blocks = materialise(listed.mapInArrow(_blocks, _ROUTED))
        self.parts = max(1, self.blocks.count())
        self.ends = not named.where(F.size("sends") == 0).isEmpty()
        self.start = materialise(start.join(named.select("id", "to", "off", "sends"), "id"))
        for df in (start, moves, nodes, named):
            discard(df)

    def first(self) -> DataFrame:
        """The start, routed."""
        none = F.lit(None).cast("binary")
        to = F.when(F.size("sends") == 0, F.array(F.lit(_LOOSE))).otherwise(F.col("sends"))
        return self.start.select(F.explode(to).alias("to"), F.col("id").alias("src"), F.col("blk").alias("kind"), none.alias("off"), none.alias("by"), "v")

    def base(self, own: float, sent: DataFrame) -> DataFrame:
        """``own`` times the start, and alpha times it for the mass of ``sent`` that stands at nodes without links."""
        width, alpha = self.width, self.alpha
        rows = self.start.select("to", "blk", "off", "v")
        rows = rows.join(self.added(sent, _LOOSE).withColumnRenamed("v", "loose"), "blk", "left") if self.ends else rows.withColumn("loose", F.lit(None).cast("binary"))

        def based(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros(width).tobytes()
            for batch in batches:
                if batch.num_rows:
                    n, one = batch.num_rows, np.ones(batch.num_rows, np.int64)
                    values = _vectors(batch.column(3), width) * (own + alpha * _vectors(batch.column(4).fill_null(none), width))
                    columns = [batch.column(0), pa.nulls(n, pa.int64()), batch.column(1), _binary(batch.column(2).to_numpy(), one), _binary(np.ones(n), one), _binary(values, np.full(n, width))]
                    yield pa.RecordBatch.from_arrays(columns, names=["to", "src", "kind", "off", "by", "v"])

        return rows.select("to", "blk", "off", "v", "loose").mapInArrow(based, _ROUTED)

    def added(self, sent: DataFrame, to: int) -> DataFrame:
        """(blk, v): sums of the rows for a block that is none, one or a few for each block of nodes."""
        width = self.width

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                blk, values = batch.column(0).to_numpy(), np.nan_to_num(_vectors(batch.column(1), width))
                for one in np.unique(blk).tolist():
                    sums[one] = sums.get(one, 0) + values[blk == one].sum(axis=0)
            if sums:
                yield _packed(np.array(list(sums)), np.zeros(len(sums), np.int64), np.stack(list(sums.values()))).select(["blk", "v"])

        rows = sent.where(F.col("to") == to).select(F.col("kind").alias("blk"), "v")
        return rows.mapInArrow(summed, "blk int, v binary").repartition("blk").mapInArrow(summed, "blk int, v binary")

    def step(self, sent: DataFrame, base: DataFrame | None, last: bool = False, watch: bool = False) -> DataFrame:
        rows = self.links.unionByName(self.blocks).unionByName(sent.where("to >= 0"))
        rows = rows if base is None else rows.unionByName(base)
        dealt = rows.repartition(self.parts, "to").sortWithinPartitions("to", "src", "kind")
        return dealt.mapInArrow(_stepped(self.width, last, watch), "blk int, id long, v binary" if last else _ROUTED)

    def spelled(self, state: DataFrame, value: str = "score") -> DataFrame:
        """(qid, id, score) of (blk, id, v)."""
        width = self.width

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    values = _vectors(batch.column(2), width)
                    row, at = np.nonzero(~np.isnan(values))
                    slot = batch.column(0).to_numpy()[row].astype(np.int64) * width + at
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(batch.column(1).to_numpy()[row]), pa.array(values[row, at])], names=["slot", "id", value])

        return state.mapInArrow(rows, f"slot long, id long, {value} double").join(self.slots, "slot").select("qid", "id", value)


def personalized_pagerank_dense(edges: DataFrame, teleport: DataFrame, alpha: float = 0.85, iterations: int = 3, width: int = 64, every: int = 5) -> DataFrame:
    """The rows of ``personalized_pagerank`` after so many rounds, for queries that reach much of the graph (``BlockWalk``)."""
    walk = BlockWalk(edges, teleport, alpha, width)
    sent = walk.first()
    for turn in range(1, iterations + 1):
        last = turn == iterations
        sent = walk.step(sent, walk.base(1 - alpha, sent), last)
        sent = materialise(sent) if not last and (walk.ends or turn % every == 0) else sent
    return walk.spelled(sent if iterations else walk.start.select("blk", "id", "v"))


def personalized_pagerank_push(edges: DataFrame, teleport: DataFrame, alpha: float = 0.85, tolerance: float = 1e-8, most: int = 400) -> DataFrame:
    """(qid, id, score): personalised walks of many queries by pushing residuals; only what is reached has a row.

    ``teleport`` is (qid, id, p) with p summing to 1 per query. A pair (query, node) keeps 1 - alpha of its residual as
    score and passes the rest along its links (a node without links: back to the teleport vector), but only while the
    size of its residual exceeds ``tolerance`` times its number of links (at least 1). The walk begins with the teleport
    vector itself as score, and with the residual that is owed to it: alpha / (1 - alpha) times what one move changes.
    Residuals then have both signs and sum to 0, and cancel as fast as the graph mixes; from no score at all, a graph
    that is reached as a whole takes steps until alpha alone has made them small. A query's scores differ from the exact
    ones by at most the sizes of the residuals that are left, all together, under tolerance x (links + reached nodes).
    Work follows the mass that still moves: queries that are settled cost nothing any more.

    Links are dealt to partitions once; a step joins the active pairs to them, adds up in one shuffle and is written to
    the shared folder, as the next one reads it more than once.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("degree"))
    degree = out.select(F.col("src").alias("id"), "degree")
    shares = edges.join(out.select("src", "total"), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    moves = cut(shares.join(degree.withColumnRenamed("id", "dst"), "dst", "left").select(F.col("src").alias("id"), "dst", "share", F.coalesce("degree", F.lit(0)).alias("to_degree")))
    moves = moves.repartition(max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "id").persist()
    start = cut(teleport.join(degree, "id", "left").select("qid", "id", "p", F.coalesce("degree", F.lit(0)).alias("degree")))
    moving = F.abs("residual") > tolerance * F.greatest("degree", F.lit(1))
    ends = not start.where("degree = 0").isEmpty() or not moves.where("to_degree = 0").isEmpty()

    def moved(kept: DataFrame, active: DataFrame, by: float) -> DataFrame:
        """``kept`` plus ``by`` times the residuals of ``active``, one move on."""
        passed = active.join(moves, "id").select("qid", F.col("dst").alias("id"), F.lit(0.0).alias("score"), (by * F.col("residual") * F.col("share")).alias("residual"), F.col("to_degree").alias("degree"))
        parts = kept.unionByName(passed)
        if ends:
            loose = active.where("degree = 0").groupBy("qid").agg(F.sum("residual").alias("loose"))
            parts = parts.unionByName(start.join(loose, "qid").select("qid", "id", F.lit(0.0).alias("score"), (by * F.col("loose") * F.col("p")).alias("residual"), "degree"))
        return cut(parts.groupBy("qid", "id").agg(F.sum("score").alias("score"), F.sum("residual").alias("residual"), F.max("degree").alias("degree")))

    owed = alpha / (1 - alpha)
    first = start.select("qid", "id", F.col("p").alias("score"), (-owed * F.col("p")).alias("residual"), "degree")
    state = moved(first, start.select("qid", "id", F.col("p").alias("residual"), "degree"), owed)
    for _ in range(most):
        active = state.where(moving)
        if active.isEmpty():
            break
        kept = state.select("qid", "id", F.when(moving, F.col("score") + (1 - alpha) * F.col("residual")).otherwise(F.col("score")).alias("score"), F.when(moving, 0.0).otherwise(F.col("residual")).alias("residual"), "degree")
        state = moved(kept, active, alpha)
    moves.unpersist()
    return state.where("score > 0").select("qid", "id", "score")


def rerank_by_walk(run: DataFrame, edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-8, digits: int | None = None, width: int = 64, most: int = 400) -> DataFrame:
    """A run (qid, doc_id, ...) with the score of a walk that starts from all documents that its query retrieved, each
    with one share, and the rank by it. Documents without a link of their own are no nodes: they start nothing and go.
    ``digits`` rounds scores before they are ranked; ties go by doc_id.

    The walk (``BlockWalk``) begins with the shares as scores and moves on what a step changes, which sums to 0 and
    fades as fast as the graph mixes. It ends when all changes still to come add up to ``tolerance`` at most for each
    query. Only the documents of the run keep their changes, which are their scores in the end.
    """
    known = materialise(run.join(edges.select(F.col("src").alias("doc_id")).union(edges.select("dst")).distinct(), "doc_id", "left_semi"))
    each = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    starts = known.select("qid", "doc_id").distinct().select("qid", F.col("doc_id").alias("id"), (1.0 / each).alias("p"))
    walk = BlockWalk(edges, starts, alpha, width)
    found, sent = [walk.start.select("blk", "id", "v")], walk.first()
    for turn in range(most):
        # First the scores themselves move: alpha of them along the links, less alpha of the start.
        base = walk.base(-alpha, sent) if not turn else walk.base(0.0, sent) if walk.ends else None
        old, sent = sent, materialise(walk.step(sent, base, watch=True))
        if turn:
            discard(old)
        found.append(materialise(sent.where(F.col("to") == _WATCHED).select(F.col("kind").alias("blk"), F.col("src").alias("id"), "v")))
        left = max((float(np.frombuffer(r.v).max()) for r in walk.added(sent, _SIZES).toLocalIterator()), default=0.0)
        if left * alpha / (1 - alpha) <= tolerance:
            break
    changes = found[0]
    for one in found[1:]:
        changes = changes.unionByName(one)
    walked = walk.spelled(changes).groupBy("qid", F.col("id").alias("doc_id")).agg(F.sum("score").alias("score"))
    walked = walked if digits is None else walked.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return known.drop("score", "rank").join(walked, ["qid", "doc_id"]).withColumn("rank", F.row_number().over(order))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int | None = None, tolerance: float = 1e-10, most: int = 200) -> DataFrame:
    """(id, score): the personalised walk of one query whose teleport vector is uniform over all nodes."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    teleport = nodes.crossJoin(F.broadcast(n)).select(F.lit(0).alias("qid"), "id", (1.0 / F.col("n")).alias("p"))
    return personalized_pagerank(nodes, edges, teleport, alpha, iterations, tolerance, most).select("id", "score")


def hits(nodes: DataFrame, edges: DataFrame, iterations: int | None = None, tolerance: float = 1e-8, most: int = 100, every: int = 5) -> DataFrame:
    """(id, hub, authority), each summing to 1."""
    edges = cut(edges.select("src", "dst", "weight"))
    hub = nodes.crossJoin(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")))).select("id", (1.0 / F.col("n")).alias("hub"))

    def scaled(df: DataFrame, value: str) -> DataFrame:
        total = df.agg(F.sum(value).alias("total"))
        return df.crossJoin(F.broadcast(total)).select("id", F.coalesce(F.try_divide(value, "total"), F.lit(0.0)).alias(value))

    turn = 0
    while True:
        turn += 1
        authority = scaled(edges.join(hub, edges["src"] == hub["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("weight") * F.col("hub")).alias("authority")), "authority")
        fresh = scaled(edges.join(authority, edges["dst"] == authority["id"]).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("authority")).alias("hub")), "hub")
        old, hub = hub, cut(fresh) if iterations is None or turn % every == 0 else fresh
        if iterations is None:
            change = hub.join(old.withColumnRenamed("hub", "old"), "id", "full_outer").agg(F.sum(F.abs(F.coalesce("hub", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        if turn >= (iterations or most) or (iterations is None and (change or 0.0) < tolerance):
            return nodes.select("id").join(hub, "id", "left").join(authority, "id", "left").fillna(0.0)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) by the least id of each weakly connected component, with pointer jumping."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        closer = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        fresh = cut(closer.join(up, "component").select("id", "old", F.least("component", "up").alias("component")))
        labels = fresh.select("id", "component")
        if fresh.where("old <> component").isEmpty():
            return labels

"""Sharding by a k-d tree over document metadata, in DataFrame functions only.

A node that must hold k shards is cut in floor(k/2) and ceil(k/2) along the dimension in which its rows
reach widest, at the weighted quantile of the bytes; coordinates are scaled to one range at the root. The
reach of all nodes of a level is measured in one aggregate. Quantiles are found by refining histograms: every round counts bytes per
(node, bin) over all rows and brings at most ``BINS`` sums to the driver. The text is read once;
later rounds read the narrow metadata table.

A position along a dimension is the coordinate followed by a hash of the row, so that rows that tie on the
coordinate (one source with a third of all rows, say) can still be cut in equal parts.

Defined cases: a null text has no bytes; null metadata takes coordinate 0; copies, ties and repeated rows
are spread like any others; an empty table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import blocks, documents, materialise

#: Bins of all nodes of a level together: the driver never gets more sums than this in a round.
BINS = 1 << 14
_COORD_BITS, _TIE_BITS = 30, 31


@dataclass
class Node:
    """A tree node in heap order (children of i: 2i+1 and 2i+2). ``first`` is its first shard; a leaf has dim -1."""

    first: int
    leaves: int
    weight: int = 0
    #: Lowest and highest coordinate of the node's rows along each dimension.
    reach: tuple[tuple[int, int], ...] = ()
    dim: int = -1
    cut: int = 0
    left_weight: int = 0


def _table(values: list, key: Column) -> Column:
    """values[key] by one constant array: generated code stays small for any number of nodes."""
    return F.element_at(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), key + 1)


def metadata_dimensions(docs: DataFrame, id_col: str, size: Column) -> list[Column]:
    """Crawl order, length on a log scale, and a hash ordinal for each categorical column that is there."""
    ordinal = lambda c: (F.xxhash64(c).bitwiseAND(F.lit((1 << 30) - 1))).cast("double")
    dims = [F.col(id_col).cast("double"), F.log1p(size.cast("double"))]
    return dims + [F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(ordinal(F.col(c))) for c in ("lang", "source") if c in docs.columns]


def place(rows: DataFrame, tree: dict[int, Node], depth: int) -> DataFrame:
    """Adds ``node``: the leaf of the tree so far that holds the row, whose positions are the array ``p``.

    The walk is one fold over ``depth`` steps, so the plan of every round is small and the same.
    """
    size = max(tree) + 1
    dims = [tree[i].dim if 2 * i + 1 in tree else -1 for i in range(size)]
    cuts = [tree[i].cut if i in tree else 0 for i in range(size)]

    def step(node: Column, _: Column) -> Column:
        dim = _table(dims, node)
        right = (F.element_at("p", (F.greatest(dim, F.lit(0)) + 1).cast("int")) >= _table(cuts, node)).cast("int")
        return F.when(dim < 0, node).otherwise(node * 2 + 1 + right)

    return rows.withColumn("node", F.aggregate(F.array_repeat(F.lit(0), depth), F.lit(0), step))


def _cuts(at: DataFrame, active: dict[int, Node], tolerance: float) -> None:
    """Set ``cut`` of each active node to its weighted quantile along ``dim``."""
    wanted = {i: n.weight * (n.leaves // 2) / n.leaves for i, n in active.items()}
    before = dict.fromkeys(active, 0)
    span = {i: (n.reach[n.dim][0] << _TIE_BITS, (n.reach[n.dim][1] + 1) << _TIE_BITS) for i, n in active.items()}
    size = max(active) + 1
    per_node = max(128, BINS // len(active))
    listed = lambda of, default: [of(i) if i in span else default for i in range(size)]
    while span:
        key = F.when(F.col("node") < size, F.col("node")).otherwise(0)
        rows = (
            at.withColumn("low", _table(listed(lambda i: span[i][0], 1), key))
            .withColumn("high", _table(listed(lambda i: span[i][1], 0), key))
            .withColumn("step", _table(listed(lambda i: -(-(span[i][1] - span[i][0]) // per_node), 1), key))
            .withColumn("pos", F.element_at("p", (_table(listed(lambda i: active[i].dim, 0), key) + 1).cast("int")))
        )
        # Rows outside the open spans fall in a null bin: a filter here would be pushed below, copying the tree walk.
        inside = (F.col("node") < size) & (F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high"))
        binned = rows.withColumn("bin", F.when(inside, F.floor((F.col("pos") - F.col("low")) / F.col("step"))))
        found: dict[int, list] = {}
        sums = binned.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        for node, b, *r in zip(*(c.to_pylist() for c in sums.select("node", "bin", "lo", "hi", "w", "n").toArrow().columns), strict=True):
            if b is not None:
                found.setdefault(node, []).append(tuple(r))
        for i in list(span):
            bins = sorted(found.get(i, []))
            for k, (lo, hi, w, n) in enumerate(bins):
                if before[i] + w < wanted[i] and k + 1 < len(bins):
                    before[i] += w
                    continue
                if lo == hi or n == 1 or w <= tolerance:
                    below = wanted[i] - before[i] < before[i] + w - wanted[i]
                    active[i].cut, active[i].left_weight = (lo, before[i]) if below else (hi + 1, before[i] + w)
                    del span[i]
                else:
                    span[i] = (lo, hi + 1)
                break
            else:
                active[i].cut, active[i].left_weight = span[i][1], before[i]
                del span[i]


def tree_depth(shards: int) -> int:
    return max(1, (shards - 1).bit_length())


def kd_tree(meta: DataFrame, total: int, dims: int, shards: int) -> dict[int, Node]:
    """Grow the tree over (size, p: positions along the dimensions) level by level; coordinates are scaled to one range at the root."""
    tree, depth = {0: Node(0, shards, total)}, tree_depth(shards)
    ends = [f(F.element_at("p", d + 1)).alias(f"{k}{d}") for d in range(dims) for k, f in (("lo", F.min), ("hi", F.max))]
    while active := {i: n for i, n in tree.items() if n.dim < 0 and n.leaves > 1}:
        placed = place(meta, tree, depth)
        for node, *found in zip(*(c.to_pylist() for c in placed.groupBy("node").agg(*ends).toArrow().columns), strict=True):
            if node in active:
                active[node].reach = tuple((lo >> _TIE_BITS, hi >> _TIE_BITS) for lo, hi in zip(found[::2], found[1::2], strict=True))
        for n in active.values():
            n.reach = n.reach or ((0, 0),) * dims
            n.dim = max(range(dims), key=lambda d: n.reach[d][1] - n.reach[d][0])
        _cuts(placed, active, 0.0005 * total / shards)
        for i, n in active.items():
            half = n.leaves // 2
            tree[2 * i + 1] = Node(n.first, half, n.left_weight)
            tree[2 * i + 2] = Node(n.first + half, n.leaves - half, n.weight - n.left_weight)
    return tree


def shard_metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The narrow table that the tree is grown over, written once; and the number of dimensions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    dims = metadata_dimensions(docs, id_col, size)
    raw = docs.select(
        F.col(id_col).alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row_tag"),
        *[F.coalesce(d, F.lit(0.0)).alias(f"x{k}") for k, d in enumerate(dims)],
    )
    return materialise(raw), len(dims)


def kd_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slot_block: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; shards hold nearly equal bytes."""
    raw, dims = shard_metadata(docs, id_col, text_col)
    ends = raw.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *[f(f"x{d}").alias(f"{k}{d}") for d in range(dims) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    tie = F.xxhash64("doc_id", "row_tag").bitwiseAND(F.lit((1 << _TIE_BITS) - 1))
    top = float((1 << _COORD_BITS) - 1)
    positions = []
    for d in range(dims):
        lo, hi = ends[f"lo{d}"] or 0.0, ends[f"hi{d}"] or 0.0
        coord = F.floor((F.col(f"x{d}") - lo) * (top / (hi - lo) if hi > lo else 0.0))
        positions.append(F.shiftleft(coord.cast("long"), _TIE_BITS) + tie)
    placed = raw.select("doc_id", "size", "text_crc32", "row_tag", F.array(*positions).alias("p"))
    tree = kd_tree(placed, ends["bytes"], dims, shards) if ends["n"] else {0: Node(0, 1)}
    n_blocks = max(4, blocks(ends["n"] // shards, slot_block))
    first = [tree[i].first if i in tree else 0 for i in range(max(tree) + 1)]
    out = place(placed, tree, tree_depth(shards)).select(
        "doc_id", "size", "text_crc32", "row_tag",
        _table(first, F.col("node")).cast("int").alias("shard"),
        F.pmod(F.xxhash64("row_tag"), F.lit(n_blocks)).alias("block"),
    )
    sums = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = out.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "row_tag"))
    return (
        out.withColumn("local", local)
        .join(offsets, ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("local") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir))

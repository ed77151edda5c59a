"""Set-similarity joins: which sources share most of their targets, without listing all pairs of a hub.

Sets are sorted by how rare their members are: the most frequent ones last, by their counts, all others by themselves.
Two sets with a Jaccard similarity of t or more must share one of the first |x| - ceil(t |x|) + 1 members of each (prefix
filter), their sizes differ by a factor of t at most (length filter), and what follows a shared member at known places
bounds the overlap (positional filter). A set of up to ``CARRIED`` members travels whole with each member of its prefix,
so a pair is judged where it meets, once, at its first shared member, and pairs that fail are never shuffled. Longer
sets meet by name and are fetched. A member of more than ``HUB`` prefixes is met with its (member, size, place)
signatures first: only pairs of signatures that can still reach t are joined to the sets behind them. A hub stands
last in every set that has anything else, where it can hardly start a pair.

Equal sets are one class, so a thousand copies are a thousand membership rows and no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.lineage import broadcast_if_small, discard, materialise

#: Members that are ordered by their counts; members of a set that travels with its prefix; prefixes that make a member a hub.
COUNTED, CARRIED, HUB = 1 << 16, 32, 1_000


@dataclass
class SimilarSets:
    """``pairs``: (a, b, common, similarity) of classes, a < b; ``classes``: (set_id, class_id, size, copies), a class
    named by its least set, with how many other sets are equal."""

    pairs: DataFrame
    classes: DataFrame

    def links(self) -> DataFrame:
        """(set_id, class_id, size, copies, links): equal sets, and similar sets of other classes."""
        sizes = self.classes.where("set_id = class_id").select(F.col("class_id").alias("other"), (F.col("copies") + 1).alias("n"))
        ends = self.pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).union(self.pairs.select("b", "a"))
        other = ends.join(sizes, "other").groupBy("class_id").agg(F.sum("n").alias("links"))
        return self.classes.join(other, "class_id", "left").select("set_id", "class_id", "size", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def _at_least(x: Column) -> Column:
    return F.ceil(x - 1e-9).cast("int")


def similar_sets(members: DataFrame, threshold: float, set_col: str = "src", member_col: str = "dst") -> SimilarSets:
    """Pairs of sets with a Jaccard similarity of ``threshold`` (above 0) or more.

    Rows that repeat count once; null sets or members are left out, so there are no empty sets. A set is one row.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = members.select(F.col(set_col).alias("set_id"), F.col(member_col).alias("m")).where("set_id is not null and m is not null")
    often = rows.groupBy("m").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "m").limit(COUNTED)
    ordered = rows.join(F.broadcast(often), "m", "left").select("set_id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "m").alias("x"))
    sets = ordered.groupBy("set_id").agg(F.sort_array(F.collect_set("x")).alias("x")).select("set_id", F.col("x.m").alias("members"))
    equal = Window.partitionBy("members")
    named = sets.withColumns({"class_id": F.min("set_id").over(equal), "copies": F.count(F.lit(1)).over(equal) - 1})
    # A class's members stand with its least set alone.
    named = materialise(named.select("set_id", "class_id", F.size("members").alias("size"), "copies", F.when(F.col("set_id") == F.col("class_id"), F.col("members")).alias("members")))
    classes = named.where("set_id = class_id").select("class_id", "size", "members")
    carried = F.when(F.col("size") <= CARRIED, F.col("members"))
    first = F.col("size") - _at_least(threshold * F.col("size")) + 1
    prefix = classes.select("class_id", "size", carried.alias("whole"), F.posexplode(F.slice("members", F.lit(1), first)).alias("place", "m"))
    hubs = materialise(prefix.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB).select("m"))
    some = not hubs.isEmpty()
    hubs = broadcast_if_small(hubs)
    most = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    needed = _at_least(threshold / (1 + threshold) * (F.col("size_a") + F.col("size_b")))
    fits = (F.col("size_a") <= F.col("size_b")) & (F.col("size_a") >= _at_least(threshold * F.col("size_b"))) & (most >= needed)
    once = (F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b"))

    # Both sides are the same but for their names, so that Spark shuffles them once.
    plain = prefix.join(hubs, "m", "left_anti") if some else prefix
    left = plain.select("m", F.col("class_id").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"), F.col("whole").alias("whole_a"))
    right = plain.select("m", F.col("class_id").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"), F.col("whole").alias("whole_b"))
    shared = F.array_intersect("whole_a", "whole_b")
    unknown = F.col("whole_a").isNull() | F.col("whole_b").isNull()
    similar = (F.size(shared) >= needed) & (shared[0] == F.col("m"))
    met = left.join(right, "m").where(fits & once & (unknown | similar))
    met = materialise(met.select("a", "b", F.when(~unknown, F.size(shared)).alias("common"), (F.col("size_a") + F.col("size_b")).alias("sizes")))
    asked = met.where("common is null").select("a", "b")
    if some:
        hub = prefix.join(hubs, "m", "left_semi")
        own = hub.groupBy("m", F.col("size").alias("size_a"), F.col("place").alias("place_a")).agg(F.count(F.lit(1)).alias("n"))
        other = own.select("m", F.col("size_a").alias("size_b"), F.col("place_a").alias("place_b"))
        alone = (F.col("size_a") == F.col("size_b")) & (F.col("place_a") == F.col("place_b")) & (F.col("n") == 1)
        signatures = own.join(other, "m").where(fits & ~alone).drop("n")
        left = hub.select("m", F.col("class_id").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"))
        right = hub.select("m", F.col("class_id").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
        asked = asked.union(left.join(signatures, ["m", "size_a", "place_a"]).join(right, ["m", "size_b", "place_b"]).where(once).select("a", "b"))
    if asked.isEmpty():
        asked = asked.limit(0)
    of = lambda name: classes.select(F.col("class_id").alias(name), F.col("members").alias(f"in_{name}"))
    fetched = asked.distinct().join(of("a"), "a").join(of("b"), "b")
    fetched = fetched.select("a", "b", F.size(F.array_intersect("in_a", "in_b")).alias("common"), (F.size("in_a") + F.size("in_b")).alias("sizes"))
    judged = met.where("common is not null").union(fetched).withColumn("similarity", F.col("common") / (F.col("sizes") - F.col("common")))
    kept = judged.where(F.col("similarity") >= threshold - 1e-12)
    pairs = materialise(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", "similarity").distinct())
    discard(met)
    return SimilarSets(pairs, named.select("set_id", "class_id", "size", "copies"))

"""Titles to documents: aliases, exact and fuzzy resolution, and model answers as JSON."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import letters_only, space_words, without_braces
from quarry.operators.retrieval import bm25, top_k


def expand_aliases(docs: DataFrame, key: str = "doc_id", aliases: str = "aliases") -> DataFrame:
    """(doc_id, alias): each alias and its form without braces."""
    both = F.array_union(F.col(aliases), F.transform(aliases, without_braces))
    return docs.select(key, F.explode(both).alias("alias")).where("alias <> ''").distinct()


def similarity(a: Column, b: Column) -> Column:
    """100 (1 - edit distance / longer length); 101 for equal strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 101.0).otherwise(100 * (1 - F.levenshtein(a, b) / F.greatest(longer, F.lit(1))))


#: Pairs that are compared together.
PAIRS = 2048
_WORD = 64


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, bit-parallel in the first string and over all pairs."""
    n = len(a)
    out = np.zeros(n, np.int64)
    order = np.argsort([len(x) + len(y) for x, y in zip(a, b, strict=True)], kind="stable")
    for at in range(0, n, PAIRS):
        part = order[at : at + PAIRS]
        one, two = [a[k] for k in part], [b[k] for k in part]
        height, width = max(_WORD, -(-max(map(len, one)) // _WORD) * _WORD), max(map(len, two))
        table = lambda texts, size, fill: np.frombuffer("".join(t.ljust(size, fill) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), size)
        # The strings are filled up with two characters that differ, and what is filled up is not counted.
        rows, columns = table(one, height, "\ufdd0"), table(two, max(1, width), "\ufdd1")
        words = height // _WORD
        state = np.full((words, len(part)), np.iinfo(np.uint64).max, np.uint64)
        for j in range(width):
            same = np.packbits(rows == columns[:, j, None], axis=1, bitorder="little").view("<u8").T
            carry = np.zeros(len(part), np.uint64)
            for w in range(words):
                v = state[w]
                u = v & same[w]
                total = v + u
                over = total < v
                with_carry = total + carry
                over |= with_carry < total
                state[w] = with_carry | (v - u)
                carry = over.astype(np.uint64)
        out[part] = np.bitwise_count(~state).sum(axis=0)
    return out


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 x 2 common / (length + length), rounded to a whole number; NULL where a side is NULL, 100 for two empty strings."""
    known = a.notna() & b.notna()
    one, two = a[known].tolist(), b[known].tolist()
    length = np.array([len(x) + len(y) for x, y in zip(one, two, strict=True)])
    ratio = np.where(length == 0, 100.0, 200.0 * (common_subsequence(one, two) if one else 0) / np.maximum(length, 1))
    out = pd.Series(np.nan, index=a.index)
    out[known] = np.rint(ratio)
    return out.astype("object").where(known, None)


def promoted(score: Column) -> Column:
    """A perfect score of 100 counts 101."""
    return F.when(score >= 100, 101.0).otherwise(score)


def ratio_score(a: Column, b: Column) -> Column:
    return promoted(indel_ratio(a, b))


def token_sort_score(a: Column, b: Column) -> Column:
    """The ratio of the words in order."""
    ordered = lambda c: F.array_join(F.array_sort(space_words(c)), " ")
    return promoted(indel_ratio(ordered(a), ordered(b)))


def token_set_score(a: Column, b: Column) -> Column:
    """The best ratio among the common words, and these with the words of either side; 100 where one side has no others."""
    one, two = F.array_distinct(space_words(a)), F.array_distinct(space_words(b))
    both = F.array_sort(F.array_intersect(one, two))
    joined = lambda more: F.array_join(F.concat(both, F.array_sort(more)), " ")
    left, right = F.array_except(one, two), F.array_except(two, one)
    common, first, second = F.array_join(both, " "), joined(left), joined(right)
    best = F.greatest(indel_ratio(common, first), indel_ratio(common, second), indel_ratio(first, second))
    contained = (F.size(both) > 0) & ((F.size(left) == 0) | (F.size(right) == 0))
    empty = (F.size(one) == 0) | (F.size(two) == 0)
    return promoted(F.when(empty, 0.0).when(contained, 100.0).otherwise(best))


def plain_letters(c: Column) -> Column:
    return letters_only(without_braces(c))


def normal_titles(titles: DataFrame) -> DataFrame:
    """Titles on letters alone, where that changes them."""
    return titles.withColumn("_n", plain_letters(F.col("title"))).where("_n <> title").select("title_id", F.col("_n").alias("title"))


def bm25_candidates(titles: DataFrame, aliases: DataFrame, k: int = 10) -> DataFrame:
    """(title_id, doc_id): the k best documents of each title by their aliases."""
    texts = aliases.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("text"))
    scores = bm25(texts, titles.select(F.col("title_id").alias("qid"), F.col("title").alias("text")))
    return top_k(scores.withColumn("score", F.round("score", 6)), k).select(F.col("qid").alias("title_id"), "doc_id")


def resolve(titles: DataFrame, aliases: DataFrame, candidates: DataFrame, least: float = 70.0, normal: DataFrame | None = None, scorer: Callable[[Column, Column], Column] = similarity) -> DataFrame:
    """(title_id, doc_id, strategy, score): exact alias, else the best fuzzy alias of the title's candidate
    documents, else the same on letters alone, else that over ``normal``: the candidates of the title's letters.
    Each stage takes the titles that earlier ones left. ``scorer`` gives the score of two columns, 101 for equal strings."""
    exact = titles.join(aliases, titles["title"] == aliases["alias"]).select("title_id", "doc_id", F.lit(1).alias("strategy"), F.lit(101.0).alias("score")).distinct()

    def fuzzy(left: DataFrame, strategy: int, clean, candidates: DataFrame = candidates) -> DataFrame:
        pairs = left.join(candidates, "title_id").join(aliases, "doc_id")
        scored = pairs.select("title_id", "doc_id", scorer(clean(F.col("title")), clean(F.col("alias"))).alias("score"))
        best = Window.partitionBy("title_id").orderBy(F.desc("score"), "doc_id")
        return scored.withColumn("r", F.row_number().over(best)).where((F.col("r") == 1) & (F.col("score") >= least)).select("title_id", "doc_id", F.lit(strategy).alias("strategy"), "score")

    left = titles.join(exact.select("title_id"), "title_id", "left_anti")
    second = fuzzy(left, 2, lambda c: c)
    left = left.join(second.select("title_id"), "title_id", "left_anti")
    third = fuzzy(left, 3, plain_letters)
    out = exact.unionByName(second).unionByName(third)
    if normal is None:
        return out
    return out.unionByName(fuzzy(left.join(third.select("title_id"), "title_id", "left_anti"), 4, plain_letters, normal))


def titles_to_run(resolved: DataFrame) -> DataFrame:
    """(qid, position, doc_id) -> scores n ... 1 from the end of the list; documents of one title share it."""
    last = F.max("position").over(Window.partitionBy("qid"))
    return resolved.withColumn("score", (last - F.col("position") + 1).cast("double"))


def answer_titles(answer: Column) -> Column:
    """Titles of a model answer in any of the usual shapes, in order: a list of strings, a list of objects, a
    single title, an object of title -> score, or an object that holds a list."""
    body = F.regexp_extract(answer, r"(?s)([\[{].*[\]}])", 1)
    body = F.when(body == "", answer).otherwise(body)
    inner = F.coalesce(*[F.get_json_object(body, f"$.{k}") for k in ("candidates", "titles", "results", "answers")], body)
    strings = F.from_json(inner, "array<string>", {"mode": "PERMISSIVE"})
    objects = F.from_json(inner, "array<struct<title: string, name: string, entity: string>>", {"mode": "PERMISSIVE"})
    named = F.filter(F.transform(objects, lambda o: F.coalesce(o["title"], o["name"], o["entity"])), lambda x: x.isNotNull())
    plain = F.filter(strings, lambda x: x.isNotNull() & ~x.startswith("{"))
    single = F.coalesce(F.get_json_object(inner, "$.title"), F.get_json_object(inner, "$.name"))
    scores = F.from_json(inner, "map<string,double>", {"mode": "PERMISSIVE"})
    by_score = F.transform(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("t")))), lambda x: x["t"])
    return F.when(F.size(named) > 0, named).when(F.size(plain) > 0, plain).when(single.isNotNull(), F.array(single)).when(F.size(by_score) > 0, by_score).otherwise(F.array().cast("array<string>"))


def titles_of(aliases: DataFrame) -> DataFrame:
    """(alias, docs): every title with the sorted set of its documents."""
    return aliases.groupBy("alias").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


def spread_titles(resolved: DataFrame, reference: DataFrame) -> DataFrame:
    """``titles_to_run`` scores where the m documents of one title are set apart: score + i / (m + 1), i = 1 ... m by
    ascending score in the reference run (absent: lowest)."""
    scored = titles_to_run(resolved).join(reference.select("qid", "doc_id", F.col("score").alias("_ref")), ["qid", "doc_id"], "left")
    title = Window.partitionBy("qid", "position")
    turn = F.row_number().over(title.orderBy(F.col("_ref").asc_nulls_first(), "doc_id"))
    m = F.count(F.lit(1)).over(title)
    return scored.withColumn("score", F.when(m > 1, F.col("score") + turn / (m + 1)).otherwise(F.col("score"))).drop("_ref")


def question_lines(text: Column, mark: str = "Q: ") -> Column:
    """Lines that start with ``mark``, without it and cut at the first full stop."""
    cut = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(cut, lambda x: x.startswith(mark)), lambda x: F.trim(F.substring_index(F.substring(x, len(mark) + 1, 1 << 20), ".", 1)))


def names_target(text: Column, target: Column) -> Column:
    """Whether a text leaks the name it must not hold."""
    return F.contains(F.lower(text), F.lower(target))

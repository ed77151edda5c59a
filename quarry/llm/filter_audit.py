"""Interaction audit of document filters: what each filter removes alone, in every order, and on average.

Copies of texts are found by an RDD that is routed by fingerprint. Each map task keeps, per xxhash64 of a text, a
collision chain of (full text, least id). A row that is not the least of its text within the task is settled there;
only the least row of each text goes, with the text, to the partition of its fingerprint. There a sort by fingerprint
brings one chain at a time into memory, texts are compared in full, and the ids that are not minimal are emitted. So
a group of copies costs a partition one row for each map task, whatever its size.

Every row then has a mask of the filters that it fails. ``combineByKey`` merges the masks of a part to a vector of
counts (of all rows, of good ones, of toxic ones) by mask, 3 x 32 numbers; all orders and steps follow from that vector.

Filters: A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * letters A-Z > 5 * code points; D: holds one
of ``#$%&*|``; E: the text is identical to that of a smaller doc_id. Words are maximal runs without ASCII white space.

Defined cases: a null text is empty, it fails A (and E, if another row with a smaller id is empty); a null source is the
part ''; a null doc_id is not smaller than any other, has no label and never fails E; rows that repeat are counted each,
and those with the least id of their text all pass E; a document with several labels is good (toxic) if one of them
says so; very long texts need the memory of one text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, permutations
from operator import itemgetter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import blocks, documents

LETTERS = "ABCDE"
_DUPLICATE = 1 << LETTERS.index("E")
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Bytes of text whose chains a map task holds before it sends them on.
HELD = 64 << 20
#: Bytes of text for each partition of fingerprints.
PART = 32 << 20
_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_MARKS = b"#$%&*|"


def own_mask(text: str, data: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = data.split()
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * len(data.translate(None, _NOT_CAPITAL)) > 5 * len(text)) << 2
        | (len(data) != len(data.translate(None, _MARKS))) << 3
    )


def _fingerprint(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def _least_of_task(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(route, (doc_id, part, mask, n)) of settled rows; (fingerprint, (text, least id, mask, rows by part)) of others."""
    chains: dict[int, list[list]] = {}
    held = 0
    for doc_id, text, part in rows:
        text, part = text or "", part or ""
        data = text.encode("utf-8", "surrogatepass")
        print_, mask = _fingerprint(data), own_mask(text, data)
        if doc_id is None:
            yield print_, (None, part, mask, 1)
            continue
        chain = chains.setdefault(print_, [])
        link = next((x for x in chain if x[0] == data), None)
        if link is None:
            chain.append([data, doc_id, mask, {part: 1}])
            held += len(data)
            if held > HELD:
                yield from ((p, tuple(x)) for p, links in chains.items() for x in links)
                chains, held = {}, 0
            continue
        spread = _fingerprint(repr(doc_id).encode())
        if doc_id == link[1]:
            link[3][part] = link[3].get(part, 0) + 1
        elif doc_id > link[1]:
            yield spread, (doc_id, part, mask | _DUPLICATE, 1)
        else:
            yield from ((spread, (link[1], p, mask | _DUPLICATE, n)) for p, n in link[3].items())
            link[1], link[3] = doc_id, {part: 1}
    yield from ((p, tuple(x)) for p, links in chains.items() for x in links)


def _settled(rows: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of every row; ``rows`` are sorted by fingerprint."""
    for _, same in groupby(rows, key=itemgetter(0)):
        chain: list[list] = []
        for _, row in same:
            if not isinstance(row[0], bytes):
                yield row
                continue
            data, doc_id, mask, parts = row
            link = next((x for x in chain if x[0] == data), None)
            if link is None:
                chain.append([data, doc_id, mask, dict(parts)])
            elif doc_id == link[1]:
                for p, n in parts.items():
                    link[3][p] = link[3].get(p, 0) + n
            else:
                least, more = ((doc_id, parts), (link[1], link[3])) if doc_id < link[1] else ((link[1], link[3]), (doc_id, parts))
                yield from ((more[0], p, mask | _DUPLICATE, n) for p, n in more[1].items())
                link[1], link[3] = least[0], dict(least[1])
        yield from ((doc_id, p, mask, n) for _, doc_id, mask, parts in chain for p, n in parts.items())


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask (bit k: the k-th filter fails), n (rows that are alike in all of these)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"), F.col(part_col).cast("string"))
    kind = rows.schema["doc_id"].dataType
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks(size, PART))
    routed = rows.rdd.mapPartitions(_least_of_task).repartitionAndSortWithinPartitions(parts, lambda print_: print_ % parts)
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
    return spark.createDataFrame(routed.mapPartitions(_settled), schema, verifySchema=False)


def duplicate_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The ids of rows whose text a smaller id has."""
    masks = failure_masks(docs, id_col, text_col, part_col)
    return masks.where(F.col("mask").bitwiseAND(_DUPLICATE) > 0).select("doc_id").distinct()


def _add(counts: list[int], row: tuple[int, int, int, int]) -> list[int]:
    mask, n, good, toxic = row
    counts[mask] += n
    counts[32 + mask] += good
    counts[64 + mask] += toxic
    return counts


def _steps() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each order and step: the filter, and the masks that it removes, leaves, and finds removed already."""
    masks = np.arange(32)
    which, removed, kept, redundant = [], [], [], []
    for order in ORDERS:
        before = np.zeros(32, bool)
        for letter in order:
            k = LETTERS.index(letter)
            fails = (masks >> k & 1).astype(bool)
            which.append(k)
            removed.append(fails & ~before)
            redundant.append(fails & before)
            before = before | fails
            kept.append(~before)
    return np.array(which), *(np.array(x, np.int64) for x in (removed, kept, redundant))


def audit_rows(part: str, counts: list[int]) -> Iterator[tuple]:
    """All orders and steps of a part from its mask counts."""
    rows, good, toxic = np.array(counts, np.int64).reshape(3, 32)
    which, removed, kept, redundant = _steps()
    here = removed @ rows
    average = [sum(int(rows[m]) * (120 // m.bit_count()) for m in range(32) if m >> k & 1) for k in range(5)]
    columns = kept @ rows, here, redundant @ rows, rows[1 << which], removed @ good, removed @ toxic
    for i, values in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
        yield (part, ORDERS[i // 5], i % 5 + 1, *values, average[which[i]])


AUDIT_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interaction_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marked = labels.groupBy(F.col(id_col).alias("doc_id")).agg(one("quality"), one("toxic"))
    rows = failure_masks(docs, id_col, text_col, part_col).join(marked, "doc_id", "left")
    of = lambda c: F.col("n") * F.coalesce(c, F.lit(0))
    pairs = rows.select("part", "mask", "n", of("quality"), of("toxic")).rdd.map(lambda r: (r[0], tuple(r[1:])))
    counts = pairs.combineByKey(lambda row: _add([0] * 96, row), _add, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda x: audit_rows(*x)), AUDIT_SCHEMA, verifySchema=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         (len(w) < 50)::INT AS a,
         (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b,
         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d,
         coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM words LEFT JOIN marked m ON words.doc_id = m.doc_id
), counts AS (
  SELECT part, [a, b, c, d, e] AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT filter_order, step, [ascii(filter_order[i]) - 64 FOR i IN range(1, step + 1)] AS seen
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), cells AS (
  SELECT part, filter_order, step, n, good, toxic, f[seen[step]] AS fails, list_sum(f) AS failing,
         CASE WHEN step = 1 THEN 0 ELSE list_max([f[k] FOR k IN seen[1:step - 1]]) END AS before
  FROM counts, steps
)
SELECT part, filter_order, step::INT AS step,
       sum(n * (1 - fails) * (1 - before))::BIGINT AS kept,
       sum(n * fails * (1 - before))::BIGINT AS removed,
       sum(n * fails * before)::BIGINT AS redundant,
       sum(CASE WHEN failing = 1 THEN n * fails ELSE 0 END)::BIGINT AS unique_fails,
       sum(good * fails * (1 - before))::BIGINT AS good_lost,
       sum(toxic * fails * (1 - before))::BIGINT AS toxic_lost,
       sum(CASE WHEN fails = 1 THEN n * 120 // failing ELSE 0 END)::BIGINT AS shapley
FROM cells GROUP BY part, filter_order, step
"""

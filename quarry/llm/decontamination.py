"""Benchmark decontamination: CGK random walks, sampled positions, exact edit verification.

The CGK embedding walks over a string: at each step it copies the current character and a random bit of
(step, character) decides whether to go on to the next one. Strings within a small edit distance get
embeddings within a small Hamming distance. An item is covered by windows at every one of its characters;
windows of documents start at every word and, in stretches without spaces, at every ``STRIDE`` characters.
Of their embeddings, ``TABLES`` sets of sampled positions are compared. Each window is a new chance to meet
in every table: at the least similarity of 0.8 a walk over all of an item hardly ever stays in step, but some
of its windows of 16 characters do (``tests/llm`` measures a recall of 0.9 at least, for errors at random and
at even distances, down to every fifth character). Hits on neighbouring diagonals propose a place for the item, from
``LEAST_HITS`` on; there the edit distance of the item to its best place is verified exactly (bit-parallel), after a
lossless bound: the sum of the least distances of the item's blocks of 64 characters on those diagonals.

Items under 48 characters take a shorter walk, with windows at every character of the documents too; items
under 10 characters, which may have one error at most, are searched by a pattern of all their neighbours.
Items are searched in blocks of at most ``BLOCK_BYTES``, so what is broadcast is bounded; a worker prepares a
block once. Texts are compared in lower case with single spaces.

Defined cases: null and blank texts match nothing; documents that repeat give a row each, and so do items
with the same text; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import blocks, documents

SIMILARITY = 0.8
#: (steps, sampled of them, shortest item): long items and short ones; still shorter ones take a pattern.
WALKS = ((32, 13, 48), (10, 7, 10))
TABLES = 12
#: Windows whose keys are computed together.
WINDOWS = 1 << 14
#: Hits that a place of a long item needs before its distance is computed.
LEAST_HITS = 2
#: Distance of window starts within a stretch without spaces.
STRIDE = 8
FILTER_BITS = 20
SLICE, BLOCK_BYTES = 1 << 21, 8 << 20


@cache
def _randomness() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Walk bits, character values, and for each walk the step -> tables that sample it."""
    rng = np.random.default_rng(19790314)
    bits = rng.integers(0, 2, (WALKS[0][0], 256)).astype(np.int32)
    values = rng.integers(1, 1 << 62, 256).astype(np.uint32) | np.uint32(1)
    sampled = {}
    for steps, samples, _ in WALKS:
        chosen = np.zeros((steps, TABLES), bool)
        for t in range(TABLES):
            chosen[rng.choice(steps, samples, replace=False), t] = True
        sampled[steps] = chosen
    return bits, values, sampled


def plain(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def _codes(text: str) -> np.ndarray:
    wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((wide ^ (wide >> np.uint32(8))) & np.uint32(255)).astype(np.uint8)


def window_keys(codes: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """(TABLES, windows): hashes of the sampled positions; ``codes`` has at least ``steps`` more at its end."""
    bits, values, sampled = _randomness()
    at = starts.astype(np.int32)
    keys = np.zeros((TABLES, len(at)), np.uint32)
    for step in range(steps):
        char = codes[at]
        if sampled[steps][step].any():
            value = values[char]
            for t in np.flatnonzero(sampled[steps][step]):
                key = keys[t]
                key ^= value
                key *= np.uint32(0x9E3779B1)
        at += bits[step][char]
    return keys


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint32(32 - FILTER_BITS)).astype(np.intp)


def window_starts(codes: np.ndarray) -> np.ndarray:
    """Starts of words, and every STRIDE characters within them."""
    inside = (codes != 32) & (codes != 0)
    first = inside & np.append(True, ~inside[:-1])
    at = np.flatnonzero(inside)
    begin = np.where(first, np.arange(len(codes), dtype=np.int32), np.int32(0))
    np.maximum.accumulate(begin, out=begin)
    return at[(at - begin[at]) % STRIDE == 0]


@dataclass
class ItemIndex:
    """Windows of the items in each table, for one walk length."""

    steps: int
    keys: list[np.ndarray] = field(default_factory=list)
    refs: list[np.ndarray] = field(default_factory=list)
    filters: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, texts: list[str], which: list[int], steps: int) -> ItemIndex:
        keys, refs = [], []
        for i in which:
            codes = np.r_[_codes(texts[i]), np.zeros(steps, np.uint8)]
            starts = np.arange(max(1, len(texts[i]) - steps // 2 + 1))
            keys.append(window_keys(codes, starts, steps))
            refs.append(np.stack([np.full(len(starts), i), starts]))
        out = cls(steps)
        for t in range(TABLES):
            key = np.concatenate([k[t] for k in keys])
            order = np.argsort(key, kind="stable")
            out.keys.append(key[order])
            out.refs.append(np.concatenate(refs, axis=1)[:, order])
            present = np.zeros(1 << FILTER_BITS, bool)
            present[_slots(key)] = True
            out.filters.append(present)
        return out

    def hits(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(window start, item, offset in the item) of all hits, as rows."""
        out = []
        for first in range(0, len(starts), WINDOWS):
            some = starts[first : first + WINDOWS]
            keys = window_keys(codes, some, self.steps)
            for t in range(TABLES):
                near = np.flatnonzero(self.filters[t][_slots(keys[t])])
                low = np.searchsorted(self.keys[t], keys[t][near], "left")
                n = np.searchsorted(self.keys[t], keys[t][near], "right") - low
                ref = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out.append(np.stack([np.repeat(some[near], n), *self.refs[t][:, ref]], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


#: Candidates that are verified together, and bits of a row block.
TOGETHER, BITS = 4096, 64
#: Characters of all candidates that are verified together, each taken as long as the longest.
CELLS = 1 << 21


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of ``sizes``, which ascend: at most TOGETHER, and CELLS if each were as long as the last."""
    at = 0
    while at < len(sizes):
        some = sizes[at : at + TOGETHER]
        end = at + max(1, int(np.searchsorted(some * np.arange(1, len(some) + 1), CELLS, "right")))
        yield at, end
        at = end


def letters_table(item: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted characters, rows): the places of each character in ``item`` as bits, BITS to a block, and a last row
    for all other characters. The item ends at the highest bit; what is free below it matches anything."""
    codes = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, which = np.unique(codes, return_inverse=True)
    blocks_of = -(-len(codes) // BITS)
    at = np.arange(len(codes)) + blocks_of * BITS - len(codes)
    bits = np.zeros((len(letters) + 1, blocks_of * BITS), bool)
    bits[:, : at[0]] = True
    bits[which, at] = True
    rows = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return letters, rows


def best_distances(tables: list[tuple[np.ndarray, np.ndarray]], items: np.ndarray, texts: list[str], limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text and the table of its item, the least edit distance of the item to a substring of the text, and
    where the first such substring ends. Bit-parallel in blocks of BITS rows, and over all candidates at once. A
    distance above its limit is told as one above the limit."""
    limits = np.full(len(texts), 1 << 40) if limits is None else limits
    best, end = limits + 1, np.zeros(len(texts), np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(size, kind="stable")
    if (limits < 1 << 40).any():
        chunks = (order[a:b] for a, b in _chunks(size[order]))
        order = np.concatenate([chunk[_may_match(_letters(tables, items[chunk], [texts[k] for k in chunk.tolist()]), limits[chunk])] for chunk in chunks])
    for a, b in _chunks(size[order]):
        part = order[a:b]
        found, end[part] = _whole_distances(_letters(tables, items[part], [texts[k] for k in part.tolist()]))
        best[part] = np.minimum(found, limits[part] + 1)
    return best, end


def _least_of_block(matches: Iterator[np.ndarray], n: int) -> np.ndarray:
    """The least edit distance of a full block of rows of each of n candidates to a substring; ``matches``: for each
    character of the texts, the rows that it matches, as bits."""
    p, m, score = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(n, np.uint64), np.full(n, BITS, np.int64)
    best, one, top = score.copy(), np.uint64(1), np.uint64(BITS - 1)
    for eq in matches:
        vertical = eq | m
        across = eq & p
        across += p
        across ^= p
        across |= eq
        fall = p & across
        across |= p
        grow = np.invert(across, out=across)
        grow |= m
        score += (grow >> top).view(np.int64)
        score -= (fall >> top).view(np.int64)
        np.minimum(best, score, out=best)
        grow <<= one
        fall <<= one
        np.bitwise_and(grow, vertical, out=m)
        vertical |= grow
        np.bitwise_or(fall, np.invert(vertical, out=vertical), out=p)
    return best


@cache
def _numbers() -> np.ndarray:
    """Code point -> number, all 0 between calls."""
    return np.zeros(0x110000, np.int32)


@dataclass
class Letters:
    """Candidates: the rows of their items' letters by block, the row of each character of their texts, and the row
    that matches only what is free before the item."""

    columns: list[np.ndarray]
    letter: np.ndarray  # (characters, candidates)
    other: np.ndarray
    blocks: np.ndarray


def _letters(tables: list, items: np.ndarray, texts: list[str]) -> Letters:
    used, which = np.unique(items, return_inverse=True)
    own = [tables[i] for i in used.tolist()]
    width = np.array([rows.shape[1] for _, rows in own])
    # All tables end at the same block; the free blocks before a shorter one match anything.
    free = np.uint64(0xFFFFFFFFFFFFFFFF)
    rows = np.concatenate([np.pad(r, ((0, 0), (width.max() - r.shape[1], 0)), constant_values=free) for _, r in own])
    ends = np.cumsum([len(r) for _, r in own])
    begins = np.append(0, ends[:-1])
    # Characters of all these items get numbers from 1 on; each item has the row of every number.
    known = np.unique(np.concatenate([letters for letters, _ in own]))
    number = _numbers()
    number[known] = np.arange(1, len(known) + 1)
    row_of = np.repeat((ends - 1)[:, None], len(known) + 1, axis=1).astype(np.int32)
    for u, (letters, _) in enumerate(own):
        row_of[u, number[letters]] = begins[u] + np.arange(len(letters))
    letter = np.repeat((ends - 1)[which][None, :], max(map(len, texts)), axis=0).astype(np.int32)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    letter[place, owner] = row_of[which[owner], number.take(codes)]
    number[known] = 0
    columns = [rows[:, w].copy() for w in range(rows.shape[1])]
    return Letters(columns, letter, (ends - 1)[which], width[which])


def _may_match(c: Letters, limits: np.ndarray) -> np.ndarray:
    """Candidates within their limits by the sum of the least distances of their full blocks."""
    alive, bound, full = np.arange(len(limits)), np.zeros(len(limits), np.int64), c.blocks - 1
    for turn in range(int(full.max())):
        more = alive[full[alive] > turn]
        if not len(more):
            break
        letter = c.letter[:, more]
        column = c.columns[-1 - turn]
        bound[more] += _least_of_block((column.take(here) for here in letter), len(more))
        alive = alive[bound[alive] <= limits[alive]]
    return alive


def _whole_distances(c: Letters) -> tuple[np.ndarray, np.ndarray]:
    columns, letter, width, (steps, n) = c.columns, c.letter, len(c.columns), c.letter.shape
    # What is free costs nothing; from there on each row costs one more.
    free = np.stack([~column[c.other] for column in columns], axis=1)
    plus, minus = [free[:, w].copy() for w in range(width)], [np.zeros(n, np.uint64) for _ in range(width)]
    score = np.bitwise_count(free).sum(axis=1).astype(np.int64)
    best, end = score.copy(), np.zeros(n, np.int64)
    one, top = np.uint64(1), np.uint64(BITS - 1)
    none = np.zeros(n, np.uint64)
    for step in range(steps):
        here = letter[step]
        up = down = none  # what comes in from the block before
        for w in range(width):
            p, m, eq = plus[w], minus[w], columns[w].take(here)
            vertical = eq | m
            if w:
                eq |= down
            across = eq & p
            across += p
            across ^= p
            across |= eq
            fall = p & across
            across |= p
            grow = np.invert(across, out=across)
            grow |= m
            up_next, down_next = grow >> top, fall >> top
            grow <<= one
            fall <<= one
            if w:
                grow |= up
                fall |= down
            np.bitwise_and(grow, vertical, out=m)
            vertical |= grow
            np.bitwise_or(fall, np.invert(vertical, out=vertical), out=p)
            up, down = up_next, down_next
        score += up.view(np.int64)
        score -= down.view(np.int64)
        better = np.flatnonzero(score < best)
        if len(better):
            best[better], end[better] = score[better], step + 1
    return best, end


def neighbours(item: str, distance: int) -> re.Pattern:
    """All strings within ``distance`` (0 or 1) of a short item."""
    forms = [re.escape(item)]
    if distance:
        cut = [(re.escape(item[:k]), re.escape(item[k + 1 :]), re.escape(item[k:])) for k in range(len(item))]
        forms += [x for a, b, c in cut for x in (f"{a}.{b}", f"{a}.{c}", a + b)]
    return re.compile("|".join(forms), re.S)


#: Blocks of items that this worker has prepared.
_prepared: dict[str, Items] = {}


@dataclass
class Items:
    key: str
    ids: list
    texts: list[str]
    similarity: float

    def slack(self, item: int) -> int:
        """The greatest edit distance that still counts."""
        return int((1 - self.similarity) * len(self.texts[item]) + 1e-9)

    def prepare(self) -> Items:
        """Builds what the search needs, once in a worker; the worker keeps the last block."""
        if self.key not in _prepared:
            _prepared.clear()
            _prepared[self.key] = self._build()
        return _prepared[self.key]

    def _build(self) -> Items:
        self.tables = [letters_table(t) for t in self.texts]
        self.sizes = np.array([len(t) for t in self.texts])
        self.slacks = np.array([self.slack(k) for k in range(len(self.texts))])
        # Full blocks of BITS characters from the end of each item: the places of each character code, as bits.
        self.full = self.sizes // BITS
        self.first_block = np.cumsum(self.full) - self.full
        self.rows = np.zeros((int(self.full.sum()), 256), np.uint64)
        for k, text in enumerate(self.texts):
            codes = _codes(text)
            for turn in range(int(self.full[k])):
                end = len(codes) - BITS * turn
                np.bitwise_or.at(self.rows[self.first_block[k] + turn], codes[end - BITS : end], np.uint64(1) << np.arange(BITS, dtype=np.uint64))
        most = [w[2] for w in WALKS]
        classes = [i for i, t in enumerate(self.texts) if len(t) >= most[0]], [i for i, t in enumerate(self.texts) if most[1] <= len(t) < most[0]]
        self.indexes = [ItemIndex.build(self.texts, which, walk[0]) for which, walk in zip(classes, WALKS, strict=True) if which]
        self.patterns = [(i, neighbours(t, self.slack(i))) for i, t in enumerate(self.texts) if 0 < len(t) < most[1]]
        return self

    def _places(self, hits: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        """(document, item, first start, last start): neighbouring places are one stretch of text; those with fewer
        than ``least`` hits go."""
        at, item, offset = hits.T
        doc = np.searchsorted(begin, at, "right") - 1
        start = at - begin[doc] - offset
        order = np.lexsort((start, item, doc))
        doc, item, start = doc[order], item[order], start[order]
        apart = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.slacks[item[1:]])
        first = np.flatnonzero(np.r_[np.ones(min(1, len(doc)), bool), apart])
        ends = np.append(first[1:], len(doc))
        keep = ends - first >= least
        first, last = first[keep], ends[keep] - 1
        return doc[first], item[first], start[first], start[last]

    def _within(self, codes: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which candidates the blocks do not rule out; ``first`` and ``last``: where the item starts in ``codes``.

        A match within the slack leaves these diagonals by the slack at most, so a block of the item meets what lies
        there; the least distances of all blocks add up to no more than that of the item. Codes of characters match
        at least where the characters do.
        """
        slack, bound = self.slacks[item], np.zeros(len(item), np.int64)
        width = last - first + BITS + 2 * slack
        alive = np.argsort(width, kind="stable")
        table = self.rows.ravel()
        for turn in range(int(self.full.max(initial=0))):
            more = alive[self.full[item[alive]] > turn]
            for a, b in _chunks(width[more]):
                part = more[a:b]
                low = first[part] + self.sizes[item[part]] - BITS * (turn + 1) - slack[part]
                steps = int(width[part[-1]])
                base = (self.first_block[item[part]] + turn) * 256
                at = np.clip(low, 0, len(codes) - 1)[None, :] + np.arange(steps)[:, None]
                letter = codes.take(at, mode="clip") + base
                bound[part] += _least_of_block((table.take(here) for here in letter), len(part))
            alive = alive[bound[alive] <= slack[alive]]
        return np.sort(alive)

    def matches(self, texts: list[str]) -> list[dict[int, tuple[int, int]]]:
        """For each text: item -> (distance, end) of its best place."""
        pad = max(steps for steps, _, _ in WALKS)
        codes = _codes("".join(t + "\0" * pad for t in texts))
        begin = np.cumsum([0] + [len(t) + pad for t in texts[:-1]])
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for index in self.indexes:
            starts = window_starts(codes) if index.steps == WALKS[0][0] else np.flatnonzero(codes)
            doc, item, first, last = self._places(index.hits(codes, starts), begin, LEAST_HITS if index.steps == WALKS[0][0] else 1)
            keep = self._within(codes, item, begin[doc] + first, begin[doc] + last)
            doc, item, first, last = doc[keep], item[keep], first[keep], last[keep]
            if not len(doc):
                continue
            slack, size = self.slacks[item], self.sizes[item]
            low = np.maximum(0, first - slack)
            parts = [texts[d][a : max(0, b)] for d, a, b in zip(doc.tolist(), low.tolist(), (last + size + slack).tolist(), strict=True)]
            distances, ends = best_distances(self.tables, item, parts, slack)
            for k in np.flatnonzero(distances <= slack).tolist():
                found, i = (int(distances[k]), int(low[k] + ends[k])), int(item[k])
                if i not in out[doc[k]] or found < out[doc[k]][i]:
                    out[doc[k]][i] = found
        for item, pattern in self.patterns:
            exact = self.texts[item]
            for doc, text in enumerate(texts):
                if (at := text.find(exact)) >= 0:
                    out[doc][item] = (0, at + len(exact))
                elif near := pattern.search(text):
                    out[doc][item] = (1, near.end())
        return out


def _sliced(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= SLICE or k + 1 == len(texts):
            yield first, k + 1
            first, total = k + 1, 0


def item_blocks(texts: DataFrame, similarity: float, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """``texts``: (id, text), no text twice; in blocks of about ``block_bytes``, one at a time."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = blocks(size, block_bytes)
    for k in range(n):
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        kept = [(r["id"], t) for r in part if (t := plain(r["text"]))]
        if kept:
            yield Items(uuid.uuid4().hex, [i for i, _ in kept], [t for _, t in kept], similarity)


def distinct_items(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text) with each text once, under its least id; and all (id, text)."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.groupBy("text").agg(F.min("id").alias("id")).select("id", "text"), rows


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, similarity, place (end, in the plain text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, item_kind = dict(rows.dtypes)["doc_id"], dict(items.dtypes)[item_col]
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, similarity double, place int"
    out = None
    texts, all_items = distinct_items(items, item_col, text_col)
    for block in item_blocks(texts, similarity):
        shared = spark.sparkContext.broadcast(block)

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ready = shared.value.prepare()
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), [plain(t) for t in batch.column(1).to_pylist()]
                hits = [
                    (keys[a + k], ready.ids[item], distance, 1 - distance / len(ready.texts[item]), end)
                    for a, b in _sliced(texts)
                    for k, matches in enumerate(ready.matches(texts[a:b]))
                    for item, (distance, end) in sorted(matches.items())
                ]
                columns = list(zip(*hits, strict=True)) or [()] * 5
                kinds = [batch.schema.field(0).type, None, pa.int32(), pa.float64(), pa.int32()]
                kinds[1] = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "similarity", "place"])

        one = rows.mapInArrow(found, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], schema)
    if all_items.groupBy("text").count().where("count > 1").isEmpty():
        return out
    same = all_items.withColumnRenamed("id", "every_id").join(texts, "text").select(F.col("id").alias("item_id"), "every_id")
    return out.join(same, "item_id").select("doc_id", F.col("every_id").alias("item_id"), "distance", "similarity", "place")


def drop_leaking(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows that hold an item; nothing is shuffled."""
    at = docs.columns.index(text_col)
    for block in item_blocks(distinct_items(items, item_col, text_col)[0], similarity):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ready = shared.value.prepare()
            for batch in batches:
                texts = [plain(t) for t in batch.column(at).to_pylist()]
                stay = [not m for a, b in _sliced(texts) for m in ready.matches(texts[a:b])]
                yield batch.filter(pa.array(stay, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

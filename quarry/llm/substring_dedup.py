"""Removal of repeated byte strings: suffix order of the places where texts may repeat.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere in the corpus is removed. Any
such string holds an anchor: its ``GRAM``-byte gram of the least hash. So two equal strings have an anchor
of the same hash at the same distance from their starts.

1. Each text gives its anchors, each with a hash of its context: the strings whose least gram it is. An
   anchor hash that occurs once rules its strings out. Contexts that occur more than once repeat whole.
2. Different contexts around one hash are the open cases: their bytes go to shards by anchor hash. Those
   that share none of a few windows with another one cannot repeat; the parts of the others that may are
   sorted, shard by shard, by external induced sorting (``suffix_array``), which carries the common prefix of
   neighbours; a common prefix of LENGTH is a repeat. A shard is a file; its queues spill to disk.

Shards are cut at ``SHARD_BYTES`` between anchor hashes. A hash with more than ``MOST_CONTEXTS`` contexts is
never held in one task: its contexts are dealt to parts of about that many, whose strings are compared in a task;
only the strings that a part leaves open meet those of the other parts in joins (``hot_spans``). Matches never cross documents and are judged on the input alone. Copies of whole
texts and of whole contexts, and strings around hashes of so many contexts, are recognised by 128 bits of hashes (a
context by its own 64 beside the 64 of its anchor), all other repeats by their bytes.

Defined cases: a null text is empty; texts under LENGTH bytes keep all bytes; copies of a longer text lose
all bytes; repeated rows count as copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialise
from quarry.llm.suffix_array import MEMORY, descending_suffixes
from quarry.operators.lineage import spread_join

LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1
SHARD_BYTES = 1 << 20
#: Different contexts of one anchor hash that a task may hold; those of a hash with more are dealt to parts of about so many.
MOST_CONTEXTS = 2048
#: Places of one anchor hash from which they are dealt to many tasks.
HOT_PLACES = 100_000
#: Bytes of texts or contexts that a task turns into one batch.
SLICE_BYTES = 1 << 22
#: Bytes of texts whose anchors are found in one pass.
SURVEY_BYTES = 1 << 15
#: Contexts are compared by windows that start at every multiple of so many bytes before the anchor; those around hot hashes
#: by ever finer ones, down to whole strings.
STEP = 24
FINER = (STEP, 8, 2, 1)
_VALUES, _OTHERS = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (7, 8))
_SPANS = "array<struct<a: int, b: int>>"


def gram_hashes(raw: np.ndarray, gram: int = GRAM, values: np.ndarray = _VALUES) -> np.ndarray:
    """Hash of the ``gram`` bytes at each position, by joining hashes of shorter grams."""
    h, size, factor = values[raw], 1, 0x9E3779B97F4A7C15
    while size < gram:
        step = min(size, gram - size)
        h = h[:-step] * np.uint64(factor) + h[step:]
        h = h ^ (h >> np.uint64(29))
        factor = (factor * factor + 2) % (1 << 64)
        size += step
    return h


def _sliding(h: np.ndarray, window: int, least: bool) -> np.ndarray:
    """Least or greatest of every ``window`` neighbours, by windows of doubled size."""
    op, size = np.minimum if least else np.maximum, 1
    while size * 2 <= window:
        h, size = op(h[:-size], h[size:]), size * 2
    rest = window - size
    return op(h[:-rest], h[rest:]) if rest else h


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first and last start of the LENGTH-byte strings whose least gram it is); ties count each."""
    return anchors_of([data])[1:]


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of its anchors) of each text, and (hash, position, first and last start) of all anchors as in ``anchors``.

    The texts are laid end to end, so that one pass of vector steps serves many short ones. Strings that do not lie in
    one text have no least gram: theirs is 0, which is under every hash, so no gram is opened by them.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    if sizes.max(initial=0) < LENGTH:
        return np.zeros(len(texts), np.int64), *(np.zeros(0, np.int64),) * 4
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    least = _sliding(h, WINDOW, True)
    for a, b in zip(np.maximum(begin, ends - LENGTH + 1).tolist(), ends.tolist(), strict=True):
        least[a:b] = 0
    opened = _sliding(np.r_[np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)], WINDOW, False)
    at = np.flatnonzero((opened == h) & (opened != 0))
    begins = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    run_ends, value = np.r_[begins[1:], len(least)], least[begins]
    # The strings of an anchor are a part of one run of equal least hashes.
    run = np.searchsorted(begins, np.maximum(0, at - WINDOW + 1), "right") - 1
    while (other := value[run] != h[at]).any():
        run[other] += 1
    owner = np.searchsorted(ends, at, "right")
    low, high = np.maximum(begins[run], at - WINDOW + 1), np.minimum(run_ends[run] - 1, at)
    return np.bincount(owner, minlength=len(texts)), h[at].view(np.int64), *(x - begin[owner] for x in (at, low, high))


#: A place is one number: position of the anchor, bytes of the context before it, bytes beyond LENGTH.
_OFF, _SIZE = 1 << 16, 1 << 8


def context(data: bytes, place: int) -> tuple[int, bytes]:
    """Bytes before the anchor, and all bytes, of the context at ``place``."""
    at, off, more = place // _OFF, place // _SIZE % _SIZE, place % _SIZE
    return off, data[at - off : at - off + LENGTH + more]


def _list_of(sizes: list[int], fields: dict[str, tuple[list, pa.DataType]]) -> pa.Array:
    """A list array whose rows hold so many structs of the given flat fields."""
    offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v, t) for v, t in fields.values()], names=list(fields)))


def _of_lists(lists: pa.Array, *fields: str) -> Iterator[tuple]:
    """(row, fields) of all structs in an array of lists."""
    flat = pc.list_flatten(lists)
    return zip(pc.list_parent_indices(lists).to_pylist(), *(flat.field(f).to_pylist() for f in fields), strict=True)


def _pick(key: bytes, doc_id: object) -> bytes:
    """One key for a text and its row's id, so that the copies of a text are spread."""
    return xxhash.xxh3_128_digest(key + repr(doc_id).encode("utf-8", "replace"))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row_tag", "doc_id", "key", "pick", "n_bytes", "sha", "anchors"]
    for batch in batches:
        first, size, raw = 0, 0, []
        for k, text in enumerate(batch.column(2)):
            raw.append((text.as_py() or "").encode("utf-8", "replace"))
            size += len(raw[-1])
            if size >= SURVEY_BYTES or k + 1 == batch.num_rows:
                rows = batch.slice(first, len(raw))
                keys = [xxhash.xxh3_128_digest(data) for data in raw]
                picks = [_pick(key, doc_id) for key, doc_id in zip(keys, rows.column(1).to_pylist(), strict=True)]
                own, h, at, low, high = anchors_of(raw)
                spans = zip(np.repeat(np.arange(len(raw)), own).tolist(), (at - low).tolist(), low.tolist(), (high + LENGTH).tolist(), strict=True)
                c = [xxhash.xxh3_64_intdigest(raw[i][a:b], seed=off) - (1 << 63) for i, off, a, b in spans]
                found = _list_of(own.tolist(), {"h": (h, pa.int64()), "c": (c, pa.int64()), "p": (at * _OFF + (at - low) * _SIZE + high - low, pa.int64())})
                shas = [hashlib.sha256(data).hexdigest() for data in raw]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(keys, pa.binary()), pa.array(picks, pa.binary()), pa.array([len(data) for data in raw], pa.int64()), pa.array(shas), found], names=names)
                first, size, raw = k + 1, 0, []


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(h: list, c: list, off: list, data: list, hot: list, once: list, part: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(off, pa.int32()), pa.array(data, pa.binary()), pa.array(hot, pa.bool_()), pa.array(once, pa.bool_()), pa.array(part, pa.int64())], names=["h", "c", "off", "data", "hot", "once", "part"])

    for batch in batches:
        h, c, off, data, hot, once, part, size, last, raw = [], [], [], [], [], [], [], 0, -1, b""
        for k, own_h, own_c, p, own_hot, own_once, own_part in _of_lists(batch.column(1), "h", "c", "p", "hot", "once", "part"):
            if k != last:
                last, raw = k, (batch.column(0)[k].as_py() or "").encode("utf-8", "replace")
            before, near = context(raw, p)
            h.append(own_h)
            c.append(own_c)
            off.append(before)
            data.append(near)
            hot.append(own_hot)
            once.append(own_once)
            part.append(own_part)
            size += len(near)
            if size >= SLICE_BYTES:
                yield made(h, c, off, data, hot, once, part)
                h, c, off, data, hot, once, part, size = [], [], [], [], [], [], [], 0
        yield made(h, c, off, data, hot, once, part)


def may_repeat(offsets: list[int], contexts: list[bytes]) -> list[tuple[int, int] | None]:
    """For contexts of one anchor hash: the part that may hold a LENGTH-byte string of another one, or None.

    A string with l bytes before the anchor holds the LENGTH - STEP bytes from floor(l / STEP) * STEP before
    it; so two contexts that share the string share one of these few windows at the same distance. The part
    runs from the first byte of any such string to the last one.
    """
    size = LENGTH - STEP
    seen: dict[tuple[int, int], int] = {}
    shared: list[tuple[int, int] | None] = [None] * len(contexts)
    for k, (off, data) in enumerate(zip(offsets, contexts, strict=True)):
        for back in range(0, min(off, LENGTH - GRAM) + 1, STEP):
            if off - back + size > len(data):
                continue
            before = seen.setdefault((back, xxhash.xxh3_64_intdigest(data[off - back : off - back + size])), k)
            if before != k:
                for x in (before, k):
                    least, most = shared[x] or (back, back)
                    shared[x] = (min(least, back), max(most, back))
    return [s and (max(0, off - s[1] - STEP + 1), min(len(data), off - s[0] + LENGTH)) for s, off, data in zip(shared, offsets, contexts, strict=True)]


def _in_runs(text: np.ndarray, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, run number) of suffixes with a neighbour of the same LENGTH bytes; a run is whole within a block."""
    held_at, held_run, run = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for at, lcp in descending_suffixes(text, LENGTH, memory):
        number = run + np.cumsum(lcp < LENGTH)
        run = int(number[-1])
        at, number = np.append(held_at, at), np.append(held_run, number)
        same = number[1:] == number[:-1]
        shared = np.append(False, same) | np.append(same, False)
        done = number < run
        yield at[shared & done], number[shared & done]
        held_at, held_run = at[~done], number[~done]
    if len(held_at) > 1:
        yield held_at, held_run


def repeated_spans(text: np.ndarray, sizes: np.ndarray, groups: np.ndarray, offsets: np.ndarray, memory: int = MEMORY) -> list[list[dict]]:
    """For contexts of anchor hashes (as group numbers), laid end to end in ``text``, the spans whose strings another one repeats."""
    begins = np.cumsum(np.append(0, sizes[:-1]))
    out: list[list[dict]] = [[] for _ in sizes]
    with tempfile.TemporaryFile() as file:
        hit = np.memmap(file, bool, "w+", shape=(len(text),))
        for at, run in _in_runs(text, memory):
            mine = np.searchsorted(begins, at, "right") - 1
            # Equal strings at the same distance from the same anchor hash; other neighbours may be the same place.
            distance = offsets[mine] - (at - begins[mine])
            ok = (at + LENGTH <= begins[mine] + sizes[mine]) & (distance >= 0) & (distance <= LENGTH - GRAM)
            at, run, distance, group = at[ok], run[ok], distance[ok], groups[mine[ok]]
            if len(at):
                place = ((run - run[0]) * (groups[-1] + 1) + group) * WINDOW + distance
                by = np.argsort(place, kind="stable")
                same = place[by][1:] == place[by][:-1]
                hit[at[by[np.append(False, same) | np.append(same, False)]]] = True
        for first in range(0, len(text), memory * 16):
            starts = np.flatnonzero(hit[first : first + memory * 16]) + first
            if not len(starts):
                continue
            mine = np.searchsorted(begins, starts, "right") - 1
            opens = np.append(True, (mine[1:] != mine[:-1]) | (starts[1:] - starts[:-1] > LENGTH))
            closes = np.append(opens[1:], True)
            for k, a, b in zip(mine[opens].tolist(), (starts - begins[mine])[opens].tolist(), (starts - begins[mine])[closes].tolist(), strict=True):
                out[k].append({"a": a, "b": b + LENGTH})
    return out


class Shard:
    """Contexts of whole anchor hashes; their bytes are in a file."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.size, self.h, self.c, self.off, self.sizes, self.groups = 0, [], [], [], [], []

    def add(self, rows: list[tuple]) -> None:
        """Rows (h, c, bytes before the anchor, data) of one hash."""
        group = self.groups[-1] + 1 if self.groups else 0
        for h, c, off, data in rows:
            self.file.write(data)
            self.size += len(data)
            self.h.append(h)
            self.c.append(c)
            self.off.append(off)
            self.sizes.append(len(data))
            self.groups.append(group)

    def spans(self) -> list[list[dict]]:
        self.file.flush()
        text = np.memmap(self.file, np.uint8, "r", shape=(self.size,))
        return repeated_spans(text, *(np.array(x, np.int64) for x in (self.sizes, self.groups, self.off)))


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hot and h; a shard ends between two hashes once it has SHARD_BYTES. Hot rows go on,
    batch by batch, with what their strings tell (``_compared``)."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def sort(shard: Shard) -> pa.RecordBatch:
        # Spans count from the anchor, so that they fit every occurrence of the context.
        told = [(h, c, [{"a": s["a"] - off, "b": s["b"] - off} for s in own]) for h, c, off, own in zip(shard.h, shard.c, shard.off, shard.spans(), strict=True) if own]
        shard.file.close()
        h, c, s = zip(*told, strict=True) if told else ((), (), ())
        return told_of(pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(s, kind), *(pa.nulls(len(h), t) for t in (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary())))

    def told_of(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["h", "c", "spans", "off", "data", "least", "most", "lead", "open"])

    shard, group = Shard(), []

    def settle() -> None:
        """Moves the parts of the rows of one hash that may repeat to the shard."""
        parts = may_repeat([r[2] for r in group], [r[3] for r in group])
        stay = [(h, c, off - p[0], data[p[0] : p[1]]) for (h, c, off, data), p in zip(group, parts, strict=True) if p]
        if stay:
            shard.add(stay)
        group.clear()

    for batch in batches:
        hot = batch.filter(batch.column(4))
        if hot.num_rows:
            h, c, off, data = hot.columns[:4]
            once = hot.column(5) if hot.num_columns > 5 else pa.array([True] * len(h))
            yield told_of(h, c, pa.nulls(len(h), kind), off, data, *_compared(h, off, data, once))
        cold = batch.filter(pc.invert(batch.column(4)))
        for row in zip(*(x.to_pylist() for x in cold.columns[:4]), strict=True):
            if group and row[0] != group[-1][0]:
                settle()
                if shard.size >= SHARD_BYTES:
                    yield sort(shard)
                    shard = Shard()
            group.append(row)
    if group:
        settle()
    if shard.size:
        yield sort(shard)


def _keys(h: pa.Array, off: np.ndarray, data: pa.Array, owner: np.ndarray, back: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window: of the ``size`` bytes from ``back`` bytes before the anchor of context ``owner`` on, of that
    distance and of the anchor hash."""
    raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    ends = np.cumsum(pc.binary_length(data).to_numpy())
    at = np.append(0, ends[:-1])[owner] + off[owner] - back
    place = h.to_numpy().view(np.uint64)[owner] * np.uint64(0x9E3779B97F4A7C15) + back.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out = []
    for values in (_VALUES, _OTHERS):
        key = (gram_hashes(raw, size, values)[at] ^ place) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(key ^ (key >> np.uint64(32)))
    return out[0].view(np.int64), out[1].view(np.int64)


def _packed(owner: np.ndarray, back: np.ndarray, rows: int) -> pa.Array:
    """A bit for each distance, for each of so many contexts."""
    bits = np.zeros((rows, WINDOW), bool)
    bits[owner, back] = True
    return pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())


def _unpacked(bits: pa.Array) -> np.ndarray:
    width = -(-WINDOW // 8)
    return np.unpackbits(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(-1, width), axis=1)[:, :WINDOW].astype(bool)


def _compared(h: pa.Array, off: pa.Array, data: pa.Array, once: pa.Array) -> tuple[pa.Array, ...]:
    """(least, most, lead, open) for contexts of one batch: the nearest and farthest distances before the anchor at which a
    context that occurs once has a string that another one of them holds (null: none; contexts that occur more than
    once repeat whole); the distances of the strings that it is the first to hold; and those of its strings beyond least
    and most, which no other context here holds."""
    rows, off, once = len(h), off.to_numpy(), once.to_numpy(zero_copy_only=False)
    far = np.minimum(off, WINDOW - 1)
    counts = far - np.maximum(0, off + LENGTH - pc.binary_length(data).to_numpy()) + 1
    owner, begins = np.repeat(np.arange(rows), counts), np.cumsum(counts) - counts
    back = far[owner] - (np.arange(len(owner)) - begins[owner])
    a, b = _keys(h, off, data, owner, back, LENGTH)
    by = np.lexsort((b, a))
    other = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
    lead, alone = np.zeros(len(by), bool), np.zeros(len(by), bool)
    lead[by] = np.append(True, other)
    alone[by] = np.append(True, other) & np.append(other, True)
    least = np.minimum.reduceat(np.where(alone, WINDOW, back), begins)
    most = np.maximum.reduceat(np.where(alone, -1, back), begins)
    open_ = alone & once[owner] & ((back < least[owner]) | (back > most[owner]))
    none = (most < 0) | ~once
    return (
        pa.array(least.astype(np.int32), mask=none), pa.array(most.astype(np.int32), mask=none),
        _packed(owner[lead], back[lead], rows), _packed(owner[open_], back[open_], rows),
    )


def _windows(step: int, above: int | None):
    """(h, c, back, a, b, wanted): the LENGTH - step + 1 bytes that all strings with back <= l < back + step bytes before the
    anchor hold, where the context is the first in its batch to hold one of them; wanted: where one is open. Of the windows of
    a coarser step ``above``, only those at ``backs`` are opened."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h, c, off, data, lead, open_, *backs = batch.columns
                lead, open_ = _unpacked(lead), _unpacked(open_)
                if above:
                    live = np.zeros((batch.num_rows, -(-WINDOW // above)), bool)
                    live[pc.list_parent_indices(backs[0]).to_numpy(), pc.list_flatten(backs[0]).to_numpy() // above] = True
                    lead = lead & np.repeat(live, above, axis=1)[:, :WINDOW]
                lead, open_ = (np.logical_or.reduceat(x, np.arange(0, WINDOW, step), axis=1) for x in (lead, open_))
                owner, block = np.nonzero(lead)
                a, b = _keys(h, off.to_numpy(), data, owner, block * step, LENGTH - step + 1)
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([h.take(own), c.take(own), pa.array((block * step).astype(np.int32)), pa.array(a), pa.array(b), pa.array(open_[owner, block])], names=["h", "c", "back", "a", "b", "wanted"])

    return apply


def hot_spans(hot: DataFrame) -> DataFrame:
    """(h, c, spans) of those contexts that occur once, of anchor hashes with any number of contexts, from what their
    parts tell (h, c, off, data, least, most, lead, open). A context that occurs more than once is a partner alone.

    What is open in a batch of a part meets the strings of the others, each once a batch: first by windows that hold several
    strings, then, where those are shared, by ever smaller ones, down to the strings. Keys are counted by a pre-aggregated groupBy, so neither a
    hash nor a string is held in one task, and the joins hand on no more than the windows and what was open and repeats.
    """
    kind = "h long, c long, back int, a long, b long, wanted boolean"
    shared = lambda rows: rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("wanted").alias("any")).where("n > 1 and any").select("a", "b")
    columns, live, above = ["h", "c", "off", "data", "lead", "open"], None, None
    for step in FINER:
        own = hot.select(columns) if live is None else hot.join(live, ["h", "c"]).select(*columns, "backs")
        rows = materialise(own.mapInArrow(_windows(step, above), kind))
        live = rows.join(shared(rows), ["a", "b"], "left_semi").groupBy("h", "c").agg(F.collect_list("back").alias("backs"))
        above = step
    found = rows.where("wanted").join(shared(rows), ["a", "b"], "left_semi").select("h", "c", F.col("back").alias("least"), F.col("back").alias("most"))
    told = hot.where("least is not null").select("h", "c", "least", "most").unionByName(found)
    # All strings of a context hold its anchor, so together they are one span.
    least, most = F.min("least"), F.max("most")
    return told.groupBy("h", "c").agg(F.array(F.struct((-most).alias("a"), (F.lit(LENGTH) - least).alias("b"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, shas = [], [], []
        found: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
        for k, a, b in _of_lists(batch.column(2), "a", "b"):
            found[k].append((a, b))
        for text, own in zip(batch.column(1).to_pylist(), found, strict=True):
            data = (text or "").encode("utf-8", "replace")
            runs = merged([(max(0, a), min(len(data), b)) for a, b in own])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            removed.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            shas.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)], names=["key", "n_removed", "n_spans", "kept_sha256"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        picks = [_pick(xxhash.xxh3_128_digest((t or "").encode("utf-8", "replace")), i) for i, t in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(picks, pa.binary()), batch.column(1)], names=["pick", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_tag"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    base = materialise(rows.mapInArrow(_survey, f"row_tag long, doc_id {kind}, key binary, pick binary, n_bytes long, sha string, anchors array<struct<h: long, c: long, p: long>>"))
    copies = base.groupBy("key").agg(F.min(F.struct("row_tag", "pick")).alias("first"), F.count(F.lit(1)).alias("copies")).select("key", "first.*", "copies")
    placed = base.select("row_tag", F.explode("anchors").alias("x")).select("row_tag", "x.*")
    # Every place of a hash that occurs more than once; the other places play no part from here on.
    repeated = materialise(placed.groupBy("h").agg(F.count(F.lit(1)).alias("all")).where("all > 1"))
    placed = materialise(spread_join(placed, repeated.select("h"), "h", heavy=repeated.where(F.col("all") > HOT_PLACES).select("h")))
    counted = placed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_tag", "p")).alias("first"))
    shared = materialise(counted.join(counted.groupBy("h").agg(F.count(F.lit(1)).alias("forms")), "h"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_keyed, "pick binary, text string")
    # The text of one copy only: a text with many copies is spread by their ids.
    key_of = base.select("row_tag", "key", "pick")
    part = F.pmod("c", F.ceil(F.col("forms") / most_contexts))
    wanted = shared.where("forms > 1").select("first.row_tag", F.struct("h", "c", "first.p", (F.col("forms") > most_contexts).alias("hot"), (F.col("n") == 1).alias("once"), part.alias("part")).alias("w")).groupBy("row_tag").agg(F.collect_list("w").alias("wanted"))
    cut = texts.join(wanted.join(key_of, "row_tag").select("pick", "wanted"), "pick").dropDuplicates(["pick"]).select("text", "wanted").mapInArrow(_cut_contexts, "h long, c long, off int, data binary, hot boolean, once boolean, part long")
    sorted_spans = cut.repartition("h", "part").sortWithinPartitions("hot", "h").mapInArrow(_sort_shards, f"h long, c long, spans {_SPANS}, off int, data binary, least int, most int, lead binary, open binary")
    if not shared.where(F.col("forms") > most_contexts).isEmpty():
        settled = materialise(sorted_spans)
        hot = hot_spans(settled.where("data is not null"))
        sorted_spans = settled.where("data is null").select("h", "c", "spans").unionByName(hot)
    sorted_spans = sorted_spans.select("h", "c", "spans")
    before = F.pmod(F.floor(F.col("first.p") / _SIZE), F.lit(_SIZE)).cast("int")
    whole = F.array(F.struct((-before).alias("a"), (F.pmod("first.p", F.lit(_SIZE)).cast("int") + LENGTH - before).alias("b")))
    spans = sorted_spans.join(shared.where("n > 1").select("h", "c"), ["h", "c"], "left_anti").unionByName(shared.where("n > 1").select("h", "c", whole.alias("spans")))
    at = lambda s: F.struct((F.col("at") + s["a"]).alias("a"), (F.col("at") + s["b"]).alias("b"))
    anchor = F.floor(F.col("p") / _OFF).cast("int").alias("at")
    found = placed.select("row_tag", "h", "c", anchor).join(materialise(spans), ["h", "c"]).select("row_tag", F.transform("spans", at).alias("s"))
    # Copies lose all bytes; only other texts with spans are read again.
    single = copies.where("copies = 1").select("row_tag", "key", "pick")
    partly = found.groupBy("row_tag").agg(F.flatten(F.collect_list("s")).alias("spans")).join(single, "row_tag").drop("row_tag")
    trimmed = texts.join(partly, "pick").dropDuplicates(["pick"]).select("key", "text", "spans").mapInArrow(_trim, "key binary, n_removed long, n_spans long, kept_sha256 string")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    all_gone = lambda out, value, plain: F.when(gone, value).otherwise(F.coalesce(out, plain))
    return (
        base.select("doc_id", "key", "n_bytes", "sha")
        .join(copies.where("copies > 1").select("key", "copies"), "key", "left")
        .join(trimmed, "key", "left")
        .select(
            "doc_id", "n_bytes",
            all_gone("n_removed", F.col("n_bytes"), F.lit(0)).alias("n_removed"),
            all_gone("n_spans", F.lit(1), F.lit(0)).cast("long").alias("n_spans"),
            all_gone("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("sha")).alias("kept_sha256"),
        )
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))

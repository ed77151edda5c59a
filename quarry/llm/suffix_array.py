"""Suffix order and common prefixes by external induced sorting, in vector steps.

Suffixes are typed S or L. The text is cut at its left-most S suffixes (LMS) and, in long stretches, every
few symbols; the pieces are sorted externally and named, and the suffixes of the string of names are sorted
by recursion. The other suffixes are induced from them in two passes: upwards for L, downwards for S. Each
pass is a priority queue of suffix tuples

    (position, common prefix with the tuple before it, leading run of its first symbol, preceding symbols)

ordered by first symbol, then arrival: the suffix before a popped one is pushed under its own first symbol.
A pushed tuple's common prefix is one more than the least common prefix that was popped since the last push
under the same symbol; these minima are a step function of at most ``depth`` steps. Where the L part of a
symbol meets its S part, the common prefix is the shorter of the two runs.

Queues keep ``memory`` tuples and append the rest to a file, as extents of a range of symbols. The text, the
types, the pieces and the L part are files too: the text is read in order but for a few symbols around each
piece, which are read in blocks through a memory map. So memory does not grow with the text. A string of
names of at most ``base`` symbols is sorted in memory.
"""

from __future__ import annotations

import bisect
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue holds in memory before it writes them to its file; also the size of most blocks.
MEMORY = 1 << 16
#: Symbols of the largest string of names that is sorted in memory.
BASE = 1 << 21
RECORD = np.dtype([("pos", "<i4"), ("lcp", "<u2"), ("run", "<u2"), ("tail", "<u8")])
_LEFT = np.uint64(56)
_TAIL = np.uint64((1 << 56) - 1)
_NEVER = -2


def _take(records: np.ndarray, at: np.ndarray) -> np.ndarray:
    """records[at], moved as 16-byte numbers."""
    return records.view(np.complex128)[at].view(RECORD)


def _fresh(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _cuts(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.append(np.flatnonzero(_fresh(values)), len(values))


class Scratch:
    """The files of one part of a sort; they go when it ends."""

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.made = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.folder.cleanup()

    def path(self) -> str:
        self.made += 1
        return f"{self.folder.name}/{self.made}"

    def array(self, n: int, dtype) -> np.ndarray:
        return np.memmap(self.path(), dtype, "w+", shape=(max(n, 1),))

    def log(self, dtype=RECORD) -> Log:
        return Log(self.path(), dtype)


class Log:
    """A file of records that grows at its end."""

    def __init__(self, path: str, dtype):
        self.file, self.dtype, self.size = open(path, "w+b"), np.dtype(dtype), 0

    def append(self, records: np.ndarray) -> int:
        """The number of the first of these records."""
        self.file.seek(0, 2)
        self.file.write(records.tobytes())
        self.size += len(records)
        return self.size - len(records)

    def read(self, first: int, count: int) -> np.ndarray:
        self.file.seek(first * self.dtype.itemsize)
        return np.frombuffer(self.file.read(count * self.dtype.itemsize), self.dtype)

    def backwards(self, low: int, high: int, block: int) -> Iterator[tuple[np.ndarray, bool]]:
        """Records high - 1 down to low in ascending blocks, each with the record after it (and whether there is one)."""
        for end in range(high, low, -block):
            first = max(low, end - block)
            more = end < high
            yield self.read(first, end - first + more), more


class Queue:
    """Priority queue of tuples by (symbol, arrival). ``bounds`` has the first symbol of each range and the end."""

    def __init__(self, scratch: Scratch, text: np.ndarray, bounds: list[int], memory: int):
        self.text, self.bounds, self.memory = text, bounds, memory
        self.starts = np.array(bounds[:-1])
        self.parts: list[deque] = [deque() for _ in bounds[:-1]]
        self.log, self.held = scratch.log(), 0
        self.now, self.inside = -1, {}

    def push(self, symbols: np.ndarray, records: np.ndarray) -> None:
        """Symbols ascend; records of one symbol come in order."""
        k = np.searchsorted(self.starts, symbols, "right") - 1
        cuts = _cuts(k)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if k[a] == self.now:
                self._inside(symbols[a:b], records[a:b])
            else:
                self.parts[k[a]].append(records[a:b])
        self.held += len(records)
        if self.held > self.memory:
            for parts in self.parts:
                fresh = [p for p in parts if isinstance(p, np.ndarray)]
                if fresh:
                    count = sum(map(len, fresh))
                    at = self.log.append(np.concatenate(fresh))
                    while parts and isinstance(parts[-1], np.ndarray):
                        parts.pop()
                    parts.append((at, count))
            self.held = 0

    def _inside(self, symbols: np.ndarray, records: np.ndarray) -> None:
        cuts = _cuts(symbols)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.inside.setdefault(int(symbols[a]), []).append(records[a:b])

    def _front(self, k: int, most: int) -> np.ndarray | None:
        out, size = [], 0
        while self.parts[k] and size < most:
            part = self.parts[k].popleft()
            if isinstance(part, tuple):
                at, count = part
                if count > most:
                    self.parts[k].appendleft((at + most, count - most))
                part = self.log.read(at, min(count, most))
            else:
                self.held -= len(part)
            out.append(part)
            size += len(part)
        return np.concatenate(out) if out else None

    def take(self, symbol: int) -> np.ndarray | None:
        """The next tuples of ``symbol``, or None. Symbols must be taken in order, up or down."""
        k = bisect.bisect_right(self.bounds, symbol) - 1
        if self.bounds[k + 1] - self.bounds[k] == 1:
            return self._front(k, self.memory)
        if k != self.now:
            self.now, self.inside = k, {}
            while (records := self._front(k, self.memory)) is not None:
                symbols = np.asarray(self.text[records["pos"]])
                order = np.argsort(symbols, kind="stable")
                self._inside(symbols[order], _take(records, order))
        found = self.inside.pop(symbol, None)
        return np.concatenate(found) if found else None


class Minima:
    """Least common prefix popped since a time, as a step function."""

    def __init__(self):
        self.at, self.value, self.now = np.zeros(0, np.int64), np.zeros(0, np.int64), -1

    def since(self, times: np.ndarray) -> np.ndarray:
        return np.append(self.value, 1 << 30)[np.searchsorted(self.at, times + 1)]

    def add(self, lcp: np.ndarray) -> None:
        low = np.minimum.accumulate(lcp[::-1])[::-1].astype(np.int64)
        steps = np.flatnonzero(np.append(low[1:] > low[:-1], True))
        stay = self.value < low[0]
        self.at, self.value = np.concatenate((self.at[stay], self.now + 1 + steps)), np.concatenate((self.value[stay], low[steps]))
        self.now += len(lcp)


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last] for each pair, by a table of powers of two."""
    size = last - first + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    rows = [values]
    for k in range(int(level.max())):
        step = 1 << k
        before = rows[-1]
        rows.append(np.concatenate((np.minimum(before[:-step], before[step:]), before[-step:])))
    table = np.stack(rows)
    return np.minimum(table[level, first], table[level, last - (1 << level) + 1])


class Induction:
    """One pass over the suffixes of ``text``, upwards (L) or downwards (S)."""

    def __init__(self, text: np.ndarray, sigma: int, bounds: list[int], up: bool, depth: int, memory: int, scratch: Scratch):
        self.text, self.up, self.depth = text, up, depth
        self.bits, self.slots = (8, 7) if text.dtype == np.uint8 else (28, 2)
        self.queue, self.minima = Queue(scratch, text, bounds, memory), Minima()
        self.last = scratch.array(sigma, np.int64) if sigma > 256 else np.empty(sigma, np.int64)
        self.last[:] = _NEVER

    def tails(self, pos: np.ndarray) -> np.ndarray:
        """Preceding symbols, the nearest lowest, and above them how many there are."""
        count = np.minimum(pos, self.slots)
        out = count.astype(np.uint64) << _LEFT
        for k in range(self.slots):
            symbol = np.asarray(self.text[np.maximum(pos - 1 - k, 0)]).astype(np.uint64)
            out |= np.where(k < count, symbol << np.uint64(self.bits * k), np.uint64(0))
        return out

    def _carried(self, lcp: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Common prefix of each pushed tuple with the one before it under its symbol."""
        fresh = _fresh(symbols)
        out = np.empty(len(at), np.int64)
        again = np.flatnonzero(~fresh)
        if len(again):
            out[again] = _range_minima(lcp, at[again - 1] + 1, at[again]) + 1
        heads = np.flatnonzero(fresh)
        times = np.asarray(self.last[symbols[heads]])
        low = np.minimum(self.minima.since(np.maximum(times, -1)), np.minimum.accumulate(lcp)[at[heads]])
        out[heads] = np.where(times == _NEVER, 0, low + 1)
        ends = np.append(heads[1:] - 1, len(at) - 1)
        self.last[symbols[ends]] = self.minima.now + 1 + at[ends]
        return np.minimum(out, self.depth)

    def pop(self, records: np.ndarray, symbol: int, same: bool) -> None:
        """Push the suffix before each of ``records``, which start with ``symbol``; ``same``: also under the symbol itself."""
        pos, tail, lcp = records["pos"], records["tail"], np.ascontiguousarray(records["lcp"])
        dry = np.flatnonzero((tail >> _LEFT == 0) & (pos > 0))
        if len(dry):
            tail = tail.copy()
            tail[dry] = self.tails(pos[dry])
        left = tail >> _LEFT
        before = (tail & np.uint64((1 << self.bits) - 1)).astype(np.uint8 if self.bits == 8 else np.int32)
        if self.up:
            goes = (before >= symbol) if same else (before > symbol)
        else:
            goes = (before <= symbol) if same else (before < symbol)
        at = np.flatnonzero(goes & (left > 0))
        if len(at):
            at = at[np.argsort(before[at], kind="stable")]
            symbols = before[at].astype(np.int64)
            out = np.empty(len(at), RECORD)
            out["pos"] = pos[at] - 1
            out["lcp"] = self._carried(lcp, at, symbols)
            out["run"] = np.where(symbols == symbol, np.minimum(records["run"][at].astype(np.int64) + 1, self.depth), 1)
            out["tail"] = ((tail[at] & _TAIL) >> np.uint64(self.bits)) | ((left[at] - np.uint64(1)) << _LEFT)
            self.queue.push(symbols, out)
        self.minima.add(lcp)


def external_sort(chunks: Iterator[np.ndarray], keys: tuple[str, ...], memory: int, scratch: Scratch) -> Iterator[np.ndarray]:
    """Blocks in the order of ``keys``: sorted runs on disk, merged block by block."""

    def ordered(x: np.ndarray) -> np.ndarray:
        return x[np.argsort(x[keys[0]], kind="stable") if len(keys) == 1 else np.lexsort([x[k] for k in reversed(keys)])]

    runs: list[list[int]] = []
    log = None
    for chunk in chunks:
        log = log or scratch.log(chunk.dtype)
        runs.append([log.append(ordered(chunk)), len(chunk)])
    if not runs:
        return
    block = max(1, memory // len(runs))
    held = [np.zeros(0, log.dtype) for _ in runs]
    while True:
        for k, (at, count) in enumerate(runs):
            if not len(held[k]) and count:
                held[k] = log.read(at, min(block, count))
                runs[k] = [at + len(held[k]), count - len(held[k])]
        open_runs = [h for h in held if len(h)]
        if not open_runs:
            return
        bound = min(tuple(h[-1][k] for k in keys) for h in open_runs)
        out = []
        for k, h in enumerate(held):
            if len(h):
                within = h[keys[0]] < bound[0]
                equal = h[keys[0]] == bound[0]
                for name, b in zip(keys[1:], bound[1:], strict=True):
                    within |= equal & (h[name] < b)
                    equal &= h[name] == b
                n = int(np.count_nonzero(within | equal))
                out.append(h[:n])
                held[k] = h[n:]
        yield ordered(np.concatenate(out))


def suffix_types(text: np.ndarray, block: int, scratch: Scratch) -> np.ndarray:
    """True for S: the suffix is smaller than the next one; the end counts as smaller than all."""
    out = scratch.array(len(text), bool)
    after, after_s = -1, False
    for b in range(len(text), 0, -block):
        a = max(0, b - block)
        part = np.asarray(text[a:b]).astype(np.int64)
        step = np.sign(np.r_[part[1:], after] - part)
        at = np.where(step != 0, np.arange(b - a), b - a)
        following = np.minimum.accumulate(at[::-1])[::-1]
        out[a:b] = np.r_[step > 0, after_s][following]
        after, after_s = int(part[0]), bool(out[a])
    return out


def _pieces(types: np.ndarray, n: int, most: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, is LMS) of the starts of pieces of at most ``most`` symbols."""

    def cut(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        times = (points[1:] - points[:-1] - 1) // most + 1
        first = np.cumsum(np.r_[0, times[:-1]])
        turn = np.arange(times.sum()) - np.repeat(first, times)
        return np.repeat(points[:-1], times) + most * turn, turn == 0

    last = np.zeros(0, np.int64)
    for a in range(0, n, block):
        low = max(a - 1, 0)
        t = np.asarray(types[low : min(n, a + block)])
        points = np.r_[last, np.flatnonzero(t[1:] & ~t[:-1]) + low + 1]
        if len(points) > 1:
            yield cut(points)
        last = points[-1:]
    if len(last):
        yield cut(np.r_[last, n])


def _direct(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before) of a short string, by ranks of ever longer prefixes."""

    def ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
        order = np.argsort(keys)
        found = keys[order]
        out = np.empty(len(keys), np.int64)
        out[order] = np.cumsum(np.concatenate(([False], found[1:] != found[:-1])))
        return out, int(out[order[-1]]) + 1

    def after(rank: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(rank), np.int64)
        out[: len(rank) - by] = rank[by:] + 1
        return out

    n = len(text)
    rank = np.asarray(text).astype(np.int64)
    names = int(rank.max()) + 1
    levels, lengths = [rank.astype(np.int32)], [1]
    while lengths[-1] < depth and names < n:
        known, key, by = lengths[-1], rank, 2
        if names < 1 << 20:
            key, by = key * (names + 1) + after(rank, min(known, n)), 3
        rank, names = ranks(key * (names + 1) + after(rank, min((by - 1) * known, n)))
        levels.append(rank.astype(np.int32))
        lengths.append(known * by)
    order = np.argsort(rank)
    x, y, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
    for ranked, known in zip(levels[::-1], lengths[::-1], strict=True):
        level = np.append(ranked, np.int32(-1))
        for _ in range(2):
            step = np.where(level[x] == level[y], known, 0)
            x, y, lcp = x + step, y + step, lcp + step
            if not step.any():
                break
    return order, np.minimum(np.append(0, lcp), depth)


def _names(text: np.ndarray, starts: np.ndarray, types: np.ndarray, most: int, memory: int, scratch: Scratch, runs: Scratch) -> tuple[np.ndarray, int, list[int]]:
    """The string of names of the pieces, how many names there are, and ranges of names of bounded frequency."""
    n, count = len(text), len(starts)
    wide, per_key, keys = (10, 6, ("k0",)) if text.dtype == np.uint8 else (30, 2, ("k0", "k1"))
    dtype = np.dtype([(k, "<i8") for k in keys] + [("r", "<i4")])

    def keyed() -> Iterator[np.ndarray]:
        for a in range(0, count, memory):
            p = np.asarray(starts[a : a + memory]).astype(np.int64)
            end = np.r_[p[1:], int(starts[a + memory]) if a + memory < count else n]
            out = np.zeros(len(p), dtype)
            for k in range(most + 1):
                at = np.minimum(p + k, n - 1)
                # Symbols with their types: no piece is the beginning of another.
                symbol = np.where((p + k <= end) & (p + k < n), 2 * np.asarray(text[at]).astype(np.int64) + types[at] + 1, 0)
                out[keys[k // per_key]] |= symbol << (wide * (per_key - 1 - k % per_key))
            out["r"] = np.arange(a, a + len(p))
            yield out

    names = scratch.array(count, np.int32)
    name, before, bounds, within = -1, None, [0], 0
    for block in external_sort(keyed(), keys, memory, runs):
        fresh = np.zeros(len(block), bool)
        for k in keys:
            fresh[1:] |= block[k][1:] != block[k][:-1]
        head = tuple(block[0][k] for k in keys)
        fresh[0] = head != before
        before = tuple(block[-1][k] for k in keys)
        own = name + np.cumsum(fresh)
        names[block["r"]] = own
        edges = np.flatnonzero(fresh)
        for at, size in zip(own[edges].tolist(), np.diff(np.r_[edges, len(block)]).tolist(), strict=True):
            # A range ends before a name that would make it longer than a block, and after one that alone is.
            if at > bounds[-1] and within + size > memory // 4:
                bounds.append(at)
                within = 0
            within += size
        if len(edges) == 0:
            within += len(block)
        name = int(own[-1])
    return names, name + 1, [*bounds, name + 1]


def _lms_order(text: np.ndarray, depth: int, memory: int, base: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, common prefix with the one before) of the LMS suffixes in ascending order."""
    n, most = len(text), 5 if text.dtype == np.uint8 else 3
    types = suffix_types(text, memory, scratch)
    starts, is_lms, count = scratch.array(n // 2 + n // most + 2, np.int32), scratch.array(n // 2 + n // most + 2, bool), 0
    for at, lms in _pieces(types, n, most, memory):
        starts[count : count + len(at)], is_lms[count : count + len(at)] = at, lms
        count += len(at)
    starts, is_lms = starts[:count], is_lms[:count]
    if not count:
        return
    with Scratch() as runs:
        names, distinct, bounds = _names(text, starts, types, most, memory, scratch, runs)
    log = scratch.log(np.dtype([("r", "<i4"), ("lcp", "<i4")]))

    def keep(r: np.ndarray, lcp: np.ndarray) -> None:
        out = np.empty(len(r), log.dtype)
        out["r"], out["lcp"] = r, lcp
        log.append(out)

    if count <= base:
        order, lcp = _direct(names, depth)
        keep(order[::-1], np.r_[0, lcp[:0:-1]])
    else:
        for r, lcp in _descending(names, distinct, bounds, depth, memory, base):
            keep(r, lcp)

    low, before = depth, -1
    for block, more in log.backwards(0, log.size, memory):
        # The log descends: the one before a suffix in ascending order is the record after it.
        r = block["r"][::-1].astype(np.int64)
        equal = block["lcp"][::-1].astype(np.int64)
        if more:
            r, equal = r[1:], equal[:-1]
            pairs, others, known = r, np.r_[before, r[:-1]], equal
        else:
            pairs, others, known = r[1:], r[:-1], equal[:-1]
        before = int(r[-1])
        end = lambda x: np.where(x < count, np.asarray(starts[np.minimum(x, count - 1)]), n).astype(np.int64)
        lcp = end(pairs + known) - end(pairs)
        x, y = end(others), end(pairs)
        alive = np.flatnonzero(lcp < depth)
        while len(alive):
            i, j = x[alive] + lcp[alive], y[alive] + lcp[alive]
            ok = (i < n) & (j < n)
            alive, i, j = alive[ok], i[ok], j[ok]
            alive = alive[np.asarray(text[i]) == np.asarray(text[j])]
            lcp[alive] += 1
            alive = alive[lcp[alive] < depth]
        lcp = np.minimum(lcp, depth) if more else np.r_[0, np.minimum(lcp, depth)]
        # Cuts inside long stretches only served to name pieces.
        stay = np.flatnonzero(np.asarray(is_lms[r]))
        if not len(stay):
            low = min(low, int(lcp.min()))
            continue
        kept = np.minimum.reduceat(lcp[: stay[-1] + 1], np.r_[0, stay[:-1] + 1])
        kept[0] = min(kept[0], low)
        tail = lcp[stay[-1] + 1 :]
        low = int(tail.min()) if len(tail) else depth
        yield end(r[stay]), kept


def _descending(text: np.ndarray, sigma: int, bounds: list[int], depth: int, memory: int, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    with Scratch() as scratch:
        lower, ends = scratch.log(), scratch.array(sigma + 1, np.int64)
        with Scratch() as below, Scratch() as queue:
            _upwards(text, sigma, lower, ends, Induction(text, sigma, bounds, True, depth, memory, queue), _lms_order(text, depth, memory, base, below))
        down = Induction(text, sigma, bounds, False, depth, memory, scratch)
        for c in range(sigma - 1, -1, -1):
            run = 0
            while (records := down.queue.take(c)) is not None:
                run = int(records["run"][-1])
                yield records["pos"], records["lcp"]
                down.pop(records, c, True)
            for block, more in lower.backwards(int(ends[c]), int(ends[c + 1]), memory):
                records = block[: len(block) - more][::-1].copy()
                shifted = block["lcp"][::-1]
                records["lcp"] = shifted[:-1] if more else np.append(min(run, int(records["run"][0])), shifted[:-1])
                yield records["pos"], records["lcp"]
                down.pop(records, c, False)


def _upwards(text: np.ndarray, sigma: int, lower: Log, ends: np.ndarray, up: Induction, lms: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
    """Writes the L tuples in order to ``lower``; those of symbol c end at ``ends[c + 1]``."""
    n, depth = len(text), up.depth

    def seeds() -> Iterator[np.ndarray]:
        """LMS tuples of one symbol at a time, ascending."""
        for pos, lcp in lms:
            out = np.empty(len(pos), RECORD)
            out["pos"], out["lcp"], out["tail"] = pos, lcp, up.tails(pos)
            run, alive, symbols = np.ones(len(pos), np.int64), np.arange(len(pos)), np.asarray(text[pos])
            while len(alive):
                # An S suffix never ends within its leading run.
                alive = alive[np.asarray(text[pos[alive] + run[alive]]) == symbols[alive]]
                run[alive] += 1
                alive = alive[run[alive] < depth]
            out["run"] = run
            cuts = _cuts(symbols)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield int(symbols[a]), out[a:b]

    last = np.empty(1, RECORD)
    last["pos"], last["lcp"], last["run"], last["tail"] = n - 1, 0, 1, up.tails(np.array([n - 1]))
    final = int(text[n - 1])
    up.last[final] = -1
    up.queue.push(np.array([final]), last)
    coming = seeds()
    seed = next(coming, None)
    for c in range(sigma):
        run = 0
        while (records := up.queue.take(c)) is not None:
            lower.append(records)
            run = int(records["run"][-1])
            up.pop(records, c, True)
        first = True
        while seed and seed[0] == c:
            records = seed[1]
            if first:
                records["lcp"][0] = min(run, int(records["run"][0]))
            first = False
            up.pop(records, c, False)
            seed = next(coming, None)
        ends[c + 1] = lower.size


def descending_suffixes(text: np.ndarray, depth: int, memory: int = MEMORY, base: int = BASE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, common prefix with the suffix before it, ``depth`` at most), the greatest suffix first.

    ``text`` holds bytes, in memory or as a memory map. Suffixes that agree in ``depth`` bytes may stand in any order.
    """
    if len(text):
        yield from _descending(text, 256, list(range(257)), depth, memory, base)

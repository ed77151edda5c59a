"""Phrase collocations by contiguous pattern growth.

Pattern growth in the manner of PrefixSpan: every occurrence of a frequent first word is projected as a pointer with
the words to its right, and each prefix is grown to the right, depth first, over its own pointers alone. One task gets
all pointers of a prefix; a prefix that holds ``HOT_SHARE`` of a language's words or more is dealt to tasks by its
second word, so it is grown in many tasks and each pattern still in one. Pointers of one task that see the same words
travel as one row with their number, packed in arrays.

Words of a language are counted first. Rare words end a projection: whether a word may be frequent is told by a bitmap
of ``SLOT_BITS`` bits of its hash, which has a fixed size and lets through all frequent words (and some rare ones,
which cost time but change nothing). Words are told apart by 64-bit hashes; should two words of a language have the
same one, which the word counts show, hashing starts anew with another seed. So all counts are exact.

Defined cases: a null text has no words; a null language is ``und``; a text without a separator is one piece, however
long (texts are handled as a stream of tokens, a slice at a time); rows that repeat are counted each; ties of a
score go by count, then by phrase; an empty table, or one without frequent phrases, gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import blocks, documents, materialise

UND = "und"
#: Bits of a hash that the bitmap of frequent words tells apart.
SLOT_BITS = 26
#: A first word with this share of its language's words or more is dealt out by its second word; there are at most
#: 1 / HOT_SHARE such words in a language.
HOT_SHARE = 1 / 4096
#: Tokens that a task counts at once, and pointers of a group of prefixes (before equal ones are merged).
SLICE, GROUP = 3_000_000, 2_000_000
#: Bits of a word's number within a slice: a slice has fewer words than numbers.
_NUMBER = 21
#: A-Z to lower case, separators of pieces to a byte that no UTF-8 text has, a tab to a space.
_PIECE = b"\xff"
_TABLE = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    """Words, with a separator between pieces."""
    data = (text or "").encode("utf-8", "replace").translate(_TABLE)
    return data.replace(_PIECE, b" \xff ").split(b" ")


class Numbers(dict):
    """word -> number within a slice; the separator and the empty string between two spaces have fixed ones."""

    def __init__(self) -> None:
        super().__init__({_PIECE: 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value

    def hashes(self, seed: int) -> np.ndarray:
        """By number; never 0 for a word."""
        out = np.fromiter((xxhash.xxh64_intdigest(w, seed) or 1 for w in self), np.uint64, len(self))
        out[:2] = 0
        return out.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Numbers, np.ndarray]]:
    """(language, numbers, stream of word numbers) of about SLICE tokens each; columns: lang, text.

    Texts end with a separator. A text of more tokens than a slice holds is a stream of its own.
    """
    held: dict[str, list[np.ndarray]] = {}
    numbers: dict[str, Numbers] = {}
    size: dict[str, int] = {}

    def done(lang: str) -> tuple[str, Numbers, np.ndarray]:
        out = lang, numbers.pop(lang), np.concatenate(held.pop(lang))
        del size[lang]
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            tokens = tokens_of(text)
            tokens.append(_PIECE)
            if lang not in held:
                held[lang], numbers[lang], size[lang] = [], Numbers(), 0
            ids = np.fromiter(map(numbers[lang].__getitem__, tokens), np.int32, len(tokens))
            held[lang].append(ids[ids != 1])
            size[lang] += len(tokens)
            if size[lang] > SLICE or len(numbers[lang]) > 1 << (_NUMBER - 1):
                yield done(lang)
        largest = max(size, key=size.get, default=None)
        if largest is not None and sum(size.values()) > 2 * SLICE:
            yield done(largest)
    for lang in list(held):
        yield done(lang)


def _words(seed: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, numbers, stream in _slices(batches):
            n = np.bincount(stream, minlength=len(numbers))[2:]
            words = list(numbers)[2:]
            for a in range(0, len(words), 1 << 17):
                part = slice(a, a + (1 << 17))
                own = words[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own), pa.string()), pa.array(numbers.hashes(seed)[2:][part]), pa.array([w.decode() for w in own], pa.string()), pa.array(n[part].astype(np.int64))],
                    names=["lang", "h", "word", "n"],
                )

    return counted


def count_words(rows: DataFrame, seeds: int = 8) -> tuple[DataFrame, int]:
    """(lang, h, word, n) of all words of ``rows`` (lang, text), and the seed under which no two words share a hash."""
    for seed in range(seeds):
        counted = rows.mapInArrow(_words(seed), "lang string, h long, word string, n long")
        words = materialise(counted.groupBy("lang", "h").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("n")))
        if words.where("word <> other").isEmpty():
            return words.drop("other"), seed
    raise ArithmeticError("words share a 64-bit hash under every seed")


def frequent_slots(words: DataFrame, least: int) -> np.ndarray:
    """A bitmap of the slots of all words that occur ``least`` times: 2^SLOT_BITS bits, whatever the vocabulary."""
    slot = F.shiftrightunsigned("h", 64 - SLOT_BITS) + 1  # Spark's bitmap functions count from 1
    parts = words.where(F.col("n") >= least).groupBy((F.bitmap_bucket_number(slot) - 1).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for r in parts.toLocalIterator():
        bits = np.frombuffer(r["bits"], np.uint8)
        out[r["at"] * 4096 : r["at"] * 4096 + len(bits)] = bits
    return out


def _unique_rows(rows: np.ndarray) -> np.ndarray:
    """Sorted rows (words ..., count), equal ones merged."""
    width = rows.shape[1] - 1
    rows = rows[np.lexsort(tuple(rows[:, k] for k in range(width - 1, -1, -1)))]
    first = np.flatnonzero(np.r_[True, (rows[1:, :width] != rows[:-1, :width]).any(axis=1)])
    out = rows[first]
    out[:, width] = np.add.reduceat(rows[:, width], first)
    return out


def project(stream: np.ndarray, frequent: np.ndarray, hashes: np.ndarray, words: int) -> np.ndarray:
    """Rows (hash of each of ``words`` words, 0 from where the projection ends; count) of the pointers in a slice."""
    ok = np.append(frequent[stream], np.zeros(words, bool))
    at = np.flatnonzero(ok[:-words] & ok[1 : len(ok) - words + 1])
    padded = np.append(stream, np.zeros(words, stream.dtype))
    alive = np.ones(len(at), bool)
    columns = []
    for k in range(words):
        alive &= ok[at + k]
        columns.append(np.where(alive, padded[at + k], 0).astype(np.int64))
    # Three words' numbers fit in one key; longer patterns replace what is packed by its rank.
    key = columns[0]
    used = 1
    for k in range(1, words):
        if used == 3:
            _, key = np.unique(key, return_inverse=True)
            used = 2
        key = key << _NUMBER | columns[k]
        used += 1
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return np.stack([*(hashes[c[first]] for c in columns), n.astype(np.int64)], axis=1)


def _group_of(rows: np.ndarray, hot: np.ndarray, groups: int) -> np.ndarray:
    """The group of each pointer's prefix: its first word, with the second one if the first is hot."""
    mixed = rows[:, 0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, rows[:, 0]), len(hot) - 1)
        mixed = np.where(hot[at] == rows[:, 0], mixed ^ rows[:, 1].view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), mixed)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def grow(rows: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(pattern, count) of all patterns of two words or more, each prefix grown depth first over its own pointers.

    ``rows`` are sorted, so the pointers of a prefix are a range of rows.
    """
    counts, deepest = rows[:, -1], rows.shape[1] - 1
    columns = [np.ascontiguousarray(rows[:, k]) for k in range(deepest)]

    def extend(prefix: tuple[int, ...], low: int, high: int) -> Iterator[tuple[tuple[int, ...], int]]:
        following = columns[len(prefix)][low:high]
        first = np.flatnonzero(np.r_[True, following[1:] != following[:-1]])
        sums = np.add.reduceat(counts[low:high], first)
        ends = np.append(first[1:], high - low)
        for k in np.flatnonzero((sums >= least) & (following[first] != 0)).tolist():
            pattern = (*prefix, int(following[first[k]]))
            if len(pattern) > 1:
                yield pattern, int(sums[k])
            if len(pattern) < deepest:
                yield from extend(pattern, low + int(first[k]), low + int(ends[k]))

    if len(rows):
        yield from extend((), 0, len(rows))


def frequent_phrases(rows: DataFrame, words: DataFrame, seed: int, least: int = 10, most_words: int = 3) -> DataFrame:
    """(lang, pattern: hashes of its words, a: its count) of phrases of two words or more that occur ``least`` times."""
    spark = rows.sparkSession
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    groups = blocks(totals.agg(F.sum("total")).first()[0] or 0, GROUP)
    hot = words.where(F.col("n") >= least).join(totals, "lang").where(F.col("n") >= F.col("total") * HOT_SHARE).select("h").distinct()
    hot = np.sort(np.array([r["h"] for r in hot.collect()], np.int64))
    shared = spark.sparkContext.broadcast((frequent_slots(words, least), hot))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        for lang, numbers, stream in _slices(batches):
            hashes = numbers.hashes(seed)
            slots = (hashes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            frequent = (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
            frequent[:2] = False
            found = project(stream, frequent, hashes, most_words)
            group = _group_of(found, hot, groups)
            order = np.argsort(group, kind="stable")
            found, group = found[order], group[order]
            if not len(group):
                continue
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.append(first[1:], len(group))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[first], pa.int64()), pa.array([lang] * len(first), pa.string()), pa.array([found[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())],
                names=["prefix_group", "lang", "pointers"],
            )

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, size, floor = None, 0, 0
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.int64())], names=["lang", "pattern", "a"])

        for batch in batches:
            for group, lang, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (group, lang) != now:
                    if held:
                        out.extend((now[1], p, a) for p, a in grow(_unique_rows(np.concatenate(held)), least))
                    held, now, size, floor = [], (group, lang), 0, 0
                held.append(np.frombuffer(data, np.int64).reshape(-1, most_words + 1))
                size += len(held[-1])
                if size > 2 * floor + GROUP:  # merges equal pointers; what is left is what the group must hold
                    held = [_unique_rows(np.concatenate(held))]
                    size = floor = len(held[0])
                if len(out) > 1 << 16:
                    yield told()
                    out.clear()
        if held:
            out.extend((now[1], p, a) for p, a in grow(_unique_rows(np.concatenate(held)), least))
        yield told()

    pointers = rows.mapInArrow(projected, "prefix_group long, lang string, pointers binary")
    dealt = pointers.repartition(max(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))), "prefix_group", "lang").sortWithinPartitions("prefix_group", "lang")
    return dealt.mapInArrow(grown, "lang string, pattern array<long>, a long")


def scored_phrases(phrases: DataFrame, words: DataFrame, contained: int = 50) -> DataFrame:
    """Candidates that no longer candidate makes up for, with their weakest cut: lang, pattern, a, l, r, score."""
    counts = phrases.unionByName(words.select("lang", F.array("h").alias("pattern"), F.col("n").alias("a")))
    part = lambda side, name: counts.select("lang", F.col("pattern").alias(side), F.col("a").alias(name))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("pattern") - 1)))
    cuts = cuts.withColumn("first", F.slice("pattern", F.lit(1), F.col("k"))).withColumn("rest", F.expr("slice(pattern, k + 1, size(pattern) - k)"))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("aa", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("lr", wide("l") * wide("r"))
    weakest = F.min(F.struct(F.expr("aa div lr").alias("score"), "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "pattern", "a").agg(weakest).select("lang", "pattern", "a", "cut.l", "cut.r", "cut.score")
    inner = F.expr("flatten(transform(sequence(2, size(pattern) - 1), m -> transform(sequence(1, size(pattern) - m + 1), i -> slice(pattern, i, m))))")
    longer = phrases.where(F.size("pattern") > 2).select("lang", F.explode(inner).alias("pattern"), "a").groupBy("lang", "pattern").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "pattern"], "left")
    return kept.where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a"))).drop("longer")


def top_collocations(docs: DataFrame, top: int = 2000, least: int = 10, most_words: int = 3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UND)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, seed = count_words(rows)
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = materialise(words.where(F.col("n") >= least))
    phrases = materialise(frequent_phrases(rows, words, seed, least, most_words))
    kept = scored_phrases(phrases, common).withColumn("tag", F.monotonically_increasing_id())
    kept = materialise(kept)
    spelt = kept.select("lang", "tag", F.posexplode("pattern").alias("at", "h")).join(common.select("lang", "h", "word"), ["lang", "h"])
    spelt = spelt.groupBy("lang", "tag").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = kept.join(spelt, ["lang", "tag"]).drop("tag", "pattern")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # The best of each of many parts first, so that no task sorts a whole language.
    parts = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = named.withColumn("part", parts).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    last = first.drop("rank", "part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.join(F.broadcast(n), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), positions AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a,
         any_value(w[i:i + m - 1]) AS ws
  FROM positions, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w)
  GROUP BY lang, m, phrase
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM grams WHERE m > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:m], ' ') AS rest
  FROM candidates c, (SELECT unnest([1, 2]) AS k) WHERE k < m
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, f.a AS l, r.a AS r,
         (1000000::HUGEINT * cuts.a * cuts.a) // (f.a::HUGEINT * r.a) AS score
  FROM cuts JOIN grams f ON f.lang = cuts.lang AND f.phrase = first JOIN grams r ON r.lang = cuts.lang AND r.phrase = rest
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM candidates WHERE m = 3
), cover AS (
  SELECT lang, phrase, max(a) AS most FROM longer GROUP BY lang, phrase
), kept AS (
  SELECT w.* FROM weakest w LEFT JOIN cover USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * w.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) JOIN totals USING (lang) WHERE rank <= 2000
"""

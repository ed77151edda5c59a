"""Quality by passages, phrase collocations and the filter audit, against brute force on small fixtures."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import collocations, filter_audit, quality_mil

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, part string, mask string"


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None, "x", "y", "z", "w")


# Filter audit


def audited():
    rng = random.Random(4)
    words = ["alpha", "beta", "GAMMA", "Delta", "x#", "eps", "zeta", "eta", "theta", "iota"] + [f"w{k}" for k in range(90)]
    texts = [" ".join(rng.choice(words[: rng.choice((3, 12, 100))]) for _ in range(rng.choice((3, 49, 50, 51, 120)))) for _ in range(60)]
    texts += [None, "", " \n\x0b", "é" * 60, "A" * 5, "a b " * 5000] + [texts[3]] * 5 + [texts[7]] * 40
    rows = [row(i, t, source=[None, "", "hot", "b"][i % 4] if i < 70 else "hot") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [row(3, texts[3], source="b"), row(3, texts[3], source="b"), row(None, texts[3]), row(None, None)]


def plain_masks(rows):
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    out = []
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), r[0] is not None and r[0] > least[text]]
        out.append((r[0], r[3] or "", sum(f << k for k, f in enumerate(fails))))
    return out


LABELS = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 110, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1)]


def test_masks_and_duplicates(spark):
    rows = audited()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = Counter()
    for r in filter_audit.failure_masks(docs).collect():
        got[r.doc_id, r.part, r["mask"]] += r.n
    assert got == Counter(plain_masks(rows))
    assert {r.doc_id for r in filter_audit.duplicate_ids(docs).collect()} == {i for i, _, m in plain_masks(rows) if m & 16}


def test_copies_send_one_row_for_each_task_and_collisions_are_told_apart(monkeypatch):
    rows = [(k, "same text", "a") for k in range(1000, 0, -1)] + [(0, "other", "a"), (5, "third", "b")]
    monkeypatch.setattr(filter_audit, "_fingerprint", lambda data: 7)
    sent = list(filter_audit._least_of_task(rows))
    assert sum(isinstance(v[0], bytes) for _, v in sent) == 3 and len(sent) == 1002
    found = sorted((r[0], r[1], r[2] >> 4) for r in filter_audit._settled(sent))
    assert found == sorted([(0, "a", 0), (5, "b", 0), (1, "a", 0)] + [(k, "a", 1) for k in range(2, 1001)])
    monkeypatch.setattr(filter_audit, "HELD", 10)
    assert sorted((r[0], r[2] >> 4) for r in filter_audit._settled(list(filter_audit._least_of_task(rows)))) == sorted((a, e) for a, _, e in found)


def test_audit_equals_a_plain_one(spark):
    rows = audited()
    good = {i: max(int(q == 1) for j, q, _ in LABELS if j == i) for i, _, _ in LABELS if i is not None}
    toxic = {i: max(int(x == 1) for j, _, x in LABELS if j == i) for i, _, _ in LABELS if i is not None}
    masks = plain_masks(rows)
    want = {}
    shares = Counter()
    for part in {p for _, p, _ in masks}:
        own = [(i, m) for i, p, m in masks if p == part]
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone, left = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                failing = sum(bool(m & bit) for _, m in own)
                want[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(m == bit for _, m in own), sum(good.get(i, 0) for i, _ in gone), sum(toxic.get(i, 0) for i, _ in gone))
                shares[part, letter] += len(gone)
    out = filter_audit.interaction_audit(spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(want) == 600 * len({p for _, p, _ in masks})
    for r in out:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want[r.part, r.filter_order, r.step]
        assert r.shapley == shares[r.part, r.filter_order[r.step - 1]]


# Collocations


def phrased():
    rng = random.Random(8)
    words = ["of", "the", "a", "new", "York", "zürich", "e f"] + [f"w{k}" for k in range(12)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randint(5, 300))) for _ in range(30)]
    texts += ["New York City " * 40, "new york; " * 30, None, "", " .,; ", "the " * 3000, "of the " * 25]
    return [row(i, t, [None, "en", "de"][i % 3]) for i, t in enumerate(texts)] + [row(30, "New York City " * 40)] * 3


def plain_phrases(rows, top=2000, least=10, most=3):
    counts = {}
    for r in rows:
        own = counts.setdefault(r[2] or "und", Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, most + 1):
                own.update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = {}
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, k): (p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)}
    return out


@pytest.mark.parametrize(("most", "top"), [(3, 2000), (4, 2000), (2, 5)])
def test_collocations_equal_a_plain_count(spark, monkeypatch, most, top):
    if most == 4:  # small slices and groups: pointers are merged in between, and prefixes are split
        for name, value in (("SLICE", 200), ("GROUP", 50), ("HOT_SHARE", 0.2)):
            monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame(phrased(), SCHEMA).repartition(3)
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.top_collocations(docs, top=top, most_words=most).collect()}
    assert got == plain_phrases(phrased(), top, most=most) and got


def test_words_that_share_a_hash_start_anew(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    real = collocations.xxhash.xxh64_intdigest

    class Colliding:
        @staticmethod
        def xxh64_intdigest(word, seed=0):
            return 5 if seed < 2 and word in (b"one", b"two") else real(word, seed)

    monkeypatch.setattr(collocations, "xxhash", Colliding)
    rows = [pa.record_batch([["en"], ["one two three"]], names=["lang", "text"])]
    assert len({h for b in collocations._words(0)(iter(rows)) for h in b.column("h").to_pylist()}) == 2
    assert len({h for b in collocations._words(2)(iter(rows)) for h in b.column("h").to_pylist()}) == 3
    monkeypatch.undo()
    words, seed = collocations.count_words(docs)
    assert seed == 0 and {r.word: r.n for r in words.collect()} == {"one": 1, "two": 1, "three": 1}


def test_bitmap_holds_all_frequent_words(spark):
    words = spark.range(3000).select(F.xxhash64("id").alias("h"), (F.col("id") % 20).alias("n"))
    bits = collocations.frequent_slots(words, 10)
    slots = np.array([r.h for r in words.where("n >= 10").collect()], np.int64).view(np.uint64) >> np.uint64(64 - collocations.SLOT_BITS)
    assert np.unpackbits(bits, bitorder="little").sum() == len(np.unique(slots))
    assert np.unpackbits(bits, bitorder="little")[slots.astype(np.int64)].all()


# Quality


def bags(n=400):
    """Good documents have plain passages; bad ones have at least one passage of shouts."""
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "po") for b in ("ra", "su", "ti", "vo", "xe")]
    out = []
    for i in range(n):
        parts = [" ".join(rng.choice(plain) for _ in range(90)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            parts[rng.randrange(len(parts))] = " ".join(rng.choice(plain).upper() + "!!" for _ in range(90))
        out.append((i, " ".join(parts), int(i % 3 > 0)))
    return out


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    x, sizes = rng.standard_normal((9, quality_mil.FEATURES)), np.array([2, 1, 4, 2])
    starts, label, weight = np.cumsum(sizes) - sizes, np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 3])
    model = quality_mil.BagModel.fresh(5, 3, 0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    grad, _ = model.gradient(x, starts, sizes, label, weight)
    for name, value in model.p.items():
        at = tuple(rng.integers(0, s) for s in value.shape)
        value[at] += 1e-5
        up = model.gradient(x, starts, sizes, label, weight)[1]
        value[at] -= 2e-5
        down = model.gradient(x, starts, sizes, label, weight)[1]
        value[at] += 1e-5
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_held_out_quality_and_the_passage_that_counts(spark):
    data = bags()
    docs = spark.createDataFrame([row(i, t) for i, t, _ in data], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 4] + [(1, None), (10_000, 1)], "doc_id long, quality int")
    model = quality_mil.fit(docs, labels, per_label=200)
    got = {r.doc_id: (r.score, r.predicted) for r in quality_mil.predict(docs, model).collect()}
    rest = [(i, y) for i, _, y in data if i % 4 == 0]
    assert np.mean([got[i][1] == y for i, y in rest]) > 0.97 and all(p == int(s >= 0.7) and 0 <= s <= 1 for s, p in got.values())
    bad = docs.where("doc_id % 12 = 0")
    weighed = {}
    for r in quality_mil.passage_weights(bad, model).collect():
        weighed.setdefault(r.doc_id, []).append(r)
    texts = {i: t.encode() for i, t, _ in data}
    hit = 0
    for i, own in weighed.items():
        assert sum(r.weight for r in own) == pytest.approx(1, abs=1e-5)
        assert [(r["first"], r["end"]) for r in sorted(own, key=lambda r: r.passage)][-1][1] == len(texts[i])
        lowest = min(own, key=lambda r: r.alone)
        hit += b"!!" in texts[i][lowest["first"] : lowest["end"]]
    assert hit == len(weighed)


def test_quality_cases(spark):
    data = [row(1, None), row(2, ""), row(3, "x" * 200_000), row(None, "a b"), row(1, None), row(4, "é" * 1000)]
    docs = spark.createDataFrame(data, SCHEMA)
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    flat = quality_mil.predict(docs, quality_mil.fit(docs, nothing), score_as="score", predicted_as="predicted")
    assert {(r.score, r.predicted) for r in flat.collect()} == {(0.5, 0)} and flat.columns.count("score") == 1 and flat.count() == len(data)
    one = quality_mil.fit(docs, spark.createDataFrame([(1, 1), (4, 1), (4, 1), (3, None)], "doc_id long, quality int"))
    scores = [r.score for r in quality_mil.predict(docs, one).collect()]
    assert all(0.5 < s <= 1 for s in scores) and scores[0] == pytest.approx(scores[1])
    assert quality_mil.fit(docs, spark.createDataFrame([(77, 1)], "doc_id long, quality int")).p is None
    long = quality_mil.passages_of("é" * 1000 + " word" * 300)
    assert b"".join(long).decode() == "é" * 1000 + " word" * 300 and max(map(len, long)) <= quality_mil.PASSAGE + quality_mil.STRETCH + 3


def test_empty_tables(spark):
    empty, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_mil.predict(empty, quality_mil.fit(empty, labels)).count() == 0
    assert collocations.top_collocations(empty).count() == 0
    assert filter_audit.interaction_audit(empty, labels).count() == 0 and filter_audit.failure_masks(empty).count() == 0

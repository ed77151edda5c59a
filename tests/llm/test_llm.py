"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, exact_dedup, language_id, lm_scoring, near_dedup, packing, pii, secrets, sharding, shingles, substring_dedup, suffix_array
from quarry.llm.components import connected_components
from quarry.llm.tokens import WordIds, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, shard string"


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    long = " ".join(rng.choice(vocabulary) for _ in range(6000))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [None, "", " \n", "one", "same text here", "same  text\there", "same text here", long, long + " end", passage, "x " + passage + " y", long[:300] * 3]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 200))) for _ in range(40)]
    base = texts[20].split()
    texts += [" ".join([*base[:k], "changed", *base[k + 1:]]) for k in (3, 5)] + ["a" * 700, "ab" * 300]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", None, "k", "s", "h") for i, t in enumerate(texts)]
    return rows + [rows[30], rows[30], (None, "no id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    model = language_id.train(empty)
    for out in (sharding.kd_shards(empty, 5), pii.pseudonymise(empty, "k"), packing.pack(empty), near_dedup.near_duplicate_classes(empty), substring_dedup.remove_repeats(empty), secrets.find_secrets(empty), exact_dedup.exact_groups(empty), language_id.predict(empty, model, lang_as="l", score_as="p"), decontamination.find_leaks(empty, items), lm_scoring.score_documents(empty, empty)):
        assert out.count() == 0


def test_sharding(docs):
    got = sharding.kd_shards(docs, 5).collect()
    rows = corpus()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_are_balanced(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    sums = [r[1] for r in sharding.kd_shards(df, 7).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 7 and max(sums) < 1.02 * min(sums)


def test_pii_round_trip_and_links(spark):
    rows = [(1, "a.b@x.org 4111 1111 1111 1111 10.0.0.1"), (2, "x 4111-1111-1111-1111, 1999-02-28; +1 (974) 555-3436"), (3, None), (4, ""), (5, "999.1.1.1 4111111111111112 1999-02-30"), (6, "4111111111111111"), (6, "4111111111111111")]
    masked = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key")
    got = masked.collect()
    by = {r.doc_id: r.masked for r in got}
    assert by[3] is None and by[4] == "" and by[5] == rows[4][1]
    digits = {re.sub("[^0-9]", "", re.search(r"(?:\d[ -]?){16}", by[k])[0]) for k in (1, 2, 6)}
    assert len(digits) == 1 and digits != {"4111111111111111"}
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(digits.pop()))
    assert total % 10 == 0
    back = pii.pseudonymise(masked.select("doc_id", F.col("masked").alias("m")), "key", ("card", "ip", "date", "phone"), text_col="m", text_as="text", back=True)
    assert {r.doc_id: r.text for r in back.collect()}[2] == rows[1][1]


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = df.select(pii.permute_digits("k", F.col("d")).alias("p"))
    assert out.distinct().count() == 1000
    assert out.select(pii.permute_digits("k", F.col("p"), back=True).alias("d")).exceptAll(df).count() == 0


def test_word_ids_equal_plain_encoding():
    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(tokenizer_path()), WordIds(tokenizer_path())
    texts = [r[1] or "" for r in corpus()] + ["Don't STOP, it's 12.5% «déjà» vu... <|endoftext|> ΣΑΣ İx é ½ 你好,世界 x\x1cy"]
    assert words.ids(texts, b"") == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, group_pieces=40).collect()
    rows = corpus()
    assert sum(r.length for r in got) == sum(len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    texts = {r[0]: np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows}
    for r in got:
        assert zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(texts[r.doc_id])
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_best_fit_takes_the_tightest_window():
    where, offset = packing.best_fit_decreasing(np.array([7, 6, 4, 3, 3, 2]), 10)
    assert where.tolist() == [0, 1, 1, 0, 2, 2] and offset.tolist() == [0, 0, 6, 7, 0, 3]


def test_exact_groups(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = corpus()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    texts = {r[0]: norm(r[1]) for r in rows}
    for r in got:
        ids = groups[texts[r.doc_id]]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert exact_dedup.drop_exact_copies(docs).count() == len(groups)


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 0])
def test_near_classes(docs, bucket_bytes):
    idf = shingles.inverse_frequencies(docs.select("text"))
    words, sets = shingles.WordHashes(), {}
    for r in corpus():
        h, c = shingles.shingles(r[1], words)
        sets[r[0]] = (h, near_dedup.weights(h, c, idf))
    ids = sorted((i for i in sets if i is not None and len(sets[i][0])))
    label = {i: i for i in sets}
    for i in ids:
        for j in ids:
            if i < j and near_dedup.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    got = near_dedup.near_duplicate_classes(docs, bucket_bytes=bucket_bytes).collect()
    assert len(got) == len(corpus())
    assert {r.doc_id: r.class_id for r in got} == label
    assert sum(r.kept for r in got) == len(set(label.values()))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    w = rng.random(len(h)).astype(np.float32) + 0.5
    a, b = (h[:800], w[:800]), (h[50:], w[50:])
    same = np.mean([near_dedup.signature(*a) == near_dedup.signature(*b)])
    assert abs(same - near_dedup.weighted_jaccard(a, b)) < 0.25


def test_settle_finds_chains():
    h = np.arange(100, dtype=np.uint64)
    sets = [(h[k : k + 40], np.ones(40, np.float32)) for k in (0, 3, 6, 60)]
    links = near_dedup.settle(sets, 0.8)
    assert {tuple(sorted(x)) for x in links} == {(0, 1), (1, 2)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "a long, b long")
    got = dict(connected_components(edges).collect())
    assert all(got[i] == (0 if i < 10 else 10) for i in range(21))


def test_suffix_order_and_common_prefixes():
    """Queues of a few tuples spill to disk; with a base of no symbols the recursion goes to its end."""
    draw = random.Random(2)
    for n in (1, 2, 3, 30, 200, 400):
        for alphabet in (b"a", b"ab", b"abc\x00\xff", bytes(range(256))):
            data = bytes(draw.choice(alphabet) for _ in range(n))
            data = data if draw.random() < 0.5 else (data[: max(1, n // 5)] * 5)[:n]
            for depth, memory, base in ((1000, 3, 0), (8, 50, 5), (1000, 1000, 1000)):
                got = list(suffix_array.descending_suffixes(np.frombuffer(data, np.uint8), depth, memory, base))
                order, common = (np.concatenate(x).tolist() for x in zip(*got, strict=True))
                texts = [data[i : i + depth] for i in order]
                assert sorted(order) == list(range(len(data))) and texts == sorted(texts, reverse=True)
                assert common[0] == 0 and common[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(texts, texts[1:])]


def test_suffix_sort_of_a_file_keeps_to_its_memory(tmp_path):
    """A text whose tuples have 4 MB: queues of 64 kB and recursion to strings of 4,096 names."""
    part = np.random.default_rng(3).integers(0, 256, 1 << 12, dtype=np.uint8).tobytes()
    (tmp_path / "text").write_bytes(part * 64)
    text = np.memmap(tmp_path / "text", np.uint8, "r")
    tracemalloc.start()
    seen = repeated = 0
    for at, common in suffix_array.descending_suffixes(text, 200, memory=1 << 12, base=1 << 12):
        seen += len(at)
        repeated += int((common == 200).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(text) and repeated == 63 * len(part) - 199
    assert peak < 2 << 20


def test_repeats_against_brute_force(docs):
    rows, n = corpus(), substring_dedup.LENGTH
    counts = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        counts.update(b[i : i + n] for i in range(len(b) - n + 1))
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in substring_dedup.remove_repeats(docs).collect():
        b, gone = texts[r.doc_id], bytearray(len(texts[r.doc_id]))
        for i in range(len(b) - n + 1):
            if counts[b[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        kept = hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, kept)


def test_secrets(spark):
    key = "AKIA" + "B7" * 8
    rows = [(1, f"password = hunter2x and {key}", "a"), (2, None, "a"), (3, "", None), (4, "SECRET: 'abc' token=abcdefg", "b")]
    rows += [(10 + k, "x 9aZ8bY7cX6dW5eV4fU3gT2", f"o{k}") for k in range(5)] + [(20, "y Q1wE2rT3yU4iO5pA6sD7fG8", "only")]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].spans == f"assign:0:19,access:24:{24 + len(key)}" and got[1].n_live == 2
    assert got[2].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].spans == "assign:14:27" and got[4].n_assign == 1
    assert got[10].spans == "" and got[10].n_example == 0 and got[20].spans == "generic:2:25"


def test_language(spark):
    rng = random.Random(3)
    make = {"xx": "abcde", "yy": "mnopq"}
    rows = [(i, " ".join("".join(rng.choice(make[k]) for _ in range(5)) for _ in range(20)), k) for i, k in enumerate(["xx", "yy"] * 40)]
    rows += [(100, None, "xx"), (101, "123 !!", "xx"), (102, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df.drop("lang"), language_id.train(df)).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows[:80])
    assert all(got[i].lang_pred == "und" for i in (100, 101, 102))


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(4)] + [(4, None), (5, "short"), (6, "twelve chars tiny")]
    filler = lambda n: " ".join(word() for _ in range(n))
    damaged = items[1][1].split()
    damaged[4], damaged[20] = "wrong", "words"
    rows = [(1, filler(50) + " " + items[0][1].upper() + " " + filler(9)), (2, filler(5) + "\n" + " ".join(damaged)), (3, filler(300)), (4, None), (5, ""), (6, "so twelve chars tiny it is"), (7, items[2][1][:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.find_leaks(docs, table).collect()}
    assert set(got) == {(1, 0), (2, 1), (6, 6)} and got[1, 0] == 0
    assert sorted(r.doc_id for r in decontamination.drop_leaking(docs, table).collect()) == [3, 4, 5, 7]


def test_edit_distance_of_the_best_place():
    rng = random.Random(6)
    for _ in range(50):
        item, text = ("".join(rng.choice("abcé你") for _ in range(n)) for n in (rng.choice((1, 5, 9, 63, 64, 65, 130)), rng.randint(0, 150)))
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item):
            fresh = [i + 1]
            for j, x in enumerate(text):
                fresh.append(min(row[j] + (c != x), row[j + 1] + 1, fresh[j] + 1))
            row = fresh
        (distance,), _ = decontamination.best_distances([decontamination.letters_table(item)], np.zeros(1, int), [text])
        assert distance == min(row)
        for limit in (0, 5, 30, 200):
            (other,), _ = decontamination.best_distances([decontamination.letters_table(item)], np.zeros(1, int), [text], np.array([limit]))
            assert other == min(distance, limit + 1)


@pytest.mark.parametrize("head", [1 << 17, 3])
def test_language_model(docs, head):
    rows = corpus()
    tokens = {r[0]: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")] + ["<end>"] for r in rows}
    training = Counter()
    for r in rows:
        if r[0] is not None and r[0] % 3:
            training.update(tokens[r[0]])
    n, v = sum(training.values()), len(training)
    got = lm_scoring.score_documents(docs, docs.where("doc_id % 3 <> 0"), head_words=head).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(training[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((training[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert r.score < 0


def plain_tree(training, depth, least, divergence, pull):
    """Retained contexts (tuples of symbols, the start among them) and a function that gives P(symbol | words before)."""
    counts = [Counter() for _ in range(depth + 1)]
    for t in training:
        own = ["<start>", *t]
        for i in range(1, len(own)):
            for k in range(min(i, depth) + 1):
                counts[k][(tuple(own[i - k:i]), own[i])] += 1
    follow = {}
    for level in counts:
        for (c, s), n in level.items():
            follow.setdefault(c, {})[s] = n
    root = follow.get((), {})
    total = sum(root.values()) + 0.5 * (len(root) + 1)
    kept = {()}

    def p(symbol, c):
        while c not in kept:
            c = c[1:]
        if not c:
            return (root.get(symbol, 0) + 0.5) / total
        own = follow[c]
        return (max(0, own.get(symbol, 0) - 1) + (pull + len(own)) * p(symbol, c[1:])) / (sum(own.values()) + pull)

    def without_one(own, m, up):
        """The same with one occurrence of a symbol that is there m times left out."""
        return (max(0, m - 2) + (pull + len(own) - (m == 1)) * up) / (sum(own.values()) - 1 + pull)

    for k in range(1, depth + 1):
        for c in [c for c in follow if len(c) == k]:
            own, n = follow[c], sum(follow[c].values())
            if n >= least and c[1:] in kept and (k == 1 or c[:-1] in kept):
                if sum(m * math.log(without_one(own, m, p(s, c[1:])) / p(s, c[1:])) for s, m in own.items()) >= divergence:
                    kept.add(c)
    return kept, p


@pytest.mark.parametrize("head", [1 << 20, 60, 0])
def test_suffix_tree_against_a_plain_one(spark, head):
    rng = random.Random(11)
    phrases = [" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(4)) for _ in range(12)]
    texts = [None, "", "Unseen words ALONE", *[" ".join(rng.choice([*phrases, "zz", "q r", f"rare{rng.randint(0, 90)}"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]]
    texts += [texts[9], texts[9]]
    rows = list(enumerate(texts))
    own = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "<end>"] for i, t in rows}
    kept, p = plain_tree([own[i] for i, _ in rows if i % 4 != 2], 3, 4, 6.0, 2.0)
    assert max(map(len, kept)) == 3 and len(kept) > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_scoring.score_documents(docs, docs.where("doc_id % 4 <> 2"), head=head, depth=3, least=4, divergence=6.0, pull=2.0).collect()
    assert len(got) == len(rows)
    for r in got:
        t = ["<start>", *own[r.doc_id]]
        assert r.score == pytest.approx(sum(math.log10(p(t[i], tuple(t[max(0, i - 3):i]))) for i in range(1, len(t)))), r.doc_id
    symbols = {s for t in own.values() for s in t if s != "<start>"} & {s for i, t in own.items() if i % 4 != 2 for s in t}
    for c in kept:
        assert sum(p(s, c) for s in symbols) + p("<unknown>", c) == pytest.approx(1)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_suffix_tree_beats_the_base_on_held_out_documents(spark, size):
    out = lm_scoring.op10_lm_scoring(spark, f"/root/testdata/{size}").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert out.s > out.b


def test_pipeline_on_a_small_table(spark, docs, tmp_path):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, corpus()[25][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == names
        seen[name] = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x))
    assert seen["language_id"] == sorted((r[0] for r in corpus() if re.search("[a-z]", r[1] or "")), key=lambda x: (x is None, x))
    assert seen["exact_dedup"].count(30) == 1 and 4 in seen["exact_dedup"] and not {5, 6} & set(seen["exact_dedup"])
    assert 20 in seen["near_dedup"] and not {52, 53} & set(seen["near_dedup"]) and 8 not in seen["near_dedup"]
    assert 25 not in seen["decontamination"] and 26 in seen["decontamination"]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen["decontamination"])


def test_parts_that_may_repeat_cover_every_repeated_string():
    import random

    draw, n, g = random.Random(5), substring_dedup.LENGTH, substring_dedup.GRAM
    text = lambda size: bytes(draw.choice(b"abcd") for _ in range(size))
    before, anchor, after = text(n - g), text(g), text(n - g)
    rows = []
    for _ in range(60):
        left, right = draw.randrange(n - g + 1), draw.randrange(n - g + 1)
        rows.append((n - g, text(n - g - left) + before[n - g - left :] + anchor + after[:right] + text(n - g - right)))
    rows.append((10, before[-10:] + anchor + after))
    seen: dict = {}
    for k, (off, data) in enumerate(rows):
        for a in range(len(data) - n + 1):
            seen.setdefault((off - a, data[a : a + n]), []).append((k, a))
    wanted = [x for found in seen.values() if len(found) > 1 for x in found]
    parts = substring_dedup.may_repeat([r[0] for r in rows], [r[1] for r in rows])
    assert wanted
    assert all(parts[k] and parts[k][0] <= a and a + n <= parts[k][1] for k, a in wanted)
    assert substring_dedup.may_repeat([], []) == []


def repeats_by_brute_force(texts):
    n, starts = substring_dedup.LENGTH, Counter()
    raw = [t.encode() for t in texts]
    for t in raw:
        starts.update(t[k : k + n] for k in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if starts[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        out.append(sum(gone))
    return out


def test_an_anchor_hash_with_many_contexts_is_split(spark):
    """A line of 190 bytes in every text, with other neighbours, some of which repeat; also one of 120 and one of 260."""
    draw = random.Random(9)
    word = lambda k: "".join(draw.choice("abcdefghijklmnop ") for _ in range(k))
    lines = [word(190), word(120), word(260)]
    texts = []
    for i in range(240):
        line = lines[i % 3]
        before, after = word(300), word(300)
        if i % 10 < 3:
            before = before[:-9] + "same left"
        if i % 10 in (2, 3):
            after = "same right end" + after[14:]
        texts.append(before + line + after)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = dict(enumerate(repeats_by_brute_force(texts)))
    assert 0 < sum(v > 0 for v in wanted.values()) < len(texts)
    for most in (2, substring_dedup.MOST_CONTEXTS):
        assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs, most_contexts=most).collect()} == wanted


def test_contexts_of_a_hot_hash_pass_the_sort_unheld():
    taken = []

    def batches():
        for k in range(5):
            taken.append(k)
            yield pa.RecordBatch.from_pydict({"h": [7] * 3, "c": [k * 3 + i for i in range(3)], "off": [0] * 3, "data": [b"x" * 368] * 3, "hot": [True] * 3})

    first = next(substring_dedup._sort_shards(batches()))
    assert first.num_rows == 3 and taken == [0]


@pytest.mark.parametrize("most", [1, 3])
def test_repeats_do_not_depend_on_the_bound_of_contexts(docs, most):
    one, other = (sorted(map(str, substring_dedup.remove_repeats(docs, **k).collect())) for k in ({}, {"most_contexts": most}))
    assert one == other


def test_repeated_ids_with_other_texts_stay(spark):
    rows = [(5, "A text"), (5, "A text"), (5, "B other"), (5, "B other"), (6, "C"), (None, "C"), (None, "D"), (None, "D")]
    kept = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text, r.doc_id) for r in kept if r.text != "D") == [("A text", 5), ("B other", 5), ("C", 6)] and [r.doc_id for r in kept if r.text == "D"] == [None]


def test_letters_of_all_planes_and_clashing_names(spark):
    rows = [(1, chr(0x20000) + chr(0x20001), "zh", 0.5, "x"), (2, "abc", "en", 0.5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.train(df)).collect()}
    assert got[1].lang_pred == "zh" and got[2].lang_pred == "en" and got[1].score > 0.5
    both = spark.createDataFrame([(1, "10.0.0.1", "old", 7, "mine", "too")], "doc_id long, text string, masked string, n_ip int, _found string, _kinds string")
    one = pii.pseudonymise(both, "k").first()
    assert one.n_ip == 1 and one.masked != "old" and (one._found, one._kinds) == ("mine", "too")


def test_personal_data_of_many_forms_is_found_and_restored(spark):
    forms = ["+49 30 1234567", "030-1234567", "(974)555-3436", "+14155552671", "06 12 34 56 78", "12/31/1999", "02.03.1948", "1850-07-01", "123-45-6789", "192.168.1.77"]
    rows = [(i, f"call {x} now") for i, x in enumerate(forms)] + [(90, "000-12-3456 666-12-3456 123-00-4567"), (91, "31.02.2001 2001-02-30")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    masked = pii.pseudonymise(df, "key", text_as="m")
    got = {r.doc_id: r.m for r in masked.collect()}
    assert all(got[i] != rows[i][1] and re.sub(r"\d", "0", got[i]) .count("0") >= 8 for i in range(len(forms) - 1)) and got[90] == rows[-2][1] and got[91] == rows[-1][1]
    back = pii.pseudonymise(masked.select("doc_id", "m"), "key", text_col="m", text_as="text", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)


@pytest.mark.parametrize("bits", [6, 22])
def test_frequencies_are_exact_however_few_buckets(docs, bits):
    words, counts, n = shingles.WordHashes(), Counter(), 0
    for r in corpus():
        h, _ = shingles.shingles(r[1], words)
        counts.update(h.tolist())
        n += len(h) > 0
    idf = shingles.inverse_frequencies(docs.select("text"), bits)
    h = np.array(sorted(counts), np.uint64)
    assert len(h) > 64 and np.allclose(idf(h), np.log1p(n / np.array([counts[x] for x in h.tolist()])), rtol=1e-5)


def damaged(rng, text, rate=0.0, every=0):
    letters = list(text)
    if every:
        for k in range(rng.randrange(every), len(letters), every):
            letters[k] = rng.choice("qxzj")
    for _ in range(int(rate * len(text))):
        k, what = rng.randrange(len(letters)), rng.random()
        if what < 0.6:
            letters[k] = rng.choice("abcdefgh ")
        elif what < 0.8:
            del letters[k]
        else:
            letters.insert(k, rng.choice("abcdefgh "))
    return "".join(letters)


@pytest.mark.parametrize("rate, every", [(0.1, 0), (0.18, 0), (0.2, 0), (0.0, 8), (0.0, 7), (0.0, 6), (0.0, 5)])
def test_leaks_found_against_exhaustive_search(rate, every):
    """Recall, against the exact distance to the best place, of damaged items in documents of other text."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [decontamination.plain(text(rng.randint(15, 60))) for _ in range(60)]
    docs = [decontamination.plain(f"{text(40)} {damaged(rng, t, rate, every)} {text(40)}") for t in items] + [decontamination.plain(text(200)) for _ in range(20)]
    search = decontamination.Items("test", list(range(60)), items, 0.8)._build()
    exact, _ = decontamination.best_distances(search.tables, np.arange(60), docs[:60])
    wanted = {i for i in range(60) if exact[i] <= search.slack(i)}
    found = search.matches(docs)
    hits = {i for i in wanted if i in found[i]}
    assert len(wanted) > 30 and len(hits) >= 0.9 * len(wanted)
    assert all(found[i][i][0] >= exact[i] for i in hits) and not any(found[60:])


def test_leaks_without_spaces_and_short_items(spark):
    chinese = "".join(chr(0x4E00 + k * 37 % 9000) for k in range(120))
    items = spark.createDataFrame([(1, chinese), (2, "abcd"), (3, "seven77"), (4, "seven77"), (5, "a longer item of some twenty")], "item_id long, text string")
    rows = [(1, "前文" * 30 + chinese + "后文" * 30), (2, "xx abcd yy"), (3, "xx abce yy"), (4, "it is sevn77 here"), (5, "then a longer itxm of some twenty."), (6, "nothing"), (6, "nothing")]
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect())
    assert got == [(1, 1, 0), (2, 2, 0), (4, 3, 1), (4, 4, 1), (5, 5, 1)]


def test_anchors_of_joined_texts_are_those_of_each():
    draw = random.Random(3)
    texts = [bytes(draw.choice(b"abc ") for _ in range(n)) for n in (0, 5, 199, 200, 201, 700, 40, 3000, 200)] + [b"a" * 500, b"ab" * 200, b"x" * 199]
    count, *joined = substring_dedup.anchors_of(texts)
    ends = np.cumsum(count)
    for t, a, b in zip(texts, ends - count, ends, strict=True):
        for whole, alone in zip(joined, substring_dedup.anchors(t), strict=True):
            assert whole[a:b].tolist() == alone.tolist()
        # Each string has its least gram among the anchors, and no other string is told of.
        hashes, at, low, high = (x[a:b] for x in joined)
        grams = substring_dedup.gram_hashes(np.frombuffer(t, np.uint8)).view(np.int64) if len(t) >= 200 else []
        told = {(s, int(h)) for h, p, x, y in zip(hashes, at, low, high, strict=True) for s in range(x, y + 1)}
        least = lambda s: min(int(g) & (1 << 64) - 1 for g in grams[s : s + 137])
        assert {(s, h & (1 << 64) - 1) for s, h in told} == {(s, least(s)) for s in range(len(t) - 199)}


def test_candidates_on_long_stretches_are_verified_in_bounded_memory():
    """4,000 short candidates beside one of 60,000 characters: matrices are cut by their cells, not by rows alone."""
    sizes = np.array([200] * 4000 + [60_000])
    chunks = list(decontamination._chunks(sizes))
    assert [a for a, _ in chunks] == [0, *(b for _, b in chunks[:-1])] and chunks[-1][1] == len(sizes)
    assert max((b - a) * int(sizes[b - 1]) for a, b in chunks) <= decontamination.CELLS
    draw = random.Random(2)
    item = "".join(draw.choice("abcdefgh ") for _ in range(150))
    long = "".join(draw.choice("abcdefgh ") for _ in range(60_000))
    texts = [item[:70] + "X" + item[71:]] + [long[k : k + 200] for k in range(1500)] + [long[:30_000] + item + long[30_000:]]
    tracemalloc.start()
    distances, _ = decontamination.best_distances([decontamination.letters_table(item)], np.zeros(len(texts), int), texts, np.full(len(texts), 30))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert distances[[0, -1]].tolist() == [1, 0] and (distances[1:-1] == 31).all() and peak < 60e6

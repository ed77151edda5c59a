"""Set joins whose sets travel with their prefixes, beside hubs and sets that are too long to travel."""

import random

import pytest

from quarry.operators import setjoin


@pytest.mark.parametrize(("carried", "hub", "counted"), [(32, 1000, 1 << 16), (3, 1000, 2), (0, 4, 1 << 16), (5, 3, 3)])
def test_every_pair_is_found_once_however_sets_meet(spark, monkeypatch, carried, hub, counted):
    monkeypatch.setattr(setjoin, "CARRIED", carried)
    monkeypatch.setattr(setjoin, "HUB", hub)
    monkeypatch.setattr(setjoin, "COUNTED", counted)
    rng = random.Random(carried)
    sets = {i: frozenset({rng.randrange(20) for _ in range(rng.randint(1, 9))}) for i in range(80)}
    sets |= {100 + i: sets[i] for i in range(10)}
    rows = [(i, m) for i, s in sets.items() for m in s]
    found = setjoin.similar_sets(spark.createDataFrame(rows + rows[:20], "src long, dst long"), 0.5)
    names = sorted({min(j for j in sets if sets[j] == s) for s in sets.values()})
    want = sorted((a, b, len(sets[a] & sets[b])) for k, a in enumerate(names) for b in names[k + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]))
    assert sorted((r.a, r.b, r.common) for r in found.pairs.collect()) == want
    assert {r.set_id: r.copies for r in found.classes.collect()} == {i: sum(s == sets[i] for s in sets.values()) - 1 for i in sets}


def test_candidates_that_fail_are_not_written_or_shuffled(spark, monkeypatch):
    """Sets of four with one member in common with many others, and no similar pair."""
    kept, keep = [], setjoin.materialise

    def seen(df):
        out = keep(df)
        kept.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(setjoin, "materialise", seen)
    rows = [(i, m) for i in range(400) for m in (i % 20, 1000 + i, 2000 + i, 3000 + i)] + [(i, 4000 + i // 2) for i in range(400)]
    found = setjoin.similar_sets(spark.createDataFrame(rows, "src long, dst long"), 0.5)
    assert found.pairs.count() == 0
    assert [n for columns, n in kept if "a" in columns] == [0, 0]

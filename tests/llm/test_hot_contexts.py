"""Contexts of one anchor hash that are too many for a task."""

import random

from quarry.llm import substring_dedup


def test_strings_that_many_contexts_share_go_on_once_a_batch(spark, monkeypatch):
    draw = random.Random(3)
    word = lambda size: "".join(draw.choice("abcdefgh") for _ in range(size))
    line = word(320)
    texts = [word(50) + line + word(50) for _ in range(400)]
    sizes, keep = [], substring_dedup.materialise

    def counted(df):
        out = keep(df)
        if "back" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "materialise", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs, most_contexts=100).collect()}
    # A common byte or two beside the line may lengthen a span by chance.
    assert len(got) == 400 and all(320 <= v < 330 for v in got.values())
    # Before, every string of the line went on from every context: 121 x 400 in all. Now each goes on once a batch.
    assert sizes and sizes[-1] < 121 * 400 / 4

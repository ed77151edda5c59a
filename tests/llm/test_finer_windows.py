"""Strings around a hot anchor hash are opened only where finer windows are shared."""

import random

from quarry.llm import substring_dedup


def test_windows_that_no_string_follows_are_not_opened(spark, monkeypatch):
    draw = random.Random(8)
    word = lambda size: "".join(draw.choice("abcdefgh") for _ in range(size))
    line = word(185)
    texts = [word(60) + line + word(60) for _ in range(400)]
    sizes, keep = [], substring_dedup.materialise

    def counted(df):
        out = keep(df)
        if "back" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "materialise", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = substring_dedup.remove_repeats(docs, most_contexts=100).collect()
    assert len(got) == 400 and not any(r["n_removed"] for r in got)
    # The windows of 177 bytes are shared. Before, all strings behind them went on, up to 24 for each window.
    assert sizes[0] >= 400 and sizes[-1] < 400

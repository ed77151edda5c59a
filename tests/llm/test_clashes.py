"""Columns of any name, and the head of a table of counts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, exact_dedup, near_dedup

WIDE = "doc_id long, text string, lang string, source string, n_chars long, stay_id long, _stay_id long, stay_sha string, again_id long, again_sha string, lang_pred string, _lang_pred string, lang_score double, label string, alone string, row_tag string"
TEXTS = ["one two three four five six", "one  two three\tfour five six", "das ist ein anderer Text", None, "", "one two three four five six"]


@pytest.fixture
def wide(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", 1, 7, 8, "a", 9, "b", "c", "d", 0.5, "e", "f", "g") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0]], WIDE)


def test_exact_and_near_copies_keep_all_columns(wide):
    for out in (exact_dedup.drop_exact_copies(wide), near_dedup.drop_near_copies(wide)):
        assert out.columns == wide.columns and {(r.stay_id, r._stay_id, r.lang_pred, r.row_tag) for r in out.collect()} == {(7, 8, "c", "g")}
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(wide).collect()) == [0, 2, 3]


def test_language_stage_keeps_all_columns(spark, wide):
    out = corpus_pipeline.identify_language(spark, wide, "")
    assert out.columns == wide.columns and {(r.lang_pred, r._lang_pred, r.lang_score) for r in out.collect()} == {("c", "d", 0.5)}


def test_free_names(wide):
    assert common.free_names(wide, "stay_id", "DOC_ID", "new", "new") == ["__stay_id", "_DOC_ID", "new", "_new"]


@pytest.mark.parametrize(("values", "most", "kept"), [([1000 + k for k in range(10)], 4, 4), ([5] * 10, 4, 0), ([9, 5, 5, 1], 3, 3), ([0, 0], 5, 0), ([3], 1, 1)])
def test_largest_of_close_values(spark, values, most, kept):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = sorted((r.v for r in common.largest(df, "v", most).collect()), reverse=True)
    assert len(got) == kept and got == sorted(values, reverse=True)[:kept] and common.largest(df.where(F.lit(False)), "v", 3).count() == 0

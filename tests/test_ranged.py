"""Lines by byte ranges, offset index and point reads, order of files, tables of SQLite files."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.sources import ranged


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(5)
    rows = [{"id": k, "text": "é" * rng.randrange(30) + "x" * rng.randrange(200)} for k in range(300)]
    for part in range(3):
        data = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows[part * 100 : part * 100 + 100])
        (tmp_path / f"part-{part}.json").write_text(data + ("\n" if part else ""))
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path), rows


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_every_line_is_read_once(spark, folder, split):
    path, rows = folder
    for file, size in ranged.files_under(path):
        got = [x for a in range(0, size, split) for x in ranged.lines_of(file, a, min(a + split, size), path, chunk=50)]
        data = open(file, "rb").read()
        want = data.split(b"\n")[: -1 if data.endswith(b"\n") else None]
        assert [line for _, line in got] == want and all(data[a : a + len(line)] == line for a, line in got)
    if split >= 1000:
        df = ranged.lines(spark, path, split, "id")
        assert df.rdd.getNumPartitions() == sum(-(-size // split) for _, size in ranged.files_under(path))
        assert sorted(int(r.key) for r in df.collect()) == [r["id"] for r in rows]


def test_a_lookup_reads_one_range_for_each_key(spark, folder):
    path, rows = folder
    index = ranged.offset_index(spark, path, "id", 4000)
    reads = spark.sparkContext.accumulator(0)
    keys = spark.createDataFrame([(3,), (250,), (100,), (3,), (999,), (None,)], "id long")
    got = {r.key: json.loads(r.value) for r in ranged.lookup(keys, index, path, "id", reads).collect()}
    assert got == {str(k): rows[k] for k in (3, 100, 250)} and reads.value == 3


def test_lines_are_numbered_as_a_plain_read_has_them(spark, folder):
    path, rows = folder
    numbered = ranged.numbered_lines(spark, path, 3000)
    got = [json.loads(r.value) for r in numbered.orderBy("ordinal").collect()]
    assert got == rows and [r.ordinal for r in numbered.orderBy("ordinal").collect()] == list(range(300))
    assert [json.loads(r.value)["id"] for r in numbered.where("ordinal < 150").orderBy("ordinal").collect()] == list(range(150))
    seen = ranged.first_seen(numbered, F.get_json_object("value", "$.id").cast("int") % 7).orderBy("first").collect()
    assert [(r.key, r.first) for r in seen] == [(k, k) for k in range(7)]


def test_sqlite_by_row_ids(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "my table" (page INTEGER, views INTEGER, title TEXT, other BLOB)')
        con.executemany('INSERT INTO "my table" VALUES (?, ?, ?, ?)', [(k, None if k % 3 else k * 2, f"t{k}", b"z") for k in range(1000)])
        con.execute('DELETE FROM "my table" WHERE page % 10 = 7')
        con.execute("CREATE TABLE none (a INTEGER)")
    df = ranged.sqlite_rows(spark, path, "my table", "views long, page long", partitions=6, key="page")
    assert df.rdd.getNumPartitions() == 6 and df.columns == ["views", "page"] and dict(df.dtypes)["page"] == "string"
    assert {(r.page, r.views) for r in df.collect()} == {(str(k), 0 if k % 3 else k * 2) for k in range(1000) if k % 10 != 7}
    assert ranged.sqlite_rows(spark, path, "none", "a long").count() == 0

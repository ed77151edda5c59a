"""Scratch tables leave no shuffle files behind."""

import os
import time

from quarry.operators.lineage import materialise, shuffles_go


def test_shuffle_files_go_with_the_write(spark):
    # Where the session keeps its blocks.
    blocks = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for top in blocks for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = shuffled()
    counts = spark.range(5000).selectExpr("id % 97 AS a").groupBy("a").count()
    out = materialise(counts)
    with shuffles_go(spark):
        assert len(counts.select("*").collect()) == 97
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and out.count() == 97
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

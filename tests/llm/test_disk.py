"""What the corpus operators leave on disk while they run."""

import time

import pytest

from siltbed.llm import common


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.length()) if (f := files.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle(spark):
    before = shuffles(spark)
    common.written(spark.range(1000).selectExpr("id % 7 AS k").repartition(5, "k"), "some")
    for _ in range(50):
        left = shuffles(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(common.CLEANUP, "false") == "false"


@pytest.mark.parametrize("most", [10, 100, 1000])
def test_slices_are_the_whole_join(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = spark.range(4000).selectExpr("xxhash64(id % 1000) AS key", "id")
    few = common.written(spark.range(0, 1000, 3).selectExpr("xxhash64(id) AS key", "id AS other"), "few")
    got = common.among(rows, few, "key", "got")
    assert sorted((r["id"], r["other"]) for r in got.collect()) == [(i, i % 1000) for i in range(4000) if i % 1000 % 3 == 0]
    common.forget(got)
    slices = common.among(rows, few, "key", "got", "left_semi")
    assert slices.columns == ["key", "id"] and slices.count() == 4 * 334

from __future__ import annotations

import os

from pyspark.sql import functions as F

from fluxweave import storage


def test_dense_index_follows_the_order(spark):
    rows = spark.range(1000).withColumn("k", F.pmod(F.hash("id"), F.lit(50)))
    indexed = storage.dense_index(rows, ["k", "id"], "ix", start=5).orderBy("ix").collect()
    assert [r.ix for r in indexed] == list(range(5, 1005))
    assert [(r.k, r.id) for r in indexed] == sorted((r.k, r.id) for r in indexed)
    assert storage.dense_index(rows.limit(0), ["k", "id"], "ix").count() == 0


def test_scratch_is_kept_apart_and_can_be_cleared(spark):
    made = storage.cut(spark.range(3))
    assert made.count() == 3
    folder = storage.scratch_folder(spark).removeprefix("file://")
    assert os.listdir(folder)
    assert storage.clear(spark) and not os.path.exists(folder)

from __future__ import annotations

import math

import numpy as np
import pytest

from fluxweave.operators import neural
from fluxweave.streaming import features as stream_features


def test_forward_pass(spark):
    arcs = spark.createDataFrame([(0, "a", "h", 1), (1, "b", "h", -1), (2, "h", "o", None), (3, "a", "o", 1)], "eix long, s string, t string, interaction int")
    plan = neural.topology(arcs)
    assert {r.eix: (r.s_layer, r.t_layer, r.sign) for r in plan.collect()} == {0: (0, 1, 1), 1: (0, 1, -1), 2: (1, 2, 1), 3: (0, 2, 1)}
    w = spark.createDataFrame([(0, 1.0), (1, -2.0), (2, 3.0), (3, 0.5)], "eix long, w double")
    b = spark.createDataFrame([("h", 0.1)], "v string, b double")
    x = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 0.5), ("u", "a", -1.0)], "sample string, v string, x double")
    sig = lambda z: 1 / (1 + math.exp(-z))
    h, u = sig(1 - 1 + 0.1), sig(-1 + 0.1)
    got = {(r["sample"], r.v): r.x for r in neural.forward(plan, w, b, x).collect()}
    assert got["s", "o"] == pytest.approx(sig(3 * h + 0.5)) and got["u", "o"] == pytest.approx(sig(3 * u - 0.5))
    from pyspark.sql import functions as F

    assert spark.range(1).select(neural.signed_kernel(F.lit(-1), F.lit(0.0))).first()[0] == pytest.approx(-math.log(2))


def test_null_space(spark):
    m = np.array([[1.0, 1, 0], [0, 0, 1]])
    entries = spark.createDataFrame([("m", i, j, float(m[i, j])) for i in range(2) for j in range(3)], "key string, i long, j long, a double")
    rows = neural.null_space(entries).collect()
    v = np.array([r.value for r in sorted(rows, key=lambda r: r.j)])
    assert len(rows) == 3 and np.allclose(m @ v, 0) and np.isclose(np.linalg.norm(v), 1)


def test_streamed_features(spark, tmp_path):
    schema = "sample string, fid string, value double, ts timestamp"
    rows = [("s", "a", 1.0, "2024-01-01 00:00:00"), ("s", "a", 2.0, "2024-01-01 00:10:00"), ("s", "b", 3.0, "2024-01-01 00:20:00")]
    from pyspark.sql import functions as F

    spark.createDataFrame(rows, "sample string, fid string, value double, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    q = stream_features.keep_up(stream_features.first_features(stream()), f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    q.awaitTermination(60)
    assert {(r["sample"], r.fid) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {("s", "a"), ("s", "b")}
    w = stream_features.windowed_values(stream()).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert {(r.fid, r.value, r.n) for r in spark.table("w").collect()} == {("a", 3.0, 2), ("b", 3.0, 1)}

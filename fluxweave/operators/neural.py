"""Networks whose neurons are a graph's vertices: topology, forward pass, kernels; and null spaces of small matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .traverse import topological_layers


def topology(arcs: DataFrame) -> DataFrame:
    """(eix, s, t, s_layer, t_layer, sign): the arcs of an acyclic graph with the layers of their ends."""
    v = arcs.select(F.col("s").alias("v")).union(arcs.select("t")).distinct()
    layers = cut(topological_layers(arcs, v), "layers")
    at = lambda end: layers.select(F.col("v").alias(end), F.col("layer").alias(f"{end}_layer"))
    sign = F.when(F.coalesce("interaction", F.lit(1)) >= 0, 1).otherwise(-1)
    return arcs.join(at("s"), "s").join(at("t"), "t").select("eix", "s", "t", "s_layer", "t_layer", sign.alias("sign"))


def signed_kernel(sign: Column, raw: Column) -> Column:
    """sign * softplus(raw): a weight that keeps its sign while it is trained."""
    return sign * F.log1p(F.exp(raw))


def forward(plan: DataFrame, weights: DataFrame, biases: DataFrame, inputs: DataFrame) -> DataFrame:
    """(sample, v, x): sigmoid(sum of weight * input + bias) layer by layer over topology(); weights(eix, w), biases(v, b) and
    inputs(sample, v, x), which give the vertices without an arc into them. Missing inputs are 0, missing biases too."""
    step = cut(plan.join(weights, "eix").select("s", "t", "w", "t_layer"), "plan")
    samples = inputs.select("sample").distinct()
    known = cut(inputs.select("sample", "v", "x"), "neurons")
    top = step.agg(F.max("t_layer")).first()[0] or 0
    for layer in range(1, top + 1):
        into = step.filter(F.col("t_layer") == layer)
        seen = into.join(known.withColumnRenamed("v", "s"), "s").groupBy("sample", F.col("t").alias("v")).agg(F.sum(F.col("w") * F.col("x")).alias("z"))
        every = into.select(F.col("t").alias("v")).distinct().join(samples, F.lit(True))  # a layer's neurons by samples: what is asked for
        z = F.coalesce("z", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
        new = every.join(seen, ["sample", "v"], "left").join(biases, "v", "left").select("sample", "v", (1 / (1 + F.exp(-z))).alias("x"))
        known = cut(known.unionByName(new), "neurons")
    return known


def null_space(entries: DataFrame, rtol: float = 1e-10) -> DataFrame:
    """(key, k, j, value): an orthonormal basis of the null space of each key's small matrix (key, i, j, a), by its SVD."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(pdf.i.max()) + 1, int(pdf.j.max()) + 1))
        np.add.at(m, (pdf.i.astype(int), pdf.j.astype(int)), pdf.a)
        _, s, vt = np.linalg.svd(m)
        basis = vt[int((s > rtol * s.max(initial=0.0)).sum()) :]
        k, j = np.divmod(np.arange(basis.size), basis.shape[1])
        return pd.DataFrame({"key": pdf["key"].iloc[0], "k": k, "j": j, "value": basis.ravel()})

    return entries.groupBy("key").applyInPandas(solve, "key string, k long, j long, value double")

"""Fail-fast checks: each gives the rows that break a rule; `require` turns any such row into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import arcs


def require(violations: DataFrame, message: str) -> None:
    row = violations.first()
    if row is not None:
        raise ValueError(f"{message}: {row.asDict()}")


def condition_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Conditions named on one side only."""
    x, y = a.select("condition").distinct(), b.select("condition").distinct()
    return x.join(y, "condition", "left_anti").withColumn("missing", F.lit("right")).unionByName(y.join(x, "condition", "left_anti").withColumn("missing", F.lit("left")))


def not_finite(values: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return values.filter(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def unknown_vertices(ids: DataFrame, vertices: DataFrame) -> DataFrame:
    return ids.join(vertices.select("v"), "v", "left_anti")


def unknown_reactions(ids: DataFrame, edges: DataFrame) -> DataFrame:
    return ids.join(edges.select("id"), "id", "left_anti")


def bad_bounds(bounds: DataFrame) -> DataFrame:
    """Lower above upper; either may be open."""
    return bounds.filter(F.col("lb") > F.col("ub"))


def bad_edge_costs(costs: DataFrame, edges: DataFrame) -> DataFrame:
    return costs.join(edges.select("eix"), "eix", "left_anti")


def not_plain(edges: DataFrame) -> DataFrame:
    """Edges that are undirected or don't have one source and one target."""
    return edges.filter((F.size("src") != 1) | (F.size("tgt") != 1) | (F.col("edge_type") != "directed"))


def without_outgoing(targets: DataFrame, edges: DataFrame) -> DataFrame:
    return targets.join(arcs(edges).select(F.col("s").alias("v")).distinct(), "v", "left_anti")


def out_of_unit(values: DataFrame, column: str, binary: bool = False) -> DataFrame:
    x = F.col(column)
    return values.filter(~F.coalesce(x.isin(0, 1) if binary else x.between(0, 1), F.lit(False)))


def bad_signs(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.coalesce(F.col("interaction").isin(-1, 1), F.lit(False)))


def repeated_features(features: DataFrame) -> DataFrame:
    return features.groupBy("sample", "fid").count().filter("count > 1")

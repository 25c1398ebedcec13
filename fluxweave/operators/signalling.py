"""What a signalling program reads off a graph before it is stated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NetGraph
from . import checks
from .graph import heads_and_tails

#: Fixed value: names of vertices that are AND gates.
AND_GATE = "^(AND|And|and)[0-9]+$"


def interactions(edges: DataFrame) -> DataFrame:
    """(eix, interaction): the signs, 1 where none is given."""
    return edges.select("eix", F.coalesce("interaction", F.lit(1)).alias("interaction"))


def and_gates(vertices: DataFrame) -> DataFrame:
    """(v, is_gate)."""
    return vertices.select("v", F.col("v").rlike(AND_GATE).alias("is_gate"))


def inhibited(vertices: DataFrame, experiments: DataFrame) -> DataFrame:
    """(v, condition, inhibited) for every vertex and condition of experiments(condition, v, role): whether the condition inhibits it
    (role `inhibition`). Conditions without an inhibition stay, as false."""
    grid = vertices.select("v").join(experiments.select("condition").distinct(), F.lit(True))  # the matrix asked for
    hit = experiments.filter("role = 'inhibition'").select("v", "condition").distinct().withColumn("inhibited", F.lit(True))
    return grid.join(hit, ["v", "condition"], "left").select("v", "condition", F.coalesce("inhibited", F.lit(False)).alias("inhibited"))


def edges_with_sources(edges: DataFrame) -> DataFrame:
    """(eix) of the edges with a source, self-loops that cancel in the matrix excepted."""
    return heads_and_tails(edges).filter("tail > 0").select("eix").distinct()


def require_consistent(g: NetGraph, experiments: DataFrame) -> None:
    """An error if a condition of experiments(condition, v, role) names a vertex that the graph lacks as an input, output or inhibition."""
    named = experiments.filter(F.col("role").isin("input", "output", "inhibition"))
    checks.require(checks.unknown_vertices(named.select("v", "condition", "role"), g.vertices), "not in the graph")


def presolve_report(g: NetGraph) -> DataFrame:
    """(part, v, eix, value): gates, entries of both incidence matrices, signs, and edges with a source, as one long table."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    ends = heads_and_tails(g.edges)
    row = lambda df, part, v, eix, value: df.select(F.lit(part).alias("part"), v, eix, value.cast("long").alias("value"))
    v, eix, no_v, no_eix = F.col("v"), F.col("eix"), none("string", "v"), none("long", "eix")
    parts = [
        row(and_gates(g.vertices), "gate", v, no_eix, F.col("is_gate").cast("int")),
        row(ends.filter("head > 0"), "target", v, eix, F.col("head")),
        row(ends.filter("tail > 0"), "source", v, eix, F.col("tail")),
        row(interactions(g.edges), "interaction", no_v, eix, F.col("interaction")),
        row(edges_with_sources(g.edges), "has_source", no_v, eix, F.lit(1)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

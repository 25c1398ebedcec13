"""Graphs and feature tables as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import dense_index

SIDE = "array<struct<v:string,coef:double>>"
EDGES = f"eix long, src {SIDE}, tgt {SIDE}, edge_type string, interaction int, weight double, id string, default_lb double, default_ub double, gpr string, attrs map<string,string>"
VERTICES = "vix long, v string, attrs map<string,string>"
FEATURES = "sample string, sample_ix long, pos long, fid string, mapping string, role string, value double, extra map<string,string>"
#: Edge columns besides the index, the sides and the type, with their types.
EXTRAS = {"interaction": "int", "weight": "double", "id": "string", "default_lb": "double", "default_ub": "double", "gpr": "string", "attrs": "map<string,string>"}


def side(*vertices: Column) -> Column:
    """A side of single vertices, each with the coefficient that is not given (taken as 1)."""
    return F.array(*(F.struct(v.cast("string").alias("v"), F.lit(None).cast("double").alias("coef")) for v in vertices)).cast(SIDE)


NOTHING = F.array


def ends(col: str) -> Column:
    """Vertex names of a side."""
    return F.transform(F.col(col), lambda x: x["v"])


@dataclass(frozen=True)
class NetGraph:
    """A directed, undirected or mixed hypergraph: edges by eix, vertices by vix in order of first appearance."""

    edges: DataFrame
    vertices: DataFrame

    @staticmethod
    def of_edges(edges: DataFrame, more_vertices: DataFrame | None = None) -> NetGraph:
        """Vertices are those of the edges, in their order, and more_vertices(v) after them."""
        edges = conform(edges)
        seen = edges.select("eix", F.posexplode(F.concat(ends("src"), ends("tgt"))).alias("at", "v")).groupBy("v").agg(F.min(F.struct("eix", "at")).alias("first"))
        rows = seen.select("v", F.lit(0).alias("late"), F.col("first.eix").alias("eix"), F.col("first.at").alias("at"))
        if more_vertices is not None:
            extra = more_vertices.select("v").distinct().join(seen.select("v"), "v", "left_anti")
            rows = rows.unionByName(extra.select("v", F.lit(1).alias("late"), F.lit(0).cast("long").alias("eix"), F.lit(0).alias("at")))
        indexed = dense_index(rows, ["late", "eix", "at", "v"], "vix")
        return NetGraph(edges, indexed.select("vix", "v", F.lit(None).cast("map<string,string>").alias("attrs")))

    @staticmethod
    def of_arcs(arcs: DataFrame, edge_type: str = "directed", order: list[str] | None = None) -> NetGraph:
        """From rows (s, t, ...): parallel edges stay; the index follows `order`, by default all columns."""
        rows = dense_index(arcs, order or arcs.columns, "eix")
        extras = [c for c in EXTRAS if c in arcs.columns]
        return NetGraph.of_edges(rows.select("eix", side(F.col("s")).alias("src"), side(F.col("t")).alias("tgt"), F.lit(edge_type).alias("edge_type"), *extras))


def conform(edges: DataFrame) -> DataFrame:
    """Edges with every column of the schema, absent ones null."""
    kinds = {"eix": "long", "src": SIDE, "tgt": SIDE, "edge_type": "string"} | EXTRAS
    default = {"edge_type": F.lit("directed"), "src": F.array().cast(SIDE), "tgt": F.array().cast(SIDE)}
    return edges.select(*((F.col(c) if c in edges.columns else default.get(c, F.lit(None))).cast(k).alias(c) for c, k in kinds.items()))


def literal_edges(spark: SparkSession, rows: list[tuple], edge_type: str = "directed") -> DataFrame:
    """Edges from Python rows (source vertices, target vertices[, {column: value}]), for small graphs given by hand."""
    made = []
    for eix, row in enumerate(rows):
        s, t, more = row if len(row) == 3 else (*row, {})
        both = [[(str(v), float(side[v]) if isinstance(side, dict) else None) for v in side] for side in (s, t)]
        made.append((eix, *both, more.get("edge_type", edge_type), *(more.get(k) for k in EXTRAS)))
    return spark.createDataFrame(made, EDGES)

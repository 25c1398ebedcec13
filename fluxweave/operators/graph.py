"""Graph scans, filters, projections, mutation and incidence, each a declarative plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SIDE, NetGraph, conform, ends, side
from ..storage import dense_index

# --- views -------------------------------------------------------------------------------------------------------


def arcs(edges: DataFrame) -> DataFrame:
    """(eix, s, t, weight, interaction, reversed): every source-target pair once; undirected edges both ways."""
    base = edges.select("eix", "edge_type", ends("src").alias("a"), ends("tgt").alias("b"), *([c for c in ("weight", "interaction") if c in edges.columns]))
    more = [c for c in ("weight", "interaction") if c in edges.columns]
    there = base.select("eix", F.explode("a").alias("s"), "b", *more).select("eix", "s", F.explode("b").alias("t"), *more, F.lit(False).alias("reversed"))
    back = base.filter("edge_type = 'undirected'").select("eix", F.explode("b").alias("s"), "a", *more).select("eix", "s", F.explode("a").alias("t"), *more, F.lit(True).alias("reversed"))
    return there.unionByName(back)


def incidence(edges: DataFrame, values: bool = False) -> DataFrame:
    """(eix, v, side, a, edge_type) in coordinate form: -1 for a source and +1 for a target, or their coefficients' sizes.

    A self-loop gives two rows.
    """
    size = lambda c: F.abs(F.coalesce(F.col(c), F.lit(1.0))) if values else F.lit(1.0)
    out = edges.select("eix", "edge_type", F.explode("src").alias("x")).select("eix", "x.v", F.lit("s").alias("side"), (-size("x.coef")).alias("a"), "edge_type")
    into = edges.select("eix", "edge_type", F.explode("tgt").alias("x")).select("eix", "x.v", F.lit("t").alias("side"), size("x.coef").alias("a"), "edge_type")
    return out.unionByName(into)


def incidence_matrix(edges: DataFrame, values: bool = False, sparse: bool = True) -> DataFrame:
    """(v, eix, a): entries summed, as a sparse matrix does, or the target's taken, as a dense one that is written twice does."""
    kept = F.sum("a") if sparse else F.max_by("a", "side")
    return incidence(edges, values).groupBy("v", "eix").agg(kept.alias("a"))


def directed_incidence(edges: DataFrame) -> DataFrame:
    """(eix, source, target) of plain edges, null at a boundary; hyperedges and edges without ends are errors."""
    bad = F.when((F.size("src") > 1) | (F.size("tgt") > 1), F.raise_error("a hyperedge has no single source and target")).when((F.size("src") == 0) & (F.size("tgt") == 0), F.raise_error("an edge has no ends"))
    return edges.select("eix", F.coalesce(bad.cast("string"), F.get(ends("src"), 0)).alias("source"), F.get(ends("tgt"), 0).alias("target"))


def heads_and_tails(edges: DataFrame) -> DataFrame:
    """(v, eix, head, tail): 1 where the vertex is a target, 1 where it is a source."""
    return incidence_matrix(edges).select("v", "eix", F.greatest("a", F.lit(0.0)).alias("head"), F.greatest(-F.col("a"), F.lit(0.0)).alias("tail"))


# --- counts and lookups ------------------------------------------------------------------------------------------


def shape(g: NetGraph) -> DataFrame:
    return g.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(g.edges.agg(F.count("*").alias("n_edges")))  # one row by one row


def is_hypergraph(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.bool_or((F.size("src") > 1) | (F.size("tgt") > 1)), F.lit(False)).alias("is_hypergraph"))


def incident_edges(edges: DataFrame, vs: DataFrame) -> DataFrame:
    """Edges that touch any vertex of vs(v), each once."""
    return edges.join(incidence(edges).join(vs.select("v"), "v", "left_semi").select("eix").distinct(), "eix", "left_semi")


def require_vertices(g: NetGraph, vs: DataFrame) -> DataFrame:
    """vs(v), or an error that names a vertex the graph lacks: for lookups that must not come back short."""
    lost = vs.select("v").join(g.vertices.select("v"), "v", "left_anti").first()
    if lost is not None:
        raise KeyError(lost.v)
    return vs


def edges_at(g: NetGraph, eixs: list[int]) -> DataFrame:
    """Edges by index; an index that the graph lacks is an error."""
    found = g.edges.filter(F.col("eix").isin(*eixs))
    if found.count() < len(set(eixs)):
        raise IndexError(f"an edge of {sorted(set(eixs))} is not in the graph")
    return found


def common_incident_edges(edges: DataFrame, vs: list[str]) -> DataFrame:
    """Edges whose ends hold every vertex of a short list."""
    want = F.array(*map(F.lit, sorted(set(vs))))
    return edges.filter(F.size(F.array_except(want, F.concat(ends("src"), ends("tgt")))) == 0)


def directed_edges(edges: DataFrame, vs: DataFrame, into: bool) -> DataFrame:
    """Edges into (out of) any of vs(v); undirected ones count whenever they touch it."""
    hit = incidence(edges).filter((F.col("side") == ("t" if into else "s")) | (F.col("edge_type") == "undirected"))
    return edges.join(hit.join(vs.select("v"), "v", "left_semi").select("eix").distinct(), "eix", "left_semi")


def successors(edges: DataFrame, vs: DataFrame) -> DataFrame:
    return arcs(edges).join(vs.select(F.col("v").alias("s")), "s", "left_semi").select(F.col("t").alias("v")).distinct()


def predecessors(edges: DataFrame, vs: DataFrame) -> DataFrame:
    return arcs(edges).join(vs.select(F.col("v").alias("t")), "t", "left_semi").select(F.col("s").alias("v")).distinct()


def neighbors(edges: DataFrame, vs: DataFrame) -> DataFrame:
    """Both sides of incident edges: a vertex that has an edge is its own neighbour."""
    return incidence(incident_edges(edges, vs)).select("v").distinct()


def edge_attribute(edges: DataFrame, name: str, default=None) -> DataFrame:
    value = F.col(name) if name in edges.columns else F.col("attrs")[name]
    return edges.select("eix", F.coalesce(value, F.lit(default)).alias("value"))


def edges_by_attribute(edges: DataFrame, name: str, value) -> DataFrame:
    """Edges that have the attribute with just that value; a missing one is no match."""
    return edges.filter((F.col(name) if name in edges.columns else F.col("attrs")[name]) == F.lit(value))


# --- subgraphs ---------------------------------------------------------------------------------------------------


def _inside(edges: DataFrame, vs: DataFrame) -> DataFrame:
    """Edges all of whose ends are in vs(v)."""
    outside = incidence(edges).join(vs.select("v"), "v", "left_anti").select("eix")
    return edges.join(outside, "eix", "left_anti")


def filter_graph(g: NetGraph, vertex: Column | None = None, edge: Column | None = None) -> NetGraph:
    """Vertices and edges by predicate; an edge also needs all its ends, a vertex needs no edge."""
    vertices = g.vertices if vertex is None else g.vertices.filter(vertex)
    edges = g.edges if edge is None else g.edges.filter(edge)
    return NetGraph(edges if vertex is None else _inside(edges, vertices), vertices)


def subgraph(g: NetGraph, vs: DataFrame) -> NetGraph:
    """The subgraph that vs(v) induce."""
    return NetGraph(_inside(g.edges, vs), g.vertices.join(vs.select("v"), "v", "left_semi"))


def edge_subgraph(g: NetGraph, eixs: DataFrame) -> NetGraph:
    """The edges of eixs(eix) and their ends."""
    edges = g.edges.join(eixs.select("eix"), "eix", "left_semi")
    return NetGraph(edges, g.vertices.join(incidence(edges).select("v"), "v", "left_semi"))


def extract_subgraph(g: NetGraph, vs: DataFrame | None, eixs: DataFrame | None) -> NetGraph:
    """Given edges bring their ends; if vertices are given too, whatever the enlarged set induces is added."""
    if vs is None:
        return edge_subgraph(g, eixs)
    if eixs is None:
        return subgraph(g, vs)
    listed = g.edges.join(eixs.select("eix"), "eix", "left_semi")
    every = vs.select("v").unionByName(incidence(listed).select("v")).distinct()
    return subgraph(g, every)


def touching_subgraph(edges: DataFrame, vs: list[str]) -> DataFrame:
    """The weaker rule: each side of an edge touches the set."""
    want = F.array(*map(F.lit, vs))
    return edges.filter(F.arrays_overlap(ends("src"), want) & F.arrays_overlap(ends("tgt"), want))


def renumbered(g: NetGraph) -> NetGraph:
    """Dense indexes in the old order."""
    return NetGraph(conform(dense_index(g.edges.withColumnRenamed("eix", "__old"), ["__old"], "eix").drop("__old")), dense_index(g.vertices.withColumnRenamed("vix", "__old"), ["__old"], "vix").select("vix", "v", "attrs"))


# --- mutation ----------------------------------------------------------------------------------------------------


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("tgt"), "tgt": F.col("src")})


def add_edges(g: NetGraph, rows: DataFrame, order: list[str]) -> NetGraph:
    """Appends edges after the last index, in the given order; parallel ones stay, new ends become vertices."""
    last = g.edges.agg(F.coalesce(F.max("eix"), F.lit(-1))).first()[0]
    edges = g.edges.unionByName(conform(dense_index(rows, order, "eix", start=last + 1)))
    return add_vertices(NetGraph(edges, g.vertices), incidence(edges).select("v", F.lit(None).cast("map<string,string>").alias("attrs")))


def add_vertices(g: NetGraph, rows: DataFrame) -> NetGraph:
    """rows(v, attrs): new vertices come after the others by name; attributes are merged, the new ones winning."""
    fresh = rows.groupBy("v").agg(F.any_value("attrs", True).alias("more"))
    merge = F.when(F.col("attrs").isNull(), F.col("more")).when(F.col("more").isNull(), F.col("attrs")).otherwise(F.map_concat(F.map_filter("attrs", lambda k, _: ~F.map_contains_key(F.col("more"), k)), F.col("more")))
    old = g.vertices.join(fresh, "v", "left").select("vix", "v", merge.alias("attrs"))
    last = g.vertices.agg(F.coalesce(F.max("vix"), F.lit(-1))).first()[0]
    new = dense_index(fresh.join(g.vertices.select("v"), "v", "left_anti").select("v", F.col("more").alias("attrs")), ["v"], "vix", start=last + 1)
    return NetGraph(g.edges, old.unionByName(new.select("vix", "v", "attrs")))


def with_boundaries(g: NetGraph, inflow: DataFrame, outflow: DataFrame) -> NetGraph:
    """Adds an edge from nothing into each vertex of inflow(v), then one out of each of outflow(v) into nothing."""
    none = F.array().cast(SIDE)
    rows = inflow.select("v").distinct().select(F.lit(0).alias("kind"), "v", none.alias("src"), side(F.col("v")).alias("tgt"))
    rows = rows.unionByName(outflow.select("v").distinct().select(F.lit(1).alias("kind"), "v", side(F.col("v")).alias("src"), none.alias("tgt")))
    return add_edges(g, rows, ["kind", "v"])


def random_signs(edges: DataFrame, inhibitory: float, seed: int = 0) -> DataFrame:
    """interaction -1 with the given probability, else +1, by a seeded hash of the index."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("eix")), F.lit(1 << 30)) / float(1 << 30)
    return edges.withColumn("interaction", F.when(unit < inhibitory, -1).otherwise(1))


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def content_hash(g: NetGraph) -> DataFrame:
    """A SHA-256 over the graph that doesn't depend on partitioning: the edges' and vertices' own digests are summed by
    position-free XOR, so no list of all rows is ever made."""
    canon = lambda cols: F.sha2(F.to_json(F.struct(*cols)), 256)
    tidy = [F.array_sort(c).alias(c) if c in ("src", "tgt") else F.array_sort(F.map_entries(c)).alias(c) if c == "attrs" else F.col(c) for c in g.edges.columns]
    parts = [F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("long") for k in range(4)]
    rows = g.edges.select(canon(tidy).alias("h")).unionByName(g.vertices.select(canon([F.col("vix"), F.col("v"), F.array_sort(F.map_entries("attrs")).alias("attrs")]).alias("h")))
    return rows.agg(F.sha2(F.concat_ws("-", F.count("*").cast("string"), *(F.coalesce(F.bit_xor(p), F.lit(0)).cast("string") for p in parts)), 256).alias("hash"))


def dependency_reactions(sif: DataFrame, gate: str = r"^(AND|And|and)[0-9]+$") -> DataFrame:
    """(rid, pos, neg, product) from signed arcs (s, interaction, t) whose AND gates are vertices.

    A plain arc is a reaction of one literal. A gate needs two inputs, an output, positive outgoing signs and no gate beside it.
    Reactions are distinct by literals and product; a literal of both signs in one reaction is an error.
    """
    is_gate = lambda c: F.col(c).rlike(gate)
    plain = sif.filter(~is_gate("s") & ~is_gate("t")).select(F.when(F.col("interaction") > 0, F.array("s")).otherwise(F.array().cast("array<string>")).alias("pos"), F.when(F.col("interaction") < 0, F.array("s")).otherwise(F.array().cast("array<string>")).alias("neg"), F.col("t").alias("product"))
    nested = F.when(is_gate("s"), F.raise_error("a gate feeds a gate")).cast("string")
    into = sif.filter(is_gate("t")).groupBy(F.col("t").alias("g")).agg(F.array_sort(F.collect_set(F.when(F.col("interaction") > 0, F.coalesce(nested, F.col("s"))))).alias("pos"), F.array_sort(F.collect_set(F.when(F.col("interaction") < 0, F.coalesce(nested, F.col("s"))))).alias("neg"))
    out = sif.filter(is_gate("s") & ~is_gate("t")).select(F.col("s").alias("g"), F.when(F.col("interaction") < 0, F.raise_error("a gate's output is negative")).otherwise(F.col("t")).alias("product"))
    wrong = F.when(F.col("pos").isNull() | F.col("product").isNull(), F.raise_error("a gate has no input or no output")).when(F.size("pos") + F.size("neg") < 2, F.raise_error("a gate has one input")).cast("string")
    gates = into.join(out, "g", "full").select("pos", "neg", F.coalesce(wrong, F.col("product")).alias("product"))
    every = plain.unionByName(gates).distinct()
    clash = F.when(F.arrays_overlap("pos", "neg"), F.raise_error("a literal has both signs")).cast("string")
    checked = every.select("pos", "neg", F.coalesce(clash, F.col("product")).alias("product"))
    return dense_index(checked, ["product", "pos", "neg"], "rid").select("rid", "pos", "neg", "product")

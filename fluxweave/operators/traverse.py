"""Traversals as bounded fixpoint loops: a frontier is joined to the arcs, what is known is taken away, lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NetGraph
from ..storage import cut
from . import graph as G

MAX_ROUNDS = 10_000
#: What is known is one table again after so many rounds, so that a round reads a few tables and not one for each before it.
FOLD = 8


def bfs(arcs: DataFrame, starts: DataFrame, reverse: bool = False, undirected: bool = False, keys: tuple[str, ...] = (), max_rounds: int = MAX_ROUNDS, touching: DataFrame | None = None) -> DataFrame:
    """(*keys, v, dist): least number of hops from the starts(*keys, v), each key for itself, all keys in one loop.

    Undirected hops go over neighbours: from a vertex to all others of an edge that touches it, those on its own side too.
    touching(eix, v) says which vertices an edge touches; without it, the arcs with the same eix are one edge (without eix, each
    arc). Vertices left after max_rounds hops are an error.
    """
    if reverse and undirected:
        raise ValueError("reverse and undirected exclude each other")
    known = [*keys, "v"]
    if undirected:
        if touching is None:
            edge = F.col("eix") if "eix" in arcs.columns else F.struct("s", "t")
            touching = arcs.select(edge.alias("eix"), F.explode(F.array("s", "t")).alias("v"))
        step = cut(touching.select("eix", "v").distinct(), "arcs")
    else:
        step = cut((arcs.select(F.col("t").alias("s"), F.col("s").alias("t")) if reverse else arcs.select("s", "t")).distinct(), "arcs")
    layer = cut(starts.select(*known).distinct().withColumn("dist", F.lit(0)), "bfs")
    seen = layer
    for hop in range(1, max_rounds + 2):
        if undirected:
            reached = layer.select(*known).join(step, "v").select(*keys, "eix").distinct().join(step, "eix").select(*known).distinct()
        else:
            reached = layer.select(*keys, F.col("v").alias("s")).join(step, "s").select(*keys, F.col("t").alias("v")).distinct()
        layer = cut(reached.join(seen.select(*known), known, "left_anti").withColumn("dist", F.lit(hop)), "bfs")
        if layer.isEmpty():
            return seen
        seen = seen.unionByName(layer)
        if hop % FOLD == 0:
            seen = cut(seen, "bfs-seen")
    raise RuntimeError(f"more is reached after {max_rounds} rounds")


def between(arcs: DataFrame, sources: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, v): what the sources reach and what reaches the targets."""
    ahead, back = bfs(arcs, sources, keys=keys), bfs(arcs, targets, reverse=True, keys=keys)
    return ahead.select(*keys, "v").intersect(back.select(*keys, "v"))


def prune(g: NetGraph, sources: DataFrame | None, targets: DataFrame | None) -> NetGraph:
    """The subgraph of all vertices on a path from a source to a target; null: every vertex."""
    every = g.vertices.select("v")
    return G.subgraph(g, between(G.arcs(g.edges), every if sources is None else sources, every if targets is None else targets))


def prune_by_condition(g: NetGraph, sources: DataFrame, targets: DataFrame) -> tuple[NetGraph, DataFrame, DataFrame]:
    """sources and targets(condition, v): the union of the conditions' subgraphs, with (condition, side, v) of ends that no
    path joins, and (condition, v) of what is kept. Both sides must name the same conditions."""
    a, b = sources.select("condition").distinct(), targets.select("condition").distinct()
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("sources and targets don't name the same conditions")
    kept = cut(between(G.arcs(g.edges), sources, targets, ("condition",)), "kept")
    lost = sources.select("condition", F.lit("source").alias("side"), "v").unionByName(targets.select("condition", F.lit("target").alias("side"), "v")).distinct().join(kept, ["condition", "v"], "left_anti")
    inside = G.incidence(g.edges).join(kept, "v").groupBy("condition", "eix").agg(F.countDistinct("v").alias("in_it"))
    whole = G.incidence(g.edges).groupBy("eix").agg(F.countDistinct("v").alias("ends"))
    eixs = inside.join(whole, "eix").filter("in_it = ends").select("eix").distinct()
    edges = g.edges.join(eixs, "eix", "left_semi")
    return NetGraph(edges, g.vertices.join(kept.select("v").distinct(), "v", "left_semi")), lost, kept


def prune_by_features(g: NetGraph, features: DataFrame, input_role: str = "input", output_role: str = "output") -> tuple[NetGraph, DataFrame]:
    """Prunes by the features' roles, then drops vertex features whose id left the graph."""
    ends = lambda role: features.filter((F.col("role") == role) & (F.col("mapping") == "vertex")).select(F.col("sample").alias("condition"), F.col("fid").alias("v"))
    pruned, _, _ = prune_by_condition(g, ends(input_role), ends(output_role))
    kept = features.join(pruned.vertices.select(F.col("v").alias("fid")), "fid", "left_semi").unionByName(features.filter("mapping <> 'vertex'"))
    return pruned, kept


def topological_layers(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, layer) by peeling vertices without a predecessor left; a cycle is an error."""
    live = cut(arcs.select("s", "t").distinct(), "topo")
    rest = cut(vertices.select("v"), "topo")
    done, layer = None, 0
    while not rest.isEmpty():
        free = cut(rest.join(live.select(F.col("t").alias("v")), "v", "left_anti").withColumn("layer", F.lit(layer)), "topo-layer")
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else done.unionByName(free)
        rest = cut(rest.join(free, "v", "left_anti"), "topo")
        live = cut(live.join(free.select(F.col("v").alias("s")), "s", "left_anti"), "topo")
        layer += 1
    return done if done is not None else vertices.select("v").withColumn("layer", F.lit(0))


def reaching_edges(edges: DataFrame, inputs: DataFrame, outputs: DataFrame | None = None, whitelist: DataFrame | None = None, early_stop: bool = False, expand_outputs: bool = True) -> DataFrame:
    """(eix, layer) of the edges that first reach a new vertex in a forward sweep, parallel ones all. A hyperedge reaches every one
    of its targets."""
    pairs = G.arcs(edges)
    pairs = cut((pairs if whitelist is None else pairs.join(whitelist.select("eix"), "eix", "left_semi")).select("eix", "s", "t"), "reach-arcs")
    seen = front = cut(inputs.select("v").distinct(), "reach")
    found, layer = None, 0
    while True:
        layer += 1
        grow = front if outputs is None or expand_outputs else front.join(outputs.select("v"), "v", "left_anti")
        hits = cut(pairs.join(grow.withColumnRenamed("v", "s"), "s", "left_semi").join(seen.withColumnRenamed("v", "t"), "t", "left_anti"), "reach")
        front = cut(hits.select(F.col("t").alias("v")).distinct(), "reach")
        step = hits.select("eix").distinct().withColumn("layer", F.lit(layer))
        found = step if found is None else found.unionByName(step)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        seen = cut(seen, "reach-seen") if layer % FOLD == 0 else seen
        if early_stop and outputs is not None and outputs.select("v").join(seen, "v", "left_anti").isEmpty():
            break
    return found.groupBy("eix").agg(F.min("layer").alias("layer"))


def shortest_paths(arcs: DataFrame, starts: DataFrame, keys: tuple[str, ...] = (), max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(*keys, v, dist, hops, via) by relaxation: least summed weight (a missing one is 0) from the starts(*keys, v).

    via is the edge into v on a best path, of equal ones that with fewer hops, then the smaller index. Weights must not be
    negative. All keys share one loop; each round only carries vertices whose distance fell.
    """
    known = [*keys, "v"]
    step = cut(arcs.select("eix", "s", "t", F.coalesce("weight", F.lit(0.0)).alias("w")), "path-arcs")
    if not step.filter("w < 0").isEmpty():
        raise ValueError("a negative weight")
    best = cut(starts.select(*known).distinct().withColumns({"dist": F.lit(0.0), "hops": F.lit(0), "via": F.lit(None).cast("long")}), "path")
    front = best
    for _ in range(max_rounds + 1):
        offer = front.withColumnRenamed("v", "s").join(step, "s").groupBy(*keys, F.col("t").alias("v")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("eix").alias("via"))).alias("new"))
        better = offer.join(best.select(*known, F.struct("dist", "hops").alias("old")), known, "left").filter(F.col("old").isNull() | (F.struct("new.dist", "new.hops") < F.col("old")))
        front = cut(better.select(*known, "new.dist", "new.hops", "new.via"), "path")
        if front.isEmpty():
            return best
        best = cut(best.join(front, known, "left_anti").unionByName(front), "path")
    raise RuntimeError(f"distances still fall after {max_rounds} rounds")


def path_edges(paths: DataFrame, arcs: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, eix) of the best paths to the targets(*keys, v), walked back edge by edge."""
    known = [*keys, "v"]
    back = cut(paths.filter("via IS NOT NULL").join(arcs.select(F.col("eix").alias("via"), F.col("s").alias("from"), F.col("t").alias("v")), ["via", "v"]).select(*known, "via", "from"), "back")
    at, found = targets.select(*known), None
    while True:
        step = cut(at.join(back, known), "walk")
        if step.isEmpty():
            return found if found is not None else step.select(*keys, F.col("via").alias("eix"))
        here = step.select(*keys, F.col("via").alias("eix"))
        found = here if found is None else found.unionByName(here)
        at = step.select(*keys, F.col("from").alias("v")).distinct()

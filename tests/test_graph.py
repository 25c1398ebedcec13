from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from fluxweave.model import NetGraph, ends, literal_edges
from fluxweave.operators import checks as Q
from fluxweave.operators import graph as G
from fluxweave.operators import results as R
from fluxweave.operators import traverse as T
from fluxweave.sources import formats as IO
from fluxweave.sources.random_graphs import duplication, preferential


def vs(spark, *names):
    return spark.createDataFrame([(str(n),) for n in names], "v string")


def arcs_of(spark, pairs):
    return spark.createDataFrame([(i, str(s), str(t)) for i, (s, t) in enumerate(pairs)], "eix long, s string, t string")


def names(df, col="v"):
    return {r[col] for r in df.collect()}


BFS7 = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 1), (3, 1), (4, 5)]


@pytest.fixture(scope="module")
def hyper(spark):
    rows = [((1, 2), (3, 4)), ((1,), (1,)), ((3,), (1,)), ((4,), (2,)), ((3,), (5, 6))]
    return NetGraph.of_edges(literal_edges(spark, rows))


def test_neighbourhoods(spark, hyper):
    e = hyper.edges
    assert names(G.successors(e, vs(spark, 1))) == {"3", "4", "1"} and names(G.successors(e, vs(spark, 3))) == {"1", "5", "6"}
    assert names(G.predecessors(e, vs(spark, 1))) == {"1", "3"}
    assert names(G.neighbors(e, vs(spark, 4))) == {"1", "2", "3", "4"}
    assert names(G.incident_edges(e, vs(spark, 5)), "eix") == {4} and names(G.common_incident_edges(e, ["1", "2"]), "eix") == {0}
    assert names(G.directed_edges(e, vs(spark, 1), True), "eix") == {1, 2} and names(G.directed_edges(e, vs(spark, 1), False), "eix") == {0, 1}
    assert G.is_hypergraph(e).first()[0] and G.shape(hyper).first().asDict() == {"n_vertices": 6, "n_edges": 5}


def test_undirected_edges_count_both_ways(spark):
    e = literal_edges(spark, [((1,), (2,)), ((3,), (1,))], "undirected")
    assert names(G.successors(e, vs(spark, 1))) == {"2", "3"} == names(G.predecessors(e, vs(spark, 1)))
    assert names(G.directed_edges(e, vs(spark, 1), True), "eix") == {0, 1}


def test_bfs_layers(spark):
    a = arcs_of(spark, BFS7)
    dist = lambda **k: {r.v: r.dist for r in T.bfs(a, vs(spark, 2), **k).collect()}
    assert dist()["1"] == 2
    back = dist(reverse=True)
    assert back["1"] == 1 and back["4"] == 2 and "5" not in back
    assert dist(undirected=True)["5"] == 3
    with pytest.raises(ValueError):
        dist(reverse=True, undirected=True)


def test_traversals_match_brute_force(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(45)]
    a = arcs_of(spark, pairs).withColumn("weight", F.pmod(F.col("eix"), F.lit(7)).cast("double"))
    seen, layer = {0: 0}, [0]
    while layer:
        layer = [t for s, t in pairs if s in layer and t not in seen]
        for t in layer:
            seen.setdefault(t, max(seen.values()) + 1 if t not in seen else seen[t])
    best = {0: 0.0}
    for _ in range(30):
        for i, (s, t) in enumerate(pairs):
            if s in best and best[s] + i % 7 < best.get(t, 1e9):
                best[t] = best[s] + i % 7
    paths = T.shortest_paths(a, vs(spark, 0))
    assert {int(r.v): r.dist for r in paths.collect()} == best
    assert {int(r.v) for r in T.bfs(a, vs(spark, 0)).collect()} == set(best)
    far = max(best, key=best.get)
    walked = [r.eix for r in T.path_edges(paths, a, vs(spark, far)).collect()]
    assert sum(e % 7 for e in walked) == best[far]
    with pytest.raises(ValueError):
        T.shortest_paths(a.withColumn("weight", F.lit(-1.0)), vs(spark, 0))


def test_prune_and_conditions(spark):
    rows = [(("a",), ("b",)), (("b",), ("c",)), (("a",), ("d",)), (("e",), ("c",)), (("c",), ("f",))]
    g = NetGraph.of_edges(literal_edges(spark, rows))
    assert names(T.prune(g, vs(spark, "a"), vs(spark, "c")).vertices) == {"a", "b", "c"}
    assert names(T.prune(g, None, vs(spark, "d")).vertices) == {"a", "d"}
    pair = lambda *rows: spark.createDataFrame(list(rows), "condition string, v string")
    pruned, lost, kept = T.prune_by_condition(g, pair(("x", "a"), ("y", "e"), ("y", "d")), pair(("x", "c"), ("y", "f")))
    assert names(pruned.edges, "eix") == {0, 1, 3, 4} and {(r.condition, r.side, r.v) for r in lost.collect()} == {("y", "source", "d")}
    assert {tuple(r) for r in kept.collect()} == {("x", "a"), ("x", "b"), ("x", "c"), ("y", "e"), ("y", "c"), ("y", "f")}
    with pytest.raises(ValueError):
        T.prune_by_condition(g, pair(("x", "a")), pair(("z", "c")))


def test_topological_layers_and_cycles(spark):
    pairs = [("a", "b"), ("a", "c"), ("c", "b"), ("c", "d"), ("c", "e"), ("b", "d"), ("d", "e")]
    order = {r.v: r.layer for r in T.topological_layers(arcs_of(spark, pairs), vs(spark, *"abcde")).collect()}
    assert all(order[s] < order[t] for s, t in pairs)
    with pytest.raises(ValueError, match="cycle"):
        T.topological_layers(arcs_of(spark, BFS7), vs(spark, *range(1, 6)))


def test_reaching_edges(spark):
    e = literal_edges(spark, [((1,), (2,)), ((1,), (2,)), ((2,), (1,)), ((2,), (3,)), ((3,), (4,)), ((4,), (2,))])
    layers = lambda **k: {r.eix: r.layer for r in T.reaching_edges(e, vs(spark, 1), **k).collect()}
    assert layers() == {0: 1, 1: 1, 3: 2, 4: 3}
    assert layers(outputs=vs(spark, 3), expand_outputs=False) == {0: 1, 1: 1, 3: 2} == layers(outputs=vs(spark, 3), early_stop=True)
    assert layers(whitelist=spark.createDataFrame([(0,), (3,)], "eix long")) == {0: 1, 3: 2}


def test_incidence_and_boundaries(spark):
    e = literal_edges(spark, [((1,), ()), ((), (1,)), ({2: 3.0}, {1: 2.0}), ((1,), (1,))])
    entries = lambda **k: {(r.v, r.eix): r.a for r in G.incidence_matrix(e, **k).collect()}
    assert entries() == {("1", 0): -1, ("1", 1): 1, ("2", 2): -1, ("1", 2): 1, ("1", 3): 0}
    assert entries(sparse=False)["1", 3] == 1 and entries(values=True)["2", 2] == -3
    assert {(r.eix, r.source, r.target) for r in G.directed_incidence(e).collect()} == {(0, "1", None), (1, None, "1"), (2, "2", "1"), (3, "1", "1")}
    back = IO.graph_from_incidence(G.incidence_matrix(e.filter("eix < 3"), values=True))
    assert {(r.eix, str(r.src), str(r.tgt)) for r in back.edges.collect()} == {(r.eix, str(r.src).replace("coef=None", "coef=1.0"), str(r.tgt).replace("coef=None", "coef=1.0")) for r in e.filter("eix < 3").collect()}
    with pytest.raises(Exception, match="hyperedge"):
        G.directed_incidence(literal_edges(spark, [((1, 2), (3,))])).collect()


def test_subgraphs_and_mutation(spark, hyper):
    assert names(G.subgraph(hyper, vs(spark, 1, 3)).edges, "eix") == {1, 2}
    picked = spark.createDataFrame([(0,), (1,), (4,)], "eix long")
    sub = G.edge_subgraph(hyper, picked)
    assert sub.edges.count() == 3 and sub.vertices.count() == 6
    assert names(G.extract_subgraph(hyper, vs(spark, 2), picked.filter("eix = 0")).edges, "eix") == {0, 1, 2, 3}
    assert names(G.filter_graph(hyper, F.col("v") != "2").edges, "eix") == {1, 2, 4}
    again = G.renumbered(G.edge_subgraph(hyper, picked.filter("eix > 0")))
    assert [(r.eix, len(r.tgt)) for r in again.edges.orderBy("eix").collect()] == [(0, 1), (1, 2)]
    grown = G.with_boundaries(hyper, vs(spark, 2, 1), vs(spark, 6))
    made = grown.edges.filter("eix > 4").orderBy("eix").select("eix", F.array_join(ends("src"), "").alias("s"), F.array_join(ends("tgt"), "").alias("t")).collect()
    assert [tuple(r) for r in made] == [(5, "", "1"), (6, "", "2"), (7, "6", "")]
    more = G.add_vertices(hyper, spark.createDataFrame([("9", {"k": "x"}), ("1", {"k": "y"})], "v string, attrs map<string,string>"))
    assert {r.v: (r.vix, r.attrs) for r in more.vertices.filter("attrs IS NOT NULL").collect()} == {"9": (6, {"k": "x"}), "1": (0, {"k": "y"})}
    assert {(r.eix, r.interaction) for r in G.random_signs(hyper.edges, 0.0).collect()} == {(i, 1) for i in range(5)}
    assert names(G.edges_by_attribute(G.random_signs(hyper.edges, 1.0), "interaction", -1), "eix") == set(range(5))
    a, b = G.content_hash(hyper).first()[0], G.content_hash(NetGraph(hyper.edges.repartition(3), hyper.vertices.repartition(2))).first()[0]
    assert a == b != G.content_hash(NetGraph(G.reverse(hyper.edges), hyper.vertices)).first()[0]


def test_dependency_reactions_check_gates(spark):
    sif = lambda *rows: spark.createDataFrame(list(rows), "s string, interaction int, t string")
    ok = G.dependency_reactions(sif(("A", 1, "and1"), ("B", -1, "and1"), ("and1", 1, "Y"), ("A", 1, "Y"), ("A", 1, "Y")))
    assert {(tuple(r.pos), tuple(r.neg), r["product"]) for r in ok.collect()} == {(("A",), ("B",), "Y"), (("A",), (), "Y")}
    for bad in ([("A", 1, "and1"), ("and1", 1, "Y")], [("A", 1, "and1"), ("B", 1, "and1")], [("A", 1, "and1"), ("B", 1, "and1"), ("and1", -1, "Y")], [("A", 1, "and1"), ("A", -1, "and1"), ("and1", 1, "Y")], [("and2", 1, "and1"), ("B", 1, "and1"), ("and1", 1, "Y"), ("A", 1, "and2"), ("C", 1, "and2")]):
        with pytest.raises(Exception):
            G.dependency_reactions(sif(*bad)).collect()


def test_files_round_trip(spark, tmp_path, hyper):
    (tmp_path / "a.sif").write_text("A\t1\tB\nB\t-1\tC\nC\t1\tC\nA\t1\tB\n")
    rows = IO.read_sif(spark, f"file://{tmp_path}/a.sif")
    assert sorted(map(tuple, rows.collect())) == [("A", 1, "B"), ("A", 1, "B"), ("B", -1, "C")]
    assert IO.read_sif(spark, f"file://{tmp_path}/a.sif", distinct=True, self_loops=True).count() == 3
    (tmp_path / "b.sif").write_text("A\t1\n")
    with pytest.raises(Exception, match="few"):
        IO.read_sif(spark, f"file://{tmp_path}/b.sif").collect()
    g = IO.graph_from_sif(spark, f"file://{tmp_path}/a.sif")
    assert g.edges.count() == 3 and names(g.vertices) == {"A", "B", "C"}
    same = lambda x, y: sorted(map(str, x.edges.collect())) == sorted(map(str, y.edges.collect())) and sorted(map(str, x.vertices.collect())) == sorted(map(str, y.vertices.collect()))
    IO.save_json(hyper, f"file://{tmp_path}/j")
    IO.write_graph(hyper, f"file://{tmp_path}/p")
    assert same(hyper, IO.load_json(spark, f"file://{tmp_path}/j")) and same(hyper, IO.read_graph(spark, f"file://{tmp_path}/p"))
    IO.write_dot(g, f"file://{tmp_path}/d")
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part*")))
    assert text.startswith("digraph {\n") and text.endswith("}\n") and '"B" -> "C" [arrowhead=tee];' in text
    assert IO.graph_from_tuples(spark, [("x", -1, "y"), ("y", 1, "z")]).edges.filter("interaction = -1").count() == 1
    with pytest.raises(Exception, match="plain"):
        IO.edge_list(hyper).collect()
    assert IO.edge_list(hyper, skip_hyperedges=True).count() == 3
    assert IO.layered_edges(hyper).filter("size(source) = 2").count() == 1


def test_sbml(spark, tmp_path):
    (tmp_path / "m.xml").write_text("""<sbml xmlns:fbc="f"><model><listOfParameters><parameter id="lo" value="0"/><parameter id="hi" value="10"/></listOfParameters><listOfReactions>
<reaction id="R1" fbc:lowerFluxBound="lo" fbc:upperFluxBound="hi"><listOfReactants><speciesReference species="A" stoichiometry="2"/></listOfReactants><listOfProducts><speciesReference species="B" stoichiometry="1"/><speciesReference species="C" stoichiometry="3"/></listOfProducts></reaction>
<reaction id="R2" fbc:lowerFluxBound="lo" fbc:upperFluxBound="hi"><listOfProducts><speciesReference species="A" stoichiometry="1"/></listOfProducts></reaction></listOfReactions></model></sbml>""")
    g = IO.read_sbml(spark, f"file://{tmp_path}/m.xml")
    assert {(r.id, r.v): r.a for r in IO.coefficients(g).collect()} == {("R1", "A"): -2, ("R1", "B"): 1, ("R1", "C"): 3, ("R2", "A"): 1}
    assert {(r.id, r.default_lb, r.default_ub) for r in g.edges.collect()} == {("R1", 0, 10), ("R2", 0, 10)}


def test_checks(spark, hyper):
    with pytest.raises(ValueError, match="unknown"):
        Q.require(Q.unknown_vertices(vs(spark, 1, 77), hyper.vertices), "unknown vertex")
    Q.require(Q.unknown_vertices(vs(spark, 1), hyper.vertices), "unknown vertex")
    nums = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (0.5,)], "x double")
    assert Q.not_finite(nums, "x").count() == 3 and Q.out_of_unit(nums, "x").count() == 3 and Q.out_of_unit(nums, "x", True).count() == 4
    assert names(Q.not_plain(hyper.edges), "eix") == {0, 4}
    assert names(Q.without_outgoing(vs(spark, 1, 5), hyper.edges)) == {"5"} and Q.bad_signs(hyper.edges).count() == 5


def test_results(spark, hyper):
    nodes, links = R.plot_model(NetGraph.of_edges(literal_edges(spark, [((1,), ()), ((1, 2), (3,), {"interaction": -1}), ((1,), (3,))]), vs(spark, 9)))
    assert {(r.node, r.kind) for r in nodes.collect()} == {("1", "vertex"), ("2", "vertex"), ("3", "vertex"), ("9", "vertex"), ("__target_0", "point"), ("__centre_1", "centre")}
    assert links.filter("head = 'tee'").count() == 1 and links.count() == 5
    sol = spark.createDataFrame([(0, 0.0), (2, 1.0)], "eix long, value double")
    assert names(R.solved_subgraph(hyper, sol).vertices) == {"1", "3"}
    merged = R.merged(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, value double"), spark.createDataFrame([("b", 5.0)], "k string, value double"), "k")
    assert {r.k: r.value for r in merged.collect()} == {"a": 1.0, "b": 5.0}


def test_random_graphs(spark):
    a = preferential(spark, 40, 2, seed=3)
    assert a.collect() == preferential(spark, 40, 2, seed=3).collect() and a.count() == 1 + 2 * 38
    b = duplication(spark, 30, 0.4, seed=5).collect()
    assert len({r.t for r in b} | {r.s for r in b}) == 30 and json.dumps(len(b))


def test_undirected_hops_go_over_neighbours(spark):
    """{1, 2} -> 3: from 1, both 2 and 3 are one hop away."""
    e = literal_edges(spark, [((1, 2), (3,)), ((3,), (4,))])
    for touching in (None, G.incidence(e)):
        found = T.bfs(G.arcs(e), vs(spark, 1), undirected=True, touching=touching)
        assert {r.v: r.dist for r in found.collect()} == {"1": 0, "2": 1, "3": 1, "4": 2}


def test_a_traversal_that_is_cut_short_is_an_error(spark):
    chain = spark.createDataFrame([(k, str(k), str(k + 1), 1.0) for k in range(12)], "eix long, s string, t string, weight double")
    assert T.bfs(chain, vs(spark, 0), max_rounds=12).count() == 13 == T.shortest_paths(chain, vs(spark, 0), max_rounds=12).count()
    for search in (T.bfs, T.shortest_paths):
        with pytest.raises(RuntimeError):
            search(chain, vs(spark, 0), max_rounds=3)

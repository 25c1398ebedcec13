from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from fluxweave.functions import scores as S
from fluxweave.model import NetGraph, literal_edges
from fluxweave.operators import graph as G
from fluxweave.operators import signalling
from fluxweave.plans import methods, solve, templates
from fluxweave.plans import model_tables as M
from fluxweave.sources import formats as IO


def optimum(p):
    s = solve.solve({"p": p}).cache()
    checked, _ = M.evaluate(p, s)
    assert checked.agg(F.coalesce(F.max("violation"), F.lit(0.0))).first()[0] < 1e-6
    return s, s.first().objective


def two_routes(spark):
    """A to B by either of two routes; sample 0 may use both, sample 1 the second only."""
    rows = [((), {"A": 1.0}, {"id": "in", "default_lb": 0.0, "default_ub": 4.0, "gpr": "g1"}), ({"A": 1.0}, {"B": 1.0}, {"id": "one", "default_lb": 0.0, "default_ub": 4.0, "gpr": "g1 and g2"}), ({"A": 1.0}, {"B": 1.0}, {"id": "two", "default_lb": 0.0, "default_ub": 4.0, "gpr": "g1 or g2"}), ({"B": 1.0}, (), {"id": "out", "default_lb": 0.0, "default_ub": 4.0})]
    g = NetGraph.of_edges(literal_edges(spark, rows))
    table = spark.createDataFrame([(0,), (1,)], "c long")
    return g, methods.resolved_bounds(g.edges, spark.createDataFrame([(1, "one", 0.0, 0.0)], "c long, id string, lb double, ub double"), table), table


def test_coupling_makes_samples_share_routes(spark):
    g, bounds, table = two_routes(spark)
    goal = table.select(F.lit("out").alias("id"), "c", F.lit(None).cast("double").alias("weight"))
    s, value = optimum(methods.fba(g, bounds, goal, coupling=0.5))
    assert value == pytest.approx(-8 + 0.5 * 3)
    assert s.filter("name = 'active_any' AND value > 0.5").count() == 3 and s.filter("name = 'flow' AND r = 1 AND value > 1e-6").count() == 0
    alone = methods.fba(g, bounds.filter("c = 0"), goal.filter("c = 0"), coupling=0.5)
    assert optimum(alone)[1] == pytest.approx(-4 + 0.5 * 3) and alone.variables.filter("name = 'active_any'").count() == 0


def test_templates_run_their_hooks_and_refuse_an_unnamed_support(spark):
    g, bounds, table = two_routes(spark)
    goal = table.select(F.lit("out").alias("id"), "c", F.lit(None).cast("double").alias("weight"))
    drop = lambda g, f: (G.filter_graph(g, edge=F.col("id") != "one"), f)
    state = lambda g, f: methods.fba(g, bounds.join(g.edges.select("eix"), "eix", "left_semi"), f, sparsity=0.1)
    p, kept = templates.Template(state, drop, "active", 1.0).build(g, goal)
    assert kept.edges.count() == 3 and optimum(p)[1] == pytest.approx(-8 + 0.6 + 3)
    assert optimum(p.reweighted(support_active_any=0.0))[1] == pytest.approx(-8 + 0.6)
    with pytest.raises(KeyError):
        p.reweighted(nothing=1.0)
    with pytest.raises(ValueError, match="names no"):
        templates.Template(state).build(g, goal)
    assert not templates.Template(state, shared=False).build(g, goal)[0].objectives[-1][0].startswith("support")


def test_gene_scores_feed_the_model(spark):
    g, bounds, _ = two_routes(spark)
    samples = spark.createDataFrame([(0, {"g1": 2.0, "g2": -3.0}), (1, {"g1": 1.0})], "c long, values map<string,double>")
    raw = {(r.id, r.c): r.score for r in methods.gene_scores(g, samples).collect()}
    assert raw == {("in", 0): 2, ("in", 1): 1, ("one", 0): -3, ("one", 1): 0, ("two", 0): 2, ("two", 1): 1}
    cut_ = {(r.id, r.c): r.score for r in methods.gene_scores(g, samples, low=-1, high=2).collect()}
    assert cut_ == {("in", 0): 1, ("in", 1): 0, ("one", 0): -1, ("one", 1): 0, ("two", 0): 1, ("two", 1): 0}
    wanted = methods.gene_scores(g, samples, low=-1, high=2)
    assert optimum(methods.imat(g, bounds, wanted, scale=None))[1] == pytest.approx(0)
    # three reactions carry the flux that two genes want, less than what missing both would cost
    assert optimum(methods.imat(g, bounds, wanted, scale=None, coupling=0.25))[1] == pytest.approx(0.75)
    assert {r.gene for r in S.unique_genes(g.edges, "gpr", prefix="g2").collect()} == {"g2"}


def test_layers_bounds_and_parents(spark):
    rows = [((), (0,)), ((0,), (1,)), ((1,), (2,)), ((0,), (2,)), ((2,), (0,))]
    g = NetGraph.of_edges(literal_edges(spark, rows))
    ix = g.vertices.select("vix", "v")
    number = {r.v: r.vix for r in ix.collect()}

    def best(**how):
        """The most edges that can be selected."""
        p = M.Problem.empty(spark)
        binary = g.edges.select(F.lit("x").alias("name"), F.col("eix").alias("r"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("lb"), F.lit(1.0).alias("ub"), F.lit("binary").alias("vartype"))
        v, con, terms = M.acyclic(g.edges, ix, 1, "x", 3, **how)
        p = p.add_variables(binary).add_variables(v).add((con, terms))
        return -optimum(p.minimise(p.symbol("x").sum() * -1.0))[1]

    def brute(limit=lambda v: 9, low=(0, 0, 0), high=(2, 2, 2)):
        top = 0
        for some in itertools.product((0, 1), repeat=5):
            chosen = [r for r, on in zip(rows, some, strict=True) if on]
            fits = any(all(not s or lay[t[0]] > lay[s[0]] for s, t in chosen) for lay in itertools.product(*(range(a, b + 1) for a, b in zip(low, high, strict=True))))
            if fits and all(sum(t == (v,) for _, t in chosen) <= limit(v) for v in range(3)):
                top = max(top, len(chosen))
        return top

    assert best() == brute() == 4
    assert best(max_parents=1) == brute(lambda v: 1)
    per = spark.createDataFrame([(number["2"], 0), (number["0"], 0)], "vix long, n int")
    assert best(max_parents=per) == brute(lambda v: {2: 0, 0: 0}.get(v, 9))
    held = spark.createDataFrame([(number["0"], 0, 2.0, None), (number["1"], 0, None, 1.0)], "vix long, c long, lb double, ub double")
    assert best(bounds=held) == brute(low=(2, 0, 0), high=(2, 1, 2))


def test_norms_and_largest(spark):
    p, x = M.Problem.empty(spark).variable("x", 2, 2)
    sol = spark.createDataFrame([("x", 0, 0, 3.0), ("x", 1, 0, -4.0), ("x", 0, 1, -1.0), ("x", 1, 1, -2.0)], "name string, r long, c long, value double")
    cells = x.take(cols=[0]).value(sol)
    assert [M.norm(cells, k).first().value for k in (1, 2, M.INF)] == [7, 5, 4]
    assert [r.value for r in M.largest(x, sol, 0).orderBy("c").collect()] == [3, -1]
    assert [r.value for r in M.largest(x, sol, 1).orderBy("r").collect()] == [3, -2] and M.largest(x, sol).first().value == 3
    hole = M.Expr(x.cells.filter("r = 1"), 2, 2)
    assert M.largest(hole, sol).first().value == 0
    with pytest.raises(KeyError):
        p.symbol("y")


def test_signalling_helpers(spark):
    g = NetGraph.of_edges(literal_edges(spark, [(("a",), ("AND1",), {"interaction": -1}), (("b",), ("AND1",)), (("AND1",), ("c",)), ((), ("a",))]))
    report = {(r.part, r.v, r.eix): r.value for r in signalling.presolve_report(g).collect()}
    assert {k[1] for k, x in report.items() if k[0] == "gate" and x} == {"AND1"} and report["interaction", None, 0] == -1 and report["interaction", None, 1] == 1
    assert {k[2] for k in report if k[0] == "has_source"} == {0, 1, 2} and ("target", "a", 3) in report and ("source", "a", 0) in report
    tests = spark.createDataFrame([("x", "a", "input"), ("x", "b", "inhibition"), ("y", "c", "output")], "condition string, v string, role string")
    assert {(r.v, r.condition) for r in signalling.inhibited(g.vertices, tests).filter("inhibited").collect()} == {("b", "x")}
    signalling.require_consistent(g, tests)
    with pytest.raises(ValueError, match="not in the graph"):
        signalling.require_consistent(g, tests.union(spark.createDataFrame([("y", "zzz", "inhibition")], tests.schema)))
    with pytest.raises(KeyError):
        G.require_vertices(g, spark.createDataFrame([("q",)], "v string"))
    assert G.edges_at(g, [0, 3]).count() == 2
    with pytest.raises(IndexError):
        G.edges_at(g, [77])


def test_exchange_lists_come_back(spark):
    g = NetGraph.of_edges(literal_edges(spark, [(("a",), ("b",), {"interaction": -1, "weight": 2.0}), (("b",), ("c",)), (("a",), ("b",))]))
    again = IO.graph_from_edge_list(IO.edge_list(g))
    key = lambda rows: sorted(str((r.s, r.t, r.interaction, r.weight)) for r in rows.collect())
    assert key(IO.edge_list(again)) == key(IO.edge_list(g))
    with pytest.raises(Exception, match="lacks an end"):
        IO.graph_from_edge_list(spark.createDataFrame([("a", None)], "s string, t string")).edges.collect()
    hyper = NetGraph.of_edges(literal_edges(spark, [({"a": 2.0, "b": 2.0}, {"c": 2.0})]))
    back = IO.graph_from_layers(IO.layered_edges(hyper, "x").unionByName(IO.layered_edges(hyper, "y")), "x").edges.first()
    assert [(x.v, x.coef) for x in back.src] == [("a", 2), ("b", 2)] and back.attrs == {"layer": "x"} and back.weight == 2
    entries = spark.createDataFrame([("a", 0, -1.0), ("b", 0, 2.0)], "v string, eix long, a double")
    known = spark.createDataFrame([("a",), ("b",), ("z",)], "v string")
    wide = IO.graph_from_incidence(entries, known, spark.createDataFrame([(0,), (1,)], "eix long"))
    assert wide.edges.count() == 2 and wide.vertices.count() == 3
    with pytest.raises(ValueError, match="unknown"):
        IO.graph_from_incidence(entries, known.filter("v <> 'a'"))


def test_gene_rules_of_sbml(spark, tmp_path):
    ref = lambda g: f'<fbc:geneProductRef fbc:geneProduct="{g}"/>'
    (tmp_path / "m.xml").write_text(f"""<sbml xmlns:fbc="f"><model><fbc:listOfGeneProducts><fbc:geneProduct fbc:id="G_1" fbc:label="b0001"/><fbc:geneProduct fbc:id="G_2"/></fbc:listOfGeneProducts>
<listOfParameters><parameter id="lo" value="0"/><parameter id="hi" value="10"/></listOfParameters><listOfReactions>
<reaction id="R_a" name="first" fbc:lowerFluxBound="lo" fbc:upperFluxBound="hi"><notes><body><p>SUBSYSTEM: Sugar</p><p>GENE_ASSOCIATION: other</p></body></notes><listOfProducts><speciesReference species="M_x" stoichiometry="1"/></listOfProducts><fbc:geneProductAssociation><fbc:and>{ref("G_1")}<fbc:or>{ref("G_2")}{ref("G_3")}</fbc:or></fbc:and></fbc:geneProductAssociation></reaction>
<reaction id="R_b" fbc:lowerFluxBound="lo" fbc:upperFluxBound="hi"><notes><body><p>GENE ASSOCIATION: (b1 and b2)</p></body></notes><listOfReactants><speciesReference species="M_x"/></listOfReactants></reaction>
<reaction id="R_c" fbc:lowerFluxBound="lo" fbc:upperFluxBound="hi"><listOfReactants><speciesReference species="M_x"/></listOfReactants><fbc:geneProductAssociation>{ref("G_1")}</fbc:geneProductAssociation></reaction></listOfReactions></model></sbml>""")
    rows = {r.id: r for r in IO.read_sbml(spark, f"file://{tmp_path}/m.xml", prefixes=False).edges.collect()}
    assert {k: r.gpr for k, r in rows.items()} == {"a": "b0001 and (2 or 3)", "b": "(b1 and b2)", "c": "b0001"}
    assert rows["a"].attrs == {"subsystem": "Sugar", "name": "first"} and rows["b"].attrs is None and rows["a"].tgt[0].v == "x"
    kept = {r.id: r.gpr for r in IO.read_sbml(spark, f"file://{tmp_path}/m.xml").edges.collect()}
    assert kept["R_a"] == "b0001 and (G_2 or G_3)"

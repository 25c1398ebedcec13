from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxweave.model import NetGraph, literal_edges
from fluxweave.operators import graph as G
from fluxweave.plans import methods, solve
from fluxweave.plans import model_tables as M


def solved(p, pid="p"):
    s = solve.solve({pid: p}).cache()
    assert {r.status for r in s.select("status").distinct().collect()} == {"optimal"}
    checked, values = M.evaluate(p, s)
    assert checked.agg(F.coalesce(F.max("violation"), F.lit(0.0))).first()[0] < 1e-6
    total = sum(r.weight * r.value for r in values.collect()) if values is not None else 0.0
    assert total == pytest.approx(s.first().objective, abs=1e-6)
    return s, {r["name"]: r["value"] for r in values.collect()} if values is not None else {}


# --- expressions and gates


def grid_problem(spark, rows=2, cols=3):
    return M.Problem.empty(spark).variable("x", rows, cols, 0, 10)


def dense(e, solution):
    out = np.zeros((e.rows, e.cols))
    for r in e.value(solution).collect():
        out[r.r, r.c] = r.value
    return out


def test_expression_algebra_is_numpys(spark):
    p, x = grid_problem(spark)
    a = np.arange(6).reshape(2, 3) + 1.0
    sol = spark.createDataFrame([("x", r, c, float(a[r, c])) for r in range(2) for c in range(3)], "name string, r long, c long, value double")
    m = np.array([[1.0, 2.0], [0.0, -1.0], [3.0, 0.0]])
    mdf = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(2)], "i long, j long, a double")
    k = spark.createDataFrame([(r, c, float(r - c)) for r in range(2) for c in range(3)], "r long, c long, value double")
    one = M.Expr.constant(k, 2, 3)
    for e, want in [(x + one * 2, a + 2 * np.subtract.outer(range(2), range(3))), (-x / 2, -a / 2), (x - x, a * 0), (x.multiply(k), a * np.subtract.outer(range(2), range(3))), (x.left(mdf, 3), m @ a), (x.right(mdf, 2), a @ m), (x.sum(), [[a.sum()]]), (x.sum(0), a.sum(0)[None]), (x.sum(1), a.sum(1)[:, None]), (x.T, a.T), (x.reshape(3, -1), a.reshape(3, 2, order="F")), (x.vstack(x), np.vstack([a, a])), (x.hstack(x), np.hstack([a, a])), (x.take([1], [2, 0]), a[[1]][:, [2, 0]])]:
        assert np.allclose(dense(e, sol), want)
    with pytest.raises(ValueError):
        x + x.T
    with pytest.raises(ValueError):
        x.reshape(4, 2)


@pytest.mark.parametrize("kind", ["or", "and", "xor"])
def test_gates_are_exact(spark, kind):
    truth = {"or": any, "and": all, "xor": lambda v: sum(v) % 2 == 1}[kind]
    problems, want = {}, {}
    for bits in itertools.product((0, 1), repeat=3):
        p, x = M.Problem.empty(spark).variable("x", 1, 3, vartype="binary")
        gv, gc, gt = M.gate(p.variables, kind, "g")
        p = p.add_variables(gv).add((gc, gt))
        for k, b in enumerate(bits):
            p = p.subject_to(x.take(cols=[k]), f"fix{k}", "=", b)
        for sense, weight in (("lo", 1.0), ("hi", -1.0)):
            pid = f"{bits}{sense}"
            problems[pid] = p.minimise(methods.linear(spark.createDataFrame([("g", 0, 0, 1.0)], "name string, vr long, vc long, coef double")), weight)
            want[pid] = float(truth(bits))
    found = {r.pid: r.value for r in solve.solve(problems).filter("name = 'g'").collect()}
    assert found == pytest.approx(want)


def test_indicators_and_hamming(spark):
    p, x = M.Problem.empty(spark).variable("x", 3, 1, -5, 5)
    nv, nc, nt = M.nonzero_indicator(p.variables, "on", 0.5)
    p = p.add_variables(nv).add((nc, nt))
    for k, v in enumerate((-2, 0, 3)):
        p = p.subject_to(x.take([k]), f"f{k}", "=", v)
    cost = spark.createDataFrame([(f"on_{s}", k, 0, -1.0) for s in ("pos", "neg") for k in range(3)], "name string, vr long, vc long, coef double")
    s, _ = solved(p.minimise(methods.linear(cost)))
    got = {(r.name, r.r): round(r.value) for r in s.filter("name LIKE 'on%'").collect()}
    assert [got["on_pos", k] for k in range(3)] == [0, 0, 1] and [got["on_neg", k] for k in range(3)] == [1, 0, 0]
    b, _ = M.Problem.empty(spark).variable("y", 3, 1, vartype="binary")
    ref = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.0), (2, 0, -1.0)], "r long, c long, value double")
    _, values = solved(b.minimise(M.hamming(b.variables, ref), name="h"))
    assert values["h"] == pytest.approx(0)
    with pytest.raises(Exception, match="finite"):
        M.indicator(M.Problem.empty(spark).variable("z", 1)[0].variables, "i")[2].collect()


def test_problem_algebra(spark):
    p, x = M.Problem.empty(spark).variable("x", 1, 1, 0, 4)
    p = p.minimise(x, -2.0, "gain").register("x", x)
    with pytest.raises(ValueError):
        p.register("x", x)
    two = p.merge(p.with_suffix("_b"))
    s, values = solved(two)
    assert values == {"gain": 4.0, "gain_b": 4.0} and set(two.named) == {"x", "x_b"} and two.direction == "min"
    with pytest.raises(ValueError):
        p.merge(M.Problem.empty(spark, "max"))


def test_linear_programs_match_vertex_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, k = int(rng.integers(1, 4)), int(rng.integers(0, 4))
        a, b = rng.integers(-3, 4, (k, n)).astype(float), rng.integers(-4, 6, k).astype(float)
        lb, ub, c = -rng.integers(0, 4, n).astype(float), rng.integers(0, 4, n).astype(float), rng.integers(-3, 4, n).astype(float)
        sense = rng.choice(["<=", ">=", "="], k)
        status, x, value = solve.linprog(c, a, sense, b, lb, ub)
        planes = [(a[i], b[i]) for i in range(k)] + [(np.eye(n)[j], v[j]) for j in range(n) for v in (lb, ub)]
        best = np.inf
        for pick in itertools.combinations(planes, n):
            m = np.array([q[0] for q in pick])
            if abs(np.linalg.det(m)) < 1e-9:
                continue
            y = np.linalg.solve(m, np.array([q[1] for q in pick]))
            r = a @ y - b
            if (y >= lb - 1e-9).all() and (y <= ub + 1e-9).all() and all({"<=": r[i] <= 1e-9, ">=": r[i] >= -1e-9, "=": abs(r[i]) <= 1e-9}[sense[i]] for i in range(k)):
                best = min(best, c @ y)
        assert (status == "optimal") == np.isfinite(best)
        if status == "optimal":
            assert value == pytest.approx(best, abs=1e-7)


def test_programs_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(25):
        n, k = 5, 3
        a, b, c = rng.integers(-3, 5, (k, n)).astype(float), rng.integers(0, 8, k).astype(float), rng.integers(-5, 4, n).astype(float)
        status, x, value = solve.milp(c, a, np.full(k, "<="), b, np.zeros(n), np.ones(n), np.ones(n, dtype=bool))
        best = min((c @ np.array(v) for v in itertools.product((0, 1), repeat=n) if (a @ np.array(v) <= b + 1e-9).all()), default=np.inf)
        assert value == pytest.approx(best)
    assert solve.linprog(np.array([-1.0]), np.zeros((0, 1)), np.array([], dtype=str), np.zeros(0), np.array([0.0]), np.array([np.inf]))[0] == "unbounded"


# --- trees

STEINER5 = [(("A",), ("B",), {"weight": 2.0}), (("B",), ("C",), {"weight": 2.0}), (("A",), ("C",), {"weight": 5.0}), (("C",), ("D",), {"weight": 1.0}), (("B",), ("D",), {"weight": 4.0})]


def graph_of(spark, rows, edge_type="directed"):
    return NetGraph.of_edges(literal_edges(spark, rows, edge_type))


def test_steiner_and_prizes(spark):
    g = graph_of(spark, STEINER5, "undirected")
    v = lambda *names: spark.createDataFrame([(n,) for n in names], "v string")
    _, values = solved(methods.steiner_tree(g, v("A", "C", "D"), "A"))
    assert values["cost"] == pytest.approx(5)
    prizes = spark.createDataFrame([("C", 6.0), ("D", 2.0)], "v string, prize double")
    _, values = solved(methods.steiner_tree(g, prizes, "A", prizes))
    assert values["cost"] + values["prize"] == pytest.approx(-3)
    assert methods.steiner_by_enumeration(G.arcs(g.edges).filter("NOT reversed"), ["A", "C", "D"]).first().best == 5


# --- signalling

CARNIVAL = [("r1", 1, "a"), ("r1", 1, "b"), ("r2", -1, "b"), ("r2", 1, "c"), ("a", 1, "d"), ("b", 1, "d"), ("b", -1, "e"), ("c", 1, "e"), ("d", 1, "tf1"), ("d", -1, "tf2"), ("e", -1, "tf2"), ("e", 1, "tf1")]


def brute_carnival(arcs, inputs, outputs):
    """Least error of one condition: each vertex takes one in-edge or none, signals follow signs."""
    vertices = sorted({x for s, _, t in arcs for x in (s, t)})
    into = {v: [(s, w) for s, w, t in arcs if t == v] for v in vertices}
    best = np.inf
    for pick in itertools.product(*([None, *into[v]] if v not in inputs else [None] for v in vertices)):
        parent = dict(zip(vertices, pick, strict=True))
        state, ok = dict(inputs), True
        for v in vertices:
            chain, x = [], v
            while x not in state and parent[x] is not None and x not in chain:
                chain.append(x)
                x = parent[x][0]
            if x in chain:
                ok = False
                break
            for y in reversed(chain):
                state[y] = state.get(parent[y][0], 0) * parent[y][1]
        if ok:
            best = min(best, sum(abs(m) * (1 - state.get(v, 0) * np.sign(m)) for v, m in outputs.items()))
    return best


def test_carnival_matches_brute_force(spark):
    g = graph_of(spark, [((s,), (t,), {"interaction": w}) for s, w, t in CARNIVAL])
    for inputs, outputs in (({"r1": 1}, {"tf1": 1, "tf2": 1}), ({"r2": 1}, {"tf1": 1, "tf2": -1})):
        rows = [("c", v, "input", float(x)) for v, x in inputs.items()] + [("c", v, "output", float(x)) for v, x in outputs.items()]
        p, _ = methods.carnival(g, spark.createDataFrame(rows, "condition string, v string, role string, value double"), 1e-3)
        _, values = solved(p)
        assert values["error"] == pytest.approx(brute_carnival(CARNIVAL, inputs, outputs))


def test_boolean_models(spark):
    sif = spark.createDataFrame([("A", 1, "and1"), ("B", 1, "and1"), ("and1", 1, "Y")], "s string, interaction int, t string")
    reactions = G.dependency_reactions(sif)
    assert reactions.count() == 1
    conditions = spark.createDataFrame([(f"{a}{b}",) for a in (0, 1) for b in (0, 1)], "condition string")
    stimuli = spark.createDataFrame([(f"{a}{b}", v, x) for a in (0, 1) for b in (0, 1) for v, x in (("A", a), ("B", b))], "condition string, v string, value int")
    on = {r.condition for r in methods.boolean_simulation(reactions, stimuli, conditions).filter("v = 'Y' AND state = 1").collect()}
    assert on == {"11"}
    options = spark.createDataFrame([(0, ["A"], [], "Y"), (1, ["B"], [], "Y"), (2, ["A"], ["B"], "Y")], "rid long, pos array<string>, neg array<string>, product string")
    measured = spark.createDataFrame([(f"{a}{b}", "Y", float(a and not b)) for a in (0, 1) for b in (0, 1)], "condition string, v string, value double")
    best = methods.boolean_fit(options, stimuli, measured, 0.01).orderBy("objective", "mask").first()
    assert (best["mask"], best["error"], best["n"]) == (4, 0.0, 1)
    loop = spark.createDataFrame([(0, [], ["Y"], "Y")], "rid long, pos array<string>, neg array<string>, product string")
    with pytest.raises(ValueError, match="cycle"):
        methods.boolean_simulation(loop, stimuli.limit(0), conditions, 20)


def brute_phonemes(arcs, start, scores, cost):
    vertices = sorted({x for a in arcs for x in a})
    best = np.inf
    for mask in range(1, 1 << len(arcs)):
        chosen = [a for k, a in enumerate(arcs) if mask >> k & 1]
        used = {x for a in chosen for x in a}
        heads, tails = {b for _, b in chosen}, {a for a, _ in chosen}
        if start not in used or start not in tails or any(v not in heads for v in used - {start}) or any(v not in tails for v in used - set(scores)):
            continue
        left, order = set(used), True
        while left and order:
            free = {v for v in left if not any(b == v and a in left for a, b in chosen)}
            order = bool(free)
            left -= free
        if not left:
            best = min(best, sum(scores.get(v, 0) for v in used) + cost * len(chosen))
    assert vertices
    return best


def test_phonemes_matches_brute_force(spark):
    arcs = [("K", "a"), ("K", "b"), ("a", "s1"), ("a", "s2"), ("b", "s2"), ("b", "s3"), ("s2", "s3"), ("s3", "a")]
    scores = {"s1": -2.0, "s2": 1.5, "s3": -1.0}
    g = graph_of(spark, [((s,), (t,)) for s, t in arcs])
    p, _ = methods.phonemes(g, spark.createDataFrame([("c", "K")], "condition string, v string"), spark.createDataFrame([("c", v, x) for v, x in scores.items()], "condition string, v string, score double"), 0.01)
    _, values = solved(p)
    assert values["score"] + 0.01 * values["edges"] == pytest.approx(brute_phonemes(arcs, "K", scores, 0.01))


def brute_both_ways(arcs, anchors, scores, cost, policy):
    def sides(kind):
        for mask in range(1 << len(arcs)):
            chosen = frozenset(a for k, a in enumerate(arcs) if mask >> k & 1)
            used = {x for a in chosen for x in a}
            heads, tails = {b for _, b in chosen}, {a for a, _ in chosen}
            start, stop = (anchors, set(scores)) if kind == "down" else (set(scores), anchors)
            if all(v in heads for v in used - start) and all(v in tails for v in used - stop):
                yield chosen, heads, tails

    def acyclic(chosen):
        left = {x for a in chosen for x in a}
        while left:
            free = {v for v in left if not any(b == v and a in left for a, b in chosen)}
            if not free:
                return False
            left -= free
        return True

    best = np.inf
    ups = list(sides("up"))
    for down, _, tails in sides("down"):
        for up, heads, _ in ups:
            ok = {"either": lambda v, t=tails, h=heads: v in t or v in h, "both": lambda v, t=tails, h=heads: v in t and v in h, "downstream": lambda v, t=tails: v in t}[policy]
            both = down | up
            if all(map(ok, anchors)) and acyclic(both):
                best = min(best, sum(scores.get(v, 0) for v in {x for a in both for x in a}) + cost * len(both))
    return best


@pytest.mark.parametrize("policy", ["either", "both", "downstream"])
def test_both_ways_matches_brute_force(spark, policy):
    arcs = [("u", "k"), ("w", "u"), ("k", "d"), ("d", "s"), ("k", "s"), ("s", "w"), ("u", "d")]
    scores = {"w": -1.0, "s": 0.5, "d": -2.0}
    g = graph_of(spark, [((s,), (t,)) for s, t in arcs])
    p, _ = methods.phonemes_both_ways(g, spark.createDataFrame([("c", "k")], "condition string, v string"), spark.createDataFrame([("c", v, x) for v, x in scores.items()], "condition string, v string, score double"), 0.01, policy)
    _, values = solved(p)
    assert values["score"] + 0.01 * values["edges"] == pytest.approx(brute_both_ways(arcs, {"k"}, scores, 0.01, policy))


# --- metabolism


def metabolic(spark):
    rows = [((), {"A": 1}, {"id": "in", "default_lb": 0.0, "default_ub": 10.0}), ({"A": 1}, {"B": 2}, {"id": "r1", "default_lb": 0.0, "default_ub": 100.0}), ({"A": 1}, {"C": 1}, {"id": "r2", "default_lb": 0.0, "default_ub": 3.0}), ({"B": 1, "C": 1}, {"X": 1}, {"id": "grow", "default_lb": 0.0, "default_ub": 100.0}), ({"X": 1}, (), {"id": "out", "default_lb": 0.0, "default_ub": 100.0}), ({"B": 1}, (), {"id": "waste", "default_lb": 0.0, "default_ub": 100.0})]
    return graph_of(spark, rows)


def test_flux_balance_and_overrides(spark):
    g = metabolic(spark)
    samples = spark.createDataFrame([(0,), (1,)], "c long")
    over = spark.createDataFrame([(1, "r2", 0.0, 1.0)], "c long, id string, lb double, ub double")
    bounds = methods.resolved_bounds(g.edges, over, samples)
    assert bounds.count() == 12
    goal = spark.createDataFrame([("out", 0, None), ("out", 1, None)], "id string, c long, weight double")
    s, values = solved(methods.fba(g, bounds, goal))
    out = {r.c: r.value for r in s.join(g.edges.filter("id = 'out'").select(F.col("eix").alias("r")), "r").filter("name = 'flow'").collect()}
    assert out == pytest.approx({0: 3.0, 1: 1.0}) and values["flux"] == pytest.approx(-4)
    _, values = solved(methods.fba(g, bounds.filter("c = 0"), goal.filter("c = 0"), 0.01))
    assert values["flux"] == pytest.approx(-3) and values["active"] == pytest.approx(5)


def test_imat_states(spark):
    g = metabolic(spark)
    bounds = methods.resolved_bounds(g.edges, spark.createDataFrame([], "c long, id string, lb double, ub double"), spark.createDataFrame([(0,)], "c long"))
    scores = spark.createDataFrame([("grow", 0, 1.0), ("waste", 0, -1.0), ("r2", 0, 1.0), ("in", 0, 0.0)], "id string, c long, score double")
    s, values = solved(methods.imat(g, bounds, scores, 0.1, None))
    assert values["missing"] == pytest.approx(0) and values["unwanted"] == pytest.approx(0, abs=1e-6)


def test_alternative_solutions(spark):
    p, x = M.Problem.empty(spark).variable("x", 2, 1, 0, 1)
    p = p.minimise(x.sum() * -1, name="sum").subject_to(x.sum(), "cap", "<=", 1)
    trials = methods.perturbed_problems(p, "x", 4, share=1.0, scale=0.05)
    s = solve.solve(trials).cache()
    values = None
    for pid, q in trials.items():
        one = M.evaluate(q, s.filter(F.col("pid") == pid))[1].withColumn("pid", F.lit(pid))
        values = one if values is None else values.unionByName(one)
    base = spark.createDataFrame([("sum", -1.0)], "name string, value double")
    assert methods.acceptable(values, base).count() == 4
    assert len({tuple(r.value for r in s.filter(F.col("pid") == t).orderBy("r").collect()) for t in trials}) == 2


def test_random_acyclic_selection_is_accepted_only_without_cycles(spark):
    rows = [((a,), (b,)) for a, b in [("u", "v"), ("v", "w"), ("w", "u"), ("u", "w")]]
    g = graph_of(spark, rows)
    p, x = M.Problem.empty(spark).variable("x", 4, 1, vartype="binary")
    lv, lc, lt = M.acyclic(g.edges, g.vertices, 1, "x", 3)
    p = p.add_variables(lv).add((lc, lt)).minimise(x.sum() * -1, name="n")
    _, values = solved(p)
    assert values["n"] == pytest.approx(-3)


def test_acyclic_flow_and_selections(spark):
    g = graph_of(spark, [((), ("u",)), (("u",), ("v",)), (("v",), ("w",)), (("w",), ("v",)), (("w",), ())])
    parts = M.acyclic_flow(g.edges, g.vertices, 3, 0.0, 5.0)
    p = M.Problem.empty(spark)
    for v, c, t in parts:
        p = p.add_variables(v).add((c, t))
    cost = spark.createDataFrame([("flow", 4, 0, -1.0), ("flow", 3, 0, -1.0)], "name string, vr long, vc long, coef double")
    s, values = solved(p.minimise(methods.linear(cost), name="out"))
    assert values["out"] == pytest.approx(-5), "the loop between v and w carries nothing"
    inner = g.edges.filter("size(src) = 1 AND size(tgt) = 1")
    sv, sc, st = M.signed_edges(inner, 1, "sel")
    vv, vc, vt = M.vertex_selection(inner, g.vertices, 1, "sel_pos", required_in=g.vertices.filter("v = 'w'"))
    q = M.Problem.empty(spark).add_variables(sv).add((sc, st)).add_variables(vv).add((vc, vt))
    pick = spark.createDataFrame([("vertex", 2, 0, -1.0), ("sel_pos", 1, 0, 0.1), ("sel_pos", 2, 0, 0.1), ("vertex", 0, 0, 0.01), ("vertex", 1, 0, 0.01)], "name string, vr long, vc long, coef double")
    s, _ = solved(q.minimise(methods.linear(pick)))
    on = {(r["name"], r.r) for r in s.filter("value > 0.5").collect()}
    assert ("vertex", 2) in on and ("sel_pos", 2) in on and ("vertex", 1) in on and ("sel_pos", 1) not in on


def test_coupled_paths_share_edges(spark):
    rows = [(("a",), ("x",), {"weight": 1.0}), (("x",), ("z",), {"weight": 1.0}), (("b",), ("y",), {"weight": 1.0}), (("y",), ("z",), {"weight": 1.0}), (("b",), ("x",), {"weight": 1.5})]
    g = graph_of(spark, rows)
    pairs = spark.createDataFrame([(0, "a", "z"), (1, "b", "z")], "c long, s string, t string")
    for coupling, want in ((0.0, 4.0), (1.0, 4.5)):
        _, values = solved(methods.coupled_paths(g, pairs, coupling))
        assert values["length"] == pytest.approx(want)
    assert values["edges"] == pytest.approx(3)


def test_conditions_and_separate_signalling(spark):
    rows = methods.conditions_of(spark, input={"s1": {"r1": 1}, "s2": {"r2": 1}}, output={"s1": {"tf1": 1, "tf2": 1}, "s2": {"tf1": 1, "tf2": -1}})
    g = graph_of(spark, [((s,), (t,), {"interaction": w}) for s, w, t in CARNIVAL])
    problems = methods.carnival_by_condition(g, rows, 1e-3, "both")
    found = solve.solve({k: p for k, (p, _) in problems.items()}).cache()
    for k, (p, _) in problems.items():
        checked, values = M.evaluate(p, found.filter(F.col("pid") == k))
        assert checked.agg(F.max("violation")).first()[0] < 1e-6
        inputs = {r.v: int(r.value) for r in rows.filter((F.col("condition") == k) & (F.col("role") == "input")).collect()}
        outputs = {r.v: r.value for r in rows.filter((F.col("condition") == k) & (F.col("role") == "output")).collect()}
        assert {r["name"]: r.value for r in values.collect()}["error"] == pytest.approx(brute_carnival(CARNIVAL, inputs, outputs))
    assert methods.conditions_of(spark, input={"a": 1}, output={"b": 2}).filter("condition = 'condition'").count() == 2
    for bad in ({"input": {"a": True}, "output": {"b": 1}}, {"input": {"x": {"a": 1}}, "output": {"y": {"b": 1}}}, {"input": {}, "output": {}}, {"input": {"a": float("nan")}, "output": {"b": 1}}):
        with pytest.raises(ValueError):
            methods.conditions_of(spark, **bad)

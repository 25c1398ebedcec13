from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from fluxweave.operators import graph as G
from fluxweave.plans import methods, solve
from fluxweave.plans import model_tables as M

SIF = [("a", 1, "x"), ("b", -1, "x"), ("a", 1, "AND1"), ("b", -1, "AND1"), ("AND1", 1, "y"), ("x", 1, "y"), ("y", 1, "x"), ("y", 1, "z")]
FEATURES = [("c1", "a", "input", 1.0), ("c1", "b", "input", 1.0), ("c1", "y", "output", 0.0), ("c1", "z", "output", 0.1), ("c2", "a", "input", 1.0), ("c2", "b", "input", 0.0), ("c2", "z", "output", 0.9)]


def brute(reactions, features, penalty):
    """Least error of all reaction sets that are acyclic and lie, dependency by dependency, between inputs and outputs."""
    starts = {v for _, v, role, _ in features if role == "input"}
    goals = {v for _, v, role, _ in features if role == "output"}
    best = float("inf")
    for size in range(len(reactions) + 1):
        for some in itertools.combinations(reactions, size):
            deps = {(s, r.product) for r in some for s in (*r.pos, *r.neg)}
            order, rest = [], {v for d in deps for v in d}
            while rest and (free := {v for v in rest if not any(t == v and s in rest for s, t in deps)}):
                order += sorted(free)
                rest -= free
            grow = lambda seen, pairs: seen if (more := {t for s, t in pairs if s in seen} - seen) == set() else grow(seen | more, pairs)
            ahead, back = grow(starts, deps), grow(goals, {(t, s) for s, t in deps})
            if rest or not all(s in ahead and t in back for s, t in deps):
                continue
            error = 0.0
            for condition in {f[0] for f in features}:
                state = {v: x for k, v, role, x in features if k == condition and role == "input"}
                for v in order:
                    on = any(r.product == v and all(state.get(u, 0) for u in r.pos) and not any(state.get(u, 0) for u in r.neg) for r in some)
                    state.setdefault(v, float(on))
                error += sum(abs(state.get(v, 0.0) - m) for k, v, role, m in features if k == condition and role == "output")
            best = min(best, error + penalty * size)
    return best


@pytest.mark.parametrize("penalty", [0.01, 0.7])
def test_the_program_is_the_best_of_all_subsets(spark, penalty):
    reactions = G.dependency_reactions(spark.createDataFrame(SIF, "s string, interaction int, t string")).cache()
    p, deps = methods.boolean_program(reactions, spark.createDataFrame(FEATURES, "condition string, v string, role string, value double"), penalty)
    s = solve.solve({"p": p}).cache()
    checked, _ = M.evaluate(p, s)
    assert checked.agg(F.max("violation")).first()[0] < 1e-6
    assert s.first().status == "optimal" and s.first().objective == pytest.approx(brute(reactions.collect(), FEATURES, penalty))
    assert deps.count() == 7 and solve.tier(p) == "branch-and-bound"


def test_refusals(spark):
    reactions = G.dependency_reactions(spark.createDataFrame([("a", 1, "x")], "s string, interaction int, t string"))
    make = lambda *rows: methods.boolean_program(reactions, spark.createDataFrame(list(rows), "condition string, v string, role string, value double"))
    out = ("c", "x", "output", 1.0)
    for rows, message in [([("c", "a", "input", 0.5), out], "neither"), ([("c", "a", "input", 1.0), ("c", "x", "output", 2.0)], "within"), ([("c", "a", "input", 1.0), ("d", "x", "output", 1.0)], "needs an input"), ([("c", "q", "input", 1.0), out], "not in the model"), ([("c", "a", "cue", 1.0), out], "role")]:
        with pytest.raises(ValueError, match=message):
            make(*rows)

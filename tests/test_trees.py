from __future__ import annotations

import itertools
import random

import pytest

from fluxweave.plans import trees

INF = float("inf")


def reach(edges, start, undirected):
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        for _, s, t, _ in edges:
            for a, b in ((s, t), (t, s))[: 1 + undirected]:
                if a == v and b not in seen:
                    seen.add(b)
                    todo.append(b)
    return seen


def every_subset(edges):
    for n in range(len(edges) + 1):
        yield from itertools.combinations(edges, n)


def network(seed, vertices=6, edges=9):
    rng = random.Random(seed)
    pairs = [(s, t) for s in range(vertices) for t in range(vertices) if s != t]
    return [(i, str(s), str(t), float(rng.randint(0, 9))) for i, (s, t) in enumerate(rng.sample(pairs, edges))]


def table(spark, rows):
    return spark.createDataFrame(rows, "eix long, s string, t string, weight double")


@pytest.mark.parametrize("seed,root", [(1, None), (3, "0")])
def test_steiner_trees_are_the_best_of_all_subsets(spark, seed, root):
    edges, goals = network(seed), ["1", "3", "4"]
    want = min((sum(e[3] for e in some) for some in every_subset(edges) if set(goals) <= reach(some, root or goals[0], root is None)), default=INF)
    cost, kept = trees.steiner(table(spark, edges), goals, root)
    eixs = {r.eix for r in kept.collect()}
    found = [r.cost for r in cost.collect()]
    assert found == ([want] if want < INF else []) and (not found or sum(e[3] for e in edges if e[0] in eixs) == want)
    if found:
        assert set(goals) <= reach([e for e in edges if e[0] in eixs], root or goals[0], root is None)


@pytest.mark.parametrize("seed,root,candidates,required,undirected", [(1, "0", None, (), True), (3, None, "all", ("5",), True), (5, None, "all", ("1",), False)])
def test_prizes_are_the_best_of_all_subsets(spark, seed, root, candidates, required, undirected):
    edges, prizes = network(seed), {"1": 6.0, "4": 9.0}
    starts = [root] if root else list(prizes) if candidates is None else [str(v) for v in range(6)]
    values = (sum(e[3] for e in some) - sum(p for v, p in prizes.items() if v in held) for some in every_subset(edges) for r in starts for held in [reach(some, r, undirected)] if set(required) <= held)
    want = min(values, default=INF)
    given = None if candidates is None else spark.createDataFrame([(s,) for s in starts], "v string")
    best, kept = trees.prize_collecting(table(spark, edges), spark.createDataFrame(list(prizes.items()), "v string, prize double"), root, given, required, undirected)
    rows = best.collect()
    assert [r.objective for r in rows] == ([want] if want < INF else [])
    if rows:
        chosen = [e for e in edges if e[0] in {r.eix for r in kept.collect()}]
        assert sum(e[3] for e in chosen) == rows[0].cost and set(required) <= reach(chosen, rows[0].root, undirected)


def test_refusals_and_bare_inputs(spark):
    empty = table(spark, [])
    with pytest.raises(ValueError, match="terminals"):
        trees.subset_trees(empty, [str(v) for v in range(13)])
    with pytest.raises(ValueError, match="negative"):
        trees.subset_trees(table(spark, [(0, "a", "b", -1.0)]), ["a"])
    cost, kept = trees.steiner(empty, ["a"])
    assert cost.collect()[0].cost == 0 and kept.count() == 0
    assert trees.steiner(empty, ["a", "b"])[0].count() == 0
    assert trees.steiner(table(spark, [(0, "a", "b", None), (1, "a", "b", 2.0)]), ["a", "b"])[0].first().cost == 0

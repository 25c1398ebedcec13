"""Seeded random graphs. Growth is one step after another, so they are made in the driver and are small by nature."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

_ARCS = "eix long, s string, t string, interaction int"


def _signed(spark: SparkSession, pairs: list[tuple[int, int]], rng: random.Random, signs: dict[int, float] | None) -> DataFrame:
    kinds, weights = zip(*(signs or {1: 1.0}).items(), strict=True)
    picked = rng.choices(kinds, weights, k=len(pairs))
    return spark.createDataFrame([(i, str(s), str(t), k) for i, ((s, t), k) in enumerate(zip(pairs, picked, strict=True))], _ARCS)


def preferential(spark: SparkSession, n: int, m: int, signs: dict[int, float] | None = None, seed: int = 0) -> DataFrame:
    """Preferential attachment: a clique of m vertices, then vertices with m distinct targets drawn by degree."""
    if not 1 <= m < n:
        raise ValueError("1 <= m < n is needed")
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(m) for b in range(a)]
    ends = [v for p in pairs for v in p] or [0]
    for v in range(m, n):
        targets: set[int] = set()
        while len(targets) < m:
            targets.add(rng.choice(ends))
        for t in sorted(targets):
            pairs.append((v, t))
            ends += [v, t]
    return _signed(spark, pairs, rng, signs)


def duplication(spark: SparkSession, n: int, keep: float, signs: dict[int, float] | None = None, seed: int = 0) -> DataFrame:
    """Duplication and divergence: a vertex copies each edge of a random parent with probability `keep` and always links to it."""
    if n < 2:
        raise ValueError("two vertices are needed")
    rng = random.Random(seed)
    near: dict[int, set[int]] = {0: {1}, 1: {0}}
    pairs = [(0, 1)]
    for v in range(2, n):
        parent = rng.randrange(v)
        mine = {parent} | {x for x in sorted(near[parent]) if rng.random() < keep}
        near[v] = mine
        for x in sorted(mine):
            near[x].add(v)
            pairs.append((v, x))
    return _signed(spark, pairs, rng, signs)

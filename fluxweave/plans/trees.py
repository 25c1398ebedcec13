"""Exact trees by dynamic programs over sets of terminals: one table row a set and vertex, grown by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: Tables hold a row for each set of terminals and vertex, so their number is bounded.
MAX_TERMINALS = 12


def both_ways(arcs: DataFrame) -> DataFrame:
    """(eix, s, t, weight) with every arc in its other direction too, under the same index."""
    return arcs.select("eix", "s", "t", "weight").unionByName(arcs.select("eix", F.col("t").alias("s"), F.col("s").alias("t"), "weight"))


def _relaxed(best: DataFrame, step: DataFrame) -> DataFrame:
    """Lets the trees of each set grow backwards along arcs until no cost falls; a round carries what fell in the last one."""
    tree = ["cost", "new", "via", "next", "part"]
    best = cut(best.withColumn("new", F.lit(1)), "trees")
    while True:
        front = best.filter("new = 1").select("mask", F.col("v").alias("next"), "cost").join(step, F.col("next") == F.col("t"))
        offer = front.select("mask", F.col("s").alias("v"), (F.col("cost") + F.col("w")).alias("cost"), F.lit(1).alias("new"), F.col("eix").alias("via"), "next", F.lit(None).cast("int").alias("part"))
        # of equal costs the known tree stays, so that a round without a fall is the last
        every = best.withColumn("new", F.lit(0)).unionByName(offer).groupBy("mask", "v").agg(F.min(F.struct(*tree)).alias("x"))
        best = cut(every.select("mask", "v", "x.*"), "trees")
        if best.filter("new = 1").isEmpty():
            return best.drop("new")


def subset_trees(arcs: DataFrame, terminals: list[str]) -> DataFrame:
    """(mask, v, cost, via, next, part): for each non-empty set of terminals, as bits in the list's order, the least cost of a tree
    that leads from v to all of them along arcs(eix, s, t, weight); absent where there is none.

    The tree starts with the edge `via` to `next`, or splits at v into the trees of `part` and of the rest, or is v alone. A
    missing weight is 0, a negative one an error; of equal trees the smaller edge index or part is taken.
    """
    if not 0 < len(terminals) <= MAX_TERMINALS or len(set(terminals)) < len(terminals):
        raise ValueError(f"1 to {MAX_TERMINALS} different terminals are needed")
    step = cut(arcs.select("eix", "s", "t", F.coalesce("weight", F.lit(0.0)).alias("w")), "tree-arcs")
    if not step.filter("w < 0").isEmpty():
        raise ValueError("a negative weight")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("via", "long"), ("next", "string"), ("part", "int"))]
    spark = arcs.sparkSession
    single = spark.createDataFrame([(1 << i, v, 0.0) for i, v in enumerate(terminals)], "mask int, v string, cost double")
    done = _relaxed(single.select("mask", "v", "cost", *none), step)
    sets = spark.range(1, 1 << len(terminals)).select(F.col("id").cast("int").alias("mask"))
    for size in range(2, len(terminals) + 1):
        split = F.filter(F.sequence(F.lit(1), F.col("mask")), lambda x: (x.bitwiseAND(F.col("mask")) == x) & (x < F.col("mask") - x))
        splits = sets.filter(F.bit_count("mask") == size).select("mask", F.explode(split).alias("part"))
        one = done.select(F.col("mask").alias("part"), "v", F.col("cost").alias("a"))
        other = done.select(F.col("mask").alias("rest"), "v", F.col("cost").alias("b"))
        joined = splits.withColumn("rest", F.col("mask") - F.col("part")).join(one, "part").join(other, ["rest", "v"])
        met = joined.groupBy("mask", "v").agg(F.min(F.struct((F.col("a") + F.col("b")).alias("cost"), "part")).alias("x"))
        done = done.unionByName(_relaxed(met.select("mask", "v", "x.cost", *none[:2], "x.part"), step))
    return done


def tree_edges(trees: DataFrame, at: DataFrame) -> DataFrame:
    """(eix) of the trees at(mask, v), followed from their starts to their terminals, all at once."""
    found = at.sparkSession.createDataFrame([], "eix long")
    at = at.select("mask", "v")
    while True:
        here = cut(at.join(trees, ["mask", "v"]), "tree-walk")
        if here.isEmpty():
            return found.distinct()
        found = found.unionByName(here.filter("via IS NOT NULL").select(F.col("via").alias("eix")))
        on = here.filter("via IS NOT NULL").select("mask", F.col("next").alias("v"))
        halves = here.filter("part IS NOT NULL").select(F.explode(F.array("part", F.col("mask") - F.col("part"))).alias("mask"), "v")
        at = on.unionByName(halves)


def steiner(arcs: DataFrame, terminals: list[str], root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cost) and (eix) of the least tree that holds all terminals: from the root along the arcs, or, without a root, along arcs
    taken both ways. No row and no edge if no tree holds them."""
    if root is None:
        arcs, root = both_ways(arcs), terminals[0]
    goals = [v for v in dict.fromkeys(terminals) if v != root] or [root]
    trees = subset_trees(arcs, goals)
    whole = (1 << len(goals)) - 1
    full = trees.filter((F.col("mask") == whole) & (F.col("v") == root))
    return full.select("cost"), tree_edges(trees, full)


def prize_collecting(arcs: DataFrame, prizes: DataFrame, root: str | None = None, candidates: DataFrame | None = None, required: tuple[str, ...] = (), undirected: bool = True) -> tuple[DataFrame, DataFrame]:
    """(root, cost, prize, objective) and (eix) of the tree with the least cost less the prizes(v, prize) it holds.

    The tree starts at the root, or at the best of candidates(v), by default the prized vertices. It holds all of `required`, which
    may be worth nothing. A root alone is a tree, if nothing else is required. Prizes and required vertices are MAX_TERMINALS
    at most. Of equal trees the smaller root, then the smaller set is taken.
    """
    worth = {r.v: float(r.prize) for r in prizes.select("v", "prize").limit(MAX_TERMINALS + 1).collect()}  # refused past the bound
    worth |= {v: 0.0 for v in required if v not in worth}
    goals = sorted(worth)
    trees = subset_trees(both_ways(arcs) if undirected else arcs, goals)
    starts = arcs.sparkSession.createDataFrame([(root,)], "v string") if root is not None else prizes.select("v") if candidates is None else candidates.select("v")
    alone = starts.distinct().select(F.lit(0).alias("mask"), "v", F.lit(0.0).alias("cost"))
    every = trees.select("mask", "v", "cost").join(starts.distinct(), "v", "left_semi").select("mask", "v", "cost").unionByName(alone)
    must = sum(1 << goals.index(v) for v in set(required))
    gain = sum(((F.shiftright("mask", i).bitwiseAND(1)) * F.lit(worth[v]) for i, v in enumerate(goals)), F.lit(0.0))
    held = every.filter(F.col("mask").bitwiseAND(must) == must).withColumn("prize", gain)
    best = held.agg(F.min(F.struct((F.col("cost") - F.col("prize")).alias("objective"), F.col("v").alias("root"), "mask", "cost", "prize")).alias("x")).filter("x IS NOT NULL").select("x.*")
    best = cut(best, "tree-best")
    return best.select("root", "cost", "prize", "objective"), tree_edges(trees, best.select("mask", F.col("root").alias("v")))

"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length; one small histogram a source goes through a bounded-knapsack dynamic program that
fills what is left of the source's budget, and documents of each length are then picked in the order of a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_of, rows_of, word_count

SEED = 20_240_601
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_REPEAT = 2
#: Documents of one source and length that are ranked together; larger groups are split by hash.
RANKED_TOGETHER = 512
#: The dynamic program covers this many times the longest document, and for it so many documents of each short length at most are
#: taken back. Both bound its memory; it is exact for what is left to it, so all of a source's subsets are not looked at.
WINDOW_LENGTHS, HANDED_BACK = 2, 16

_PLAN = "source string, size long, n long, base long, extra long, source_size long, target double"


def fill(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many documents of each length to take so that the words come as near goal from below as can be.

    A proportional share of every length is taken first, then whole documents from the longest down until what is left
    fits the window; the bounded-knapsack program fills the rest as well as the documents left to it can.
    """
    total = int((lengths * counts).sum())
    if goal >= total:
        return counts.copy()
    take = np.zeros_like(counts)
    if goal <= 0:
        return take
    take = np.minimum(counts, np.floor(counts * (goal / total)).astype(np.int64))
    left = goal - int((take * lengths).sum())
    window = int(lengths.max()) * WINDOW_LENGTHS
    for i in np.argsort(-lengths, kind="stable"):
        if left <= window:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - take[i]), (left - window) // int(lengths[i]) + 1, left // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    given = 0  # short documents are handed back, so that the program has both taken and untaken ones to choose from
    for i in np.argsort(lengths, kind="stable"):
        if lengths[i] > 0 and (back := min(int(take[i]), HANDED_BACK, (window - given) // int(lengths[i]))) > 0:
            take[i] -= back
            given += back * int(lengths[i])
    return take + knapsack(lengths, counts - take, left + given)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: the counts whose words are the largest sum of at most budget."""
    by = np.full(budget + 1, -1, dtype=np.int32)
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    for i in np.argsort(lengths, kind="stable"):
        step = int(lengths[i])
        if step == 0 or step > budget or counts[i] == 0:
            continue
        fresh = reached
        for _ in range(int(min(counts[i], budget // step))):
            moved = np.zeros_like(reached)
            moved[step:] = fresh[:-step]
            fresh = moved & ~reached
            if not fresh.any():
                break
            by[fresh] = i
            reached = reached | fresh
        if reached[budget]:
            break
    take, at = np.zeros_like(counts), int(np.flatnonzero(reached)[-1])
    while at > 0:
        take[by[at]] += 1
        at -= int(lengths[by[at]])
    return take


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, goal = int((lengths * counts).sum()), int(np.floor(pdf["target"].iloc[0] + 0.5))
    base = goal // total if total else 1
    extra = fill(lengths, counts, goal - base * total) if total else np.zeros_like(counts)
    return pdf.assign(base=np.int64(base), extra=extra)[["source", "size", "n", "base", "extra", "source_size", "target"]]


def source_targets(hist: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, size, n).

    Weights go to the sources by code point, null last, over and over. A target that would pass max_repeat times its
    source's size stops there, and the excess is shared again by weight. One row a source is all that meets in one task.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_repeat))
    every = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    share = (F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rated = ranked.withColumn("rate", share)
    level = F.max(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.col("rate"))).over(every)
    return rated.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs(doc_id, text, source, ...).

    size is the number of words (null or empty text: 0); copies says how often the mix holds the document (at most
    max_repeat) and taken = copies * size. A source's taken words are those of the best subset that the bounded dynamic
    program finds, at most half a word above its target; usually they are its nearest whole number. Null is a source of its own, the last one. Rows with equal
    doc_id are ranked apart. Other columns are not read. The same rows and seed give the same mix; an empty table gives
    an empty one.
    """
    sized = materialise(docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    hist = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    goals = source_targets(hist, weights, budget, max_repeat)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    with_goal = hist.alias("h").join(goals.alias("g"), F.col("h.source").eqNullSafe(F.col("g.source"))).select("h.source", "size", "n", "source_size", "target")
    plan = materialise(with_goal.groupBy("source").applyInPandas(_plan_source, _PLAN), "mix-plan")
    split = F.ceil(F.col("n") / RANKED_TOGETHER).cast("long")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    each = sized.join(plan, same(sized, plan) & (sized["size"] == plan["size"])).select(sized["doc_id"], sized["source"], sized["size"], "n", "base", "extra", "source_size", "target", F.pmod(key, split).alias("part"), F.xxhash64(F.lit(seed + 1), F.col("doc_id")).alias("turn"))
    parts = each.groupBy("source", "size", "part").agg(F.count("*").alias("in_part"), F.first("extra").alias("want"))
    run = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = parts.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("in_part"), F.col("want") - F.coalesce(F.sum("in_part").over(run), F.lit(0)))))
    e, q = each.alias("e"), quota.select("source", "size", "part", "quota").alias("q")
    both = e.join(q, F.col("e.source").eqNullSafe(F.col("q.source")) & (F.col("e.size") == F.col("q.size")) & (F.col("e.part") == F.col("q.part"))).select("e.*", "quota")
    turn = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("turn", "doc_id"))
    copies = F.col("base") + (turn <= F.col("quota")).cast("long")
    return both.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of docs as often as mix() takes it, with all its columns, whatever their names.

    Rows without a word (null and empty texts too) count as size 0 and are taken once. Of rows equal in doc_id, source and size, those
    whose text hashes low stand for the ones taken least. An empty table gives an empty one.
    """
    judged = materialise(mix(docs, **how).select("doc_id", "source", "size", "copies"), "mix-copies")
    keys = ["doc_id", "source", "size"]
    keyed = docs.select(row_of(docs), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))
    nth_left, nth_right = F.lit(1), F.lit(1)
    if not judged.groupBy(keys).count().filter("count > 1").isEmpty():
        nth_left = F.row_number().over(Window.partitionBy(*keys).orderBy("th"))
        nth_right = F.row_number().over(Window.partitionBy(*keys).orderBy("copies"))
    left, right = keyed.withColumn("nth", nth_left).alias("l"), judged.withColumn("nth", nth_right).filter("copies > 0").hint("merge").alias("r")  # the same plan at every size
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.size") == F.col("r.size")) & (F.col("l.nth") == F.col("r.nth"))
    taken = left.join(right, on).select("l.row", "r.copies")
    return rows_of(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))

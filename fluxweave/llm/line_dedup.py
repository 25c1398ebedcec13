"""Line dedup over overlapping windows of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Lines in a window.
WIDTH = 3


def _hash(salt: int):
    return lambda line: F.xxhash64(F.lit(salt), line)


def _marked(lines):
    """(a, b, w) of each line: two independent 64-bit hashes, and 1 if it has a word."""
    return F.transform(lines, lambda line: F.struct(_hash(11)(line).alias("a"), _hash(23)(line).alias("b"), line.rlike(r"[^\x20\x09-\x0D]").cast("int").alias("w")))


def _windows(marked, width: int):
    """(a, b, pos) of each window with a word in it: the two hashes and the first line's position."""
    n = F.greatest(F.size(marked) - (width - 1), F.lit(0))
    names = [f"l{k}" for k in range(width)]
    beside = F.arrays_zip(*(F.slice(marked, k + 1, n).alias(name) for k, name in enumerate(names)))
    window = lambda x, i: F.struct(F.xxhash64(*(x[c]["a"] for c in names)).alias("a"), F.xxhash64(*(x[c]["b"] for c in names)).alias("b"), i.alias("pos"), F.greatest(*(x[c]["w"] for c in names)).alias("w"))
    return F.filter(F.transform(beside, window), lambda x: x["w"] == 1)


def drop_repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_lines, n_removed, text for each row of docs(doc_id, text, ...).

    A window is `width` consecutive \\n-split lines of which one has a word at least. Of equal windows anywhere, the first by
    (doc_id, hash of the text, position) stays; the lines of all later ones go, overlapping ones being merged. The rest is
    joined by \\n again. Documents of fewer lines have no window and stay whole; null text stays null with 0 lines. Rows equal
    in doc_id and text are one document and get the same result. A null doc_id comes first. Other columns are not read.
    """
    keyed = docs.select(F.col("doc_id"), F.xxhash64(F.lit(5), F.col("text")).alias("th"), F.split(F.col("text"), "\n", -1).alias("lines"))
    marked = keyed.filter(F.size("lines") >= width).select("doc_id", "th", _marked(F.col("lines")).alias("marked"))
    each = materialise(marked.select("doc_id", "th", _windows(F.col("marked"), width).alias("ws")).filter(F.size("ws") > 0), "line-windows")
    spread = each.select("doc_id", "th", F.explode("ws").alias("x")).select("doc_id", "th", "x.a", "x.b", "x.pos")
    repeated = spread.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("first")).filter("n > 1")
    repeated = materialise(repeated, "line-repeats")  # plain on both sides, the join can split a very common window
    later = spread.join(repeated.select("a", "b", "first"), ["a", "b"]).filter(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("starts"))
    k, g = keyed.alias("k"), gone.alias("g")
    both = k.join(g, F.col("k.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("k.th") == F.col("g.th")), "left").select("k.doc_id", "k.lines", "g.starts")
    lines, starts, none = F.col("lines"), F.col("starts"), F.array().cast("array<string>")
    # what stands between the end of one covered window and the start of the next
    gaps = F.transform(starts, lambda s, i: F.struct((F.coalesce(F.get(starts, i - 1), F.lit(-width)) + width).alias("at"), s.alias("to")))
    kept = F.flatten(F.transform(gaps, lambda x: F.when(x["to"] > x["at"], F.slice(lines, x["at"] + 1, x["to"] - x["at"])).otherwise(none)))
    end = F.element_at(starts, -1) + width
    tail = F.when(F.size(lines) > end, F.slice(lines, end + 1, F.size(lines) - end)).otherwise(none)
    left = both.select("doc_id", F.coalesce(F.size(lines), F.lit(0)).alias("n"), F.when(starts.isNull(), lines).otherwise(F.concat(kept, tail)).alias("left"))
    size = lambda n: F.greatest(n, F.lit(0)).cast("long")
    return left.select("doc_id", size(F.col("n")).alias("n_lines"), (size(F.col("n")) - size(F.size("left"))).alias("n_removed"), F.array_join("left", "\n").alias("text"))

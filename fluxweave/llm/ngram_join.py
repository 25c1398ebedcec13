"""Jaccard self-join of documents on word n-grams by chosen paths.

Each distinct shingle set is embedded as T min-hash tokens. A run samples a token at the root and sends a set down the
(token, value) it has; a bucket that is still too large is split again on tokens sampled for its path, unless its
sets share them anyway. Small buckets are brute-forced, large ones of like sets in blocks. Runs are repeated until a pair at
the threshold meets with at least the target probability. Every pair that meets is verified on its exact shingle sets, once,
in the first bucket the two share.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_of, rows_of, shuffle_partitions, words_of
from .components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99999
#: Tokens a set is embedded as; buckets of more sets than SMALL are split; tokens sampled for a split; deepest split.
TOKENS, SMALL, FAN, DEPTH = 64, 256, 2, 3
#: A split that leaves more than this share of a bucket together is useless: the bucket holds like sets.
LIKE = 0.5
#: Sets, and shingles, in a block of a brute-forced bucket. Smaller blocks make more even tasks and more copies of each set.
BLOCK_SETS, BLOCK_SHINGLES = 512, 500_000
#: Sketches of a similar pair agree in a share below SIMILARITY by this many standard deviations at most.
SLACK = 5.0
#: Words whose hash a task remembers.
REMEMBERED = 400_000

_rng = np.random.default_rng(97)
_A = (_rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_C = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[str], known: dict[str, int], n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams; a text of fewer words is one shingle, one of none has none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > REMEMBERED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(n, len(words))
    out = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for k in range(span):
        out = (out ^ (out >> np.uint64(29))) * _C + h[k : len(words) - span + 1 + k]
    return np.unique(out ^ (out >> np.uint64(32)))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """The min-hash tokens of sets that aren't empty, a row each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), TOKENS), dtype=np.int32)
    for k in range(TOKENS):
        out[:, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), starts).astype(np.uint32).view(np.int32)
    return out


_SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("sig", pa.list_(pa.int32()))])


def _embed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}

    def emit(ids: list, sets: list) -> pa.RecordBatch:
        sig = iter(sketch(full)) if (full := [s for s in sets if len(s)]) else iter(())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array([next(sig) if len(s) else None for s in sets], pa.list_(pa.int32()))], schema=_SETS)

    for batch in batches:
        ids, sets, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            sets.append(shingles(words_of(text.as_py()), known))
            held += len(sets[-1])
            if held > 500_000:
                yield emit(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield emit(ids, sets)


def embed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, sig): the 128-bit hash, size and tokens of each document's shingle set; key and sig null if empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_embed, "doc_id long, key binary, n int, sig array<int>")


def root_order() -> list[int]:
    """The order in which runs sample tokens at the root: each run takes the next one, so none is taken twice."""
    return np.random.default_rng(1_000).permutation(TOKENS).tolist()


def meets(slots: int, depth: int, similarity: float = SIMILARITY, least: float = 0.0) -> float:
    """Probability that a pair at the threshold agrees in `least` tokens and shares a final bucket after `slots` runs.

    Tokens agree independently with probability `similarity`. Given how many do, the root's tokens are a sample without
    replacement, and each split at `depth` levels keeps a pair together if one of its FAN tokens, hashed for the path, agrees.
    """
    total = 0.0
    for agree in range(math.ceil(least), TOKENS + 1):
        chance = math.comb(TOKENS, agree) * similarity**agree * (1 - similarity) ** (TOKENS - agree)
        stays = (1 - (1 - agree / TOKENS) ** FAN) ** depth
        missed = sum(math.comb(agree, k) * math.comb(TOKENS - agree, slots - k) * (1 - stays) ** k for k in range(slots + 1) if k <= agree and slots - k <= TOKENS - agree) / math.comb(TOKENS, slots)
        total += chance * (1 - missed)
    return total


def least_agreeing(similarity: float = SIMILARITY) -> float:
    """Tokens in which the sketches of a pair must agree before it is verified."""
    return TOKENS * (similarity - SLACK * math.sqrt(similarity * (1 - similarity) / TOKENS))


def _split(live: DataFrame, sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of buckets (path, key, size): those of like sets as they are, and the others' parts (path, key, size)."""
    token = lambda j: F.pmod(F.xxhash64(F.col("path"), F.lit(j)), F.lit(TOKENS)).cast("int")
    kid = lambda j: F.xxhash64(F.col("path"), F.lit(j), F.get(F.col("sig"), token(j)))
    held = live.join(sigs, "key")
    kids = materialise(held.select("path", "key", "size", F.explode(F.array(*map(kid, range(FAN)))).alias("kid")).distinct(), "join-split")
    sizes = materialise(kids.groupBy("path", "size", "kid").agg(F.count("*").alias("n")), "join-sizes")
    like = materialise(sizes.groupBy("path", "size").agg(F.max("n").alias("most")).filter(F.col("most") > LIKE * F.col("size")).select("path"), "join-like")
    parts = kids.join(sizes.select("kid", "n").filter("n > 1"), "kid").join(like, "path", "left_anti").select(F.col("kid").alias("path"), "key", F.col("n").alias("size"))
    return live.join(like, "path", "left_semi"), parts


def buckets(sets: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(path, key) of the final buckets with two sets or more."""
    found, slots, who, order, least = [], 0, sets, root_order(), least_agreeing(similarity)
    while True:
        fresh, deepest = 1, DEPTH if slots else 0  # as many runs at once as the recall takes, then those that splits take
        while meets(slots + fresh, deepest, similarity, least) < recall and slots + fresh < TOKENS:
            fresh += 1
        paths = F.array(*(F.xxhash64(F.lit(k), F.get(F.col("sig"), F.lit(k))) for k in order[slots : slots + fresh]))
        slots += fresh
        nodes = who.select("key", F.explode(paths).alias("path"))
        sizes = materialise(nodes.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), "join-sizes")
        open_ = materialise(nodes.join(sizes, "path"), "join-buckets")
        found.append(open_.filter(F.col("size") <= SMALL))
        live, depth, torn = materialise(open_.filter(F.col("size") > SMALL), "join-live"), 0, None
        if not live.isEmpty():  # the tokens of the few sets that are looked at again, so that a split doesn't move all of them
            sigs = materialise(sets.select("key", "sig").join(live.select("key").distinct(), "key", "left_semi"), "join-sigs")
        while depth < DEPTH and not live.isEmpty():
            like, parts = _split(live, sigs)
            if depth == 0:  # all sets of a bucket that was split, those left alone in its parts too
                torn = materialise(live.join(like.select("path").distinct(), "path", "left_anti").select("key").distinct(), "join-torn")
            depth += 1
            parts = materialise(parts, "join-parts")
            found += [like, parts.filter(F.col("size") <= SMALL)]
            live = materialise(parts.filter(F.col("size") > SMALL), "join-live")
        found.append(live)
        if torn is None or torn.isEmpty() or deepest or slots >= TOKENS:
            break
        who = materialise(sigs.join(torn, "key", "left_semi"), "join-again")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("path", "key").distinct()


def _groups(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in their first columns, of batches sorted by these."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != at:
                if rows:
                    yield at, rows
                at, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield at, rows


def _pairs(path: int, left: int, right: int, side: np.ndarray, sig: np.ndarray, paths: list[list[int]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block pair whose sketches agree enough and that share no bucket before this one."""
    one, two = [], []
    wide = max(map(len, paths))
    early = np.full((len(paths), wide), 0, dtype=np.int64)
    has = np.zeros((len(paths), wide), dtype=bool)
    for i, p in enumerate(paths):
        p = [x for x in p if x < path]
        early[i, : len(p)], has[i, : len(p)] = p, True
    every = np.arange(len(paths))
    for i in range(len(paths)):
        others = every[i + 1 :] if left == right else (every[side == right] if side[i] == left else every[:0])
        others = others[(sig[others] == sig[i]).sum(axis=1) >= least]
        for p in early[i][has[i]]:
            others = others[~((early[others] == p) & has[others]).any(axis=1)]
        if len(others):
            one.append(np.full(len(others), i))
            two.append(others)
    return (np.concatenate(one), np.concatenate(two)) if one else (every[:0], every[:0])


def _sketched(least: float):
    schema = pa.schema([("path", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (path, left, right), rows in _groups(batches, 3):
            keys, side, sig, paths = zip(*rows, strict=True)
            i, j = _pairs(path, left, right, np.array(side), np.array(sig, dtype=np.int32), list(paths), least)
            out += [(path, keys[k]) for k in np.unique(np.concatenate([i, j]))]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs."""
    if not len(i):
        return np.zeros(0, dtype=np.int64)
    used = np.unique(np.concatenate([i, j]))
    values, column, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    common = times > 1
    width = int(common.sum())
    if len(i) < 4 * len(used) or width > 40_000:
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)), dtype=np.int64, count=len(i))
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    number = np.cumsum(common) - 1
    mine = common[column]
    row, column = row[mine], number[column[mine]]
    total = np.zeros((len(used), len(used)), dtype=np.float32)
    for at in range(0, width, 2048):
        part = (column >= at) & (column < at + 2048)
        dense = np.zeros((len(used), min(2048, width - at)), dtype=np.float32)
        dense[row[part], column[part] - at] = 1
        total += dense @ dense.T
    place = {int(k): n for n, k in enumerate(used)}
    look = np.zeros(int(used.max()) + 1, dtype=np.int64)
    for k, n in place.items():
        look[k] = n
    return total[look[i], look[j]].astype(np.int64)


_LINKS = pa.schema([("key", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])


def _verified(least: float, similarity: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for (path, left, right), rows in _groups(batches, 3):
            keys, side, sig, paths, copies, texts = zip(*rows, strict=True)
            i, j = _pairs(path, left, right, np.array(side), np.array(sig, dtype=np.int32), list(paths), least)
            if not len(i):
                continue
            sets = [shingles(words_of(t), known) for t in texts]
            n = np.array(list(map(len, sets)))
            both = shared(sets, i, j)
            hit = both >= similarity * (n[i] + n[j] - both) - 1e-9
            i, j = i[hit], j[hit]
            if not len(i):
                continue
            copies = np.array(copies, dtype=np.int64)
            links = np.zeros(len(keys), dtype=np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = np.arange(len(keys))
            while True:  # smallest reachable member, by repeated minima over the links
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            seen = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in seen], pa.binary()), pa.array([keys[root[k]] for k in seen], pa.binary()), pa.array(links[seen], pa.int64())], schema=_LINKS)

    return run


def _blocked(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members(path, key, ...) dealt to the block pairs (path, i, j) of their bucket, with the side they are on.

    sizes(path, blocks) names the buckets of two blocks or more, a few of all; in the others nothing needs to be looked up.
    """
    held = members.join(sizes, "path", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda x: F.struct(F.least(x, F.col("side")).alias("i"), F.greatest(x, F.col("side")).alias("j")))
    return held.withColumn("to", F.explode(to)).withColumns({"i": F.col("to.i"), "j": F.col("to.j")}).drop("to", "blocks")


def similar(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, rep_id, n_links, set_key for each row of docs(doc_id, text, ...).

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is `similarity` or more; words are
    runs of characters that aren't ASCII white space, as they stand. A text of one to four words is a single shingle. Texts
    without a word (null and empty ones too) are linked to nothing. rep_id is the smallest doc_id with the very same set,
    class_id the smallest doc_id of all that links lead to (both the own doc_id where there is no other), n_links the number of
    linked rows. A null doc_id is never smallest, unless all are null. Rows that repeat count each. Other columns are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    embedded = materialise(embed(docs), "join-sets")
    full = embedded.filter("key IS NOT NULL")
    sets = materialise(full.groupBy("key").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "join-classes")
    leaves = materialise(buckets(sets, similarity, recall), "join-leaves")
    least = least_agreeing(similarity)
    where = leaves.groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    rich = materialise(where.join(sets, "key").select("key", "paths", "sig", "n", "copies"), "join-members")
    spread = rich.select("*", F.explode("paths").alias("path"))
    sizes = materialise(spread.groupBy("path").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks")).filter("blocks > 1"), "join-blocks")
    dealt = _blocked(spread.select("path", "key", "sig", "paths"), sizes).select("path", "i", "j", "key", "side", "sig", "paths")
    active = materialise(dealt.repartition(parts, "path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(_sketched(least), "path long, key binary").distinct(), "join-active")
    members = active.join(rich, "key")
    sizes = materialise(members.groupBy("path").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).filter("blocks > 1"), "join-blocks")
    with_text = _texts(docs, sets, active)
    dealt = _blocked(members.select("path", "key", "sig", "paths", "copies"), sizes).join(with_text, "key").select("path", "i", "j", "key", "side", "sig", "paths", "copies", "text")
    links = materialise(dealt.repartition(parts, "path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(_verified(least, similarity), "key binary, root binary, links long"), "join-links")
    roots = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    grouped = roots.join(sets.select(F.col("key").alias("node"), "rep_id"), "node")
    first = materialise(grouped.groupBy("root").agg(F.min("rep_id").alias("class_id")), "join-first")
    linked = grouped.join(first, "root").select(F.col("node").alias("key"), "class_id").join(counts, "key", "left")
    table = sets.select("key", "rep_id", "copies").join(linked, "key", "left").select("key", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    table = materialise(table, "join-table")  # as plain files on both sides, a hot set's rows can be split
    told = full.select("doc_id", "key").join(table, "key").select("doc_id", "class_id", "rep_id", "n_links", F.col("key").alias("set_key"))
    alone = embedded.filter("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("set_key"))
    return told.unionByName(alone)


def _texts(docs: DataFrame, sets: DataFrame, active: DataFrame) -> DataFrame:
    """(key, text): a text of each set in `active`, found by its smallest doc_id and the hash of the set made anew."""
    ids = active.select("key").distinct().join(sets.select("key", F.col("rep_id").alias("__id")), "key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    near = rows.join(ids.select("__id").distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    keyed = near.mapInArrow(_with_key, "key binary, text string")
    return keyed.join(ids.select("key"), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))


def _with_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingles(words_of(t.as_py()), known) for t in part.column(1)]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column(1)], names=["key", "text"])


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """One row of docs for each class of similar(), whole and with all its columns: the one with the smallest doc_id.

    Texts without a word (null and empty ones too) are classes of their own and stay. Rows that share a doc_id are told apart by
    their text only where two or more of them are to stay; equal ones then stay as one. A null doc_id stays only where all of its class are null. An empty table gives an empty one.
    """
    judged = similar(docs, **how)
    stays = judged.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "set_key", "rep_id")
    stays = materialise(stays, "join-stays")
    ids = stays.groupBy("doc_id").agg(F.count("*").alias("rows"))
    keyed = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    pick = lambda n: ids.filter(n).select("doc_id").hint("merge")  # noqa: E731  the same plan at every size
    one = keyed.join(pick("rows = 1"), F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    if pick("rows > 1").isEmpty():
        return rows_of(one)
    again = keyed.join(pick("rows > 1"), F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").dropDuplicates(["id", "th"])
    return rows_of(one).unionByName(rows_of(again))

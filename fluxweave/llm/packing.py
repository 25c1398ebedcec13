"""Best-fit packing of tokenised documents into sequences by a configuration linear program.

Only the length histogram, 2,048 rows at most whatever the input, reaches the driver. There a covering program over
configurations (multisets of lengths that fit a sequence) is solved by multiplicative weights, prices finding new
configurations through a knapsack dynamic program. The fractional solution is rounded, the program of what is left solved
again, and so on; the last few items are packed best-fit by decreasing length. Pieces then take their places by their rank
among those of their length.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialise

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Multiplicative weights: rounds of pricing, configurations taken a round, step, and the coverage at which to stop.
ROUNDS, TAKEN, RATE, COVER = 30, 64, 1.0, 2.0
#: Steps that lengths are rounded to where dual prices are learned; pricings that this takes at most, and after the last one that
#: raised the bound by 0.1 %; their step.
GRAINS, PRICINGS, PATIENCE, STEP = 64, 800, 120, 0.2
#: What a full sequence is worth besides its items' dual prices.
FULLNESS = 0.5
#: Share of the words that is rounded before the program is solved again; share of the items that is left to best fit.
DIVE, LEFT = 0.25, 0.02
#: Buckets of doc_ids within which pieces of one length are ranked, at least; and rows planned for one.
BUCKETS, BUCKET_ROWS = 256, 4_000


@lru_cache(maxsize=2)
def _encoders(path: str) -> tuple[Tokenizer, tiktoken.Encoding]:
    """The tokenizer of a byte-level BPE file, and a faster reader of the same vocabulary, pattern and special tokens."""
    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): number for token, number in spec["model"]["vocab"].items() if token not in special}
    return slow, tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: Control characters that the two readers' patterns may class differently.
_UNSURE = tuple(map(chr, [*range(0x1C, 0x20), 0x85]))


def token_ids(text: str, path: str) -> list[int]:
    """The tokenizer's ids. Latin-1 text goes through the fast reader, any other through the tokenizer itself: their tables of
    letters and digits may be of different Unicode versions."""
    slow, fast = _encoders(path)
    try:
        text.encode("latin-1")
        if not any(c in text for c in _UNSURE):
            return fast.encode(text, allowed_special="all")
    except Exception:  # beyond Latin-1, or a run that the fast reader's pattern can't take
        pass
    return slow.encode(text, add_special_tokens=False).ids


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones but for the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = [*([0] if first else []), *range(first, n, capacity)]
    return [(s, (starts[k + 1] if k + 1 < len(starts) else n) - s) for k, s in enumerate(starts)]


def _tokenise(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.array([*token_ids(text.as_py() or "", path), END], dtype="<u4")
                    rows += [(doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())) for k, (start, n) in enumerate(cut(len(ids)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def price(value: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Bounded knapsack by dynamic programming: which multiset of lengths, no more of each than there are, is worth most.

    Each length comes in bundles of 1, 2, 4, ... items. Returns the best value for each room, the bundles (length, items), and
    for each bundle the rooms in which it is taken.
    """
    bundles: list[tuple[int, int]] = []
    for size in map(int, np.flatnonzero(counts)[::-1]):
        left, k = min(int(counts[size]), capacity // size), 1
        while left > 0:
            bundles.append((size, min(k, left)))
            left, k = left - min(k, left), 2 * k
    best, taken = np.zeros(capacity + 1), np.zeros((len(bundles), capacity + 1), dtype=bool)
    for n, (size, k) in enumerate(bundles):
        width = size * k
        found = best[: capacity + 1 - width] + value[size] * k
        better = found > best[width:]
        taken[n, width:] = better
        best[width:] = np.where(better, found, best[width:])
    return best, bundles, taken


def contents(room: int, bundles: list[tuple[int, int]], taken: np.ndarray) -> dict[int, int]:
    """The multiset of lengths (length to items) that price() takes for a room."""
    found: dict[int, int] = {}
    last = len(bundles)
    while True:
        at = np.flatnonzero(taken[:last, room])
        if not len(at):
            return found
        last = int(at[-1])
        size, k = bundles[last]
        found[size] = found.get(size, 0) + k
        room -= size * k


def prices(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Dual prices of the lengths: what share of a sequence an item is worth; no configuration is worth more than about one.

    Multiplicative weights on a coarse histogram (lengths rounded up to GRAINS steps of the capacity): the best configuration at
    the present prices is added, what it covers gets cheaper. Of all prices seen, those stay that give the highest lower bound on
    the number of sequences. Lengths between two steps are priced in between.
    """
    grains = min(GRAINS, capacity)
    grain = -(-np.arange(capacity + 1) * grains // capacity)
    held = np.bincount(grain, weights=counts, minlength=grains + 1).astype(np.int64)
    kinds = np.flatnonzero(held)
    covered, best, found, since = np.zeros(grains + 1), 0.0, np.arange(grains + 1) / grains, 0
    for n in range(PRICINGS if len(kinds) else 0):
        if n - since > PATIENCE:
            break
        value = np.zeros(grains + 1)
        value[kinds] = np.exp(-STEP * (covered[kinds] - covered[kinds].min())) / held[kinds]
        worth, bundles, taken = price(value, held, grains)
        bound = float((held * value).sum() / worth[grains])
        if bound > best:
            since = n if bound > 1.001 * best else since
            best, found = bound, np.maximum.accumulate(value / worth[grains])
        config = contents(grains, bundles, taken)
        step = min(held[x] / k for x, k in config.items())
        for x, k in config.items():
            covered[x] += step * k / held[x]
    return np.interp(np.arange(capacity + 1) * (grains / capacity), np.arange(grains + 1), found)


def configurations(counts: np.ndarray, dual: np.ndarray, capacity: int = CAPACITY) -> dict[tuple[int, ...], float]:
    """A fractional cover of counts[L] items of each length L by configurations, scaled to cover once on average.

    Multiplicative weights: a length's price, at first its dual one, falls as it gets covered. Each round of pricing starts
    configurations from the lengths covered least and fills their rest with what is worth most at these prices. No configuration
    holds more items of a length than there are, so each of them alone is a sequence that can be packed.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return {}
    covered = np.zeros(capacity + 1)
    used: dict[tuple[int, ...], float] = defaultdict(float)
    for _ in range(ROUNDS):
        low = covered[lengths]
        if low.min() >= COVER:
            break
        value = np.zeros(capacity + 1)
        value[lengths] = (dual[lengths] + lengths / capacity * FULLNESS) * np.exp(-RATE * (low - low.min()))
        _, bundles, taken = price(value, counts, capacity)
        for needed in map(int, lengths[np.lexsort((-lengths, low))[:TAKEN]]):
            times = contents(capacity - needed, bundles, taken)
            if times.get(needed, 0) < counts[needed]:
                times[needed] = times.get(needed, 0) + 1
            step = min(counts[x] / k for x, k in times.items())
            used[tuple(sorted((x for x, k in times.items() for _ in range(k)), reverse=True))] += step
            for x, k in times.items():
                covered[x] += step * k / counts[x]
    weight = lengths * counts[lengths]
    scale = float((covered[lengths] * weight).sum() / weight.sum())
    return {c: x / scale for c, x in used.items()}


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (configuration, times). Bins of the same contents are handled together."""
    bins: dict[int, list[list]] = defaultdict(list)
    for size in map(int, np.flatnonzero(counts)[::-1]):
        left = int(counts[size])
        for room in range(size, capacity + 1):
            if not left:
                break
            each, stay = room // size, []
            for config, times in bins.pop(room, []):
                full = min(times, left // each)
                if full:
                    bins[room - each * size].append([config + (size,) * each, full])
                    left -= full * each
                if (times := times - full) and left:  # left < each: one more bin takes the rest
                    bins[room - left * size].append([config + (size,) * left, 1])
                    left, times = 0, times - 1
                if times:
                    stay.append([config, times])
            if stay:
                bins[room] = stay + bins.get(room, [])
        if left:
            each = capacity // size
            if left // each:
                bins[capacity - each * size].append([(size,) * each, left // each])
            if left % each:
                bins[capacity - left % each * size].append([(size,) * (left % each), 1])
    return [(config, times) for same in bins.values() for config, times in same]


def rounded(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(configuration, times) that the program places, and the counts that it leaves.

    The program is solved, the configurations of most worth (of these, the ones with the longest items) are taken as often as its solution says (rounded down, but once at
    least) where their items are still there, and what remains is a smaller program. Each such dive places DIVE of its words at
    most, so that prices keep up with what is left; it ends when LEFT of all items remain.
    """
    plan: list[tuple[tuple[int, ...], int]] = []
    left, some = counts.astype(np.int64).copy(), int(LEFT * counts.sum())
    sizes = np.arange(capacity + 1)
    while left.sum() > some:
        dual = prices(left, capacity)
        fractional = configurations(left, dual, capacity)
        goal = DIVE * float((left * sizes).sum())
        placed = 0
        worth = lambda c: round(sum(dual[x] for x in c) + sum(c) / capacity * FULLNESS, 3)
        for config, x in sorted(fractional.items(), key=lambda c: (-worth(c[0]), [-x for x in c[0]])):
            kinds, each = np.unique(config, return_counts=True)
            times = int(min(max(1, np.floor(x + 1e-9)), (left[kinds] // each).min()))
            if times:
                plan.append((config, times))
                left[kinds] -= times * each
                placed += times * sum(config)
                if placed >= goal:
                    break
    return plan, left


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, times) that hold every one of counts[L] items of length L, L from 1 to capacity."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    more, left = rounded(left, capacity)
    return plan + more + best_fit(left, capacity)


def places(plan: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan as ranges of rank within a length: key (length << 40 | first rank), copies a sequence, first sequence, offset."""
    rank, sequence = np.zeros(capacity + 1, dtype=np.int64), 0
    key, each, base, offset = [], [], [], []
    for config, times in plan:
        at = 0
        for size, k in zip(*map(np.ndarray.tolist, np.unique(config, return_counts=True)), strict=True):
            key.append((size << 40) + int(rank[size]))
            each.append(k)
            base.append(sequence)
            offset.append(at)
            rank[size] += k * times
            at += size * k
        sequence += times
    order = np.argsort(np.array(key, dtype=np.int64), kind="stable")
    return {n: np.array(x, dtype=np.int64)[order] for n, x in (("key", key), ("each", each), ("base", base), ("offset", offset))}


_PLACED = _PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))


def _place(table: dict[str, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(table["key"], (length << 40) + rank, side="right") - 1
            past = (length << 40) + rank - table["key"][at]
            sequence, nth = table["base"][at] + past // table["each"][at], past % table["each"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in _PIECES), pa.array(sequence), pa.array(table["offset"][at] + nth * length)], schema=_PLACED)

    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    path = public_tokenizers.path(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tokenise(path), _PIECES_DDL)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs(doc_id, text, ...).

    A document is the tokenizer's ids of its whole text (null: empty) and the id 0. One longer than 2,048 is cut into pieces
    of 2,048, the first of which may be shorter; no other is cut. Sequences hold 2,048 tokens at most; offsets run from 0
    without gaps. Rows with the same doc_id are documents of their own; a null doc_id is kept. Other columns are not read.
    The same rows give the same packing; an empty table gives an empty one.
    """
    made = materialise(pieces(docs, tokenizer), "pack-pieces")
    histogram = made.groupBy("length").count().collect()  # 2,048 rows at most
    counts = np.zeros(CAPACITY + 1, dtype=np.int64)
    for row in histogram:
        counts[row["length"]] = row["count"]
    table = places(solve(counts))
    buckets = max(BUCKETS, int(counts.sum()) // BUCKET_ROWS)
    spread = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("here"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = spread.join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)
    return ranked.select(*(f.name for f in _PIECES), "rank").mapInArrow(_place(table), f"{_PIECES_DDL}, sequence_id long, offset long")

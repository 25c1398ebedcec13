"""Quality rules as a short-circuit cascade.

A bounded sample of whole documents tells each rule's cost (CPU seconds a document) and selectivity (share it rejects of those
that the rules before it let through). Rules then run in the order of rejection per cost, each only on the documents that all
before it let through; what a rule looks at, apart from the base measures, is computed when it is reached. The verdict is that of
all rules together, whatever their order.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, words_of

SYMBOLS = "#*$%&|<>"
SPAN = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Documents that costs and selectivities are estimated on, whole: those with the smallest hashed doc_id.
SAMPLE_DOCS, SAMPLE_TASKS = 256, 16
#: How a line begins that is an item of a list, and how one ends that breaks off.
BULLET, ELLIPSIS = re.compile(r"[ \t]*[-*•·]"), re.compile(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\Z")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_NOT_SYMBOL = {ord(c): None for c in SYMBOLS}


class Doc:
    """A text, its base measures, and what rules have asked of it so far."""

    def __init__(self, text: str | None) -> None:
        self.text, self.words = text or "", words_of(text)
        self.n_words, self.word_chars = len(self.words), sum(map(len, self.words))
        self.n_symbols = len(self.text) - len(self.text.translate(_NOT_SYMBOL))
        self.lines = [x for x in self.text.split("\n") if x and not x.isspace() or words_of(x)]
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.n_repeat_words = repeat_words(self.words)

    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words

    @cached_property
    def counts(self) -> Counter:
        """How often the text has each word."""
        return Counter(self.words)

    def words_with(self, test: Callable[[str], object]) -> int:
        return sum(n for w, n in self.counts.items() if test(w))

    def top_pair(self) -> int:
        """How often the most frequent two neighbouring words occur."""
        return max(Counter(zip(self.words, self.words[1:], strict=False)).values(), default=0)


_letter = regex.compile(r"\p{L}").search


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of SPAN words which the text holds twice or more."""
    n = len(words) - SPAN + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    if len(number) == len(words):
        return 0
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SPAN):
        h += (ids[k : k + n] + np.uint64(1)) * _MULTIPLIERS[k]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    cover[np.flatnonzero(twice)] += 1
    cover[np.flatnonzero(twice) + SPAN] -= 1
    return int((np.cumsum(cover) > 0).sum())


#: A rule says whether a document passes.
RULES: dict[str, Callable[[Doc], bool]] = {
    "word_length": lambda d: 2 * d.n_words <= d.word_chars <= 20 * d.n_words,
    "symbols": lambda d: 4 * d.n_symbols <= d.n_words,
    "dup_lines": lambda d: 10 * d.n_dup_lines <= 6 * len(d.lines),
    "bullets": lambda d: 10 * sum(map(bool, map(BULLET.match, d.lines))) <= 9 * len(d.lines),
    "ellipses": lambda d: 10 * sum(map(bool, map(ELLIPSIS.search, d.lines))) <= 3 * len(d.lines),
    "upper_words": lambda d: 2 * d.words_with(str.isupper) <= d.n_words,
    "letter_words": lambda d: 10 * d.words_with(_letter) >= 6 * d.n_words,
    "top_word": lambda d: 10 * max(d.counts.values(), default=0) <= 3 * d.n_words,
    "variety": lambda d: len(d.counts) ** 2 >= d.n_words,
    "top_pair": lambda d: 10 * d.top_pair() <= 2 * d.n_words,
}


def measured(texts: Iterable[str | None], rules: dict[str, Callable[[Doc], bool]] = RULES) -> Iterator[list[tuple[float, bool]]]:
    """For each text that the base lets through, (seconds, passed) of each rule on its own."""
    for text in texts:
        if Doc(text).base_failed():
            continue
        row = []
        for rule in rules.values():
            d = Doc(text)  # anew, so that no rule pays for another
            began = time.thread_time()
            passed = bool(rule(d))
            row.append((time.thread_time() - began, passed))
        yield row


def plan_order(rows: list[list[tuple[float, bool]]], names: Iterable[str] = tuple(RULES)) -> list[tuple[str, float, float]]:
    """(rule, cost, selectivity) in the order of rejection per cost, from measured(). A rule's selectivity is the share it rejects of
    the documents that all rules before it let through; of rules that reject none of them, the cheapest goes first, then by name."""
    names = list(names)
    passed = np.array([[p for _, p in row] for row in rows], dtype=bool).reshape(len(rows), len(names))
    cost = np.maximum(np.array([[c for c, _ in row] for row in rows]).reshape(len(rows), len(names)).sum(axis=0) / max(1, len(rows)), 1e-9)
    left, alive, found = set(range(len(names))), np.ones(len(rows), dtype=bool), []
    while left:
        share = {k: float((~passed[alive, k]).mean()) if alive.any() else 0.0 for k in left}
        best = min(left, key=lambda k: (-share[k] / cost[k], cost[k], names[k]))
        found.append((names[best], float(cost[best]), share[best]))
        alive &= passed[:, best]
        left.remove(best)
    return found


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """On the executors, so that the driver gets two numbers a rule and no text."""
    for batch in batches:
        rows = [*measured(t.as_py() for t in batch.column(1))]
        kind = [pa.list_(pa.float64()), pa.list_(pa.bool_())]
        yield pa.RecordBatch.from_arrays([pa.array([[x[k] for x in row] for row in rows], kind[k]) for k in (0, 1)], names=["seconds", "passed"])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("failed_rule", pa.string())])
_OUT_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"


def _judge(order: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    d = Doc(text.as_py())
                    base = d.base_failed()
                    failed = "base" if base else next((name for name in order if not RULES[name](d)), None)
                    rows.append((doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, base, failed is None, failed))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the first rule that failed, for each row of docs(doc_id, text, ...).

    Null and empty texts have no words, so the base fails. Which of several failing rules is named depends on the measured
    order; kept does not. Other columns are not read; rows that repeat are judged each; an empty table gives an empty one.
    """
    sample = hashed_sample(docs, "doc_id", SAMPLE_DOCS, F.col("text").cast("string").alias("t")).repartition(SAMPLE_TASKS, "h")
    told = sample.mapInArrow(_measure, "seconds array<double>, passed array<boolean>").collect()  # SAMPLE_DOCS rows at most
    order = [name for name, _, _ in plan_order([[*zip(r["seconds"], r["passed"], strict=True)] for r in told])]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_judge(order), _OUT_DDL)

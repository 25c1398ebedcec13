"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut the score into grades:
P(grade >= k) = sigmoid(w.x - theta_k). The model is fitted in one task on a bounded sample of labelled rows and scores
every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

GRADES = 3
#: Hashed features.
BUCKETS = 1 << 14
#: The model is fitted on so many labelled rows at most (those with the smallest hashed doc_id).
FIT_ROWS = 3_000
EPOCHS, RATE, DECAY, BATCH, SEED = 12, 0.1, 1e-6, 64, 5
#: Tail probability of grade 1 or more from which a document is selected.
SELECT = 0.5
REMEMBERED = 300_000
_letters = [(re.compile(p), r) for p, r in ((r"[^\W\d_]", "a"), (r"\d", "9"))]


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of a word: itself in lower case, its shape (case, digits, marks, runs shortened) and its marks."""
    core = word.strip(".,;:!?\"'()")
    if core.isalpha():
        shape = "A" if core.isupper() and len(core) > 1 else "Aa" if core[0].isupper() else "a"
        rest = word.replace(core, "", 1)
    else:
        shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))[:12]
        rest = "".join(sorted({c for c in word if not c.isalnum()}))
    return _bucket(f"w:{word.lower()}"), _bucket(f"s:{shape}"), _bucket(f"m:{rest}")


def features(text: str | None, known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a text: root-mean shares of its words' buckets, of repeated neighbours, and its length class."""
    words = words_of(text)
    if not words:
        return np.array([_bucket("empty")]), np.array([1.0])
    if len(known) > REMEMBERED:
        known.clear()
    n, counts = len(words), Counter(words)
    for w in counts:
        if w not in known:
            known[w] = word_features(w)
    where = np.fromiter((b for w in counts for b in known[w]), dtype=np.int64, count=3 * len(counts))
    times = np.repeat(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), 3)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    extra = [(_bucket("repeat"), again / n), (_bucket("variety"), len(counts) / n), (_bucket(f"length:{min(12, n.bit_length())}"), 0.25), (_bucket("bias"), 0.5)]
    at = np.concatenate([where, [b for b, _ in extra]])
    values = np.concatenate([np.sqrt(times / n) * 0.5, [v for _, v in extra]])
    return at, values


def fit(texts: list[str | None], grades: list[int], n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """fit_features() of texts."""
    known: dict[str, tuple[int, ...]] = {}
    return fit_features([features(t, known) for t in texts], grades, n_grades)


def fit_features(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) by stochastic gradients on the cumulative links' log-likelihood.

    Thresholds are a first one plus non-negative steps, so they stay ordered. Without rows, or with a single grade, the weights
    are zero and the thresholds follow the grades' shares.
    """
    y = np.asarray(grades, dtype=np.int64)
    shares = np.array([((y >= k).sum() + 0.5) / (len(y) + 1) for k in range(1, n_grades)])
    theta = np.maximum.accumulate(-np.log(shares / (1 - shares)))
    w = np.zeros(BUCKETS)
    if len(set(grades)) < 2:
        return w, theta
    g2, gt2 = np.full(BUCKETS, 1e-8), np.full(n_grades - 1, 1e-8)
    start, steps = theta[0], np.log(np.expm1(np.maximum(np.diff(theta), 1e-2)))
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            theta = start + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(steps)))])
            p = 1 / (1 + np.exp(np.clip(theta - (w[at] * v).sum(), -30, 30)))
            up = p - (np.arange(1, n_grades) <= y[i])  # of the K-1 binary links
            g = up.sum() * v + DECAY * w[at]
            np.add.at(g2, at, g * g)
            np.subtract.at(w, at, RATE * g / np.sqrt(g2[at]))
            gs = np.concatenate([[-up.sum()], [-up[k + 1 :].sum() / (1 + np.exp(-steps[k])) for k in range(n_grades - 2)]])
            gt2 += gs * gs
            move = RATE * gs / np.sqrt(gt2)
            start, steps = start - move[0], steps - move[1:]
    return w, start + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(steps)))])


def tails(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k from 1, a column each."""
    return 1 / (1 + np.exp(np.clip(theta[None, :] - x[:, None], -60, 60)))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for low quality, 1 for good but toxic, 2 for good and clean; rows without a quality are left out."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).otherwise(2)
    return labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade"))


_FEATURES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("grade", pa.int32()), ("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))])
_FEATURES_DDL = "doc_id long, th long, grade int, at array<int>, v array<double>"


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of each whole text, so that the one fitting task reads no text; th tells texts of one doc_id apart."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        found = [features(t, _known) for t in texts]
        hashes = [zlib.crc32(t.encode()) if t is not None else -1 for t in texts]
        columns = [batch.column(0), pa.array(hashes, pa.int64()), batch.column(2), pa.array([a.tolist() for a, _ in found], _FEATURES.field("at").type), pa.array([v.tolist() for _, v in found], _FEATURES.field("v").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=_FEATURES)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Fits on `rows` labelled documents at most, of those whose crc32(doc_id as text) mod 3 is not 1; the rest is for testing."""
    usable = graded(labels).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    picked = usable.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "grade").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = text.join(F.broadcast(picked), "doc_id").mapInArrow(_extracted, _FEATURES_DDL)  # `rows` rows at most, whole texts

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "th", "grade"], kind="stable").head(2 * rows)
        w, theta = fit_features([(np.asarray(a, dtype=np.int64), np.asarray(v)) for a, v in zip(pdf["at"], pdf["v"], strict=True)], pdf["grade"].astype(int).tolist())
        return pd.DataFrame({"w": [w.astype(np.float32).tolist()], "theta": [theta.tolist()]})

    model = sample.groupBy(F.lit("all")).applyInPandas(fitted, "w array<float>, theta array<double>").first()
    if model is None:
        return fit([], [])
    return np.array(model["w"], dtype=np.float64), np.array(model["theta"])


_OUT = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("p_good", pa.float64()), ("p_best", pa.float64()), ("kept", pa.bool_())])
_OUT_DDL = "doc_id long, expected_grade double, p_good double, p_best double, kept boolean"


def _scorer(w: np.ndarray, theta: np.ndarray, select: float):
    def score(texts: list) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            at, v = features(text.as_py(), _known)
            out[i] = (w[at] * v).sum()
        return tails(out, theta)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score(list(batch.column(1)))
            p = p if len(p) else np.zeros((0, len(theta)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (p.sum(axis=1), p[:, 0], p[:, -1], p[:, 0] >= select))], schema=_OUT)

    return run


_known: dict[str, tuple[int, ...]] = {}


def classify(docs: DataFrame, labels: DataFrame, select: float = SELECT) -> DataFrame:
    """doc_id, expected_grade, p_good (grade 1 or more), p_best (the top grade) and kept for each row of docs(doc_id, text, ...).

    labels(doc_id, quality, toxic) give the grades; kept means p_good >= select. Null and empty texts are scored as texts
    without a word. Without any label the grades' prior is uniform. Repeated rows are scored each; other columns are not
    read; an empty table gives an empty one.
    """
    w, theta = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(w, theta, select), _OUT_DDL)


def keep_good(docs: DataFrame, labels: DataFrame, select: float = SELECT) -> DataFrame:
    """The rows of docs that classify() keeps, whole and with all their columns, whatever their names.

    Null and empty texts are judged as texts without a word; repeated rows stay or go together; without labels p_good is the prior's
    and all rows stay or go; an empty table gives an empty one.
    """
    w, theta = train(docs, labels)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(at)):
                where, v = features(text.as_py(), _known)
                x[i] = (w[where] * v).sum()
            yield batch.filter(pa.array(tails(x, theta)[:, 0] >= select))

    return docs.mapInArrow(run, schema)

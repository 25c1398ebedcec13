"""Toxicity: a learned lexicon in a trie, searched by Levenshtein automata, with context-window scores.

The lexicon is learned from the labelled rows that are not held out: words, and stems of words, whose documents are far more
often toxic in both halves of these rows. It is kept in a trie. A word's Levenshtein automaton walks the trie and finds terms
within one edit. Windows around each hit tell quotation and report from abuse; a small logistic model over such counts gives
the score. Misspelled abuse and quoted terms are rare in labelled rows, so the model also learns from generated ones: toxic
rows with their terms misspelled, still toxic, and with each term quoted, no longer so.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, words_of
from .ngram_join import shingles

#: Labelled rows that the lexicon and the weights are learned from, at most (those with the smallest hashed doc_id).
FIT_ROWS = 8_000
#: Toxic documents a term or stem must be in, and in each half of the rows; log-odds it must reach in all and in each half.
LEAST_DOCS, LEAST_HALF, LEAST_ODDS, HALF_ODDS = 5, 2, 2.5, 1.5
#: Stems have so many letters. A document has a stem if so many different words of it begin so; so many words of toxic ones must.
STEM, STEM_TWICE, STEM_WORDS = (3, 8), 2, 6
#: Terms of so many letters at least are also found misspelled, by one edit.
FUZZY_LETTERS = 5
WINDOW, PREDICT = 5, 0.7
REMEMBERED = 300_000
#: Marks that open or close a quotation, and words that report someone's speech.
QUOTES = "\"“”«»„‘’"
REPORT = {"said", "says", "quote", "quoted", "called", "wrote", "word", "term", "dit", "sagte", "dijo"}

_word = re.compile(r"[\w@$]+")
_quote = re.compile(f"[{QUOTES}]")
_like = str.maketrans("013457@$", "oleastas")
_digit = {"o": "0", "l": "1", "e": "3", "a": "4", "s": "5", "t": "7"}


def plain_form(word: str) -> str:
    return word.lower().strip("@$_")


class Trie:
    """Terms by letter. A node is a dict of letters; the empty string marks a term's end, '*' a stem's."""

    def __init__(self, words: Iterable[str] = (), stems: Iterable[str] = ()) -> None:
        self.root: dict = {}
        for mark, terms in (("", words), ("*", stems)):
            for term in terms:
                node = self.root
                for letter in term:
                    node = node.setdefault(letter, {})
                node[mark] = term

    def exact(self, word: str) -> str | None:
        """The word itself, or the longest stem that begins it."""
        node, found = self.root, None
        for letter in word:
            found = node.get("*", found)
            node = node.get(letter)
            if node is None:
                return found
        return node.get("", node.get("*", found))

    def fuzzy(self, word: str, edits: int = 1) -> str | None:
        """The nearest term, then the first by letters, within `edits` of the word. The automaton's states are the edit distances
        near the diagonal; a branch of the trie is left as soon as all of them are past `edits`."""
        n, best = len(word), None
        stack = [(self.root, 0, tuple(k - edits if k >= edits else edits + 1 for k in range(2 * edits + 1)))]
        while stack:
            node, depth, state = stack.pop()
            at = n - depth + edits
            if "" in node and depth >= FUZZY_LETTERS and 0 <= at <= 2 * edits and state[at] <= edits and (best is None or (state[at], node[""]) < best):
                best = (state[at], node[""])
            for letter, child in node.items():
                if letter and letter != "*":
                    after = step(state, word, letter, depth, edits)
                    if min(after) <= edits:
                        stack.append((child, depth + 1, after))
        return best[1] if best else None


def step(state: tuple[int, ...], word: str, letter: str, depth: int, edits: int) -> tuple[int, ...]:
    """The Levenshtein automaton after one more letter of the term: state[k] is the distance of the term's first `depth` letters
    from the word's first depth - edits + k ones, edits + 1 standing for more."""
    past, n, out, left = edits + 1, len(word), [], edits + 1
    for k in range(2 * edits + 1):
        j = depth + 1 - edits + k
        if j < 0 or j > n:
            left = past
        elif j == 0:
            left = min(depth + 1, past)
        else:
            left = min(left + 1, state[k] + (word[j - 1] != letter), state[k + 1] + 1 if k < 2 * edits else past, past)
        out.append(left)
    return tuple(out)


def first_of_kind(sketches: list[tuple]) -> list[bool]:
    """Whether each text is the first of its kind: none before it shares one of a few min-hashes of five-word shingles. Copies
    and near copies would otherwise make all their words look like signs of their label."""
    seen: set[tuple[int, int]] = set()
    first = []
    for sketch in sketches:
        mine = {*enumerate(sketch)}
        first.append(not mine & seen)
        seen |= mine
    return first


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def sketch(text: str | None, known: dict[str, int]) -> list[int]:
    """A few min-hashes of a text's shingles, as one number of 53 bits each; zeros where it has no word."""
    grams = shingles(words_of(text), known)
    return [int(((grams * m) >> np.uint64(11)).min()) for m in _MIX] if len(grams) else [0] * len(_MIX)


def stems_of(words: Iterable[str]) -> dict[str, set[str]]:
    """Stems that STEM_TWICE of the words or more begin with and go on after."""
    found: dict[str, set[str]] = {}
    for w in words:
        for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1):
            found.setdefault(w[:k], set()).add(w)
    return {s: ws for s, ws in found.items() if len(ws) >= STEM_TWICE}


def _odds(toxic, clean, n_toxic, n_clean):
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))


def lexicon(rows: DataFrame) -> tuple[list[str], list[str]]:
    """(words, stems) that mark toxic documents, from rows(rid, toxic, half, text).

    A term must reach LEAST_ODDS, the smoothed log-odds of document counts, in all rows and HALF_ODDS in each half of them. All
    terms that do are kept; of stems that begin with one another, the strongest is.
    """
    n = {(r["toxic"], r["half"]): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    of = lambda y, h=None: float(sum(k for (a, b), k in n.items() if a == y and h in (None, b)))
    told = rows.select("toxic", "half", "text").mapInArrow(_terms_in, "kind string, term string, toxic int, half int, words array<string>")
    at = lambda y, h: F.sum(((F.col("toxic") == y) & (F.col("half") == h)).cast("long"))
    told = materialise(told, "toxic-terms")
    counts = told.groupBy("kind", "term").agg(*(at(y, h).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)))
    counts = counts.withColumns({"t": F.col("n10") + F.col("n11"), "c": F.col("n00") + F.col("n01")})
    odds = _odds(F.col("t"), F.col("c"), of(1), of(0))
    halves = [(F.col(f"n1{h}") >= LEAST_HALF) & (_odds(F.col(f"n1{h}"), F.col(f"n0{h}"), of(1, h), of(0, h)) >= HALF_ODDS) for h in (0, 1)]
    good = counts.filter((F.col("t") >= LEAST_DOCS) & (odds >= LEAST_ODDS) & halves[0] & halves[1]).select("kind", "term", (odds * F.sqrt("t")).alias("strength"))
    good = materialise(good, "toxic-good")
    begun = told.filter("kind = 's' AND toxic = 1").join(good, ["kind", "term"], "left_semi").select("kind", "term", F.explode("words").alias("word")).distinct().groupBy("kind", "term").agg(F.count("*").alias("begun"))
    found = good.join(begun, ["kind", "term"], "left").filter(f"kind = 'w' OR begun >= {STEM_WORDS}").collect()
    found = sorted(found, key=lambda r: (-r["strength"], -len(r["term"]), r["term"]))
    kept: list[str] = []
    for stem in (r["term"] for r in found if r["kind"] == "s"):
        if not any(stem.startswith(k) or k.startswith(stem) for k in kept):
            kept.append(stem)
    return [r["term"] for r in found if r["kind"] == "w" and not r["term"].startswith(tuple(kept))], kept


_TERMS = pa.schema([("kind", pa.string()), ("term", pa.string()), ("toxic", pa.int32()), ("half", pa.int32()), ("words", pa.list_(pa.string()))])


def _terms_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different word ('w') and stem ('s') of each text; a stem of a toxic text also names its words."""
    for batch in batches:
        for y, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            mine = {plain_form(w) for w in set(_word.findall(text.as_py()))}
            rows = [("w", w, y, half, None) for w in mine] + [("s", s, y, half, sorted(ws) if y else None) for s, ws in stems_of(mine).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _TERMS, strict=True)], schema=_TERMS)


def misspelled(word: str, turn: int) -> str:
    """The word with one letter after its first changed, doubled, dropped or written as a digit, by the number `turn`."""
    at, how = 1 + turn % (len(word) - 1), turn // 7 % 4
    letter = word[at]
    if how == 0 and letter.lower() in _digit:
        return word[:at] + _digit[letter.lower()] + word[at + 1 :]
    if how == 1:
        return word[:at] + letter + word[at:]
    if how == 2:
        return word[:at] + word[at + 1 :]
    return word[:at] + ("q" if letter != "q" else "k") + word[at + 1 :]


def rewritten(text: str, terms: dict[str, tuple[str, bool]], stems: frozenset, quote: bool) -> str | None:
    """A text with every term quoted, or with every word of the lexicon misspelled; None if there is none to misspell."""
    count = 0

    def one(m: re.Match) -> str:
        nonlocal count
        w, hit = m.group(), terms.get(m.group())
        if hit is None:
            return w
        if quote:
            return f'said "{w}"'
        if hit[0] in stems or len(w) < FUZZY_LETTERS + 1:
            return "" if hit[0] in stems else w
        count += 1
        return misspelled(w, zlib.crc32(f"{count} {w}".encode()))

    out = _word.sub(one, text)
    return out if quote or count else None


class Scanner:
    """Finds terms in texts; remembers the words it has looked at, apart by whether they are a term."""

    def __init__(self, words: list[str], stems: list[str], plain: Iterable[str] = ()) -> None:
        self.trie, self.plain, self.stems = Trie(words, stems), frozenset(plain), frozenset(stems)
        self.hits: dict[str, tuple[str, bool]] = {}
        self.boring: set[str] = set()
        self.begins = frozenset(t[:3] for t in (*words, *stems))
        self.short = any(len(t) < 3 for t in (*words, *stems))
        #: One edit leaves the first or the last half of a term as it is; by length of word, halves of the terms near it.
        self.halves: dict[int, tuple[set[str], set[str], list[int], list[int]]] = {}
        for w in words:
            if len(w) >= FUZZY_LETTERS:
                for n in range(len(w) - 1, len(w) + 2):
                    first, last, a, b = self.halves.setdefault(n, (set(), set(), [], []))
                    cut = len(w) // 2
                    first.add(w[:cut])
                    last.add(w[cut:])
                    a[:] = sorted({*a, cut})
                    b[:] = sorted({*b, len(w) - cut})

    def may_be_bent(self, word: str) -> bool:
        near = self.halves.get(len(word))
        return near is not None and (any(word[:k] in near[0] for k in near[2]) or any(word[-k:] in near[1] for k in near[3]))

    def look(self, word: str) -> tuple[str, bool] | None:
        """(term, whether misspelled) of a word as written."""
        low = plain_form(word)
        if (self.short or low[:3] in self.begins) and (found := self.trie.exact(low)):
            return found, False
        plain = low if low.isalpha() else low.translate(_like)
        if plain is not low and (found := self.trie.exact(plain)):
            return found, True
        if not self.may_be_bent(plain) or low in self.plain:
            return None
        found = self.trie.fuzzy(plain)
        return (found, True) if found else None

    def terms(self, words: set[str]) -> dict[str, tuple[str, bool]]:
        """Those of a text's different words that are terms."""
        for w in words - self.boring:
            if w not in self.hits:
                if hit := self.look(w):
                    self.hits[w] = hit
                else:
                    self.boring.add(w)
        found = {w: self.hits[w] for w in words & self.hits.keys()}
        if len(self.boring) > REMEMBERED:
            self.boring.clear()
        if len(self.hits) > REMEMBERED:
            self.hits.clear()
        return found

    def counts(self, text: str | None) -> np.ndarray:
        """What the score is made from: hits of words, of stems, misspelled and quoted ones, their kinds, shares and nearness."""
        out = np.zeros(SIGNS)
        out[-1] = 1.0
        words = _word.findall(text) if text else []
        terms = self.terms(set(words))
        if not terms:
            return out
        found = [*map(terms.get, words)]
        at = [k for k, f in enumerate(found) if f]
        spans = [m.span() for m in _word.finditer(text)]
        plain = stem = bent = quoted = 0
        for k in at:
            lo, hi = max(0, k - WINDOW), min(len(spans) - 1, k + WINDOW)
            before, after = text[spans[lo][0] : spans[k][0]], text[spans[k][1] : spans[hi][1] + 1]
            if any(w.lower() in REPORT for w in words[lo:k]) or (_quote.search(before) and _quote.search(after)):
                quoted += 1
            elif found[k][1]:
                bent += 1
            elif found[k][0] in self.stems:
                stem += 1
            else:
                plain += 1
        kinds = len({found[k][0] for k in at if found[k][0] not in self.stems})
        near = sum(b - a <= WINDOW for a, b in zip(at, at[1:], strict=False))
        out[:-1] = [plain > 0, min(plain, 4), plain > 1, min(stem, 6), stem > 1, stem > 2, min(1.0, 25 * stem / len(words)), bent > 0, bent > 1, quoted > 0, min(quoted, 3), kinds > 1, min(1.0, 20 * plain / len(words)), near > 0]
        return out


#: Length of Scanner.counts().
SIGNS = 15


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= move
        if abs(move).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


_SKETCH = pa.schema([("rid", pa.int64()), ("sketch", pa.list_(pa.int64()))])
_BENT = pa.schema([("word", pa.string())])
_SIGNS = pa.schema([("toxic", pa.int32()), ("signs", pa.list_(pa.float64()))])


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(t.as_py(), known) for t in batch.column(1)], _SKETCH.field("sketch").type)], schema=_SKETCH)


def _bent(words: list[str], stems: list[str]):
    """For each text the different words that would be taken for misspellings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(words, stems)
        for batch in batches:
            found = [w for t in batch.column(0) for w in {plain_form(w) for w, hit in scan.terms(set(_word.findall(t.as_py()))).items() if hit[1]}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], schema=_BENT)

    return run


def _signs(words: list[str], stems: list[str], plain: list[str]):
    """The signs of each text and, of a toxic one with terms, of its misspelled (toxic) and its quoted form (not toxic)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(words, stems, plain)
        for batch in batches:
            out: list[tuple[int, list[float]]] = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append((y, scan.counts(text).tolist()))
                terms = scan.terms(set(_word.findall(text))) if y else {}
                if terms:
                    bent = rewritten(text, terms, scan.stems, False)
                    out += [(1, scan.counts(bent).tolist())] if bent else []
                    out.append((0, scan.counts(rewritten(text, terms, scan.stems, True)).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SIGNS, strict=True)], schema=_SIGNS) if out else pa.RecordBatch.from_pylist([], schema=_SIGNS)

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Lexicon, the words that are not to be taken for misspellings, and weights, from `rows` labelled rows at most.

    Texts stay in the distributed scans; the driver gets the sample's min-hashes, its terms and a row of signs a text.
    """
    usable = labels.filter(F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out())
    picked = materialise(usable.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "toxic").limit(rows), "toxic-rows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id")  # `rows` rows at most
    sample = materialise(sample.select(F.xxhash64("doc_id", "text").alias("rid"), "toxic", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).cast("int").alias("half"), "text"), "toxic-sample")
    told = sorted(sample.select("rid", "text").mapInArrow(_sketched, "rid long, sketch array<long>").collect(), key=lambda r: r["rid"])
    firsts = [r["rid"] for r, first in zip(told, first_of_kind([tuple(r["sketch"]) for r in told]), strict=True) if first]
    kept = sample.join(F.broadcast(sample.sparkSession.createDataFrame([(x,) for x in firsts], "rid long")), "rid", "left_semi")  # so are these
    words, stems = lexicon(kept)
    bent = sample.filter("toxic = 0").select("text").mapInArrow(_bent(words, stems), "word string")
    plain = sorted(r["word"] for r in bent.groupBy("word").count().filter("count > 1").collect())
    learnt = sample.select("toxic", "text").mapInArrow(_signs(words, stems, plain), "toxic int, signs array<double>").collect()
    learnt = sorted((r["toxic"], tuple(r["signs"])) for r in learnt)  # the same sums whatever the order of tasks
    weights = logistic(np.array([x for _, x in learnt]).reshape(len(learnt), SIGNS), np.array([y for y, _ in learnt], dtype=np.float64)) if learnt else np.zeros(SIGNS)
    return {"words": words, "stems": stems, "plain": plain, "weights": weights.tolist()}


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.7 up) for each row of docs(doc_id, text, ...).

    held_out rows, those whose crc32(doc_id as text) mod 3 is 1, take no part in learning. The score depends on the text alone;
    null counts as empty, and texts without a term get the score of that. A null doc_id is not held out. Without labels every
    score is 0.5. `model` is a trained one to use instead. Abuse counts when misspelled by one edit; terms in quotation marks, or after a word of report, do not.
    Repeated rows are scored each; other columns are not read; an empty table gives an empty one.
    """
    model = model or train(docs, labels, rows)
    weights = np.array(model["weights"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model["words"], model["stems"], model["plain"])
        for batch in batches:
            x = np.array([scan.counts(t.as_py()) for t in batch.column(2)]).reshape(batch.num_rows, SIGNS)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= PREDICT).astype(np.int32))], schema=_OUT)

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

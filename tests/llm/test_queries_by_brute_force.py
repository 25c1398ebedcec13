"""The queries of fitted models over whole tables, against plain scoring with the same model."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from fluxweave.llm import ordinal_quality, queries, toxicity
from fluxweave.llm.common import words_of

SF = "/root/testdata/sf0.001"


def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r.text for r in docs.collect()}


def test_quality_of_every_document(spark):
    docs, labels, texts = tables(spark)
    w, theta = ordinal_quality.train(docs, labels)
    found = {r.doc_id: r for r in queries.op6_ordinal_quality(spark, SF).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        words = words_of(text)
        x = 0.0
        for word, n in Counter(words).items():
            x += sum(0.5 * math.sqrt(n / len(words)) * w[b] for b in ordinal_quality.word_features(word))
        bucket = lambda f: w[zlib.crc32(f.encode()) % ordinal_quality.BUCKETS]
        if words:
            again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
            x += again * bucket("repeat") + len(set(words)) / len(words) * bucket("variety") + 0.25 * bucket(f"length:{min(12, len(words).bit_length())}") + 0.5 * bucket("bias")
        else:
            x = bucket("empty")
        p = [1 / (1 + math.exp(t - x)) for t in theta]
        r = found[i]
        assert abs(r.expected_grade - sum(p)) < 1e-9 and abs(r.p_best - p[-1]) < 1e-9 and r.kept == (r.p_good >= 0.5)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        left, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, left + (x != y))
    return row[-1]


class Plain(toxicity.Scanner):
    """Terms by looking at every one of the lexicon for every word."""

    def __init__(self, words, stems, plain):
        super().__init__(words, stems, plain)
        self.words = words

    def exact(self, word):
        return word if word in self.words else max((s for s in self.stems if word.startswith(s)), key=len, default=None)

    def terms(self, words):
        out = {}
        for w in words:
            low = toxicity.plain_form(w)
            other = low.translate(str.maketrans("013457@$", "oleastas"))
            if hit := self.exact(low):
                out[w] = (hit, False)
            elif hit := self.exact(other) if other != low and not low.isalpha() else None:
                out[w] = (hit, True)
            elif low not in self.plain:
                near = [t for t in self.words if len(t) >= toxicity.FUZZY_LETTERS and abs(len(t) - len(other)) <= 1 and edits(t, other) == 1]
                if near:
                    out[w] = (min(near), True)
        return out


def test_toxicity_of_every_document(spark):
    docs, labels, texts = tables(spark)
    model = toxicity.train(docs, labels)
    for m in (model, model | {"words": ["there", "onese", "thing", *model["words"]], "stems": ["tion", *model["stems"]], "weights": [0.3 * k - 2 for k in range(toxicity.SIGNS)]}):
        scan, weights = Plain(m["words"], m["stems"], m["plain"]), np.array(m["weights"])
        found = toxicity.score(docs, labels, model=m) if m is not model else queries.op8_toxicity(spark, SF)
        rows = {r.doc_id: r for r in found.collect()}
        assert rows.keys() == texts.keys()
        for i, text in texts.items():
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(scan.counts(text) @ weights)))))
            assert abs(rows[i].score - p) < 1e-9 and rows[i].predicted == (p >= 0.7)
            assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)

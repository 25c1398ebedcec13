"""Models learn from all that the sampled rows hold."""

from __future__ import annotations

import random

import numpy as np

from fluxweave.llm import ordinal_quality, toxicity


def test_a_rare_term_enters_the_lexicon(spark):
    rng = random.Random(31)
    vocabulary = [f"{a}{b}" for a in "ba ko li mu ren sto".split() for b in "dar fen gol hip jun".split()]
    rows = []
    for i in range(1_200):
        words = [rng.choice(vocabulary) for _ in range(30)]
        if i % 2:
            words[rng.randrange(30)] = "scoundrel" if i < 12 else rng.choice(["wretch", "dimwit"])
        rows.append((i, i % 2, i // 2 % 2, " ".join(words)))
    assert set(toxicity.lexicon(spark.createDataFrame(rows, "rid long, toxic int, half int, text string"))[0]) == {"scoundrel", "wretch", "dimwit"}  # the first in 6 of 600 toxic texts


def test_quality_learns_from_the_end_of_long_texts(docs_of, spark):
    rng = random.Random(37)
    clean = [f"{a}{b}" for a in "ba ko li mu".split() for b in "dar fen gol".split()]
    rows, labels = [], []
    for i in range(90):
        good = i % 2
        words = [rng.choice(clean) for _ in range(4_200)]  # over 20,000 characters
        rows.append((i, " ".join(words + ["late" if good else "junk"] * 900), "s"))
        labels.append((i, good, 0))
    w, theta = ordinal_quality.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    p = [ordinal_quality.tails(np.array([(w[a] * v).sum()]), theta)[0, 0] for a, v in (ordinal_quality.features(t, {}) for _, t, _ in rows)]
    assert all((x >= 0.5) == bool(i % 2) for i, x in enumerate(p))
    at = {k: ordinal_quality.word_features(k)[0] for k in ("late", "junk")}
    assert w[at["late"]] > 0.1 and w[at["junk"]] < -0.1


def test_misspelled_abuse_counts_and_quoted_terms_do_not(docs_of, spark):
    """Misspelled-only abuse is toxic, its quoted form is not, and without either sign results change."""
    rng = random.Random(43)
    plain = [f"{a}{b}" for a in "ba ko li mu ren sto".split() for b in "dar fen gol hip jun".split()]
    abuse = ["wretched", "scoundrel", "dimwitted", "blockhead"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        for _ in range(2 if i % 3 == 0 else 0):
            words[rng.randrange(40)] = rng.choice(abuse)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(i % 3 == 0)))
    model = toxicity.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(model["words"]) == set(abuse)
    tests, want = [], []
    for i in range(200):
        words = [rng.choice(plain) for _ in range(40)]
        at = sorted(rng.sample(range(40), 2))
        used = [rng.choice(abuse) for _ in at]
        for kind in ("bent", "quoted", "clean", "exact"):
            mine = list(words)
            for k, w in zip(at, used, strict=True):
                mine[k] = {"bent": toxicity.misspelled(w, rng.randrange(1000)), "quoted": f"wrote “{w}”", "clean": words[k], "exact": w}[kind]
            tests.append(" ".join(mine))
            want.append(int(kind in ("bent", "exact")))

    def predicted(weights):
        scan = toxicity.Scanner(model["words"], model["stems"], model["plain"])
        x = np.array([scan.counts(t) for t in tests])
        return (1 / (1 + np.exp(-x @ weights)) >= toxicity.PREDICT).astype(int)

    weights = np.array(model["weights"])
    got, want = predicted(weights), np.array(want)
    assert (got == want).mean() >= 0.99
    for signs in ((7, 8), (9, 10)):  # misspelled, quoted
        without = weights.copy()
        without[list(signs)] = 0
        assert signs == (9, 10) or (predicted(without) != got).sum() >= 150
    assert weights[9] < 0 or weights[10] < 0

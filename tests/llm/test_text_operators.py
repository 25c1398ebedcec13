from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from fluxweave.llm import exact_dedup, line_dedup, mixing, quality_cascade
from fluxweave.llm.common import DOCUMENT_COLUMNS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- exact dedup


def test_cuckoo_index_inserts_finds_deletes_and_grows():
    live, index = {}, exact_dedup.CuckooIndex(2)
    rng = random.Random(1)
    for n in range(5_000):
        key = hashlib.sha256(str(rng.randrange(900)).encode()).digest()
        if key in live and rng.random() < 0.5:
            assert index.delete(key) == live.pop(key)
        elif key not in live:
            index.insert(key, n)
            live[key] = n
        assert index.size == len(live)
    assert dict(index.items()) == live and index.resizes > 3
    assert all(index.values[index.find(k)] == v for k, v in live.items())
    gone = hashlib.sha256(b"never").digest()
    assert index.find(gone) == -1
    with pytest.raises(KeyError):
        index.delete(gone)


def test_cuckoo_hit_is_verified_on_equal_fingerprints():
    index = exact_dedup.CuckooIndex(4)
    a, b = bytes(32), bytes(31) + b"\1"  # same bucket, same fingerprint
    index.insert(a, "a")
    assert index.find(b) == -1
    index.insert(b, "b")
    assert (index.delete(a), index.delete(b), index.size) == ("a", "b", 0)


def test_local_index_evicts_and_merges():
    import pyarrow as pa

    shas = [hashlib.sha256(str(i % 50).encode()).digest() for i in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(shas[k : k + 40]), pa.array([1] * 40), pa.array(range(k, k + 40)), pa.array([1] * 40), pa.array([1] * 40)], schema=exact_dedup._GROUP) for k in range(0, 400, 40)]
    partial = list(exact_dedup._index(10)(batches))
    merged = list(exact_dedup._index(None)(partial))
    found = {r["sha"]: r for b in merged for r in b.to_pylist()}
    assert len(found) == 50 and all(r["group_size"] == 8 for r in found.values())
    assert {r["keep_id"] for r in found.values()} == set(range(350, 400))


def test_exact_dedup_matches_brute_force(awkward):
    rows = [(r.doc_id, r.text or "") for r in awkward.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    found = exact_dedup.exact_dedup(awkward).collect()
    assert len(found) == len(rows)
    text_of = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in found:
        ids = groups[text_of[r.text_sha256]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (keep, len(ids))
        assert not r.kept or r.doc_id == keep
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert kept == {h: 1 for h in text_of}, "one row of each group stays"


def test_drop_copies_keeps_columns_and_one_row_each(awkward):
    left = exact_dedup.drop_copies(awkward)
    assert left.columns == awkward.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in awkward.collect()})


# --- line dedup


def brute_windows(rows):
    keys = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: x[:2])
    seen, gone = set(), defaultdict(set)
    for has, i, t in keys:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not WORD.search(" ".join(w)):
                continue
            if w in seen:
                gone[has, i, t] |= {p, p + 1, p + 2}
            seen.add(w)
    return {k: (len(k[2].split("\n")), len(gone[k]), "\n".join(x for n, x in enumerate(k[2].split("\n")) if n not in gone[k])) for k in keys}


def test_line_windows_match_brute_force(docs_of):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a x", "b", "", "c d", " "]) for _ in range(rng.randrange(0, 14))), "s") for i in range(120)]
    rows += [(500, None, "s"), (501, "", "s"), (None, "a x\nb\nc d", "s")]
    want = brute_windows([(i, t) for i, t, _ in rows])
    for r in line_dedup.drop_repeated_windows(docs_of(rows)).collect():
        if r.doc_id == 500:
            assert (r.n_lines, r.n_removed, r.text) == (0, 0, None)
            continue
        options = [v for k, v in want.items() if k[0] == (r.doc_id is not None) and k[1] == (r.doc_id or 0)]
        assert (r.n_lines, r.n_removed, r.text) in options


def test_line_dedup_of_awkward_rows(awkward):
    found = line_dedup.drop_repeated_windows(awkward).collect()
    assert len(found) == awkward.count()
    ten = next(r for r in found if r.doc_id == 10)
    assert (ten.n_lines, ten.n_removed, ten.text) == (6, 4, "l0\nend")


def test_line_dedup_plan_is_native(awkward):
    plan = line_dedup.drop_repeated_windows(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- mixing


def test_knapsack_is_exact():
    import itertools

    import numpy as np

    rng = random.Random(5)
    for _ in range(60):
        k = rng.randrange(1, 6)
        lengths = np.array(rng.sample(range(1, 30), k))
        counts = np.array([rng.randrange(0, 4) for _ in range(k)])
        budget = rng.randrange(0, 60)
        best = max(s for c in itertools.product(*(range(x + 1) for x in counts)) if (s := int((np.array(c) * lengths).sum())) <= budget)
        take = mixing.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and int((take * lengths).sum()) == best


def targets(sizes, budget=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    cap, left, open_ = {s: 2.0 * sizes[s] for s in names}, budget * sum(sizes.values()), set(names)
    out = {}
    while open_:
        over = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > cap[s]}
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        for s in over:
            out[s] = cap[s]
        left -= sum(cap[s] for s in over)
        open_ -= over
    return out


def test_mix_reaches_its_targets(docs_of):
    rng = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 3, 3, 10, 50, 400]))), rng.choice(["a", "b", "é", "z", None, "a"])) for i in range(900)]
    rows += [(1000 + i, "same words here", "b") for i in range(1500)]  # one length of one source past what is ranked together
    docs = docs_of(rows)
    found, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    want, took = targets(sizes), Counter()
    assert len(found) == len(rows)
    for r in found:
        took[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
    assert all(abs(took[s] - want[s]) <= 3 for s in want), (took, want)


def test_mix_of_awkward_rows_and_its_rows(awkward):
    judged = mixing.mix(awkward).collect()
    assert len(judged) == awkward.count()
    taken = mixing.take_mix(awkward)
    assert taken.columns == awkward.columns
    assert taken.count() == sum(r.copies for r in judged)
    assert sum(len(WORD.findall(r.text or "")) for r in taken.collect()) == sum(r.taken for r in judged)


def test_an_index_of_live_digests_is_kept_between_runs(docs_of):
    rng, live, index = random.Random(13), Counter(), None
    for step in range(4):
        new = [(i, rng.choice([None, "", *(f"text {k}" for k in range(40))]), "s") for i in range(60)]
        live.update(t or "" for _, t, _ in new)
        gone = rng.sample(sorted(live.elements()), 45)
        live -= Counter(gone)
        index = exact_dedup.updated_index(index, docs_of(new), docs_of([(i, t, "s") for i, t in enumerate(gone)]) if step else None)
        if not step:
            index = exact_dedup.updated_index(index, None, docs_of([(i, t, "s") for i, t in enumerate(gone)]))
        found = {bytes(r.sha): r.copies for r in index.collect()}
        assert found == {hashlib.sha256(t.encode()).digest(): n for t, n in live.items()}
    asked = docs_of([(1, next(iter(live)), "s"), (2, "never seen", "s"), (None, None, "s")])
    assert {r.doc_id: r.copies for r in exact_dedup.live_copies(index, asked).collect()} == {1: next(iter(live.values())), 2: 0, None: live[""]}
    with pytest.raises(Exception, match="not live"):
        exact_dedup.updated_index(index, None, asked)


# --- quality cascade


def base(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    spans = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if spans[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_measures_match_brute_force(docs_of, awkward):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b#", "c", "dd|", "\n", "a b c d e f g h", "é x"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [f"{' '.join(f'x{k}' for k in range(200))}"]
    for docs in (docs_of([(i, t, "s") for i, t in enumerate(texts)]), awkward):
        text = [(r.doc_id, r.text) for r in docs.collect()]
        found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_cascade.judge(docs).collect())
        assert found == Counter((i, *base(t)) for i, t in text)


def test_verdict_does_not_depend_on_the_order_and_is_cheapest_first(docs_of):
    clean = " ".join(f"word{k} text{k}" for k in range(40))
    loud, marked = clean.upper(), clean.replace(" ", " ## ")
    docs = docs_of([(1, clean, "s"), (2, loud, "s"), (3, marked, "s"), (4, "short", "s"), (5, " ".join(["the"] * 12 + [f"k{i}" for i in range(20)]), "s")])
    kept = {r.doc_id: r.kept for r in quality_cascade.judge(docs).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    rules = {"slow": lambda d: sum(range(20_000)) < 0, "sharp": lambda d: False, "never": lambda d: True}
    assert [n for n, _, _ in quality_cascade.plan_order([*quality_cascade.measured([clean] * 20, rules)], rules)] == ["sharp", "never", "slow"]


def test_selectivity_is_that_of_what_is_left():
    """b rejects most, a nearly the same documents; c, which rejects fewer but others, goes before a."""
    rows = [[(1e-4, k >= 40), (1e-4, k >= 50), (1e-4, k < 80)] for k in range(100)]
    assert [(n, round(s, 2)) for n, _, s in quality_cascade.plan_order(rows, "abc")] == [("b", 0.5), ("c", 0.4), ("a", 0.0)]


def test_the_order_changes_what_is_measured():
    """The planned order looks at fewer features than its reverse and keeps the same documents."""
    clean = " ".join(f"word{k} text{k}" for k in range(200))
    texts = [clean.replace(" ", " ## ") if k % 2 else clean for k in range(40)]
    planned = [n for n, _, _ in quality_cascade.plan_order([*quality_cascade.measured(texts)])]
    kept, looked = {}, {}
    for name, order in (("planned", planned), ("reverse", planned[::-1])):
        docs = [quality_cascade.Doc(t) for t in texts]
        kept[name] = [all(quality_cascade.RULES[r](d) for r in order) for d in docs]
        looked[name] = sum("counts" in vars(d) for d in docs)
    assert planned[0] == "symbols" and kept["planned"] == kept["reverse"] == [True, False] * 20
    assert looked["planned"] == 20 < looked["reverse"] == 40


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "x", "s")]).limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert line_dedup.drop_repeated_windows(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.take_mix(none).count() == 0
    assert quality_cascade.judge(none).count() == 0
    assert set(DOCUMENT_COLUMNS) <= set(none.columns)

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from fluxweave.llm import ordinal_quality, pii, toxicity


@pytest.fixture(scope="module")
def corpus(docs_of, spark):
    rng = random.Random(29)
    vocabulary = [f"{a}{b}" for a in "ba ko li mu ren sto".split() for b in "dar fen gol hip jun".split()]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))]
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.7)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["wretch", "bungler", "dimwit"])
        if not good:
            words = [w + rng.choice(["###", "$$$", "|"]) for w in words]
        rows.append((i, " ".join(words), "s"))
        if i % 5:
            labels.append((i, good, toxic, "x"))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), {i: (g, t) for i, g, t, _ in labels}


def is_held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


# --- quality


def test_ordinal_fit_orders_grades():
    rng = random.Random(31)
    texts = [" ".join([rng.choice(["good", "fine"])] * g + [rng.choice(["bad", "poor"])] * (4 - 2 * g) + ["the", "a"] * 3) for g in (0, 1, 2) for _ in range(60)]
    grades = [g for g in (0, 1, 2) for _ in range(60)]
    w, theta = ordinal_quality.fit(texts, grades)
    assert (np.diff(theta) > 0).all()
    known = {}
    x = np.array([(w[a] * v).sum() for a, v in (ordinal_quality.features(t, known) for t in texts)])
    p = ordinal_quality.tails(x, theta)
    assert (p[:, 0] >= p[:, 1]).all()
    expected = p.sum(axis=1)
    means = [expected[np.array(grades) == g].mean() for g in (0, 1, 2)]
    assert means == sorted(means) and np.corrcoef(expected, grades)[0, 1] > 0.9


def test_quality_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    found = {r.doc_id: r for r in ordinal_quality.classify(docs, labels).collect()}
    assert len(found) == 700 and all(abs(r.expected_grade - r.p_good - r.p_best) < 1e-9 for r in found.values())
    held = [i for i in truth if is_held(i)]
    assert sum(found[i].kept == bool(truth[i][0]) for i in held) > 0.95 * len(held)
    kept = ordinal_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}


def test_quality_of_awkward_rows_and_without_labels(corpus, awkward, spark):
    _, labels, _ = corpus
    found = ordinal_quality.classify(awkward, labels)
    assert found.count() == awkward.count() and found.filter("p_good IS NULL OR isnan(p_good)").count() == 0
    none = ordinal_quality.classify(awkward, labels.limit(0)).collect()
    assert len(none) == awkward.count() and all(r.p_good == pytest.approx(0.5) for r in none)
    assert ordinal_quality.classify(awkward.limit(0), labels).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert ordinal_quality.classify(awkward, nulls).count() == awkward.count()


# --- toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


def test_automaton_finds_what_edit_distance_does():
    terms = ["wretch", "bungler", "dimwit", "bungles"]
    trie = toxicity.Trie(terms)
    scan = toxicity.Scanner(terms, [])
    rng = random.Random(37)
    for _ in range(2_000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            w[k : k + (kind > 0)] = [] if kind == 2 else [rng.choice("abcdefgilmnrtuw")]
        w = "".join(w)
        near = [t for t in terms if edit_distance(w, t) <= 1]
        assert (trie.fuzzy(w) is not None) == bool(near)
        if near:
            assert trie.fuzzy(w) in near and scan.may_be_bent(w), w


def test_quotation_is_told_from_abuse():
    scan = toxicity.Scanner(["wretch"], ["grub"])
    plain, quoted = scan.counts("you wretch you wretch"), scan.counts('they said "wretch" and left')
    assert plain[0] and not plain[9] and quoted[9] and not quoted[0]
    assert scan.counts("gruben grubix grubal of it")[4:6].all()
    assert scan.counts("you wr3tch wrretch")[7] and not scan.counts("nothing here")[:-1].any()
    assert (scan.counts(None) == scan.counts("")).all()


def test_toxicity_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    found = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(found) == 700 and all(r.held_out == is_held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in found.items())
    held = [i for i in truth if is_held(i)]
    assert all(found[i].predicted == truth[i][1] for i in held)


def test_held_out_labels_are_not_learned(corpus, spark):
    docs, labels, truth = corpus
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a == b and set(a["words"]) == {"wretch", "bungler", "dimwit"}


def test_toxicity_of_awkward_rows(corpus, awkward):
    _, labels, _ = corpus
    found = toxicity.score(awkward, labels)
    assert found.count() == awkward.count() and found.filter("score IS NULL OR isnan(score)").count() == 0
    assert all(r.score == 0.5 for r in toxicity.score(awkward, labels.limit(0)).collect())
    assert toxicity.score(awkward.limit(0), labels).count() == 0


# --- personal data

KEY = b"of the tests"
TEXTS = [
    "write to anna.lee@mail.example.com or ANNA.LEE@mail.example.com now",
    "call +1 (469) 555-3334, or +1 469 555 3334; not 555",
    "card 4111 1111 1111 1111 and 4111111111111111 from 192.168.17.4",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and DE89 3704 0044 0532 0130 00',
    "Mrs. Julia Weber met Herr Karl Braun and Mrs. Julia Weber; г-н Иван Петров too",
    "nothing at all, version 1.2 of 2024",
    "ssn 123-45-6789###",
    'password=13c62e6ad807057713 and PASSWORD=13C62E6AD807057713!! api_key: "zz9-Ab12cd"; the word password=is no secret',
]


def test_entities_are_found_whole():
    kinds = [[e[2] for e in pii.entities(t)] for t in TEXTS]
    assert kinds == [["email", "email"], ["phone", "phone"], ["card", "card", "ipv4"], ["secret", "iban"], ["name_f", "name_m", "name_f", "name_m"], [], ["ssn"], ["secret", "secret", "secret"]]
    assert pii.entities(None) == [] == pii.entities("")


def test_surrogates_keep_type_format_and_coreference(docs_of):
    docs = docs_of([(i, t, "s") for i, t in enumerate(TEXTS * 2)] + [(90, None, "s"), (91, "", "s"), (None, TEXTS[0], "s")])
    found = {}
    for r in pii.replace(docs, KEY).collect():
        found.setdefault(r.doc_id, r)
    for i, t in enumerate(TEXTS):
        new = found[i].text
        assert new == found[i + len(TEXTS)].text, "the same in every document"
        a, b = pii.entities(t), pii.entities(new)
        assert [x[2] for x in a] == [x[2] for x in b] and found[i].n_entities == len(a)
        assert len({x[2:4] for x in a}) == len({x[2:4] for x in b})
        for x, y in zip(a, b, strict=True):
            assert t[x[0] : x[1]] != new[y[0] : y[1]] and t[x[0] : x[1]] not in new
        cards = [x[3] for x in b if x[2] == "card"]
        assert all(pii.luhn_ok(c) for c in cards) and len(set(cards)) <= 1
    assert found[5].text == TEXTS[5] and found[90].text is None and found[91].text == ""
    assert "ANNA" not in found[0].text and any(w.partition("@")[0].isupper() for w in found[0].text.split())
    assert "(" in found[1].text and found[4].text.count("Mrs. ") == 2
    assert any("а" <= c <= "я" for c in found[4].text.rpartition("г-н")[2])
    iban = next(x[3] for x in pii.entities(found[3].text) if x[2] == "iban")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_surrogates_are_distinct_and_keyed(docs_of):
    docs = docs_of([(i, f"from 10.0.0.{i} to 10.0.{i}.7, or u{i}@x.org", "s") for i in range(120)])
    table = pii.surrogate_table(pii.find(docs), KEY).collect()
    assert len({r.surrogate for r in table}) == len(table) == len({(r.kind, r.entity) for r in table}) == 359  # 10.0.0.7 twice
    assert all(r.surrogate != r.entity for r in table)
    assert pii.formatted("ipv4", "1.2.3.4", KEY) == pii.formatted("ipv4", "1.2.3.4", KEY) != pii.formatted("ipv4", "1.2.3.4", b"other key")


def test_collisions_are_drawn_again(docs_of, monkeypatch):
    docs = docs_of([(i, f"Mr. N{chr(97 + i % 26)}{chr(97 + i // 26)}o", "s") for i in range(400)])
    table = pii.surrogate_table(pii.find(docs), KEY).collect()
    assert len(table) == 400 == len({r.surrogate for r in table})
    few = [pii.draw("name_m", f"n{i}", 0, KEY) for i in range(20_000)]
    assert len(set(few)) < len(few)  # so there is something to draw again for


def test_permutations_have_no_fixed_point_and_lose_nothing():
    for size in (2, 3, 10, 97, 1000, 4097):
        to = [pii.permuted(KEY, "t", size, x) for x in range(size)]
        assert sorted(to) == list(range(size)) and all(a != b for a, b in enumerate(to))


def test_a_full_pool_of_a_format(spark):
    """All 10,000 six-digit secrets that begin with 12: as many surrogates, none of them another one's, none its own."""
    step = {f"{n:06d}": pii.formatted("secret", f"{n:06d}", KEY) for n in range(120_000, 130_000)}
    assert len(set(step.values())) == len(step) and all(a != b and b.isdigit() and len(b) == 6 for a, b in step.items())
    found = spark.range(1000).selectExpr("'passport' AS kind", "lpad(id, 3, '0') AS entity")
    table = pii.surrogate_table(found, KEY).collect()  # the whole pool of three digits
    assert {r.surrogate for r in table} == {f"{n:03d}" for n in range(1000)} and all(r.surrogate != r.entity for r in table)


def test_formats_stay_what_they_are():
    rng = random.Random(3)
    made = {"card": [], "iban": [], "phone": [], "ipv4": [], "ipv6": [], "mac": [], "birth": [], "secret": [], "ssn": []}
    for _ in range(60):
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        made["card"].append(digits + pii.luhn_digit(digits))
        rest = "".join(rng.choice("0123456789") for _ in range(18))
        made["iban"].append("DE" + pii.iban_check("DE", rest) + rest)
        made["phone"].append("1" + rng.choice("23456789") + rest[:9])
        made["ipv4"].append(rng.choice(["10.1.2.", "192.168.7.", "8.8.4.", "172.20.1."]) + str(rng.randrange(256)))
        made["ipv6"].append(f"2001:0db8:0000:0000:0000:0000:{rng.randrange(65536):04x}:0001")
        made["mac"].append(f"{rng.randrange(1 << 48):012x}")
        made["birth"].append(f"19{rng.randrange(10, 99)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}")
        made["secret"].append(rng.choice(["AKIA", ""]) + "".join(rng.choice("abcdefXYZ0123456789") for _ in range(16)))
        made["ssn"].append(rest[:9])
    for kind, entities in made.items():
        out = {e: pii.formatted(kind, e, KEY) for e in entities}
        assert len(set(out.values())) == len(out) and all(a != b and len(a) == len(b) or kind == "ipv4" for a, b in out.items())
        for a, b in out.items():
            assert pii.canonical(kind, b) == b
            assert kind != "ipv4" or pii._ip_class(a) == pii._ip_class(b)
            assert kind != "secret" or [(c.isdigit(), c.isupper()) for c in a] == [(c.isdigit(), c.isupper()) for c in b]


def brute_replace(rows, key):
    """Every entity's surrogate by plain dictionaries, one attempt after the other over all entities."""
    found = [pii.entities(t) for _, t in rows]
    genders = {}
    for x in (x for f in found for x in f if x[2] in ("name_m", "name_f")):
        genders.setdefault(x[3], set()).add(x[2])
    as_kind = lambda x: next(iter(genders[x[3]])) if x[2] == "name_u" and len(genders.get(x[3], ())) == 1 else x[2]
    table, todo = {}, {(as_kind(x), x[3]) for f in found for x in f if x[2] in pii.DRAWN}
    real, attempt = {(k.split("_")[0], e) for k, e in todo}, 0
    while todo:
        drawn = sorted((k.split("_")[0], pii.draw(k, e, attempt, key), e, k) for k, e in todo)
        used, before = set(), {(k.split("_")[0], v) for (k, _), v in table.items()}
        for cls, v, e, k in drawn:
            if (cls, v) not in used and (cls, v) not in real and (cls, v) not in before:
                table[k, e] = v
            used.add((cls, v))
        todo, attempt = {x for x in todo if x not in table}, attempt + 1
    out = []
    for (i, text), spans in zip(rows, found, strict=True):
        for a, b, k, e, part in reversed(spans):
            new = table[as_kind((a, b, k, e)), e] if k in pii.DRAWN else pii.formatted(k, e, key)
            text = text[:a] + pii.dress(k, text[a:b], new, part) + text[b:]
        out.append((i, len(spans), text))
    return out


def test_replace_equals_brute_force(docs_of):
    more = ["Mr. John Smith met Smith. John Smith left; John came back", "Dr Ana Lopez", "Mrs. Ana Lopez and Ana", "passport no. X1234567, born on 1975-03-09", "MAC 00:1A:2B:3C:4D:5E at fe80::1ff:fe23:4567:890a", "Κύριος Νίκος Παππάς, και Παππάς", "我见王小明先生"]
    rows = list(enumerate((TEXTS + more) * 2 + [f"Herr {a}{b} schrieb" for a in "ABCDEFGH" for b in ("ndt", "lba")]))
    got = sorted((r.doc_id, r.n_entities, r.text) for r in pii.replace(docs_of([(i, t, "s") for i, t in rows]), KEY).collect())
    assert got == sorted(brute_replace(rows, KEY))
    new = {i: t for i, _, t in got}[len(TEXTS)]
    assert "Smith" not in new and "John" not in new
    first, last = new.split()[1:3]
    assert new.split()[4] == f"{last}." and new.split()[5:7] == [first, last] and new.split()[8] == first
    greek, han = {i: t for i, _, t in got}[len(TEXTS) + 5], {i: t for i, _, t in got}[len(TEXTS) + 6]
    assert pii.script_of(greek.split()[1]) == "greek" == pii.script_of(greek.split()[-1]) and pii.script_of(han[2]) == "cjk"


def test_pii_of_awkward_and_empty_tables(awkward):
    assert pii.replace(awkward, KEY).count() == awkward.count()
    assert pii.replace(awkward.limit(0), KEY).count() == 0

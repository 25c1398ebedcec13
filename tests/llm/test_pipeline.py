from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from fluxweave.llm import mixing, ordinal_quality, packing, queries
from fluxweave.llm.common import words_of

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found) and set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names
            docs = corpus_pipeline.materialise(out, "test")
            counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    taken = Counter(r.doc_id for r in docs.collect())
    assert max(taken.values()) <= 2
    pieces = out.collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == taken


def brute_targets(sizes):
    """Targets by raising one level until the budget is spent."""
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else weight[s] * level
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    return target


def test_run_matches_brute_force(spark):
    """Each stage's decisions in plain Python over the whole of a small input, then the pieces of what the mix takes."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    w, theta = ordinal_quality.train(docs, labels)
    score = lambda text: (lambda at, v: (w[at] * v).sum())(*ordinal_quality.features(text, {}))
    good = [i for i, r in rows.items() if 1 / (1 + np.exp(theta[0] - score(r.text))) >= ordinal_quality.SELECT]
    last = {}
    for i in good:
        last[rows[i].text or ""] = max(i, last.get(rows[i].text or "", i))
    distinct = sorted(last.values())
    sets = {}
    for i in distinct:
        words = words_of(rows[i].text)
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else None
    root = {i: i for i in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in distinct:
        for b in distinct:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [i for i in distinct if find(i) == i]
    assert len(rows) > len(good) > len(kept) > 0

    judged = mixing.mix(docs.filter(docs.doc_id.isin(kept))).collect()
    sizes = Counter()
    for i in kept:
        sizes[rows[i].source] += len(words_of(rows[i].text))
    want = brute_targets(sizes)
    taken = Counter()
    for r in judged:
        assert r.size == len(words_of(rows[r.doc_id].text)) and 0 <= r.copies <= 2 and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.copies * r.size
    longest = max(r.size for r in judged)
    assert all(abs(taken[s] - want[s]) <= longest for s in want)  # sources of a few documents can't come nearer
    copies = {r.doc_id: r.copies for r in judged}

    slow, pieces = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), Counter()
    for i, n in copies.items():
        ids = np.array([*slow.encode(rows[i].text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 if len(ids) > 2048 else 0
        starts = [*([0] if first or len(ids) <= 2048 else []), *(range(first, len(ids), 2048) if len(ids) > 2048 else [])]
        for k, start in enumerate(starts):
            end = starts[k + 1] if k + 1 < len(starts) else len(ids)
            if n:
                pieces[i, k, start, end - start, zlib.crc32(ids[start:end].tobytes())] += n
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == pieces
    at = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0) and r.offset + r.length <= 2048
        at[r.sequence_id] = r.offset + r.length


def test_stages_of_awkward_and_empty_tables(spark, awkward):
    """Every stage takes null, empty and repeated rows and no row at all, whatever the other columns are called."""
    for docs in (awkward, awkward.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert (n > 0) == (docs.count() > 0) and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", [n for n in queries.ORACLES])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    cols = sorted(c[0] for c in want.description)
    expected = sorted(tuple(map(str, (dict(zip([c[0] for c in want.description], r, strict=True))[c] for c in cols))) for r in want.fetchall())
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == cols
    assert sorted(tuple(map(str, r)) for r in found.select(*cols).collect()) == expected

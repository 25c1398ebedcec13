"""Queries over whole tables: nothing of the input is left out."""

from __future__ import annotations

import __spark_entry__
from fluxweave.plans import views as V

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


def test_every_order_has_its_list(spark):
    found = {r.o_orderkey: r.n for r in run(spark, "stoichiometry_lists").collect()}
    want = {}
    for r in V.read(spark, SF, "lineitem").select("l_orderkey", "l_partkey").collect():
        want.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    assert max(want) >= 500
    assert found == {k: len(v) for k, v in want.items()}


def test_every_event_has_its_map(spark):
    found = sorted((r.event_id, r.j) for r in run(spark, "canonical_maps").collect())
    want = sorted((r.event_id, f'{{"a":"{r.event_type}","b":"{r.user_id}"}}') for r in V.read(spark, SF, "events").collect())
    assert want[-1][0] >= 500
    assert found == want


def signs_by_order(spark):
    flags = {}
    for r in V.read(spark, SF, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").collect():
        flags.setdefault(r.l_orderkey, {}).setdefault(f"p{r.l_partkey}", set()).add(r.l_returnflag)
    return {o: {p: min(f) != "R" for p, f in parts.items()} for o, parts in flags.items() if len(parts) > 1}


def test_every_order_is_a_gate(spark):
    found = {r.product: (r.pos, r.neg) for r in run(spark, "and_gate_compile").collect()}
    want = {f"y{o}": tuple(",".join(sorted(p for p, up in parts.items() if up == sign)) for sign in (True, False)) for o, parts in signs_by_order(spark).items()}
    assert len(want) > 40
    assert found == want


def test_every_order_is_a_reaction(spark):
    found = sorted(r.reaction for r in run(spark, "reaction_text").collect())
    want = sorted(" AND ".join([*sorted(p for p, up in parts.items() if up), *(f"NOT {p}" for p in sorted(p for p, up in parts.items() if not up))]) + f" -> y{o}" for o, parts in signs_by_order(spark).items())
    assert len(want) > 40
    assert found == want


def test_programs_over_the_whole_region_network(spark):
    """All 20 arcs. Scores of -2 and -1 one arc each from the start give -3 at best; two outputs, two arcs at least and the input's own."""
    arcs = V.region_trade(spark, SF).collect()
    sign = {(r.s, r.t): 1 if r.weight % 2 == 0 else -1 for r in arcs}
    assert len(sign) == 20
    assert {r["name"]: r["value"] for r in run(spark, "phonemes_small").collect()} == {"score": -3.0, "edges": 2.0}
    two = [(a, b) for a in sign for b in sign if a[0] == "0" and b[0] in ("0", a[1]) and a != b]
    ends = lambda a, b: {a[1]: sign[a], b[1]: sign[b] * (1 if b[0] == "0" else sign[a])}
    assert any(ends(a, b) == {"1": 1, "3": -1} for a, b in two)
    assert {r["name"]: r["value"] for r in run(spark, "carnival_small").collect()} == {"error": 0.0, "edges": 3.0}

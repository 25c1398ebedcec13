from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fluxweave.functions import scores as S
from fluxweave.operators import features as D
from fluxweave.sources import formats as IO


@pytest.fixture(scope="module")
def data(spark):
    return D.FeatureSet.of_mapping(spark, {"s1": {"A": {"value": 2, "mapping": "vertex", "role": "input", "note": "x"}, "B": {"value": None, "mapping": "edge", "role": "output"}}, "s2": {"A": {"value": -1, "mapping": "vertex", "role": "output"}, "C": {"value": 3, "mapping": "vertex", "role": "input"}}, "s3": {}})


def test_feature_queries(data):
    assert {r.value for r in data.pluck().collect()} == {"A", "B", "C"}
    none = data.filter(F.col("value") > 2)
    assert {r["sample"]: r.n_features for r in none.counts().collect()} == {"s1": 0, "s2": 1, "s3": 0}
    assert {(r.fid, r.value) for r in data.unique().collect()} == {("A", 2.0), ("B", None), ("C", 3.0)}
    assert {(r["sample"], r.fid) for r in data.unique_by_sample("mapping").collect()} == {("s1", "A"), ("s1", "B"), ("s2", "A")}
    assert {(r.fid, r.role) for r in data.roles().collect()} == {("A", "mixed"), ("C", "input")}
    assert data.sample("s2").features.count() == 2 == data.sample(1).features.count()
    with pytest.raises(KeyError):
        data.sample("zz")
    assert {r.value for r in data.map(value=F.col("value") * 2).pluck(F.col("value")).collect()} == {4.0, -2.0, 6.0, None}


def test_feature_additions_and_files(spark, tmp_path, data):
    again = data.features.limit(1)
    with pytest.raises(ValueError):
        data.add(again)
    more = data.add(again.withColumn("fid", F.lit("Z")))
    assert more.features.count() == 5
    back = D.FeatureSet.from_json(data.to_json())
    assert sorted(map(str, back.features.select(data.features.columns).collect())) == sorted(map(str, data.features.collect())) and back.samples.count() == 3
    g = IO.graph_from_tuples(spark, [("A", 1, "C")])
    IO.write_dataset(g, data, f"file://{tmp_path}/set")
    g2, d2 = IO.read_dataset(spark, f"file://{tmp_path}/set")
    assert g2.edges.count() == 1 and d2.features.count() == 4
    assert IO.condition_layers(data).count() == 3


def test_folds(spark):
    cells = spark.createDataFrame([(i, j, float((i * j) % 3)) for i in range(6) for j in range(8)], "r int, c int, x double")
    dealt = D.ranked_folds(cells, ["r", "c"], "x", 3)
    assert dealt.filter("(x = 0) <> (fold IS NULL)").count() == 0
    full, seen = cells.filter("x <> 0").count(), 0
    for f in range(3):
        m = D.fold_masks(dealt, "x", f)
        held = m.filter("isnan(train)").count()
        assert m.filter("x <> 0 AND isnan(train) = isnan(valid)").count() == 0 and m.filter("x = 0 AND (isnan(train) OR isnan(valid))").count() == 0
        seen += held
    assert seen == full
    assert D.hash_folds(cells, ["r", "c"], "x", 3).filter("fold IS NOT NULL").count() == full


CASES = [("A and (B or C)", 4), ("A or B", 5), ("A and B", 2), ("(A or B) and C", 4), ("A", 5), ("X", 0), ("A and", 0), ("", 0), ("A And B", 0), ("A and 3", 3), ("NA and NB", -2), ("NA or NB", -5), ("NA and A", -2), ("NA or A", 5), ("A or B and C", 5)]


def test_gene_rules(spark):
    samples = spark.createDataFrame([("s", {"A": 5.0, "B": 2.0, "C": 4.0, "NA": -2.0, "NB": -5.0})], "sample string, values map<string,double>")
    found = {r.id: r.score for r in S.evaluate_rules([(f"{i}", t) for i, (t, _) in enumerate(CASES)], samples).collect()}
    assert found == {f"{i}": float(want) for i, (_, want) in enumerate(CASES)}
    rules = spark.createDataFrame([("(b0001 and b0002) or b0001",), ("MTOR and AKT1",)], "r string")
    assert [r[0] for r in rules.select(S.genes(F.col("r"))).collect()] == [["b0001", "b0002"], ["MTOR", "AKT1"]]
    assert [r[0] for r in rules.select(S.genes(F.col("r"), "ecoli_bnumber")).collect()] == [["b0001", "b0002"], []]


def test_site_scores(spark):
    rows = spark.createDataFrame([("c", 0.005, 2.0), ("c", 0.05, -2.0), ("c", 0.5, 0.2)], "condition string, p double, fold_change double")
    assert [round(r.score, 9) for r in S.site_scores(rows).collect()] == [round(x, 9) for x in (-math.log2(10), 0.0, math.log2(10))]
    up = S.site_scores(rows.withColumn("p", F.lit(0.005)), change="up", fold_threshold=1.0).collect()
    assert [r.score < 0 for r in up] == [True, False, False]
    assert [r.score for r in S.site_scores(rows, by=["condition"]).orderBy("p").collect()] == [-1.0, 0.0, 1.0]


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()[0]
    assert get(S.signed_error(F.lit(-2.0), F.lit(1))) == 4.0 and get(S.signed_error(F.lit(2.0), F.lit(0))) == 2.0
    assert [get(S.sign(F.lit(x))) for x in ("-3", "0", "abc", None)] == [-1, 1, 1, 1]
    assert get(S.reaction_text(F.array(F.lit("A")), F.array(F.lit("B")), F.lit("Y"))) == "A AND NOT B -> Y"
    assert get(S.canonical_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == '{"a":2,"b":1}'
    assert get(S.subsystem(F.lit("[array(['Glycolysis'], dtype='<U10'), array(['TCA'])]"))) == ["Glycolysis", "TCA"]
    rows = spark.createDataFrame([("g", float(x)) for x in (-4, 0, 1, 2)], "k string, v double")
    scaled = {r.v: round(r.scaled, 6) for r in S.scaled_magnitude(rows, "v", ["k"]).collect()}
    assert scaled == {-4.0: 1.0, 0.0: 0.0, 1.0: round(math.log(2) / math.log(5), 6), 2.0: round(math.log(3) / math.log(5), 6)}
    assert {r.v: r.clipped for r in S.clipped(rows, "v", ["k"], 0.25).collect()} == {-4.0: -1.0, 0.0: 0.0, 1.0: 1.0, 2.0: 1.25}
    met = spark.createDataFrame([("r", "b", 1.0), ("r", "a", -1.0)], "reaction string, metabolite string, coef double")
    assert [tuple(x) for x in S.stoichiometry(met).first().metabolites] == [("a", -1.0), ("b", 1.0)]


def test_gene_presets(spark):
    rules = spark.createDataFrame([("mtor_1 and (AKT1 or 7x) and HLA.A:b-2",), ("P12345 or A1B2C3 or Q9",), (None,)], "r string")
    of = lambda preset: [r[0] for r in rules.select(S.genes(F.col("r"), preset)).collect()]
    assert of("symbol_simple")[0] == ["mtor_1", "AKT1", "7x", "HLA", "A", "b", "2"]
    assert of("symbol_extended")[0] == ["mtor_1", "AKT1", "7x", "HLA.A:b-2"]
    assert of("uniprot_acc") == [[], ["P12345", "A1B2C3"], None]
    assert {r.gene for r in S.unique_genes(rules, "r", "uniprot_acc").collect()} == {"P12345", "A1B2C3"}


def test_scaling_of_bounds_zeros_and_null_groups(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), (None, 4.0), (None, 4.0)], "k string, v double")
    at = lambda how: sorted((r.k or "", r.v, round(r.scaled, 6)) for r in S.scaled_magnitude(rows, "v", ["k"], how, 1.0).collect())
    assert at(None) == [("", 4.0, 1.0), ("", 4.0, 1.0), ("a", 1.0, 0.5), ("a", 2.0, 1.0), ("b", 0.0, 0.0), ("b", 0.0, 0.0)]
    assert at("std") == at(None)
    scaled = sorted((r.k or "", r.w) for r in rows.select("k", S.rescaled(F.col("v"), ["k"]).alias("w")).collect())
    assert scaled[-2:] == [("b", 0.0), ("b", 0.0)] and scaled[:2] == [("", 50.0), ("", 50.0)]

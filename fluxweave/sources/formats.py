"""Readers and writers: SIF, tuples, incidence matrices, SBML, JSON, Parquet, interchange lists and DOT text."""

from __future__ import annotations

from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGES, SIDE, VERTICES, NetGraph, conform, ends, side
from ..operators.checks import require
from ..operators.features import FeatureSet
from ..operators.graph import incidence
from ..storage import dense_index


def read_sif(spark: SparkSession, path: str, delimiter: str = "\t", header: bool = False, columns: tuple[int, int, int] = (0, 1, 2), self_loops: bool = False, distinct: bool = False) -> DataFrame:
    """(s, interaction, t) of a signed arc file. A row with too few columns or a sign that is no integer is an error; repeated
    rows stay unless `distinct`."""
    names = [f"c{i}" for i in range(max(columns) + 1)]
    raw = spark.read.csv(path, sep=delimiter, header=header, schema=", ".join(f"{n} string" for n in names), mode="PERMISSIVE")
    s, sign, t = (F.col(names[i]) for i in columns)
    short = F.when(s.isNull() | sign.isNull() | t.isNull(), F.raise_error("a row has too few columns")).cast("string")
    rows = raw.select(F.coalesce(short, F.trim(s)).alias("s"), F.trim(sign).cast("int").alias("interaction"), F.trim(t).alias("t"))
    rows = rows if self_loops else rows.filter("s <> t")
    return rows.distinct() if distinct else rows


def graph_from_sif(spark: SparkSession, path: str, **how) -> NetGraph:
    return NetGraph.of_arcs(read_sif(spark, path, **how), order=["s", "interaction", "t"])


def graph_from_tuples(spark: SparkSession, rows: list[tuple]) -> NetGraph:
    """From (s, t) or (s, sign, t), the index following the list."""
    wide = len(rows[0]) == 3 if rows else False
    made = [(i, str(r[0]), str(r[-1]), int(r[1]) if wide else None) for i, r in enumerate(rows)]
    arcs = spark.createDataFrame(made, "eix long, s string, t string, interaction int")
    return NetGraph.of_edges(arcs.select("eix", side(F.col("s")).alias("src"), side(F.col("t")).alias("tgt"), "interaction"))


def graph_from_incidence(entries: DataFrame, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> NetGraph:
    """From (v, eix, a): negative entries are sources and positive ones targets, with their sizes as coefficients.

    Given vertices(v) or edges(eix), an entry of any other is an error; edges without an entry have no ends, vertices without
    one are there all the same."""
    item = F.struct("v", F.abs("a").alias("coef"))
    for known, key in ((vertices, "v"), (edges, "eix")):
        if known is not None:
            require(entries.join(known.select(key), key, "left_anti"), f"an entry's {key} is unknown")
    group = entries.filter("a <> 0").groupBy("eix").agg(F.array_sort(F.collect_list(F.when(F.col("a") < 0, item))).alias("src"), F.array_sort(F.collect_list(F.when(F.col("a") > 0, item))).alias("tgt"))
    if edges is not None:
        group = edges.select("eix").join(group, "eix", "left").select("eix", F.coalesce("src", F.array().cast(SIDE)).alias("src"), F.coalesce("tgt", F.array().cast(SIDE)).alias("tgt"))
    return NetGraph.of_edges(group, vertices)


def graph_from_reactions(reactions: DataFrame, stoichiometry: DataFrame) -> NetGraph:
    """From reactions(id, lb, ub, gpr[, attrs]) and stoichiometry(id, metabolite, coef)."""
    item = F.struct(F.col("metabolite").alias("v"), F.abs("coef").alias("coef"))
    sides = stoichiometry.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("coef") < 0, item))).alias("src"), F.array_sort(F.collect_list(F.when(F.col("coef") > 0, item))).alias("tgt"))
    rows = reactions.join(sides, "id", "left").select("id", F.col("lb").alias("default_lb"), F.col("ub").alias("default_ub"), "gpr", *(["attrs"] if "attrs" in reactions.columns else []), F.coalesce("src", F.array().cast(SIDE)).alias("src"), F.coalesce("tgt", F.array().cast(SIDE)).alias("tgt"))
    return NetGraph.of_edges(dense_index(rows, ["id"], "eix"))


def _gene_rule(inner: pd.Series) -> pd.Series:
    """The and/or text of a gene association's inner XML, in which products are named by id; null where there is none. Nesting has no
    bound, so this can't be a schema; a row is one reaction."""

    def text(x: ET.Element) -> str | None:
        kind = x.tag.rsplit("}", 1)[-1]
        if kind == "geneProductRef":
            return next((v for k, v in x.attrib.items() if k.rsplit("}", 1)[-1] == "geneProduct"), None)
        parts = [p for p in map(text, x) if p]
        if len(parts) < 2 or kind not in ("and", "or"):
            return parts[0] if parts else None
        return "(" + f" {kind} ".join(parts) + ")"

    def rule(xml: str | None) -> str | None:
        if not xml or not xml.strip():
            return None
        found = text(ET.fromstring(f'<r xmlns:fbc="fbc">{xml}</r>'))
        return found[1:-1] if found and found.startswith("(") else found

    return inner.map(rule, na_action="ignore")


def read_sbml(spark: SparkSession, path: str, prefixes: bool = True) -> NetGraph:
    """A metabolic model from SBML: products and reactants become the sides; flux bounds, gene rules and the subsystem attributes.

    A gene rule is the reaction's gene association, its products named by label where they have one, or else the notes' line
    GENE_ASSOCIATION (GENE ASSOCIATION). The subsystem is the notes' line SUBSYSTEM, kept in attrs with the reaction's name. Without `prefixes`, a leading
    R_, M_ or G_ is taken off ids.
    """
    species = "struct<_species:string,_stoichiometry:double>"
    schema = f"_id string, _name string, `_fbc:lowerFluxBound` string, `_fbc:upperFluxBound` string, notes string, `fbc:geneProductAssociation` string, listOfReactants struct<speciesReference:array<{species}>>, listOfProducts struct<speciesReference:array<{species}>>"
    load = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    bare = lambda c, letter: c if prefixes else F.regexp_replace(c, f"^{letter}_", "")
    raw, bounds = load("reaction", schema), load("parameter", "_id string, _value double")
    pair = lambda c, sign: F.transform(F.coalesce(F.col(f"{c}.speciesReference"), F.array().cast(f"array<{species}>")), lambda x: F.struct(bare(x["_species"], "M").alias("metabolite"), (F.coalesce(x["_stoichiometry"], F.lit(1.0)) * sign).alias("coef")))
    noted = lambda key: F.nullif(F.trim(F.regexp_extract("notes", key + r":\s*([^<]*)", 1)), F.lit(""))
    said = F.when(F.col("`fbc:geneProductAssociation`").isNotNull(), F.pandas_udf(_gene_rule, "string")(F.col("`fbc:geneProductAssociation`")))
    subsystem, name = noted("SUBSYSTEM"), F.nullif(F.trim("_name"), F.lit(""))
    attrs = F.map_filter(F.create_map(F.lit("subsystem"), subsystem, F.lit("name"), name), lambda _, x: x.isNotNull())
    rows = raw.select(F.col("_id").alias("id"), F.col("`_fbc:lowerFluxBound`").alias("lo"), F.col("`_fbc:upperFluxBound`").alias("hi"), said.alias("said"), noted("GENE[_ ]ASSOCIATION").alias("noted"), F.when(F.size(attrs) > 0, attrs).alias("attrs"), F.concat(pair("listOfReactants", -1), pair("listOfProducts", 1)).alias("both"))
    lo, hi = bounds.select(F.col("_id").alias("lo"), F.col("_value").alias("lb")), bounds.select(F.col("_id").alias("hi"), F.col("_value").alias("ub"))
    # a rule's words, of which those that are products get their labels
    products = load("fbc:geneProduct", "`_fbc:id` string, `_fbc:label` string").select(F.col("`_fbc:id`").alias("word"), F.coalesce("`_fbc:label`", "`_fbc:id`").alias("label"))
    words = rows.select("id", F.posexplode(F.regexp_extract_all("said", F.lit(r"[()]|[^\s()]+"), F.lit(0))).alias("at", "word")).join(products.dropDuplicates(["word"]), "word", "left")
    word = bare(F.coalesce("label", "word"), "G")
    labelled = words.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", word.alias("word")))), lambda x: x["word"]), " ").alias("gpr"))
    tidy = F.regexp_replace(F.regexp_replace("gpr", r"\( ", "("), r" \)", ")")
    full = rows.join(lo, "lo", "left").join(hi, "hi", "left").join(labelled, "id", "left")
    reactions = full.select(bare(F.col("id"), "R").alias("id"), "lb", "ub", F.coalesce(tidy, F.when(F.col("said").isNull(), F.col("noted"))).alias("gpr"), "attrs")
    return graph_from_reactions(reactions, rows.select(bare(F.col("id"), "R").alias("id"), F.explode("both").alias("x")).select("id", "x.metabolite", "x.coef"))


def write_graph(g: NetGraph, path: str, compression: str = "zstd") -> None:
    g.edges.write.option("compression", compression).parquet(f"{path}/edges")
    g.vertices.write.option("compression", compression).parquet(f"{path}/vertices")


def read_graph(spark: SparkSession, path: str) -> NetGraph:
    return NetGraph(spark.read.schema(EDGES).parquet(f"{path}/edges"), spark.read.schema(VERTICES).parquet(f"{path}/vertices"))


def graph_json(g: NetGraph) -> DataFrame:
    """(kind, ix, json): a JSON line for each vertex and edge; ids stay strings on either side."""
    v = g.vertices.select(F.lit("vertex").alias("kind"), F.col("vix").alias("ix"), F.to_json(F.struct("vix", "v", "attrs")).alias("json"))
    return v.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("eix").alias("ix"), F.to_json(F.struct(*g.edges.columns)).alias("json")))


def graph_from_json(lines: DataFrame) -> NetGraph:
    read = lambda kind, schema: lines.filter(F.col("kind") == kind).select(F.from_json("json", schema).alias("x")).select("x.*")
    return NetGraph(conform(read("edge", EDGES)), read("vertex", VERTICES))


def save_json(g: NetGraph, path: str, compression: str = "gzip") -> None:
    graph_json(g).write.option("compression", compression).json(path)


def load_json(spark: SparkSession, path: str) -> NetGraph:
    return graph_from_json(spark.read.schema("kind string, ix long, json string").json(path))


def write_dataset(g: NetGraph, features: FeatureSet, path: str) -> None:
    """A graph and its features under one folder."""
    write_graph(g, f"{path}/graph")
    features.features.write.parquet(f"{path}/features")
    features.samples.write.parquet(f"{path}/samples")


def read_dataset(spark: SparkSession, path: str) -> tuple[NetGraph, FeatureSet]:
    return read_graph(spark, f"{path}/graph"), FeatureSet(spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/samples"))


def edge_list(g: NetGraph, skip_hyperedges: bool = False) -> DataFrame:
    """(s, t, edge_type, interaction, weight, attrs) for exchange with graph libraries; a hyperedge or a boundary is an error
    unless skipped."""
    plain = (F.size("src") == 1) & (F.size("tgt") == 1)
    edges = g.edges.filter(plain) if skip_hyperedges else g.edges.withColumn("edge_type", F.when(plain, F.col("edge_type")).otherwise(F.raise_error("not a plain edge").cast("string")))
    return edges.select(F.get(ends("src"), 0).alias("s"), F.get(ends("tgt"), 0).alias("t"), "edge_type", "interaction", "weight", "attrs")


def graph_from_edge_list(rows: DataFrame) -> NetGraph:
    """Back from (s, t[, edge_type, interaction, weight, attrs]): the index follows the ends and what else is given but attributes;
    parallel edges stay. A row without an end is an error."""
    order = [c for c in ("s", "t", "edge_type", "interaction", "weight") if c in rows.columns]
    checked = rows.withColumn("s", F.when(F.col("s").isNull() | F.col("t").isNull(), F.raise_error("an edge lacks an end").cast("string")).otherwise(F.col("s").cast("string")))
    kind = F.coalesce("edge_type", F.lit("directed")) if "edge_type" in rows.columns else F.lit("directed")
    extras = [c for c in ("interaction", "weight", "attrs") if c in rows.columns]
    numbered = dense_index(checked, order, "eix")
    return NetGraph.of_edges(numbered.select("eix", side(F.col("s")).alias("src"), side(F.col("t").cast("string")).alias("tgt"), kind.alias("edge_type"), *extras))


def graph_from_layers(rows: DataFrame, layer: str | None = None) -> NetGraph:
    """Back from (layer, source, target, weight), of one layer or of all: the weight is every end's coefficient and the edge's
    weight, the layer an attribute."""
    ends_of = lambda c: F.transform(c, lambda x: F.struct(x.alias("v"), F.col("weight").cast("double").alias("coef"))).cast(SIDE)
    kept = rows if layer is None else rows.filter(F.col("layer") == layer)
    numbered = dense_index(kept, ["layer", "source", "target", "weight"], "eix")
    return NetGraph.of_edges(numbered.select("eix", ends_of("source").alias("src"), ends_of("target").alias("tgt"), "weight", F.create_map(F.lit("layer"), F.col("layer")).alias("attrs")))


def layered_edges(g: NetGraph, layer: str = "default") -> DataFrame:
    """(layer, source, target, weight): an edge list with a layer; edges need both ends, and a single coefficient that all ends
    of an edge share becomes its weight."""
    coefs = F.array_distinct(F.transform(F.concat("src", "tgt"), lambda x: x["coef"]))
    bad = F.when((F.size("src") == 0) | (F.size("tgt") == 0), F.raise_error("an edge lacks a side")).cast("string")
    return g.edges.select(F.coalesce(bad, F.lit(layer)).alias("layer"), ends("src").alias("source"), ends("tgt").alias("target"), F.coalesce("weight", F.when(F.size(coefs) == 1, F.get(coefs, 0))).alias("weight"))


def condition_layers(features: FeatureSet) -> DataFrame:
    """(layer, v, role, value): conditions as layers."""
    return features.features.filter("mapping = 'vertex'").select(F.col("sample").alias("layer"), F.col("fid").alias("v"), "role", "value")


def condition_results(observed: DataFrame, predicted: DataFrame, reactions: DataFrame) -> DataFrame:
    """(condition, error, n_selected, n_active) from observed and predicted(condition, v, value) and reactions(condition, rid,
    selected, active)."""
    error = observed.alias("o").join(predicted.alias("p"), ["condition", "v"]).groupBy("condition").agg(F.sum(F.abs(F.col("p.value") - F.col("o.value"))).alias("error"))
    counts = reactions.groupBy("condition").agg(F.sum(F.col("selected").cast("long")).alias("n_selected"), F.sum(F.col("active").cast("long")).alias("n_active"))
    return error.join(counts, "condition", "full")


def dot_lines(g: NetGraph) -> DataFrame:
    """(part, ix, line) of a DOT text: vertices first, then edges; a boundary side is a point, a hyperedge a centre node."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    nodes = g.vertices.select(F.lit(0).alias("part"), F.col("vix").alias("ix"), F.concat(F.lit("  "), quote(F.col("v")), F.lit(";")).alias("line"))
    head = F.when(F.col("edge_type") == "undirected", "none").when(F.col("interaction") < 0, "tee").otherwise("normal")
    plain = (F.size("src") == 1) & (F.size("tgt") == 1)
    one = g.edges.filter(plain).select(F.lit(1).alias("part"), F.col("eix").alias("ix"), F.concat(F.lit("  "), quote(F.get(ends("src"), 0)), F.lit(" -> "), quote(F.get(ends("tgt"), 0)), F.lit(" [arrowhead="), head, F.lit("];")).alias("line"))
    centre = F.concat(F.lit('"e'), F.col("eix").cast("string"), F.lit('"'))
    many = g.edges.filter(~plain).select("eix", centre.alias("c"), head.alias("h"), "src", "tgt")
    dots = many.select(F.lit(1).alias("part"), F.col("eix").alias("ix"), F.concat(F.lit("  "), F.col("c"), F.lit(" [shape=point];")).alias("line"))
    out = many.select("eix", "c", F.explode("src").alias("x")).select(F.lit(1).alias("part"), F.col("eix").alias("ix"), F.concat(F.lit("  "), quote(F.col("x.v")), F.lit(" -> "), F.col("c"), F.lit(" [arrowhead=none];")).alias("line"))
    into = many.select("eix", "c", "h", F.explode("tgt").alias("x")).select(F.lit(1).alias("part"), F.col("eix").alias("ix"), F.concat(F.lit("  "), F.col("c"), F.lit(" -> "), quote(F.col("x.v")), F.lit(" [arrowhead="), F.col("h"), F.lit("];")).alias("line"))
    return nodes.unionByName(one).unionByName(dots).unionByName(out).unionByName(into)


def write_dot(g: NetGraph, path: str) -> None:
    """DOT text as part files whose lines are in order."""
    spark = g.edges.sparkSession
    head = spark.createDataFrame([(-1, 0, "digraph {"), (2, 0, "}")], "part int, ix long, line string")
    dot_lines(g).unionByName(head).orderBy("part", "ix", "line").select("line").write.text(path)


def coefficients(g: NetGraph) -> DataFrame:
    """(id, v, a): the stoichiometric matrix by reaction id."""
    return incidence(g.edges, values=True).join(g.edges.select("eix", "id"), "eix").groupBy("id", "v").agg(F.sum("a").alias("a"))

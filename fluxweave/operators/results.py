"""Result tables: solved subgraphs, plot models, styles, categories and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import NetGraph, ends
from .graph import edge_subgraph, incidence

#: Parts in which the first few items of a category are looked for.
PARTS = 256


def solved_subgraph(g: NetGraph, solution: DataFrame, tolerance: float = 1e-6) -> NetGraph:
    """The edges whose solved value(eix, value) isn't zero, and their ends."""
    return edge_subgraph(g, solution.filter(F.abs("value") > tolerance).select("eix").distinct())


def plot_model(g: NetGraph) -> tuple[DataFrame, DataFrame]:
    """nodes(node, kind) and links(eix, a, b, head): points for empty sides, a centre for each hyperedge, isolated vertices too."""
    head = F.when(F.col("edge_type") == "undirected", "none").when(F.col("interaction") < 0, "tee").otherwise("normal")
    name = lambda kind: F.concat(F.lit(f"{kind}"), F.col("eix").cast("string"))
    hyper = (F.size("src") > 1) | (F.size("tgt") > 1)
    e = g.edges.select("eix", ends("src").alias("s"), ends("tgt").alias("t"), head.alias("head"), hyper.alias("hyper"))
    full = lambda c, kind: F.when(F.size(c) == 0, F.array(name(kind))).otherwise(F.col(c))
    e = e.withColumns({"s": full("s", "__source_"), "t": full("t", "__target_")})
    plain = e.filter("NOT hyper").select("eix", F.get("s", 0).alias("a"), F.get("t", 0).alias("b"), "head")
    centre = name("__centre_")
    out = e.filter("hyper").select("eix", F.explode("s").alias("a"), centre.alias("b"), F.lit("none").alias("head"))
    into = e.filter("hyper").select("eix", centre.alias("a"), F.explode("t").alias("b"), "head")
    links = plain.unionByName(out).unionByName(into)
    points = e.select(F.explode(F.concat("s", "t")).alias("node")).filter(F.col("node").rlike("^__(source|target)_\\d+$")).select("node", F.lit("point").alias("kind"))
    centres = e.filter("hyper").select(centre.alias("node"), F.lit("centre").alias("kind"))
    return g.vertices.select(F.col("v").alias("node"), F.lit("vertex").alias("kind")).unionByName(points).unionByName(centres).distinct(), links


def edge_styles(values: DataFrame, positive: str = "red", negative: str = "blue", neutral: str = "gray", widest: float = 5.0) -> DataFrame:
    """(eix, colour, width) from (eix, value): colour by sign, width by size against the largest."""
    most = F.lit(values.agg(F.max(F.abs("value"))).first()[0])  # one number
    return values.select("eix", F.when(F.col("value") > 0, positive).when(F.col("value") < 0, negative).otherwise(neutral).alias("colour"), F.when(most > 0, 0.5 + (widest - 0.5) * F.abs("value") / most).otherwise(0.5).alias("width"))


def vertex_styles(g: NetGraph, roles: DataFrame, values: DataFrame, shapes: dict[str, str] | None = None) -> DataFrame:
    """(v, shape, colour): shape by role, colour by the value's sign; what the user gave wins over what was solved."""
    shapes = shapes or {"input": "invtriangle", "output": "square", "terminal": "diamond", "mixed": "hexagon"}
    table = F.create_map(*(F.lit(x) for kv in shapes.items() for x in kv))
    joined = g.vertices.join(roles.select(F.col("fid").alias("v"), "role"), "v", "left").join(values.select("v", "value"), "v", "left")
    return joined.select("v", F.coalesce(table[F.col("role")], F.lit("circle")).alias("shape"), F.when(F.col("value") > 0, "red").when(F.col("value") < 0, "blue").otherwise("white").alias("colour"))


def merged(solved: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Given values win over solved ones."""
    return solved.alias("s").join(given.alias("g"), key, "full").select(key, F.coalesce("g.value", "s.value").alias("value"))


def usage_categories(active: DataFrame, n_conditions: int, shown: int = 6) -> DataFrame:
    """(category, active_in, size, first): items by the number of conditions(item, condition) that use them."""
    uses = active.groupBy("item").agg(F.countDistinct("condition").alias("active_in"))
    kind = F.when(F.col("active_in") == n_conditions, "shared core").when(F.col("active_in") > 1, "partially shared").otherwise("context-specific")
    few = Window.partitionBy("active_in", "part").orderBy("item")
    parts = uses.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS))).withColumn("r", F.row_number().over(few))
    first = parts.filter(F.col("r") <= shown).groupBy("active_in").agg(F.slice(F.array_sort(F.collect_list("item")), 1, shown).alias("first"))  # of PARTS * shown items
    sizes = uses.withColumn("category", kind).groupBy("category", "active_in").agg(F.count("*").alias("size"))
    return sizes.join(first, "active_in").select("category", "active_in", "size", F.array_join("first", ",").alias("first"))


def top_by_size(rows: DataFrame, by: list[str], value: str, n: int, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs(value).desc(), tie))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def group_means(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n groups with the largest mean: a report, so a top-k."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean")).orderBy(F.col("mean").desc(), key).limit(n)


def ends_of(arcs: DataFrame) -> DataFrame:
    """(v, kind): inputs are sources that are no target, outputs targets that are no source, inner ones both."""
    s, t = arcs.select(F.col("s").alias("v")).distinct(), arcs.select(F.col("t").alias("v")).distinct()
    kinds = [(s.join(t, "v", "left_anti"), "input"), (t.join(s, "v", "left_anti"), "output"), (s.intersect(t), "inner")]
    out = None
    for df, kind in kinds:
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out


def observed_and_predicted(observed: DataFrame, predicted: DataFrame, signals: list[str]) -> DataFrame:
    """A row for each condition with o_<signal> and p_<signal>."""
    one = observed.select("condition", F.concat(F.lit("o_"), "v").alias("c"), "value").unionByName(predicted.select("condition", F.concat(F.lit("p_"), "v").alias("c"), "value"))
    return one.groupBy("condition").pivot("c", [f"{p}_{s}" for s in signals for p in "op"]).agg(F.first("value"))


def degrees(g: NetGraph) -> DataFrame:
    return incidence(g.edges).groupBy("v").agg(F.sum((F.col("side") == "s").cast("long")).alias("out_degree"), F.sum((F.col("side") == "t").cast("long")).alias("in_degree"))

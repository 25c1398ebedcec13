"""Score functions as Column expressions, and the gene-rule grammar compiled to them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gene id patterns.
GENE_PATTERNS = {
    "ecoli_bnumber": r"\bb\d{4}\b",
    "symbol_simple": r"\b(?!and\b|or\b)[A-Za-z0-9_]+\b",
    "symbol_extended": r"\b(?!and\b|or\b)[A-Za-z0-9_.:-]+\b",
    "uniprot_acc": r"\b(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9][A-Z0-9]{3}[0-9])\b",
}


def genes(rule: Column, pattern: str = "symbol_simple") -> Column:
    """The distinct genes of a rule, by preset name or pattern. `and` and `or` in lower case are no genes."""
    return F.array_distinct(F.regexp_extract_all(rule, F.lit(GENE_PATTERNS.get(pattern, pattern)), F.lit(0)))


def both(a: Column, b: Column) -> Column:
    """`and`: the smaller, or the larger of two negatives."""
    return F.when((a < 0) & (b < 0), F.greatest(a, b)).otherwise(F.least(a, b))


def either(a: Column, b: Column) -> Column:
    """`or`: the larger, or the smaller of two negatives."""
    return F.when((a < 0) & (b < 0), F.least(a, b)).otherwise(F.greatest(a, b))


def rule_column(rule: str | None, gene: Callable[[str], Column], default: float = 0.0, on_and=both, on_or=either) -> Column:
    """A rule compiled to a Column: `and` binds before `or`, both fold from the left, keywords are lower case, numbers stand for
    themselves. A gene that is missing (null) and a rule that isn't well-formed give the default."""
    tokens = re.findall(r"\(|\)|[^\s()]+", rule or "")
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("the rule ends early")
        at += 1
        return tokens[at - 1]

    def atom() -> Column:
        token = take()
        if token == "(":
            inner = chain("or")
            if take() != ")":
                raise ValueError("a bracket isn't closed")
            return inner
        if token in (")", "and", "or"):
            raise ValueError(token)
        if re.fullmatch(r"-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?", token):
            return F.lit(float(token))
        if not re.fullmatch(r"[^\W\d]\w*", token):
            raise ValueError(token)
        return F.coalesce(gene(token), F.lit(default))

    def chain(word: str) -> Column:
        part = (lambda: chain("and")) if word == "or" else atom
        out = part()
        while peek() == word:
            take()
            out = (on_or if word == "or" else on_and)(out, part())
        return out

    try:
        out = chain("or")
        if peek() is not None:
            raise ValueError(peek())
        return out
    except ValueError:
        return F.lit(default)


def evaluate_rules(rules: list[tuple[str, str]], samples: DataFrame, values: str = "values", default: float = 0.0) -> DataFrame:
    """(sample, id, score) of rules (id, text) over samples(sample, values map): rules are compiled once, in the driver, to
    one array of expressions, so that scoring stays in generated code without a join."""
    scored = [F.struct(F.lit(i).alias("id"), rule_column(text, lambda g: F.col(values)[g], default).alias("score")) for i, text in rules]
    return samples.select("sample", F.explode(F.array(*scored)).alias("x")).select("sample", "x.id", "x.score")


def unique_genes(rules: DataFrame, rule: str, pattern: str = "symbol_simple", prefix: str | None = None) -> DataFrame:
    """(gene): every gene of any rule of a table, once, or those that start with a prefix. Null rules have none."""
    found = rules.select(F.explode(genes(F.col(rule), pattern)).alias("gene")).distinct()
    return found if prefix is None else found.filter(F.col("gene").startswith(prefix))


def with_group(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Adds aggregates of each row's group. They are partial sums before any shuffle, so a group of any size is no hot task; null is
    a group too."""
    held = rows.groupBy(*(F.col(c).alias(f"__by{n}") for n, c in enumerate(by))).agg(*(v.alias(name) for name, v in values.items()))
    on = [rows[c].eqNullSafe(held[f"__by{n}"]) for n, c in enumerate(by)]
    same = on[0]
    for x in on[1:]:
        same = same & x
    return rows.join(held, same).drop(*(f"__by{n}" for n in range(len(by))))


def discretise(score: Column, low: float, high: float) -> Column:
    """+1 from high up, -1 from low down, else null."""
    return F.when(score >= high, 1).when(score <= low, -1)


def rescaled(weight: Column, by: list[str], total: float = 100.0) -> Column:
    """Weights scaled so that their sizes sum to `total` in each group; those of a group of zeros stay zero."""
    return F.coalesce(weight / F.nullif(F.sum(F.abs(weight)).over(Window.partitionBy(*by)), F.lit(0.0)) * total, weight)


def site_scores(rows: DataFrame, threshold: float = 0.05, change: str = "both", fold_threshold: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Adds `score` to rows(p, fold_change, ...).

    A site is supported if p is below the threshold and its fold change passes; the size is |log2(p / threshold)| and a
    supported site's sign is minus. Given `by`, negatives and positives are each scaled to a largest size of 1 in each group.
    """
    passes = {"both": F.abs("fold_change") >= fold_threshold, "up": F.col("fold_change") >= fold_threshold, "down": F.col("fold_change") <= -fold_threshold}[change]
    size = F.abs(F.log2(F.greatest(F.col("p"), F.lit(2.2250738585072014e-308)) / threshold))
    supported = (F.col("p") < threshold) & (passes if fold_threshold or change != "both" else F.lit(True))
    raw = rows.withColumn("score", F.when(supported, -size).otherwise(size))
    if by is None:
        return raw
    held = with_group(raw, by, __low=F.min("score"), __high=F.max("score"))
    scaled = F.when(F.col("score") < 0, -F.col("score") / F.col("__low")).when(F.col("score") > 0, F.col("score") / F.col("__high")).otherwise(F.col("score"))
    return held.withColumn("score", scaled).drop("__low", "__high")


def scaled_magnitude(rows: DataFrame, value: str, by: list[str], how: str | None = "log", threshold: float = 1e-6, clip: float = 0.0) -> DataFrame:
    """Adds `scaled`: sizes, those below the threshold set to 0, log1p or divided by the population deviation (unless that is 0),
    clipped at the (1 - clip) quantile of the non-zero ones, divided by the largest; per group."""
    x = rows.withColumn("scaled", F.when(F.abs(value) >= threshold, F.abs(value)).otherwise(0.0))
    if how == "log":
        x = x.withColumn("scaled", F.log1p("scaled"))
    elif how == "std":
        x = with_group(x, by, __dev=F.stddev_pop("scaled")).withColumn("scaled", F.coalesce(F.col("scaled") / F.nullif(F.col("__dev"), F.lit(0.0)), "scaled")).drop("__dev")
    some = F.when(F.col("scaled") > 0, F.col("scaled"))
    x = with_group(x, by, __top=F.percentile(some, F.lit(1 - clip)) if clip else F.max("scaled"))
    # the largest after clipping is the quantile itself
    return x.withColumn("scaled", F.when(F.col("__top") > 0, F.least("scaled", "__top") / F.col("__top")).otherwise(0.0)).drop("__top")


def clipped(rows: DataFrame, value: str, by: list[str], q: float) -> DataFrame:
    """Adds `clipped`: values held between the q and 1 - q quantiles of their group."""
    bounds = rows.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("__lo"), F.percentile(value, F.lit(1 - q)).alias("__hi"))
    return rows.join(bounds, by).withColumn("clipped", F.greatest(F.least(F.col(value), F.col("__hi")), F.col("__lo"))).drop("__lo", "__hi")


def signed_error(measured: Column, state: Column) -> Column:
    return F.abs(measured) * (1 - state * F.signum(measured))


def sign(text: Column, default: int = 1) -> Column:
    """+1 from 0 up, else -1; what can't be read gives the default."""
    x = text.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x), default).when(x >= 0, 1).otherwise(-1)


def reaction_text(pos: Column, neg: Column, product: Column) -> Column:
    """"A AND NOT B -> Y"."""
    return F.concat(F.array_join(F.concat(F.array_sort(pos), F.transform(F.array_sort(neg), lambda x: F.concat(F.lit("NOT "), x))), " AND "), F.lit(" -> "), product)


def canonical_json(m: Column) -> Column:
    """A map's JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def subsystem(text: Column) -> Column:
    """Names within ['...'] of a list written as text; nothing is evaluated."""
    return F.regexp_extract_all(text, F.lit(r"\['(.*?)'\]"), F.lit(1))


def stoichiometry(rows: DataFrame) -> DataFrame:
    """(reaction, metabolites): the (id, coefficient) pairs of each reaction, by id."""
    return rows.groupBy("reaction").agg(F.array_sort(F.collect_list(F.struct("metabolite", "coef"))).alias("metabolites"))

"""Optimisation models as tables, an expression algebra over them, and graph macros that emit their rows.

variables(name, r, c, lb, ub, vartype) · constraints(block, r, c, sense, rhs) · terms(block, r, c, name, vr, vc, coef) ·
objectives(oid, name, weight, const) · obj_terms(oid, name, vr, vc, coef). A constraint is identified by its block and cell, so
models are unions and no numbering is needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import arcs, incidence

VARIABLES = "name string, r long, c long, lb double, ub double, vartype string"
CONSTRAINTS = "block string, r long, c long, sense string, rhs double"
TERMS = "block string, r long, c long, name string, vr long, vc long, coef double"
CELLS = "r long, c long, name string, vr long, vc long, coef double"
INF = float("inf")


# --- expressions -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Expr:
    """An affine expression of a shape: cells(r, c, name, vr, vc, coef), constants having a null name."""

    cells: DataFrame
    rows: int
    cols: int = 1

    @staticmethod
    def constant(values: DataFrame, rows: int, cols: int = 1) -> Expr:
        none = F.lit(None)
        return Expr(values.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), none.cast("string").alias("name"), none.cast("long").alias("vr"), none.cast("long").alias("vc"), F.col("value").cast("double").alias("coef")), rows, cols)

    def _tidy(self, cells: DataFrame, rows: int | None = None, cols: int | None = None) -> Expr:
        summed = cells.groupBy("r", "c", "name", "vr", "vc").agg(F.sum("coef").alias("coef")).filter("coef <> 0")
        return Expr(summed, self.rows if rows is None else rows, self.cols if cols is None else cols)

    def _moved(self, r: Column, c: Column, rows: int, cols: int) -> Expr:
        return Expr(self.cells.withColumns({"r": r.cast("long"), "c": c.cast("long")}), rows, cols)

    def __add__(self, other: Expr) -> Expr:
        if (self.rows, self.cols) != (other.rows, other.cols):
            raise ValueError(f"shapes differ: {self.rows}x{self.cols} and {other.rows}x{other.cols}")
        return self._tidy(self.cells.unionByName(other.cells))

    def __neg__(self) -> Expr:
        return self * -1.0

    def __sub__(self, other: Expr) -> Expr:
        return self + -other

    def __mul__(self, k: float) -> Expr:
        return replace(self, cells=self.cells.withColumn("coef", F.col("coef") * float(k)))

    def __truediv__(self, k: float) -> Expr:
        return self * (1.0 / k)

    def multiply(self, factors: DataFrame) -> Expr:
        """Cell by cell with factors(r, c, value); a missing factor is 0."""
        return replace(self, cells=self.cells.join(factors.select("r", "c", F.col("value").alias("__f")), ["r", "c"]).withColumn("coef", F.col("coef") * F.col("__f")).drop("__f").select("r", "c", "name", "vr", "vc", "coef"))

    def left(self, matrix: DataFrame, rows: int) -> Expr:
        """matrix(i, j, a) @ self."""
        moved = self.cells.join(matrix, F.col("r") == F.col("j")).select(F.col("i").cast("long").alias("r"), "c", "name", "vr", "vc", (F.col("coef") * F.col("a")).alias("coef"))
        return self._tidy(moved, rows=rows)

    def right(self, matrix: DataFrame, cols: int) -> Expr:
        """self @ matrix(i, j, a)."""
        moved = self.cells.join(matrix, F.col("c") == F.col("i")).select("r", F.col("j").cast("long").alias("c"), "name", "vr", "vc", (F.col("coef") * F.col("a")).alias("coef"))
        return self._tidy(moved, cols=cols)

    def sum(self, axis: int | None = None) -> Expr:
        zero = F.lit(0).cast("long")
        if axis is None:
            return self._tidy(self.cells.withColumns({"r": zero, "c": zero}), 1, 1)
        return self._tidy(self.cells.withColumn("r", zero), 1, self.cols) if axis == 0 else self._tidy(self.cells.withColumn("c", zero), self.rows, 1)

    @property
    def T(self) -> Expr:  # noqa: N802
        return self._moved(F.col("c"), F.col("r"), self.cols, self.rows)

    def reshape(self, rows: int, cols: int) -> Expr:
        """Column by column; one size may be -1."""
        total = self.rows * self.cols
        rows, cols = (total // cols if rows == -1 else rows), (total // rows if cols == -1 else cols)
        if rows * cols != total:
            raise ValueError(f"{total} cells don't fit {rows}x{cols}")
        flat = F.col("c") * self.rows + F.col("r")
        return self._moved(flat % rows, F.floor(flat / rows), rows, cols)

    def vstack(self, other: Expr) -> Expr:
        if self.cols != other.cols:
            raise ValueError("the numbers of columns differ")
        low = other.cells.withColumn("r", F.col("r") + self.rows)
        return Expr(self.cells.unionByName(low), self.rows + other.rows, self.cols)

    def hstack(self, other: Expr) -> Expr:
        return self.T.vstack(other.T).T

    def take(self, rows: list[int] | None = None, cols: list[int] | None = None) -> Expr:
        """The given rows and columns, renumbered in that order."""
        out, r, c = self, self.rows, self.cols
        for axis, picked in (("r", rows), ("c", cols)):
            if picked is not None:
                table = F.create_map(*(F.lit(x) for k, old in enumerate(picked) for x in (old, k)))
                at = table[F.col(axis).cast("int")]
                out = replace(out, cells=out.cells.withColumn(axis, at.cast("long")).filter(F.col(axis).isNotNull()))
                r, c = (len(picked), c) if axis == "r" else (r, len(picked))
        return Expr(out.cells, r, c)

    def compare(self, block: str, sense: str, rhs: float = 0.0) -> tuple[DataFrame, DataFrame]:
        """(constraints, terms) of self <sense> rhs, cell by cell; constants move to the right. Cells without a term count too."""
        spark = self.cells.sparkSession
        grid = spark.range(self.rows).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.cols - 1).cast("long"))).alias("c"))
        moved = self.cells.filter("name IS NULL").groupBy("r", "c").agg(F.sum("coef").alias("k"))
        con = grid.join(moved, ["r", "c"], "left").select(F.lit(block).alias("block"), "r", "c", F.lit(sense).alias("sense"), (F.lit(float(rhs)) - F.coalesce("k", F.lit(0.0))).alias("rhs"))
        return con, self.cells.filter("name IS NOT NULL").select(F.lit(block).alias("block"), "r", "c", "name", "vr", "vc", "coef")

    def value(self, solution: DataFrame) -> DataFrame:
        """(r, c, value) under solution(name, r, c, value)."""
        s = solution.select(F.col("name").alias("__n"), F.col("r").alias("__r"), F.col("c").alias("__c"), "value")
        hit = self.cells.join(s, (F.col("name") == F.col("__n")) & (F.col("vr") == F.col("__r")) & (F.col("vc") == F.col("__c")), "left")
        part = F.when(F.col("name").isNull(), F.col("coef")).otherwise(F.col("coef") * F.coalesce("value", F.lit(0.0)))
        return hit.groupBy("r", "c").agg(F.sum(part).alias("value"))


def norm(values: DataFrame, order: float = 2) -> DataFrame:
    """(value) of a solved expression's cells(r, c, value): the sum of sizes (1), the length (2), the largest size (INF) or the root
    of the powers' sum. No cell gives 0."""
    size = F.abs("value")
    whole = F.max(size) if order == INF else F.pow(F.sum(F.pow(size, F.lit(float(order)))), F.lit(1.0 / order))
    return values.agg(F.coalesce(whole, F.lit(0.0)).alias("value"))


def largest(expr: Expr, solution: DataFrame, axis: int | None = None) -> DataFrame:
    """(r, c, value): the largest cell under a solution, of all (axis null), of each column (0) or of each row (1). Cells without a
    term are zeros and count."""
    spark = expr.cells.sparkSession
    grid = spark.range(expr.rows).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(expr.cols - 1).cast("long"))).alias("c"))
    full = grid.join(expr.value(solution), ["r", "c"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    zero = F.lit(0).cast("long")
    return full.groupBy((F.col("r") if axis == 1 else zero).alias("r"), (F.col("c") if axis == 0 else zero).alias("c")).agg(F.max("value").alias("value"))


# --- problems ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Problem:
    """The five tables, and named expressions."""

    variables: DataFrame
    constraints: DataFrame
    terms: DataFrame
    objectives: tuple[tuple[str, float, Expr], ...] = ()
    named: dict[str, Expr] = field(default_factory=dict)
    direction: str = "min"

    @staticmethod
    def empty(spark: SparkSession, direction: str = "min") -> Problem:
        return Problem(*(spark.createDataFrame([], s) for s in (VARIABLES, CONSTRAINTS, TERMS)), direction=direction)

    def add_variables(self, rows: DataFrame) -> Problem:
        return replace(self, variables=self.variables.unionByName(rows.select("name", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("lb").cast("double").alias("lb"), F.col("ub").cast("double").alias("ub"), "vartype")))

    def variable(self, name: str, rows: int, cols: int = 1, lb: float = -INF, ub: float = INF, vartype: str = "continuous") -> tuple[Problem, Expr]:
        """A grid of variables; a binary one ignores the bounds given."""
        spark = self.variables.sparkSession
        lb, ub = (0.0, 1.0) if vartype == "binary" else (lb, ub)
        grid = spark.range(rows).select(F.lit(name).alias("name"), F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("c"))
        return self.add_variables(grid.select("name", "r", "c", F.lit(lb).alias("lb"), F.lit(ub).alias("ub"), F.lit(vartype).alias("vartype"))), symbol(grid, rows, cols)

    def add(self, made: tuple[DataFrame, DataFrame]) -> Problem:
        con, terms = made
        return replace(self, constraints=self.constraints.unionByName(con), terms=self.terms.unionByName(terms))

    def subject_to(self, expr: Expr, block: str, sense: str, rhs: float = 0.0) -> Problem:
        return self.add(expr.compare(block, sense, rhs))

    def minimise(self, expr: Expr, weight: float = 1.0, name: str = "") -> Problem:
        return replace(self, objectives=(*self.objectives, (name or f"objective{len(self.objectives)}", float(weight), expr)))

    def reweighted(self, **weights: float) -> Problem:
        """Other weights for named objectives: what a parameter is here. The tables are shared, so a sweep states its program once."""
        absent = set(weights) - {name for name, _, _ in self.objectives}
        if absent:
            raise KeyError(f"no such objective: {sorted(absent)}")
        return replace(self, objectives=tuple((n, float(weights.get(n, w)), e) for n, w, e in self.objectives))

    def symbol(self, name: str) -> Expr:
        """The expression of a variable by its name; an error if there is none."""
        grid = self.variables.filter(F.col("name") == name)
        size = grid.agg(F.max("r"), F.max("c")).first()
        if size[0] is None:
            raise KeyError(name)
        return symbol(grid, size[0] + 1, size[1] + 1)

    def register(self, name: str, expr: Expr) -> Problem:
        if name in self.named:
            raise ValueError(f"{name} is registered already")
        return replace(self, named=self.named | {name: expr})

    def merge(self, other: Problem) -> Problem:
        """Both problems' rows; the direction is kept, and two different ones are an error."""
        if self.direction != other.direction:
            raise ValueError("the directions differ")
        return Problem(self.variables.unionByName(other.variables), self.constraints.unionByName(other.constraints), self.terms.unionByName(other.terms), self.objectives + other.objectives, self.named | other.named, self.direction)

    def with_suffix(self, suffix: str) -> Problem:
        """Every symbol, block and expression renamed."""
        more = lambda df, *cols: df.withColumns({c: F.concat(F.col(c), F.lit(suffix)) for c in cols})
        shift = lambda e: replace(e, cells=e.cells.withColumn("name", F.concat("name", F.lit(suffix))))
        return Problem(more(self.variables, "name"), more(self.constraints, "block"), more(self.terms, "block", "name"), tuple((n + suffix, w, shift(e)) for n, w, e in self.objectives), {n + suffix: shift(e) for n, e in self.named.items()}, self.direction)

    def objective_terms(self) -> DataFrame:
        """(name, vr, vc, coef) of the weighted sum, and its constant in a row without a name. Weights of 0 leave no objective."""
        out = None
        for _, weight, expr in self.objectives:
            part = expr.cells.select("name", "vr", "vc", (F.col("coef") * weight).alias("coef"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.variables.sparkSession.createDataFrame([], "name string, vr long, vc long, coef double")
        return out.groupBy("name", "vr", "vc").agg(F.sum("coef").alias("coef"))


def symbol(grid: DataFrame, rows: int, cols: int = 1) -> Expr:
    """The expression of variables listed as grid(name, r, c)."""
    return Expr(grid.select("r", "c", "name", F.col("r").alias("vr"), F.col("c").alias("vc"), F.lit(1.0).alias("coef")), rows, cols)


def evaluate(p: Problem, solution: DataFrame) -> tuple[DataFrame, DataFrame]:
    """violations(block, r, c, sense, rhs, lhs, violation) and objectives(name, weight, value) of a solution, whoever made it."""
    s = solution.select("name", F.col("r").alias("vr"), F.col("c").alias("vc"), "value")
    lhs = p.terms.join(s, ["name", "vr", "vc"], "left").groupBy("block", "r", "c").agg(F.sum(F.col("coef") * F.coalesce("value", F.lit(0.0))).alias("lhs"))
    gap = F.coalesce("lhs", F.lit(0.0)) - F.col("rhs")
    off = F.when(F.col("sense") == "=", F.abs(gap)).when(F.col("sense") == "<=", F.greatest(gap, F.lit(0.0))).otherwise(F.greatest(-gap, F.lit(0.0)))
    checked = p.constraints.join(lhs, ["block", "r", "c"], "left").withColumn("violation", off)
    values = None
    for name, weight, expr in p.objectives:
        row = expr.value(solution).agg(F.lit(name).alias("name"), F.lit(weight).alias("weight"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
        values = row if values is None else values.unionByName(row)
    return checked, values


# --- macros ------------------------------------------------------------------------------------------------------


def _rows(df: DataFrame, block: str, sense: str, rhs: Column) -> DataFrame:
    return df.select(F.lit(block).alias("block"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.lit(sense).alias("sense"), rhs.cast("double").alias("rhs"))


def _term(df: DataFrame, block: str, name: str, coef: Column, vr: Column | None = None, vc: Column | None = None) -> DataFrame:
    return df.select(F.lit(block).alias("block"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.lit(name).alias("name"), (F.col("r") if vr is None else vr).cast("long").alias("vr"), (F.col("c") if vc is None else vc).cast("long").alias("vc"), coef.cast("double").alias("coef"))


def _spread(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def flow(edges: DataFrame, vertices: DataFrame, n_flows: int = 1, lb: float = 0.0, ub: float = 1000.0, name: str = "flow", values: bool = False, shared: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variables, constraints, terms): a flow an edge and column, conserved at every vertex. Edges' own bounds win over lb and
    ub; with `shared`, the columns' sum keeps the first column's bounds too."""
    own = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in edges.columns else F.lit(default)
    e = _spread(edges.select(F.col("eix").alias("r"), own("default_lb", float(lb)).alias("lb"), own("default_ub", float(ub)).alias("ub")), n_flows)
    variables = e.select(F.lit(name).alias("name"), "r", "c", "lb", "ub", F.lit("continuous").alias("vartype"))
    con = _rows(_spread(vertices.select(F.col("vix").alias("r")), n_flows), f"{name}_balance", "=", F.lit(0.0))
    a = incidence(edges, values).join(vertices.select("vix", "v"), "v").select(F.col("vix").alias("r"), "eix", "a")
    a = a.groupBy("r", "eix").agg(F.sum("a").alias("a")).filter("a <> 0")
    terms = _term(_spread(a, n_flows), f"{name}_balance", name, F.col("a"), vr=F.col("eix"))
    if shared and n_flows > 1:
        first = e.filter("c = 0")
        for block, sense, rhs in ((f"{name}_shared_lb", ">=", "lb"), (f"{name}_shared_ub", "<=", "ub")):
            con = con.unionByName(_rows(first, block, sense, F.col(rhs)))
            terms = terms.unionByName(_term(e.withColumn("k", F.col("c")).withColumn("c", F.lit(0)), block, name, F.lit(1.0), vc=F.col("k")))
    return variables, con, terms


def indicator(variables: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A binary a variable: lb * I <= V <= ub * I. Bounds must be finite; one pinned to 0 pins its binary."""
    v = variables.select(F.col("name").alias("of"), "r", "c", _finite("lb").alias("lb"), _finite("ub").alias("ub"))
    pinned = (F.col("lb") == 0) & (F.col("ub") == 0)
    made = v.select(F.lit(name).alias("name"), "r", "c", F.lit(0.0).alias("lb"), F.when(pinned, 0.0).otherwise(1.0).alias("ub"), F.lit("binary").alias("vartype"))
    con, terms = None, None
    for block, sense, bound in ((f"{name}_lb", ">=", "lb"), (f"{name}_ub", "<=", "ub")):
        con_, one = _rows(v, block, sense, F.lit(0.0)), _of(v, block)
        both = one.unionByName(_term(v, block, name, -F.col(bound)))
        con, terms = (con_, both) if con is None else (con.unionByName(con_), terms.unionByName(both))
    return made, con, terms.filter("coef <> 0")


def _of(v: DataFrame, block: str, coef: float = 1.0) -> DataFrame:
    return _term(v, block, "", F.lit(coef)).drop("name").join(v.select("r", "c", F.col("of").alias("name")), ["r", "c"]).select("block", "r", "c", "name", "vr", "vc", "coef")


def _finite(c: str) -> Column:
    return F.when(F.abs(F.col(c)) == INF, F.raise_error("an indicator needs finite bounds").cast("double")).otherwise(F.col(c))


def nonzero_indicator(variables: DataFrame, name: str, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two exclusive binaries a variable, for its positive and negative direction:
    V >= lb * N + tol * P and V <= ub * P - tol * N; a direction that the bounds exclude is pinned."""
    v = variables.select(F.col("name").alias("of"), "r", "c", _finite("lb").alias("lb"), _finite("ub").alias("ub"))
    made = None
    for sign, can in (("_pos", F.col("ub") > 0), ("_neg", F.col("lb") < 0)):
        part = v.select(F.lit(name + sign).alias("name"), "r", "c", F.lit(0.0).alias("lb"), can.cast("double").alias("ub"), F.lit("binary").alias("vartype"))
        made = part if made is None else made.unionByName(part)
    tol = F.lit(float(tolerance))
    spec = [("_once", "<=", 1.0, None, F.lit(1.0), F.lit(1.0)), ("_low", ">=", 0.0, 1.0, -tol, -F.col("lb")), ("_high", "<=", 0.0, 1.0, -F.col("ub"), tol)]
    con, terms = None, None
    for tail, sense, rhs, own, pos, neg in spec:
        block = name + tail
        con_ = _rows(v, block, sense, F.lit(rhs))
        t = _term(v, block, f"{name}_pos", pos).unionByName(_term(v, block, f"{name}_neg", neg))
        t = t if own is None else t.unionByName(_of(v, block))
        con, terms = (con_, t) if con is None else (con.unionByName(con_), terms.unionByName(t))
    return made, con, terms.filter("coef <> 0")


def acyclic(edges: DataFrame, vertices: DataFrame, n: int, selected: str, n_vertices: int, name: str = "layer", negative: str | None = None, max_parents: int | DataFrame | None = None, bounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A layer from 0 to V - 1 a vertex and column; a selected edge's target is a layer later at least. Edges with two sides
    only; hyperedges are an error. A negative selection reverses the edge.

    max_parents, one number or a table (vix, n), bounds the selected edges, of either direction, that enter a vertex; boundary
    edges count, and undirected ones on both sides. bounds(vix, c, lb, ub) hold a vertex's layer closer; null leaves a side open, but never past 0 to V - 1.
    """
    big = float(n_vertices)
    layers = _spread(vertices.select(F.col("vix").alias("r")), n).withColumns({"lb": F.lit(0.0), "ub": F.lit(big - 1)})
    if bounds is not None:
        mine = bounds.select(F.col("vix").alias("r"), F.col("c").cast("long").alias("c"), F.col("lb").cast("double").alias("__lo"), F.col("ub").cast("double").alias("__hi"))
        layers = layers.join(mine, ["r", "c"], "left").withColumns({"lb": F.greatest("lb", "__lo"), "ub": F.least("ub", "__hi")})
    layers = layers.select(F.lit(name).alias("name"), "r", "c", "lb", "ub", F.lit("continuous").alias("vartype"))
    plain = edges.filter((F.size("src") > 0) & (F.size("tgt") > 0)).withColumn("edge_type", F.when((F.size("src") > 1) | (F.size("tgt") > 1), F.raise_error("a hyperedge can't be acyclic").cast("string")).otherwise("directed"))
    ix = vertices.select("vix", "v")
    pairs = arcs(plain).join(ix.select(F.col("vix").alias("a"), F.col("v").alias("s")), "s").join(ix.select(F.col("vix").alias("b"), F.col("v").alias("t")), "t")
    each = _spread(pairs.select(F.col("eix").alias("r"), "a", "b"), n)
    con, terms = None, None
    for var, head, tail, tag in [(selected, "b", "a", "fwd")] + ([(negative, "a", "b", "rev")] if negative else []):
        # L_head - L_tail >= x + (1 - V)(1 - x)  <=>  L_head - L_tail - V x >= 1 - V
        block = f"{name}_{tag}"
        c = _rows(each, block, ">=", F.lit(1.0 - big))
        t = _term(each, block, name, F.lit(1.0), vr=F.col(head)).unionByName(_term(each, block, name, F.lit(-1.0), vr=F.col(tail))).unionByName(_term(each, block, var, F.lit(-big)))
        con, terms = (c, t) if con is None else (con.unionByName(c), terms.unionByName(t))
    if max_parents is not None:
        most = ix.select(F.col("vix").alias("r"), F.lit(max_parents).alias("most")) if isinstance(max_parents, int) else max_parents.select(F.col("vix").alias("r"), F.col("n").alias("most"))
        enter = incidence(edges).filter("side = 't' OR edge_type = 'undirected'").select("eix", "v").distinct().join(ix, "v").select(F.col("vix").alias("r"), F.col("eix").alias("e"))
        into = _spread(enter.join(most, "r"), n)
        con = con.unionByName(_rows(into.select("r", "c", "most").distinct(), f"{name}_parents", "<=", F.col("most")))
        for var in (selected, negative) if negative else (selected,):
            terms = terms.unionByName(_term(into, f"{name}_parents", var, F.lit(1.0), vr=F.col("e")))
    summed = terms.groupBy("block", "r", "c", "name", "vr", "vc").agg(F.sum("coef").alias("coef"))
    return layers, con, summed


def gate(variables: DataFrame, kind: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One binary a row r that is the OR, AND or XOR of the binaries in its columns, as linear rows."""
    g = variables.select(F.col("name").alias("of"), "r", "c")
    n = g.groupBy("r").agg(F.count("*").cast("double").alias("n")).withColumn("c", F.lit(0).cast("long"))
    made = n.select(F.lit(name).alias("name"), "r", "c", F.lit(0.0).alias("lb"), F.lit(1.0).alias("ub"), F.lit("binary").alias("vartype"))
    many = lambda block: g.select(F.lit(block).alias("block"), "r", F.lit(0).cast("long").alias("c"), F.col("of").alias("name"), F.col("r").alias("vr"), F.col("c").alias("vc"), F.lit(1.0).alias("coef"))
    if kind == "xor":
        half = n.select(F.lit(f"{name}_half").alias("name"), "r", "c", F.lit(0.0).alias("lb"), F.floor(F.col("n") / 2).cast("double").alias("ub"), F.lit("integer").alias("vartype"))
        b = f"{name}_parity"
        return made.unionByName(half), _rows(n, b, "=", F.lit(0.0)), many(b).unionByName(_term(n, b, f"{name}_half", F.lit(-2.0))).unionByName(_term(n, b, name, F.lit(-1.0)))
    lo, hi = f"{name}_lo", f"{name}_hi"
    if kind == "or":  # sum <= n * OR, OR <= sum
        con = _rows(n, lo, "<=", F.lit(0.0)).unionByName(_rows(n, hi, ">=", F.lit(0.0)))
        return made, con, many(lo).unionByName(_term(n, lo, name, -F.col("n"))).unionByName(many(hi)).unionByName(_term(n, hi, name, F.lit(-1.0)))
    con = _rows(n, lo, ">=", F.lit(0.0)).unionByName(_rows(n, hi, "<=", F.col("n") - 1))  # n * AND <= sum, sum - AND <= n - 1
    return made, con, many(lo).unionByName(_term(n, lo, name, -F.col("n"))).unionByName(many(hi)).unionByName(_term(n, hi, name, F.lit(-1.0)))


def hamming(variables: DataFrame, reference: DataFrame) -> Expr:
    """The number of mismatches between binaries and reference(r, c, value), whose sizes are 0 or 1."""
    both = variables.join(reference, ["r", "c"])
    one = F.abs("value") > 0.5
    zero = F.lit(0).cast("long")
    linear = both.select(zero.alias("r"), zero.alias("c"), "name", F.col("r").alias("vr"), F.col("c").alias("vc"), F.when(one, -1.0).otherwise(1.0).alias("coef"))
    const = both.filter(one).agg(F.count("*").cast("double").alias("coef")).select(zero.alias("r"), zero.alias("c"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("vr"), F.lit(None).cast("long").alias("vc"), "coef")
    return Expr(linear.unionByName(const), 1, 1)


def acyclic_flow(edges: DataFrame, vertices: DataFrame, n_vertices: int, lb: float = 0.0, ub: float = 1000.0, tolerance: float = 1e-4) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """A flow, its non-zero indicators and the layers that keep what carries it from closing a cycle, as three parts."""
    carried = flow(edges, vertices, 1, lb, ub)
    on = nonzero_indicator(carried[0], "on", tolerance)
    return [carried, on, acyclic(edges, vertices, 1, "on_pos", n_vertices, negative="on_neg")]


def signed_edges(edges: DataFrame, n: int, name: str = "signal") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two exclusive binaries an edge and column: its value is the first minus the second, and it is selected if either is."""
    e = _spread(edges.select(F.col("eix").alias("r")), n)
    made = None
    for sign in ("_pos", "_neg"):
        part = e.select(F.lit(name + sign).alias("name"), "r", "c", F.lit(0.0).alias("lb"), F.lit(1.0).alias("ub"), F.lit("binary").alias("vartype"))
        made = part if made is None else made.unionByName(part)
    block = f"{name}_once"
    return made, _rows(e, block, "<=", F.lit(1.0)), _term(e, block, f"{name}_pos", F.lit(1.0)).unionByName(_term(e, block, f"{name}_neg", F.lit(1.0)))


def vertex_selection(edges: DataFrame, vertices: DataFrame, n: int, selected: str, name: str = "vertex", required_in: DataFrame | None = None, required_out: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A binary a vertex and column that any selected edge at it switches on: in <= degree * V and out <= degree * V. Vertices of
    required_in(vix) and required_out(vix) need a selected edge on that side while they are on."""
    ix = vertices.select("vix", "v")
    at = incidence(edges).join(ix, "v").select("eix", "side", F.col("vix").alias("r"))
    grid = _spread(ix.select(F.col("vix").alias("r")), n)
    made = grid.select(F.lit(name).alias("name"), "r", "c", F.lit(0.0).alias("lb"), F.lit(1.0).alias("ub"), F.lit("binary").alias("vartype"))
    con, terms = None, None
    for side, tag, must in (("t", "in", required_in), ("s", "out", required_out)):
        mine = at.filter(F.col("side") == side)
        degree = _spread(mine.groupBy("r").agg(F.count("*").alias("d")), n)
        each = _spread(mine, n)
        block = f"{name}_{tag}"
        c = _rows(degree, block, "<=", F.lit(0.0))
        t = _term(each, block, selected, F.lit(1.0), vr=F.col("eix")).unionByName(_term(degree, block, name, -F.col("d")))
        if must is not None:
            need = degree.join(must.select(F.col("vix").alias("r")), "r", "left_semi")
            tight = f"{name}_needs_{tag}"
            c = c.unionByName(_rows(need, tight, ">=", F.lit(0.0)))
            t = t.unionByName(_term(each.join(need.select("r", "c"), ["r", "c"], "left_semi"), tight, selected, F.lit(1.0), vr=F.col("eix"))).unionByName(_term(need, tight, name, F.lit(-1.0)))
        con, terms = (c, t) if con is None else (con.unionByName(c), terms.unionByName(t))
    return made, con, terms.groupBy("block", "r", "c", "name", "vr", "vc").agg(F.sum("coef").alias("coef"))

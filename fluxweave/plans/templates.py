"""Methods as templates: prepare the inputs, state the program, then charge for what any condition uses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NetGraph
from . import model_tables as M
from .methods import linear


def unchanged(g: NetGraph, features: DataFrame) -> tuple[NetGraph, DataFrame]:
    return g, features


def with_shared_support(p: M.Problem, binary: str | None, coupling: float) -> M.Problem:
    """Charges `coupling` for every row of a binary variable that is 1 in any column: the columns' union, or, of one column,
    its sum. A method that names no such variable is an error, whatever the weight."""
    if binary is None:
        raise ValueError("the method names no variable whose support is shared")
    cells = p.variables.filter(F.col("name") == binary)
    columns = cells.agg(F.countDistinct("c")).first()[0]
    if not columns:
        raise ValueError(f"there is no variable {binary}")
    name = binary
    if columns > 1:
        name = f"{binary}_any"
        made, con, terms = M.gate(cells.select("name", "r", "c"), "or", name)
        p = p.add_variables(made).add((con, terms))
        cells = made
    cost = cells.select("name", F.col("r").alias("vr"), F.col("c").alias("vc"), F.lit(1.0).alias("coef"))
    return p.minimise(linear(cost), coupling, f"support_{name}")


@dataclass(frozen=True)
class Template:
    """A method of one's own. prepare(g, features) gives both as the program needs them, state(g, features) the program, and
    `support` names the binary variable whose use in any condition costs `coupling`; without `shared`, nothing is charged."""

    state: Callable[[NetGraph, DataFrame], M.Problem]
    prepare: Callable[[NetGraph, DataFrame], tuple[NetGraph, DataFrame]] = unchanged
    support: str | None = None
    coupling: float = 0.0
    shared: bool = True

    def build(self, g: NetGraph, features: DataFrame) -> tuple[M.Problem, NetGraph]:
        """The program and the graph it is about."""
        g, features = self.prepare(g, features)
        p = self.state(g, features)
        return (with_shared_support(p, self.support, self.coupling) if self.shared else p), g

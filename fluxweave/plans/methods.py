"""Inference methods: (graph, features) compiled to model tables, or answered by an exact combinatorial plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NetGraph
from ..operators import checks as Q
from ..operators import graph as G
from ..operators import traverse as T
from ..storage import cut
from . import model_tables as M


def _grid(df: DataFrame, name: str, lb, ub, kind: str = "continuous") -> DataFrame:
    """Variables listed as df(r, c)."""
    lb, ub = (F.lit(0.0), F.lit(1.0)) if kind == "binary" else (lb, ub)
    return df.select(F.lit(name).alias("name"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), lb.cast("double").alias("lb"), ub.cast("double").alias("ub"), F.lit(kind).alias("vartype"))


def linear(rows: DataFrame, total: str = "coef") -> M.Expr:
    """One cell that is the sum of rows(name, vr, vc, coef); a null name is a constant."""
    zero = F.lit(0).cast("long")
    return M.Expr(rows.select(zero.alias("r"), zero.alias("c"), "name", F.col("vr").cast("long").alias("vr"), F.col("vc").cast("long").alias("vc"), F.col(total).cast("double").alias("coef")), 1, 1)


def _problem(*parts: tuple[DataFrame, DataFrame, DataFrame]) -> M.Problem:
    p = M.Problem.empty(parts[0][0].sparkSession)
    for variables, con, terms in parts:
        p = p.add_variables(variables).add((con, terms))
    return p


def _rule(rows: DataFrame, block: str, sense: str, rhs, *terms: tuple[str, object, object, object]) -> tuple[DataFrame, DataFrame]:
    """A constraint for each of rows(r, c, ...) with the terms (name, vr, vc, coef)."""
    keyed = cut(rows, "rule")
    out = None
    for name, vr, vc, coef in terms:
        t = M._term(keyed, block, name, coef, vr=vr, vc=vc)
        out = t if out is None else out.unionByName(t)
    return M._rows(keyed, block, sense, rhs), out.groupBy("block", "r", "c", "name", "vr", "vc").agg(F.sum("coef").alias("coef"))


def _any(variables: DataFrame, name: str) -> tuple[tuple, str]:
    """The OR over the columns of binaries, as a gate."""
    return M.gate(variables, "or", name), name


# --- inputs ------------------------------------------------------------------------------------------------------


def conditions_of(spark, **roles: dict) -> DataFrame:
    """(condition, v, role, value) from one mapping a role: {vertex: value} for a single condition, named "condition", or
    {condition: {vertex: value}}. All roles must name the same conditions, and values must be finite numbers, not truth values."""
    rows, named = [], {}
    for role, given in roles.items():
        many = given if given and all(isinstance(x, dict) for x in given.values()) else {"condition": given}
        named[role] = set(many)
        for condition, values in many.items():
            for v, x in values.items():
                if isinstance(x, bool) or not isinstance(x, (int, float)) or x != x or abs(x) == float("inf"):
                    raise ValueError(f"{role} of {v} in {condition} is no finite number: {x!r}")
                rows.append((str(condition), str(v), role, float(x)))
    if not rows or len(set(map(frozenset, named.values()))) != 1:
        raise ValueError(f"the roles don't name the same conditions, or none: {named}")
    return spark.createDataFrame(rows, "condition string, v string, role string, value double")


# --- paths -------------------------------------------------------------------------------------------------------


def coupled_paths(g: NetGraph, pairs: DataFrame, coupling: float) -> M.Problem:
    """One unit of flow from s to t of each of pairs(c, s, t), c from 0: least summed weight plus `coupling` for every edge that
    any pair uses. Without coupling, traverse.shortest_paths() answers the same without a program."""
    n = pairs.agg(F.max("c")).first()[0] + 1
    ix = cut(g.vertices.select("vix", "v"), "paths")
    edges = cut(g.edges.withColumns({"default_lb": F.lit(0.0), "default_ub": F.lit(1.0)}), "paths")
    v, con, terms = M.flow(edges, ix, n)
    at = lambda end, amount: pairs.select("c", F.col(end).alias("v"), F.lit(amount).alias("b"))
    need = at("s", -1.0).unionByName(at("t", 1.0)).join(ix, "v").groupBy(F.col("vix").alias("r"), "c").agg(F.sum("b").alias("b"))
    con = con.drop("rhs").join(need, ["r", "c"], "left").select("block", "r", "c", "sense", F.coalesce("b", F.lit(0.0)).alias("rhs"))
    e = cut(edges.select(F.col("eix").alias("r"), F.lit(0).alias("c"), F.coalesce("weight", F.lit(0.0)).alias("w")), "paths")
    each = cut(M._spread(e.drop("c"), n), "paths")
    p = _problem((v, con, terms)).add_variables(_grid(e, "used", None, None, "binary"))
    p = p.add(_rule(each, "any_use", "<=", F.lit(0.0), ("flow", F.col("r"), F.col("c"), F.lit(1.0)), ("used", F.col("r"), F.lit(0), F.lit(-1.0))))
    p = p.minimise(linear(each.select(F.lit("flow").alias("name"), F.col("r").alias("vr"), F.col("c").alias("vc"), F.col("w").alias("coef"))), name="length")
    return p.minimise(linear(e.select(F.lit("used").alias("name"), F.col("r").alias("vr"), F.lit(0).alias("vc"), F.lit(1.0).alias("coef"))), coupling, "edges")


# --- trees -------------------------------------------------------------------------------------------------------


def steiner_tree(g: NetGraph, terminals: DataFrame, root: str, prizes: DataFrame | None = None) -> M.Problem:
    """Least-cost tree from the root that holds all terminals(v), or, given prizes(v, prize), whichever are worth it.

    A unit of flow goes from the root to each vertex to be held; an edge that carries any is paid for. Undirected edges carry
    either way. `selected` are the edges, `held` the terminals.
    """
    ix = cut(g.vertices.select("vix", "v"), "steiner")
    goals = cut((terminals if prizes is None else prizes).join(ix, "v").filter(F.col("v") != root), "steiner")
    n = float(max(1, goals.count()))
    both = (F.col("edge_type") == "undirected").cast("double")
    edges = cut(g.edges.withColumns({"default_lb": both * -n, "default_ub": F.lit(n)}), "steiner")
    v, con, terms = M.flow(edges, ix, 1, name="flow")
    e = edges.select(F.col("eix").alias("r"), F.lit(0).alias("c"), "default_lb", "weight")
    held = goals.select(F.col("vix").alias("r"), F.lit(0).alias("c"))
    p = _problem((v, con.join(ix.filter(F.col("v") == root).select(F.col("vix").alias("r")), "r", "left_anti").select(con.columns), terms.join(ix.filter(F.col("v") == root).select(F.col("vix").alias("r")), "r", "left_anti").select(terms.columns)))
    p = p.add_variables(_grid(e, "selected", None, None, "binary")).add_variables(_grid(held, "held", None, None, "binary"))
    p = replace(p, terms=p.terms.unionByName(M._term(held, "flow_balance", "held", F.lit(-1.0))))
    same = (F.col("r"), F.col("c"))
    p = p.add(_rule(e, "paid_up", "<=", F.lit(0.0), ("flow", *same, F.lit(1.0)), ("selected", *same, F.lit(-n))))
    p = p.add(_rule(e, "paid_down", ">=", F.lit(0.0), ("flow", *same, F.lit(1.0)), ("selected", *same, F.lit(n))))
    cost = e.select(F.lit("selected").alias("name"), F.col("r").alias("vr"), F.col("c").alias("vc"), F.coalesce("weight", F.lit(0.0)).alias("coef"))
    if prizes is None:
        return p.add(_rule(held, "all_held", "=", F.lit(1.0), ("held", *same, F.lit(1.0)))).minimise(linear(cost), name="cost")
    gain = goals.select(F.lit("held").alias("name"), F.col("vix").alias("vr"), F.lit(0).alias("vc"), (-F.col("prize")).alias("coef"))
    own = prizes.filter(F.col("v") == root).select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("vr"), F.lit(None).cast("long").alias("vc"), (-F.col("prize")).alias("coef"))
    return p.minimise(linear(cost), name="cost").minimise(linear(gain.unionByName(own)), name="prize")


def steiner_by_enumeration(arcs: DataFrame, terminals: list[str]) -> DataFrame:
    """(best) cost of an undirected Steiner tree over 20 edges at most: every subset is a row, and reachability from the first
    terminal grows over all subsets at once."""
    from .solve import bit, subsets

    spark = arcs.sparkSession
    edges = cut(arcs.select("eix", "s", "t", "weight"), "enum")
    n = edges.count()
    masks = subsets(spark, n)
    ranked = cut(edges.join(edges.select(F.col("eix").alias("other")), F.col("other") < F.col("eix"), "left").groupBy("eix", "s", "t", "weight").agg(F.count("other").alias("i")), "enum")
    chosen = cut(masks.crossJoin(F.broadcast(ranked)).filter(bit("mask", "i") == 1), "enum")  # at most 2^20 masks of 20 edges
    cost = chosen.groupBy("mask").agg(F.sum("weight").alias("cost"))
    both = cut(chosen.select("mask", "s", "t").unionByName(chosen.select("mask", F.col("t").alias("s"), F.col("s").alias("t"))), "enum")
    seen = cut(masks.withColumn("v", F.lit(terminals[0])), "enum")
    front = seen
    while True:
        step = front.join(both, (both["mask"] == front["mask"]) & (both["s"] == front["v"])).select(front["mask"], F.col("t").alias("v")).distinct()
        front = cut(step.join(seen, ["mask", "v"], "left_anti"), "enum")
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front), "enum")
    full = seen.filter(F.col("v").isin(terminals)).groupBy("mask").agg(F.countDistinct("v").alias("k")).filter(F.col("k") == len(set(terminals)))
    return full.join(cost, "mask").agg(F.min("cost").alias("best"))


# --- signalling --------------------------------------------------------------------------------------------------


def carnival(g: NetGraph, features: DataFrame, edge_penalty: float = 0.0) -> tuple[M.Problem, NetGraph]:
    """Signed signals from perturbed inputs to measured outputs.

    features(condition, v, role, value) name inputs and outputs. The graph is pruned per condition and given boundary edges; one
    acyclic flow is shared by all conditions. An edge carries an activating or an inhibiting signal of its source's sign times
    its own; a vertex is the sum of what enters. The error is |m| (1 - V sign m), and each edge used costs the penalty.
    """
    named = features.select("condition", "v", "role", F.col("value").cast("double").alias("value"))
    ends = lambda role: named.filter(F.col("role") == role).select("condition", "v")
    Q.require(Q.condition_mismatch(ends("input"), ends("output")), "inputs and outputs name different conditions")
    pruned, _, _ = T.prune_by_condition(g, ends("input"), ends("output"))
    pruned = G.renumbered(NetGraph(cut(pruned.edges, "carnival"), cut(pruned.vertices, "carnival")))
    inside = pruned.vertices.select("v")
    inputs, outputs = (ends(r).select("v").distinct().join(inside, "v", "left_semi") for r in ("input", "output"))
    whole = G.with_boundaries(pruned, inputs, outputs)
    edges, ix = cut(whole.edges, "carnival"), cut(whole.vertices.select("vix", "v"), "carnival")
    n_vertices = ix.count()
    conditions = named.select("condition").distinct().orderBy("condition").collect()  # one short row a condition
    number = F.create_map(*(F.lit(x) for i, r in enumerate(conditions) for x in (r[0], i)))
    at = cut(named.join(ix, "v").select(number[F.col("condition")].alias("c"), F.col("vix").alias("r"), "role", "value"), "carnival")
    n = len(conditions)
    v, con, terms = M.flow(edges, ix, 1, ub=float(max(1, n_vertices)), name="flow")
    e1 = edges.select(F.col("eix").alias("r"), F.lit(0).alias("c"), F.coalesce("interaction", F.lit(1)).alias("sign"), F.get(F.transform("src", lambda x: x["v"]), 0).alias("s"), F.get(F.transform("tgt", lambda x: x["v"]), 0).alias("t"))
    e1 = cut(e1.join(ix.select(F.col("vix").alias("a"), F.col("v").alias("s")), "s", "left").join(ix.select(F.col("vix").alias("b"), F.col("v").alias("t")), "t", "left"), "carnival")
    each = cut(M._spread(e1.drop("c"), n), "carnival")
    p = _problem((v, con, terms), M.acyclic(edges, ix, n, "act", n_vertices), M.acyclic(edges, ix, n, "inh", n_vertices, name="layer"))
    p = replace(p, variables=p.variables.distinct(), constraints=p.constraints.filter("block <> 'layer_fwd'"), terms=p.terms.filter("block <> 'layer_fwd'"))
    p = p.add_variables(_grid(each, "act", None, None, "binary")).add_variables(_grid(each, "inh", None, None, "binary"))
    r, c, zero, one = F.col("r"), F.col("c"), F.lit(0), F.lit(1.0)
    used = p.add(_rule(each, "one_sign", "<=", F.lit(1.0), ("act", r, c, one), ("inh", r, c, one)))
    used = used.add(_rule(each, "in_flow", "<=", F.lit(0.0), ("act", r, c, one), ("inh", r, c, one), ("flow", r, zero, -one)))
    inner = cut(each.filter("a IS NOT NULL AND b IS NOT NULL"), "carnival")
    big = float(n_vertices)
    used = used.add(_rule(inner, "order", ">=", F.lit(1.0 - big), ("layer", F.col("b"), c, one), ("layer", F.col("a"), c, -one), ("act", r, c, F.lit(-big)), ("inh", r, c, F.lit(-big))))
    value = cut(M._spread(ix.select(F.col("vix").alias("r")), n), "carnival")
    used = used.add_variables(_grid(value, "state", F.lit(-1.0), F.lit(1.0), "integer"))
    into = each.filter("b IS NOT NULL").select(F.col("b").alias("r"), "c", F.col("r").alias("e"))
    states = M._rows(value, "state_sum", "=", F.lit(0.0)), M._term(value, "state_sum", "state", -one).unionByName(M._term(into, "state_sum", "act", one, vr=F.col("e"))).unionByName(M._term(into, "state_sum", "inh", -one, vr=F.col("e")))
    used = used.add(states)
    # an activating signal is the source's state times the edge's sign, and there is none from a silent source
    for name, sense in (("act", 1.0), ("inh", -1.0)):
        used = used.add(_rule(inner, f"from_{name}", ">=", F.lit(-1.0), ("state", F.col("a"), c, F.col("sign") * sense), (name, r, c, F.lit(-2.0))))
    into_count = _rule(into.withColumn("__e", F.col("e")), "parents", "<=", F.lit(1.0), ("act", F.col("e"), c, one), ("inh", F.col("e"), c, one))
    used = used.add((into_count[0].distinct(), into_count[1]))
    fixed = at.filter("role = 'input' AND value <> 0")
    used = used.add(_rule(fixed.select("r", "c", F.signum("value").alias("s")), "perturbed", "=", F.col("s"), ("state", r, c, one)))
    idle = cut(each.filter("a IS NULL").select("r", "c", F.col("b").alias("v")).join(fixed.select(F.col("r").alias("v"), "c"), ["v", "c"], "left_anti"), "carnival")
    used = used.add(_rule(idle, "unperturbed", "=", F.lit(0.0), ("act", r, c, one), ("inh", r, c, one)))
    m = at.filter("role = 'output'")
    error = m.select(F.lit("state").alias("name"), F.col("r").alias("vr"), F.col("c").alias("vc"), (-F.col("value")).alias("coef"))
    const = m.select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("vr"), F.lit(None).cast("long").alias("vc"), F.abs("value").alias("coef"))
    lost = named.filter("role = 'output'").join(inside, "v", "left_anti").select(*const.columns[:0], F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("vr"), F.lit(None).cast("long").alias("vc"), F.abs("value").alias("coef"))
    used = used.minimise(linear(error.unionByName(const).unionByName(lost)), name="error")
    if edge_penalty:
        any_ = _grid(e1, "edge_used", None, None, "binary")
        used = used.add_variables(any_).add(_rule(each, "counted", "<=", F.lit(0.0), ("act", r, c, one), ("inh", r, c, one), ("edge_used", r, zero, -one)))
        used = used.minimise(linear(e1.select(F.lit("edge_used").alias("name"), r.alias("vr"), zero.alias("vc"), one.alias("coef"))), edge_penalty, "edges")
    return used, whole


def carnival_by_condition(g: NetGraph, features: DataFrame, penalty: float, on: str = "edges") -> dict[str, tuple[M.Problem, NetGraph]]:
    """The signalling program without a shared flow: every condition is a problem of its own, so they are solved side by side, and
    the penalty counts its edges, vertices or both. Every edge needs a sign of 1 or -1."""
    Q.require(Q.bad_signs(g.edges), "an edge has no sign")
    out = {}
    for row in features.select("condition").distinct().orderBy("condition").collect():  # a row a condition
        p, whole = carnival(g, features.filter(F.col("condition") == row.condition))
        no_flow = lambda df, c: df.filter(~F.col(c).isin("flow", "in_flow", "flow_balance"))
        p = replace(p, variables=no_flow(p.variables, "name"), constraints=no_flow(p.constraints, "block"), terms=no_flow(p.terms, "block"))
        inner = whole.edges.filter((F.size("src") > 0) & (F.size("tgt") > 0)).select("eix")
        edges = [inner.select(F.lit(s).alias("name"), F.col("eix").alias("vr"), F.lit(0).alias("vc"), F.lit(1.0).alias("coef")) for s in ("act", "inh")]
        if on in ("edges", "both"):
            p = p.minimise(linear(edges[0].unionByName(edges[1])), penalty, "edges")
        if on in ("nodes", "both"):  # a vertex is on if an edge into it is, as it has one parent at most
            into = whole.edges.filter(F.size("tgt") > 0).select("eix")
            nodes = [into.select(F.lit(s).alias("name"), F.col("eix").alias("vr"), F.lit(0).alias("vc"), F.lit(1.0).alias("coef")) for s in ("act", "inh")]
            p = p.minimise(linear(nodes[0].unionByName(nodes[1])), penalty, "nodes")
        out[row.condition] = (p, whole)
    return out


def boolean_simulation(reactions: DataFrame, stimuli: DataFrame, conditions: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(condition, v, state) of a selected acyclic Boolean model, layer by layer.

    A reaction(rid, pos, neg, product) is active if every literal holds; a species is on if any reaction that makes it is,
    unless stimuli(condition, v, value) force it. Species that nothing makes are off.
    """
    lit = lambda c, want: reactions.select("rid", "product", F.explode(c).alias("v"), F.lit(want).alias("want"))
    literals = cut(lit("pos", 1).unionByName(lit("neg", 0)), "literals")
    species = cut(literals.select("v").union(reactions.select("product")).distinct(), "species")
    forced = cut(stimuli.select("condition", "v", F.col("value").cast("int").alias("forced")), "forced")
    state = cut(conditions.crossJoin(species).join(forced, ["condition", "v"], "left").withColumn("state", F.coalesce("forced", F.lit(0))), "states")  # the result's own size
    for _ in range(max_rounds):
        active = literals.join(state.select("condition", "v", "state"), "v").groupBy("condition", "rid", "product").agg(F.min((F.col("state") == F.col("want")).cast("int")).alias("on"))
        made = active.groupBy("condition", F.col("product").alias("v")).agg(F.max("on").alias("made"))
        after = cut(state.join(made, ["condition", "v"], "left").select("condition", "v", "forced", F.coalesce("forced", "made", F.lit(0)).alias("state"), F.col("state").alias("was")), "states")
        if after.filter("state <> was").isEmpty():
            return after.select("condition", "v", "state")
        state = after.drop("was")
    raise ValueError("the model does not settle: it has a cycle")


def boolean_fit(reactions: DataFrame, stimuli: DataFrame, measured: DataFrame, penalty: float = 0.0, max_rounds: int = 1_000) -> DataFrame:
    """(mask, error, n, objective) of every subset of up to 20 reactions, best first to sort: sum |x - m| + penalty * n.

    reactions' rid runs from 0; subsets are a key of one simulation, so all are simulated at once.
    """
    from .solve import bit, subsets

    n = reactions.count()
    masks = cut(subsets(reactions.sparkSession, n), "masks")
    conditions = stimuli.select("condition").union(measured.select("condition")).distinct()
    kept = cut(masks.join(F.broadcast(reactions), bit("mask", "rid") == 1), "kept")  # 20 reactions at most
    key = lambda c: F.concat_ws("|", F.col("mask").cast("string"), c)
    keyed = kept.select(key(F.col("rid").cast("string")).alias("rid"), F.transform("pos", lambda x: key(x)).alias("pos"), F.transform("neg", lambda x: key(x)).alias("neg"), key("product").alias("product"))
    forced = masks.crossJoin(stimuli).select("condition", key("v").alias("v"), "value")  # subsets by stimuli: what is asked for
    state = boolean_simulation(keyed, forced, conditions, max_rounds)
    want = masks.crossJoin(measured).select("mask", "condition", key("v").alias("v"), F.col("value").alias("m"))
    off = want.join(state, ["condition", "v"], "left").groupBy("mask").agg(F.sum(F.abs(F.coalesce("state", F.lit(0)) - F.col("m"))).alias("error"))
    size = masks.select("mask", F.bit_count("mask").alias("n"))
    return off.join(size, "mask").withColumn("objective", F.col("error") + penalty * F.col("n"))


def boolean_program(reactions: DataFrame, features: DataFrame, penalty: float = 0.0, epsilon: float = 1.0, max_flow: float | None = None) -> tuple[M.Problem, DataFrame]:
    """The Boolean model of least error as a program, and (eix, rid, s, t) of its dependencies: one set of reactions for all conditions.

    reactions(rid, pos, neg, product) are those of graph.dependency_reactions(). features(condition, v, role, value, input_value) force
    vertices (role `input`, 0 or 1) or measure them (`output`, 0 to 1); `input_output` does both, forcing to input_value. A
    selected reaction is active where all its literals hold, a vertex that is not forced is on where a reaction that makes it is
    active. Selected dependencies are acyclic, and a flow from forced to measured vertices runs through each of them and no
    other. The error is the sum of |state - measured|; each selected reaction costs the penalty. A condition needs an input and
    an output; unknown vertices, other roles and other values are errors.
    """
    role = F.col("role")
    named = features.select("condition", "v", "role", F.col("value").cast("double").alias("value"), (F.col("input_value") if "input_value" in features.columns else F.lit(None)).cast("double").alias("input_value"))
    Q.require(named.filter(~F.coalesce(role.isin("input", "output", "input_output"), F.lit(False))), "a role is none of input, output, input_output")
    forced = named.filter(role != "output").select("condition", "v", F.coalesce("input_value", F.when(role == "input", F.col("value"))).alias("value"))
    measured = named.filter(role != "input").select("condition", "v", "value")
    Q.require(Q.out_of_unit(forced, "value", binary=True), "an input is neither 0 nor 1")
    Q.require(Q.out_of_unit(measured, "value"), "a measurement is not within 0 and 1")
    Q.require(Q.condition_mismatch(forced, measured), "a condition needs an input and an output")
    reactions = cut(reactions.select("rid", "pos", "neg", "product"), "boolean")
    literals = reactions.select("rid", "product", F.explode("pos").alias("v"), F.lit(1.0).alias("sign")).unionByName(reactions.select("rid", "product", F.explode("neg").alias("v"), F.lit(-1.0).alias("sign")))
    inner = G.renumbered(NetGraph.of_arcs(literals.select(F.col("v").alias("s"), F.col("product").alias("t"), F.col("rid").cast("string").alias("id")), order=["id", "s", "t"]))
    inner = NetGraph(cut(inner.edges, "boolean"), cut(inner.vertices, "boolean"))
    Q.require(Q.unknown_vertices(named.select("v", "condition"), inner.vertices), "not in the model")
    whole = G.with_boundaries(inner, forced.select("v"), measured.select("v"))
    edges, ix = cut(whole.edges, "boolean"), cut(whole.vertices.select("vix", "v"), "boolean")
    deps = cut(G.directed_incidence(inner.edges).join(inner.edges.select("eix", F.col("id").cast("long").alias("rid")), "eix").select("eix", "rid", F.col("source").alias("s"), F.col("target").alias("t")), "boolean")
    n_deps, n_vertices = deps.count(), ix.count()
    most = float(max(n_deps, 1)) if max_flow is None else float(max_flow)
    if most < epsilon:
        raise ValueError("max_flow is less than epsilon")
    conditions = [r.condition for r in named.select("condition").distinct().orderBy("condition").collect()]  # one short row a condition
    if not conditions:
        raise ValueError("no condition is given")
    number = F.create_map(*(F.lit(x) for i, name in enumerate(conditions) for x in (name, i)))
    n = len(conditions)
    place = lambda df: cut(df.join(ix, "v").select(F.col("vix").alias("r"), number[F.col("condition")].cast("long").alias("c"), "value"), "boolean")
    at, want = place(forced), place(measured)
    r, c, zero, one = F.col("r"), F.col("c"), F.lit(0).cast("long"), F.lit(1.0)
    rx = cut(reactions.select(F.col("rid").alias("r"), "product", F.size("neg").cast("double").alias("n_neg"), (F.size("pos") + F.size("neg")).cast("double").alias("k")), "boolean")
    each, states = cut(M._spread(rx, n), "boolean"), cut(M._spread(ix.select(F.col("vix").alias("r")), n), "boolean")
    used = deps.select(F.col("eix").alias("r"), zero.alias("c"), "rid")
    p = _problem(M.flow(edges, ix, 1, ub=most), M.acyclic(inner.edges, ix, 1, "used", n_vertices))
    for name, rows in (("selected", rx.withColumn("c", zero)), ("active", each), ("state", states), ("used", used)):
        p = p.add_variables(_grid(rows, name, None, None, "binary"))
    p = p.add(_rule(used, "same_reaction", "=", F.lit(0.0), ("used", r, c, one), ("selected", F.col("rid"), zero, -one)))
    p = p.add(_rule(used, "flow_if_used", ">=", F.lit(0.0), ("flow", r, c, one), ("used", r, c, F.lit(-float(epsilon)))))
    p = p.add(_rule(used, "used_if_flow", "<=", F.lit(0.0), ("flow", r, c, one), ("used", r, c, F.lit(-most))))
    p = p.add(_rule(each, "only_selected", "<=", F.lit(0.0), ("active", r, c, one), ("selected", r, zero, -one)))
    # a reaction's literals that hold, but for its number of negative ones
    held = cut(M._spread(literals.join(ix, "v").select(F.col("rid").alias("r"), F.col("vix").alias("at"), "sign"), n), "boolean")
    lit = lambda block: M._term(held, block, "state", -F.col("sign"), vr=F.col("at"))
    p = p.add((M._rows(each, "all_hold", "<=", F.col("n_neg")), M._term(each, "all_hold", "active", F.col("k")).unionByName(lit("all_hold"))))
    fires = M._term(each, "fires", "active", one).unionByName(M._term(each, "fires", "selected", -one, vc=zero)).unionByName(lit("fires"))
    p = p.add((M._rows(each, "fires", ">=", F.col("n_neg") - F.col("k")), fires))
    free = cut(states.join(at.select("r", "c"), ["r", "c"], "left_anti"), "boolean")
    makers = each.join(ix.select(F.col("v").alias("product"), F.col("vix").alias("p")), "product").select(F.col("p").alias("r"), "c", F.col("r").alias("rid")).join(free, ["r", "c"], "left_semi")
    makers = cut(makers, "boolean")
    made = lambda block, coef: M._term(makers, block, "active", F.lit(coef), vr=F.col("rid"))
    p = p.add((M._rows(free, "on_by", "<=", F.lit(0.0)), M._term(free, "on_by", "state", one).unionByName(made("on_by", -1.0))))
    several = cut(makers.groupBy("r", "c").agg(F.count("*").cast("double").alias("m")), "boolean")
    p = p.add((M._rows(several, "makes", "<=", F.lit(0.0)), made("makes", 1.0).unionByName(M._term(several, "makes", "state", -F.col("m")))))
    p = p.add(_rule(at, "forced", "=", F.col("value"), ("state", r, c, one)))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    error = want.select(F.lit("state").alias("name"), r.alias("vr"), c.alias("vc"), (1 - 2 * F.col("value")).alias("coef"))
    const = want.select(none("string", "name"), none("long", "vr"), none("long", "vc"), F.col("value").alias("coef"))
    p = p.minimise(linear(error.unionByName(const)), name="error")
    size = rx.select(F.lit("selected").alias("name"), r.alias("vr"), zero.alias("vc"), one.alias("coef"))
    return p.minimise(linear(size), penalty, "reactions"), deps


def phonemes(g: NetGraph, perturbed: DataFrame, scores: DataFrame, edge_cost: float = 1e-4) -> tuple[M.Problem, NetGraph]:
    """Least summed score of the vertices that acyclic paths from perturbed(condition, v) to scored sites(condition, v, score)
    select, plus the cost of each edge used in any condition. Each perturbation must reach a site."""
    Q.require(Q.not_plain(g.edges), "the network needs plain directed edges")
    pruned, _, _ = T.prune_by_condition(g, perturbed, scores.select("condition", "v"))
    pruned = G.renumbered(NetGraph(cut(pruned.edges, "phonemes"), cut(pruned.vertices, "phonemes")))
    edges, ix = cut(pruned.edges, "phonemes"), cut(pruned.vertices.select("vix", "v"), "phonemes")
    conditions = perturbed.select("condition").distinct().orderBy("condition").collect()  # one short row a condition
    number = F.create_map(*(F.lit(x) for i, r in enumerate(conditions) for x in (r[0], i)))
    place = lambda df: cut(df.join(ix, "v").withColumns({"r": F.col("vix"), "c": number[F.col("condition")]}), "phonemes")
    src, site = place(perturbed), place(scores)
    n, n_vertices = len(conditions), ix.count()
    pairs = G.directed_incidence(edges).join(ix.select(F.col("vix").alias("a"), F.col("v").alias("source")), "source").join(ix.select(F.col("vix").alias("b"), F.col("v").alias("target")), "target")
    each = cut(M._spread(pairs.select(F.col("eix").alias("r"), "a", "b"), n), "phonemes")
    verts = cut(M._spread(ix.select(F.col("vix").alias("r")), n), "phonemes")
    p = _problem(M.acyclic(edges, ix, n, "edge", n_vertices))
    p = p.add_variables(_grid(each, "edge", None, None, "binary")).add_variables(_grid(verts, "vertex", None, None, "binary")).add_variables(_grid(each.select("r", F.lit(0).alias("c")).distinct(), "edge_any", None, None, "binary"))
    r, c, one = F.col("r"), F.col("c"), F.lit(1.0)
    p = p.add(_rule(each, "edge_source", "<=", F.lit(0.0), ("edge", r, c, one), ("vertex", F.col("a"), c, -one)))
    p = p.add(_rule(each, "edge_target", "<=", F.lit(0.0), ("edge", r, c, one), ("vertex", F.col("b"), c, -one)))
    p = p.add(_rule(each, "edge_counted", "<=", F.lit(0.0), ("edge", r, c, one), ("edge_any", r, F.lit(0), -one)))
    for block, end, free in (("needs_in", "b", src), ("needs_out", "a", site)):
        must = cut(verts.join(free.select("r", "c"), ["r", "c"], "left_anti"), "phonemes")
        edge_terms = M._term(each.withColumn("e", r).withColumn("r", F.col(end)), block, "edge", one, vr=F.col("e")).join(must, ["r", "c"], "left_semi").select("block", "r", "c", "name", "vr", "vc", "coef")
        p = p.add((M._rows(must, block, ">=", F.lit(0.0)), edge_terms.unionByName(M._term(must, block, "vertex", -one))))
    p = p.add(_rule(src.select("r", "c"), "perturbed", "=", one, ("vertex", r, c, one)))
    out = each.withColumn("e", r).withColumn("r", F.col("a")).join(src.select("r", "c"), ["r", "c"], "left_semi")
    p = p.add((M._rows(src.select("r", "c"), "leaves", ">=", one), M._term(out, "leaves", "edge", one, vr=F.col("e"))))
    p = p.minimise(linear(site.select(F.lit("vertex").alias("name"), r.alias("vr"), c.alias("vc"), F.col("score").alias("coef"))), name="score")
    return p.minimise(linear(each.select(F.lit("edge_any").alias("name"), r.alias("vr"), F.lit(0).alias("vc"), one.alias("coef")).distinct()), edge_cost, "edges"), pruned


def phonemes_both_ways(g: NetGraph, anchors: DataFrame, scores: DataFrame, edge_cost: float = 1e-5, policy: str = "either") -> tuple[M.Problem, NetGraph]:
    """One network around anchors(condition, v): downstream paths from an anchor to a scored vertex and upstream paths from a
    scored vertex to an anchor, chosen together.

    A vertex is on if either side uses it, and its score(condition, v, score) counts once; an edge costs once over sides and
    conditions; the union of both sides is acyclic in each condition. By `policy` an anchor must take part on either side, on both
    or downstream.
    """
    Q.require(Q.not_plain(g.edges), "the network needs plain directed edges")
    if policy not in ("either", "both", "downstream"):
        raise ValueError(f"policy {policy!r} is none of either, both, downstream")
    pairs, sites = G.arcs(g.edges), scores.select("condition", "v")
    spans = {"down": cut(T.between(pairs, anchors, sites, ("condition",)), "both"), "up": cut(T.between(pairs, sites, anchors, ("condition",)), "both")}
    near = spans["down"].select("v").union(spans["up"].select("v")).union(anchors.select("v")).distinct()
    kept = G.subgraph(g, near)
    kept = G.renumbered(NetGraph(cut(kept.edges, "both"), cut(kept.vertices, "both")))
    edges, ix = cut(kept.edges, "both"), cut(kept.vertices.select("vix", "v"), "both")
    conditions = anchors.select("condition").distinct().orderBy("condition").collect()  # one short row a condition
    number = F.create_map(*(F.lit(x) for i, r in enumerate(conditions) for x in (r[0], i)))
    place = lambda df: cut(df.join(ix, "v").withColumns({"r": F.col("vix"), "c": number[F.col("condition")]}), "both")
    anchor, site = place(anchors), place(scores)
    inside = {side: place(df).select("r", "c") for side, df in spans.items()}
    n, n_vertices = len(conditions), ix.count()
    ends = G.directed_incidence(edges).join(ix.select(F.col("vix").alias("a"), F.col("v").alias("source")), "source").join(ix.select(F.col("vix").alias("b"), F.col("v").alias("target")), "target")
    each = cut(M._spread(ends.select(F.col("eix").alias("r"), "a", "b"), n), "both")
    verts = cut(M._spread(ix.select(F.col("vix").alias("r")), n), "both")
    r, c, one, zero = F.col("r"), F.col("c"), F.lit(1.0), F.lit(0)
    p = _problem(M.acyclic(edges, ix, n, "edge", n_vertices))
    for name, rows in (("edge", each), ("down", each), ("up", each), ("vertex", verts), ("v_down", verts), ("v_up", verts), ("edge_any", each.select("r", zero.alias("c")).distinct())):
        p = p.add_variables(_grid(rows, name, None, None, "binary"))
    p = p.add(_rule(each, "counted", "<=", F.lit(0.0), ("edge", r, c, one), ("edge_any", r, zero, -one)))
    for side, start, stop in (("down", anchor, site), ("up", site, anchor)):
        p = p.add(_rule(each, f"{side}_edge", "<=", F.lit(0.0), (side, r, c, one), ("edge", r, c, -one)))
        p = p.add(_rule(verts, f"{side}_vertex", "<=", F.lit(0.0), (f"v_{side}", r, c, one), ("vertex", r, c, -one)))
        for end in "ab":
            p = p.add(_rule(each, f"{side}_{end}", "<=", F.lit(0.0), (side, r, c, one), (f"v_{side}", F.col(end), c, -one)))
        out = cut(verts.join(inside[side], ["r", "c"], "left_anti"), "both")
        p = p.add(_rule(out, f"{side}_out", "=", F.lit(0.0), (f"v_{side}", r, c, one)))
        for block, end, free in ((f"{side}_needs_in", "b", start), (f"{side}_needs_out", "a", stop)):
            must = cut(verts.join(free.select("r", "c"), ["r", "c"], "left_anti"), "both")
            at = M._term(each.withColumn("e", r).withColumn("r", F.col(end)), block, side, one, vr=F.col("e")).join(must, ["r", "c"], "left_semi").select("block", "r", "c", "name", "vr", "vc", "coef")
            p = p.add((M._rows(must, block, ">=", F.lit(0.0)), at.unionByName(M._term(must, block, f"v_{side}", -one))))
    # a vertex is on only if a side uses it
    p = p.add(_rule(verts, "on", "<=", F.lit(0.0), ("vertex", r, c, one), ("v_down", r, c, -one), ("v_up", r, c, -one)))
    mine = anchor.select("r", "c").distinct()
    leave = M._term(each.withColumn("e", r).withColumn("r", F.col("a")), "takes_part", "down", one, vr=F.col("e"))
    enter = M._term(each.withColumn("e", r).withColumn("r", F.col("b")), "takes_part", "up", one, vr=F.col("e"))
    for tag, parts in {"either": [("", [leave, enter])], "both": [("_down", [leave]), ("_up", [enter])], "downstream": [("_down", [leave])]}[policy]:
        terms = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        block = f"takes_part{tag}"
        terms = terms.withColumn("block", F.lit(block)).join(mine, ["r", "c"], "left_semi").select("block", "r", "c", "name", "vr", "vc", "coef")
        p = p.add((M._rows(mine, block, ">=", one), terms))
    p = p.minimise(linear(site.select(F.lit("vertex").alias("name"), r.alias("vr"), c.alias("vc"), F.col("score").alias("coef"))), name="score")
    return p.minimise(linear(each.select(F.lit("edge_any").alias("name"), r.alias("vr"), zero.alias("vc"), one.alias("coef")).distinct()), edge_cost, "edges"), kept


# --- metabolism --------------------------------------------------------------------------------------------------


def resolved_bounds(edges: DataFrame, overrides: DataFrame, samples: DataFrame) -> DataFrame:
    """(eix, c, lb, ub): an edge's default bounds unless the sample's overrides(c, id, lb, ub) give others."""
    grid = edges.select("eix", "id", "default_lb", "default_ub").join(samples.select("c"), F.lit(True))  # edges by samples: the model's own size
    return grid.join(overrides, ["c", "id"], "left").select("eix", "c", F.coalesce("lb", "default_lb").alias("lb"), F.coalesce("ub", "default_ub").alias("ub"))


def fba(g: NetGraph, bounds: DataFrame, objective: DataFrame, sparsity: float = 0.0, coupling: float = 0.0) -> M.Problem:
    """Flux balance: S v = 0 within bounds(eix, c, lb, ub); objective(id, c, weight), a null weight being -1 (maximise).

    With a sparsity weight, each active reaction of a sample costs that much; with coupling, each that is active in any sample.
    """
    n = bounds.agg(F.max("c")).first()[0] + 1
    v, con, terms = M.flow(g.edges, g.vertices, n, name="flow", values=True)
    v = v.drop("lb", "ub").join(bounds.select(F.col("eix").alias("r"), "c", "lb", "ub"), ["r", "c"]).select("name", "r", "c", "lb", "ub", "vartype")
    v = cut(v, "fba")
    p = _problem((v, con, terms))
    goal = objective.join(g.edges.select("eix", "id"), "id").select(F.lit("flow").alias("name"), F.col("eix").alias("vr"), F.col("c").alias("vc"), F.coalesce("weight", F.lit(-1.0)).alias("coef"))
    p = p.minimise(linear(goal), name="flux")
    if not sparsity and not coupling:
        return p
    iv, icon, iterms = M.indicator(v, "active")
    p = p.add_variables(iv).add((icon, iterms))
    if sparsity:
        p = p.minimise(linear(iv.select("name", F.col("r").alias("vr"), F.col("c").alias("vc"), F.lit(1.0).alias("coef"))), sparsity, "active")
    if not coupling:
        return p
    from .templates import with_shared_support

    return with_shared_support(p, "active", coupling)


def gene_scores(g: NetGraph, samples: DataFrame, default: float = 0.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """(id, c, score) of all reactions with a gene rule, from samples(c, values), a map from gene to value: the rules' scores, or, given both
    thresholds, 1 from high up, -1 from low down and else 0. Rules are compiled in the driver, one for each different text."""
    from ..functions import scores as S

    rules = [r.gpr for r in g.edges.filter("gpr IS NOT NULL").select("gpr").distinct().orderBy("gpr").collect()]  # a model's rules
    none = g.edges.sparkSession.createDataFrame([], "id string, c long, score double")
    if not rules:
        return none
    found = S.evaluate_rules([(r, r) for r in rules], samples.select(F.col("c").alias("sample"), "values"), default=default)
    if (low is None) != (high is None):
        raise ValueError("both thresholds or none")
    score = F.col("score") if low is None else F.coalesce(S.discretise(F.col("score"), low, high), F.lit(0))
    made = found.select(F.col("id").alias("gpr"), F.col("sample").cast("long").alias("c"), score.cast("double").alias("score"))
    return g.edges.select("id", "gpr").join(made, "gpr").select("id", "c", "score")


def imat(g: NetGraph, bounds: DataFrame, scores: DataFrame, tolerance: float = 1e-3, scale: float | None = 100.0, coupling: float = 0.0) -> M.Problem:
    """Flux states that agree with scores(id, c, score), which gene_scores() makes from genes: high ones want flux, low ones want
    none; weights may be scaled to a sum of sizes in each sample. With coupling, each reaction active in any sample costs that."""
    p = fba(g, bounds, scores.limit(0).select("id", "c", F.lit(0.0).alias("weight")))
    w = scores.filter("score <> 0").join(g.edges.select("eix", "id"), "id")
    if scale:
        w = w.join(w.groupBy("c").agg(F.sum(F.abs("score")).alias("s")), "c").withColumn("score", F.col("score") / F.col("s") * scale)
    w = cut(w.select(F.col("eix").alias("r"), "c", "score"), "imat")
    mine = p.variables.filter("name = 'flow'").join(w.select("r", "c"), ["r", "c"], "left_semi").select("name", "r", "c", "lb", "ub", "vartype")
    nv, ncon, nterms = M.nonzero_indicator(cut(mine, "imat"), "on", tolerance)
    p = replace(p, objectives=()).add_variables(nv).add((ncon, nterms))
    high = w.filter("score > 0")
    none = lambda c: F.lit(None).cast(c)
    const = high.select(none("string").alias("name"), none("long").alias("vr"), none("long").alias("vc"), F.col("score").alias("coef"))
    agree = None
    for sign in ("on_pos", "on_neg"):
        part = high.select(F.lit(sign).alias("name"), F.col("r").alias("vr"), F.col("c").alias("vc"), (-F.col("score")).alias("coef"))
        agree = part if agree is None else agree.unionByName(part)
    p = p.minimise(linear(const.unionByName(agree)), name="missing")
    low = w.filter("score < 0")
    free = mine.join(low.select("r", "c"), ["r", "c"], "left_semi")
    iv, icon, iterms = M.indicator(cut(free, "imat"), "open")
    cost = low.select(F.lit("open").alias("name"), F.col("r").alias("vr"), F.col("c").alias("vc"), F.abs("score").alias("coef"))
    p = p.add_variables(iv).add((icon, iterms)).minimise(linear(cost), name="unwanted")
    if not coupling:
        return p
    from .templates import with_shared_support

    av, acon, aterms = M.indicator(cut(p.variables.filter("name = 'flow'"), "imat"), "active")
    return with_shared_support(p.add_variables(av).add((acon, aterms)), "active", coupling)


def perturbed_problems(p: M.Problem, variable: str, trials: int, share: float = 0.05, scale: float = 0.1, seed: int = 0) -> dict[str, M.Problem]:
    """Independent problems whose objective has seeded noise on a share of one variable's entries: solved side by side, their
    solutions are alternatives wherever acceptable() lets them pass."""
    out = {}
    for t in range(trials):
        unit = lambda k, t=t: (F.pmod(F.xxhash64(F.lit(seed), F.lit(t), F.lit(k), F.col("r"), F.col("c")), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2)) * scale
        noise = p.variables.filter((F.col("name") == variable) & (unit(0) < share)).select("name", F.col("r").alias("vr"), F.col("c").alias("vc"), normal.alias("coef"))
        out[f"trial{t}"] = p.minimise(linear(noise), name="noise")
    return out


def acceptable(values: DataFrame, baseline: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(pid) of trials whose every objective(pid, name, value) but the noise is within the relative tolerance of baseline(name, value)."""
    both = values.filter("name <> 'noise'").join(baseline.select("name", F.col("value").alias("base")), "name")
    near = F.abs(F.col("value") - F.col("base")) <= tolerance * F.greatest(F.abs("base"), F.lit(1e-9)) + 1e-9
    return both.groupBy("pid").agg(F.bool_and(near).alias("ok")).filter("ok").select("pid")

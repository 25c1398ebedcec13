"""Query catalogue: name to plan, and name to the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..model import NetGraph, ends, side
from ..operators import checks as Q
from ..operators import features as D
from ..operators import graph as G
from ..operators import results as R
from ..operators import traverse as T
from ..sources import formats as IO
from . import methods as C
from . import model_tables as M
from . import solve as L
from . import views as V

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Plan) -> Plan:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def vs(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "v string")


def trade_edges(spark: SparkSession, d: str, edge_type: str = "directed") -> DataFrame:
    """Edges whose index is 100 * source + target, so that no numbering is needed."""
    t = V.trade(spark, d)
    return t.select((F.col("s").cast("long") * 100 + F.col("t").cast("long")).alias("eix"), side(F.col("s")).alias("src"), side(F.col("t")).alias("tgt"), F.lit(edge_type).alias("edge_type"), "weight", F.when(F.col("weight") % 2 == 0, 1).otherwise(-1).alias("interaction"))


def trade_graph(spark: SparkSession, d: str, edge_type: str = "directed") -> NetGraph:
    from ..model import conform

    edges = conform(trade_edges(spark, d, edge_type))
    v = G.incidence(edges).select("v").distinct()
    return NetGraph(edges, v.select(F.col("v").cast("long").alias("vix"), "v", F.lit(None).cast("map<string,string>").alias("attrs")))


EIX = "CAST(s AS BIGINT) * 100 + CAST(t AS BIGINT) AS eix"
REACH = "r AS (SELECT {start} AS v, 0 AS d UNION SELECT {to}, d + 1 FROM r JOIN {arcs} ON {on} WHERE d < {depth})"

# --- traversal ---------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {V.TRADE}, {REACH.format(start=chr(39) + '0' + chr(39), to='t', arcs='trade', on='s = v', depth=30)} SELECT v, CAST(min(d) AS INTEGER) AS dist FROM r GROUP BY v")
def bfs_trade(spark, d):
    """Hops from nation 0 over the trade network."""
    return T.bfs(V.trade(spark, d), vs(spark, "0"))


@query(f"WITH RECURSIVE {V.TRADE}, r AS (SELECT '0' AS v, 0 AS d UNION SELECT s, d + 1 FROM r JOIN trade ON t = v WHERE d < 30) SELECT v, CAST(min(d) AS INTEGER) AS dist FROM r GROUP BY v")
def bfs_reverse(spark, d):
    return T.bfs(V.trade(spark, d), vs(spark, "0"), reverse=True)


@query(f"WITH RECURSIVE {V.TRADE}, both_ways AS (SELECT s, t FROM trade UNION SELECT t, s FROM trade), r AS (SELECT '0' AS v, 0 AS d UNION SELECT t, d + 1 FROM r JOIN both_ways ON s = v WHERE d < 12) SELECT v, CAST(min(d) AS INTEGER) AS dist FROM r GROUP BY v")
def bfs_undirected(spark, d):
    return T.bfs(V.trade(spark, d), vs(spark, "0"), undirected=True)


@query(f"WITH RECURSIVE {V.HIER}, r AS (SELECT 'r:0' AS v, 0 AS d UNION ALL SELECT t, d + 1 FROM r JOIN hier ON s = v) SELECT CAST(d AS INTEGER) AS dist, count(*) AS n FROM r GROUP BY d")
def bfs_hier_depth(spark, d):
    return T.bfs(V.hier(spark, d), vs(spark, "r:0")).groupBy("dist").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {V.HIER}, f AS (SELECT 'n:3' AS v UNION SELECT t FROM f JOIN hier ON s = v),
    b AS (SELECT 'o:' || o_orderkey AS v FROM orders WHERE o_orderstatus = 'F' UNION SELECT s FROM b JOIN hier ON t = v),
    k AS (SELECT v FROM f INTERSECT SELECT v FROM b) SELECT s, t FROM hier WHERE s IN (SELECT v FROM k) AND t IN (SELECT v FROM k)""")
def prune_paths(spark, d):
    """What lies between one nation and all finished orders."""
    arcs = V.hier(spark, d)
    done = V.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("v"))
    kept = T.between(arcs, vs(spark, "n:3"), done)
    return arcs.join(kept.withColumnRenamed("v", "s"), "s", "left_semi").join(kept.withColumnRenamed("v", "t"), "t", "left_semi").select("s", "t")


@query(f"""WITH RECURSIVE {V.TRADE}, n AS (SELECT CAST(n_regionkey AS VARCHAR) AS condition, CAST(n_nationkey AS VARCHAR) AS v FROM nation), hubs AS (SELECT t AS v FROM trade GROUP BY t HAVING count(*) > 1),
    f AS (SELECT condition, v FROM n UNION SELECT condition, t FROM f JOIN trade ON s = v), b AS (SELECT condition, h.v FROM hubs h, (SELECT DISTINCT condition FROM n) UNION SELECT condition, s FROM b JOIN trade ON t = v)
    SELECT condition, v FROM f INTERSECT SELECT condition, v FROM b""")
def prune_paths_by_condition(spark, d):
    """Per region, what lies between its nations and the nations that two or more sell to; all regions in one loop."""
    arcs = V.trade(spark, d)
    n = V.read(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("condition"), F.col("n_nationkey").cast("string").alias("v"))
    hubs = arcs.groupBy(F.col("t").alias("v")).agg(F.count("*").alias("n")).filter("n > 1").select("v")
    every = n.groupBy().agg(F.collect_set("condition").alias("all"))  # a row, of as many as there are regions
    return T.between(arcs, n, hubs.join(F.broadcast(every)).select(F.explode("all").alias("condition"), "v"), ("condition",))


@query(f"WITH {V.HIER} SELECT CAST(layer AS INTEGER) AS layer, count(*) AS n FROM (SELECT DISTINCT v, CASE substr(v, 1, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 WHEN 'c' THEN 2 ELSE 3 END AS layer FROM (SELECT s AS v FROM hier UNION SELECT t FROM hier)) GROUP BY layer")
def toposort_hier(spark, d):
    arcs = V.hier(spark, d)
    vertices = arcs.select(F.col("s").alias("v")).union(arcs.select("t")).distinct()
    return T.topological_layers(arcs, vertices).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {V.TRADE}, r AS (SELECT '0' AS v, 0 AS d UNION SELECT t, d + 1 FROM r JOIN trade ON s = v WHERE d < 30), dist AS (SELECT v, min(d) AS d FROM r GROUP BY v)
    SELECT {EIX}, CAST(b.d AS INTEGER) AS layer FROM trade JOIN dist a ON s = a.v JOIN dist b ON t = b.v WHERE b.d = a.d + 1""")
def reachability_edges(spark, d):
    return T.reaching_edges(trade_edges(spark, d), vs(spark, "0"))


PATHS = """p AS (SELECT '0' AS v, 0.0::DOUBLE AS c, 0 AS h UNION ALL SELECT t, c + weight, h + 1 FROM p JOIN rtrade ON s = v WHERE h < 5)"""


@query(f"WITH RECURSIVE {V.REGION_TRADE}, {PATHS} SELECT v, min(c) AS dist FROM p GROUP BY v")
def shortest_path_region(spark, d):
    arcs = V.region_trade(spark, d).withColumn("eix", F.col("s").cast("long") * 10 + F.col("t").cast("long"))
    return T.shortest_paths(arcs, vs(spark, "0")).select("v", "dist")


@query(f"""WITH RECURSIVE {V.TRADE}, p AS (SELECT DISTINCT s AS pair, s AS v, 0.0::DOUBLE AS c, 0 AS h FROM trade WHERE CAST(s AS INTEGER) < 5
    UNION ALL SELECT pair, t, min(c + weight), any_value(h) + 1 FROM p JOIN trade ON s = v WHERE h < 24 GROUP BY pair, t) SELECT pair, v, min(c) AS dist FROM p GROUP BY pair, v""")
def shortest_paths_multi(spark, d):
    """From five nations at once, each its own problem in one loop."""
    arcs = V.trade(spark, d).withColumn("eix", F.col("s").cast("long") * 100 + F.col("t").cast("long"))
    starts = arcs.filter(F.col("s").cast("int") < 5).select(F.col("s").alias("pair"), F.col("s").alias("v")).distinct()
    return T.shortest_paths(arcs, starts, ("pair",)).select("pair", "v", "dist")


# --- scans and projections -----------------------------------------------------------------------------------------


@query(f"WITH {V.TRADE} SELECT {EIX}, kind FROM (SELECT s, t, 'in' AS kind FROM trade WHERE t IN ('1', '2') UNION ALL SELECT s, t, 'out' FROM trade WHERE s IN ('1', '2'))")
def in_out_edges(spark, d):
    e, two = trade_edges(spark, d), vs(spark, "1", "2")
    pick = lambda into, kind: G.directed_edges(e, two, into).select("eix", F.lit(kind).alias("kind"))
    return pick(True, "in").unionByName(pick(False, "out"))


@query(f"WITH {V.TRADE} SELECT {EIX} FROM trade WHERE s IN ('1', '2') OR t IN ('1', '2')")
def incident_edges(spark, d):
    return G.incident_edges(trade_edges(spark, d), vs(spark, "1", "2")).select("eix")


@query(f"WITH {V.TRADE} SELECT {EIX} FROM trade WHERE s IN ('1', '2') OR t IN ('1', '2')")
def undirected_in_edges(spark, d):
    """Undirected edges count as incoming wherever they touch."""
    return G.directed_edges(trade_edges(spark, d, "undirected"), vs(spark, "1", "2"), into=True).select("eix")


@query(f"WITH {V.HYPER} SELECT DISTINCT b.v FROM hyper a JOIN hyper b USING (eix) WHERE a.side = 's' AND b.side = 't' AND a.v IN ('p:1', 'p:2', 'p:3')")
def successors(spark, d):
    return G.successors(V.hyper(spark, d), vs(spark, "p:1", "p:2", "p:3"))


@query(f"WITH {V.HYPER} SELECT DISTINCT a.v FROM hyper a JOIN hyper b USING (eix) WHERE a.side = 's' AND b.side = 't' AND b.v IN ('c:1', 'c:2')")
def predecessors(spark, d):
    return G.predecessors(V.hyper(spark, d), vs(spark, "c:1", "c:2"))


@query(f"WITH {V.HYPER} SELECT DISTINCT v FROM hyper WHERE eix IN (SELECT eix FROM hyper WHERE v = 'p:7')")
def neighbors(spark, d):
    return G.neighbors(V.hyper(spark, d), vs(spark, "p:7"))


@query(f"WITH {V.HYPER}, want AS (SELECT v FROM hyper WHERE eix = 7) SELECT eix FROM hyper WHERE v IN (SELECT v FROM want) GROUP BY eix HAVING count(DISTINCT v) = (SELECT count(*) FROM want)")
def common_incident(spark, d):
    """Edges that hold every end of order 7."""
    e = V.hyper(spark, d)
    return G.common_incident_edges(e, [r.v for r in G.incidence(e.filter("eix = 7")).collect()]).select("eix")  # the ends of one order


@query(f"WITH {V.TRADE} SELECT {EIX} FROM trade WHERE s NOT IN ('3', '4') AND t NOT IN ('3', '4') AND weight > 100")
def filter_graph(spark, d):
    return G.filter_graph(trade_graph(spark, d), ~F.col("v").isin("3", "4"), F.col("weight") > 100).edges.select("eix")


@query(f"WITH {V.TRADE}, n AS (SELECT CAST(n_nationkey AS VARCHAR) AS v FROM nation WHERE n_regionkey < 3) SELECT {EIX} FROM trade WHERE s IN (SELECT v FROM n) AND t IN (SELECT v FROM n)")
def vertex_subgraph(spark, d):
    n = V.read(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("v"))
    return G.subgraph(trade_graph(spark, d), n).edges.select("eix")


@query(f"WITH {V.TRADE}, k AS (SELECT s, t FROM trade WHERE weight % 3 = 0) SELECT DISTINCT v FROM (SELECT s AS v FROM k UNION SELECT t FROM k)")
def edge_subgraph(spark, d):
    g = trade_graph(spark, d)
    return G.edge_subgraph(g, g.edges.filter("weight % 3 = 0").select("eix")).vertices.select("v")


@query(f"""WITH {V.TRADE}, k AS (SELECT '5' AS v UNION SELECT s FROM trade WHERE weight % 5 = 0 UNION SELECT t FROM trade WHERE weight % 5 = 0)
    SELECT {EIX} FROM trade WHERE s IN (SELECT v FROM k) AND t IN (SELECT v FROM k)""")
def extract_subgraph(spark, d):
    g = trade_graph(spark, d)
    return G.extract_subgraph(g, vs(spark, "5"), g.edges.filter("weight % 5 = 0").select("eix")).edges.select("eix")


@query(f"WITH {V.HYPER} SELECT eix FROM hyper GROUP BY eix HAVING bool_or(side = 's' AND v IN ('p:1', 'p:2', 'p:3', 'p:4')) AND bool_or(side = 't' AND v IN ('c:1', 'c:2', 'c:4', 'c:5', 'c:7', 'c:8', 'c:10'))")
def touching_subgraph(spark, d):
    return G.touching_subgraph(V.hyper(spark, d), ["p:1", "p:2", "p:3", "p:4", "c:1", "c:2", "c:4", "c:5", "c:7", "c:8", "c:10"]).select("eix")


@query(f"WITH {V.HYPER} SELECT (SELECT count(DISTINCT v) FROM hyper) AS n_vertices, (SELECT count(DISTINCT eix) FROM hyper) AS n_edges")
def graph_shape(spark, d):
    e = V.hyper(spark, d)
    return G.shape(NetGraph(e, G.incidence(e).select("v").distinct()))


@query(f"WITH {V.HYPER} SELECT bool_or(n > 1) AS is_hypergraph FROM (SELECT count(*) AS n FROM hyper GROUP BY eix, side)")
def is_hypergraph(spark, d):
    return G.is_hypergraph(V.hyper(spark, d))


@query(f"WITH {V.TRADE} SELECT {EIX}, t AS a, s AS b FROM trade")
def reverse_graph(spark, d):
    return G.reverse(trade_edges(spark, d)).select("eix", F.get(ends("src"), 0).alias("a"), F.get(ends("tgt"), 0).alias("b"))


@query(f"""WITH {V.TRADE}, top AS (SELECT max(CAST(s AS BIGINT) * 100 + CAST(t AS BIGINT)) AS m FROM trade), b AS (SELECT 0 AS kind, v FROM (VALUES ('0'), ('7')) x(v) UNION ALL SELECT 1, v FROM (VALUES ('3')) y(v))
    SELECT m + row_number() OVER (ORDER BY kind, v) AS eix, CASE WHEN kind = 0 THEN '' ELSE v END AS a, CASE WHEN kind = 0 THEN v ELSE '' END AS b FROM b, top""")
def boundary_edges(spark, d):
    g = trade_graph(spark, d)
    edges = G.with_boundaries(g, vs(spark, "0", "7"), vs(spark, "3")).edges
    return edges.filter((F.size("src") == 0) | (F.size("tgt") == 0)).select("eix", F.array_join(ends("src"), "").alias("a"), F.array_join(ends("tgt"), "").alias("b"))


@query(f"WITH {V.TRADE} SELECT row_number() OVER (ORDER BY s, t) - 1 AS eix, s, t FROM trade")
def arcs_to_graph(spark, d):
    """A graph numbered by a total order, without one task numbering all."""
    g = NetGraph.of_arcs(V.trade(spark, d), order=["s", "t"])
    return g.edges.select("eix", F.get(ends("src"), 0).alias("s"), F.get(ends("tgt"), 0).alias("t"))


@query(f"WITH {V.TRADE} SELECT {EIX} FROM trade WHERE weight % 2 = 0")
def edges_by_attribute(spark, d):
    return G.edges_by_attribute(trade_edges(spark, d), "interaction", 1).select("eix")


# --- incidence -----------------------------------------------------------------------------------------------------


@query(f"WITH {V.HYPER} SELECT v, sum(a) AS total, count(*) AS n FROM hyper GROUP BY v")
def incidence_coo(spark, d):
    return G.incidence(V.hyper(spark, d), values=True).groupBy("v").agg(F.sum("a").alias("total"), F.count("*").alias("n"))


@query("""WITH loops AS (SELECT l_orderkey * 10 + l_linenumber AS eix, 'n' || (l_partkey % 7) AS s, 'n' || (l_suppkey % 7) AS t FROM lineitem), i AS (SELECT eix, s AS v, 's' AS side, -1.0 AS a FROM loops UNION ALL SELECT eix, t, 't', 1.0 FROM loops)
    SELECT v, CAST(sum(dense) AS DOUBLE) AS dense, CAST(sum(summed) AS DOUBLE) AS summed FROM (SELECT v, eix, arg_max(a, side) AS dense, sum(a) AS summed FROM i GROUP BY v, eix) GROUP BY v""")
def incidence_dense_vs_sparse(spark, d):
    """A self-loop is +1 in a dense matrix and 0 in a sparse one."""
    li = V.read(spark, d, "lineitem")
    e = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("eix"), side(F.concat(F.lit("n"), F.col("l_partkey") % 7)).alias("src"), side(F.concat(F.lit("n"), F.col("l_suppkey") % 7)).alias("tgt"), F.lit("directed").alias("edge_type"))
    dense = G.incidence_matrix(e, sparse=False).groupBy("v").agg(F.sum("a").alias("dense"))
    return dense.join(G.incidence_matrix(e).groupBy("v").agg(F.sum("a").alias("summed")), "v")


@query(f"WITH {V.TRADE} SELECT {EIX}, s AS source, t AS target FROM trade")
def directed_incidence(spark, d):
    return G.directed_incidence(trade_edges(spark, d))


@query(f"WITH {V.HYPER} SELECT v, CAST(count(*) FILTER (WHERE side = 't') AS DOUBLE) AS head, CAST(count(*) FILTER (WHERE side = 's') AS DOUBLE) AS tail FROM hyper GROUP BY v")
def heads_and_tails(spark, d):
    return G.heads_and_tails(V.hyper(spark, d)).groupBy("v").agg(F.sum("head").alias("head"), F.sum("tail").alias("tail"))


GATES = """sif AS (SELECT l_orderkey AS o, 'p' || l_partkey AS s, CASE WHEN min(l_returnflag) = 'R' THEN -1 ELSE 1 END AS interaction FROM lineitem GROUP BY l_orderkey, l_partkey),
    gates AS (SELECT o, list_sort(list(s) FILTER (WHERE interaction > 0)) AS pos, list_sort(list(s) FILTER (WHERE interaction < 0)) AS neg FROM sif GROUP BY o HAVING count(*) > 1)"""


def _order_gates(spark: SparkSession, d: str) -> DataFrame:
    """(o, s, interaction): the parts of each order as signed literals; orders of one part make no gate."""
    rows = V.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), "l_partkey").agg(F.min("l_returnflag").alias("f"))
    many = rows.groupBy("o").agg(F.count("*").alias("n")).filter("n > 1").select("o")
    return rows.join(many, "o", "left_semi").select("o", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("s"), F.when(F.col("f") == "R", -1).otherwise(1).alias("interaction"))


@query(f"WITH {GATES} SELECT 'y' || o AS product, coalesce(array_to_string(pos, ','), '') AS pos, coalesce(array_to_string(neg, ','), '') AS neg FROM gates")
def and_gate_compile(spark, d):
    """AND gates written as vertices, one an order with its parts as literals, compiled to reactions."""
    into = _order_gates(spark, d).select("s", "interaction", F.concat(F.lit("AND"), F.col("o").cast("string")).alias("t"))
    out = into.select(F.col("t").alias("s"), F.lit(1).alias("interaction"), F.concat(F.lit("y"), F.substring("t", 4, 20)).alias("t")).distinct()
    return G.dependency_reactions(into.unionByName(out)).select("product", F.array_join("pos", ",").alias("pos"), F.array_join("neg", ",").alias("neg"))


# --- features --------------------------------------------------------------------------------------------------------


def features(spark, d) -> D.FeatureSet:
    return D.FeatureSet.of(V.feat(spark, d))


@query(f"WITH {V.FEAT} SELECT s.sample, count(f.fid) AS n_features FROM (SELECT DISTINCT sample FROM feat) s LEFT JOIN (SELECT * FROM feat WHERE value > 100 AND mapping <> 'none') f USING (sample) GROUP BY 1")
def features_filter(spark, d):
    """Samples that a filter empties stay."""
    return features(spark, d).filter((F.col("value") > 100) & (F.col("mapping") != "none")).counts().select("sample", "n_features")


@query(f"WITH {V.FEAT} SELECT sample, fid, round(value * 2 + k, 6) AS value FROM feat")
def features_map(spark, d):
    return features(spark, d).map(value=F.round(F.col("value") * 2 + F.col("extra")["k"].cast("int"), 6)).features.select("sample", "fid", "value")


@query(f"WITH {V.FEAT} SELECT DISTINCT fid || ':' || role AS value FROM feat")
def features_pluck(spark, d):
    return features(spark, d).pluck(F.concat_ws(":", "fid", "role"))


@query(f"WITH {V.FEAT} SELECT fid, role, sample, value FROM (SELECT *, row_number() OVER (PARTITION BY fid, role ORDER BY sample_ix, pos) AS rn FROM feat) WHERE rn = 1")
def features_unique(spark, d):
    return features(spark, d).unique("fid", "role").select("fid", "role", "sample", "value")


@query(f"WITH {V.FEAT} SELECT sample, mapping, fid FROM (SELECT *, row_number() OVER (PARTITION BY sample, mapping ORDER BY pos) AS rn FROM feat) WHERE rn = 1")
def features_unique_by_sample(spark, d):
    return features(spark, d).unique_by_sample("mapping").select("sample", "mapping", "fid")


@query(f"WITH {V.FEAT} SELECT fid, count(*) AS n FROM feat WHERE sample_ix % 10 = 0 GROUP BY fid")
def samples_filter(spark, d):
    return features(spark, d).filter_samples(F.col("sample_ix") % 10 == 0).features.groupBy("fid").agg(F.count("*").alias("n"))


@query(f"WITH {V.FEAT} SELECT sample, count(*) AS n_features FROM feat GROUP BY sample")
def sample_counts(spark, d):
    return features(spark, d).counts().select("sample", "n_features")


@query(f"WITH {V.FEAT} SELECT fid, CASE WHEN min(role) = max(role) THEN min(role) ELSE 'mixed' END AS role FROM feat WHERE mapping = 'vertex' GROUP BY fid")
def infer_roles(spark, d):
    return features(spark, d).roles()


@query(f"WITH {V.FEAT} SELECT sample, fid, value, CASE WHEN value <> 0 THEN (row_number() OVER (PARTITION BY sample ORDER BY fid) - 1) % 3 END::INTEGER AS fold FROM feat WHERE value <> 0 UNION ALL SELECT sample, fid, value, NULL FROM feat WHERE value = 0")
def kfold_cells(spark, d):
    return D.ranked_folds(V.feat(spark, d).select("sample", "fid", "value"), ["sample", "fid"], "value", 3)


@query(f"WITH {V.FEAT} SELECT DISTINCT fid AS v FROM feat WHERE fid NOT IN ('click', 'view')")
def validate_unknown_vertices(spark, d):
    return Q.unknown_vertices(V.feat(spark, d).select(F.col("fid").alias("v")).distinct(), vs(spark, "click", "view"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount AND l_quantity > 45")
def validate_bounds(spark, d):
    li = V.read(spark, d, "lineitem").filter("l_quantity > 45")
    return Q.bad_bounds(li.withColumns({"lb": F.col("l_tax"), "ub": F.col("l_discount")})).select("l_orderkey", "l_linenumber")


@query(f"WITH {V.TRADE} SELECT {EIX} FROM trade WHERE s NOT IN ('1', '2')")
def validate_edge_costs(spark, d):
    e = trade_edges(spark, d)
    return Q.bad_edge_costs(e.select("eix"), G.directed_edges(e, vs(spark, "1", "2"), False))


# --- scores ----------------------------------------------------------------------------------------------------------

RULES = [("r1", "click and (view or purchase)"), ("r2", "signup or error"), ("r3", "click and view and error or purchase"), ("r4", "missing or click"), ("r5", "click and (")]
PIVOT = f"""{V.FEAT}, p AS (SELECT sample, max(value - 100) FILTER (WHERE fid = 'click') AS click, max(value - 100) FILTER (WHERE fid = 'view') AS view_, max(value - 100) FILTER (WHERE fid = 'purchase') AS purchase,
    max(value - 100) FILTER (WHERE fid = 'signup') AS signup, max(value - 100) FILTER (WHERE fid = 'error') AS error_ FROM feat GROUP BY sample),
    z AS (SELECT sample, coalesce(click, 0) AS c, coalesce(view_, 0) AS v, coalesce(purchase, 0) AS p, coalesce(signup, 0) AS s, coalesce(error_, 0) AS e FROM p)"""


def _sql_rule(word: str, a: str, b: str) -> str:
    inner, outer = ("greatest", "least") if word == "and" else ("least", "greatest")
    return f"(CASE WHEN {a} < 0 AND {b} < 0 THEN {inner}({a}, {b}) ELSE {outer}({a}, {b}) END)"


@query(f"""WITH {PIVOT} SELECT sample, id, round(score, 6) AS score FROM (SELECT sample, 'r1' AS id, {_sql_rule('and', 'c', _sql_rule('or', 'v', 'p'))} AS score FROM z
    UNION ALL SELECT sample, 'r2', {_sql_rule('or', 's', 'e')} FROM z UNION ALL SELECT sample, 'r3', {_sql_rule('or', _sql_rule('and', _sql_rule('and', 'c', 'v'), 'e'), 'p')} FROM z
    UNION ALL SELECT sample, 'r4', {_sql_rule('or', '0', 'c')} FROM z UNION ALL SELECT sample, 'r5', 0 FROM z)""")
def gpr_scores(spark, d):
    f = V.feat(spark, d)
    samples = f.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("fid", F.col("value") - 100))).alias("values"))
    return S.evaluate_rules(RULES, samples).select("sample", "id", F.round("score", 6).alias("score"))


@query("SELECT p_type, count(*) AS n FROM (SELECT DISTINCT p_type, unnest(regexp_extract_all(upper(p_type) || ' and b' || p_size || '_1 or X', '[A-Za-z0-9_]+')) AS gene FROM part) WHERE gene NOT IN ('and', 'or') GROUP BY p_type")
def gene_extract(spark, d):
    rule = F.concat(F.upper("p_type"), F.lit(" and b"), F.col("p_size").cast("string"), F.lit("_1 or X"))
    return V.read(spark, d, "part").select("p_type", F.explode(S.genes(rule, "symbol_simple")).alias("gene")).distinct().groupBy("p_type").agg(F.count("*").alias("n"))


@query(f"WITH {V.FEAT} SELECT sample, fid, CAST(CASE WHEN value >= 200 THEN 1 ELSE -1 END AS INTEGER) AS score FROM feat WHERE value >= 200 OR value <= 50")
def discretise_scores(spark, d):
    return V.feat(spark, d).select("sample", "fid", S.discretise(F.col("value"), 50, 200).alias("score")).filter("score IS NOT NULL")


@query(f"WITH {V.FEAT} SELECT sample, fid, round(value / sum(abs(value)) OVER (PARTITION BY sample) * 100, 6) AS weight FROM feat")
def rescale_weights(spark, d):
    return V.feat(spark, d).select("sample", "fid", F.round(S.rescaled(F.col("value"), ["sample"]), 6).alias("weight"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, greatest(l_discount, 2.2250738585072014e-308) AS p, l_tax - 0.04 AS fc FROM lineitem WHERE l_discount > 0),
    y AS (SELECT *, CASE WHEN p < 0.05 AND fc >= 0.01 THEN -abs(log2(p / 0.05)) ELSE abs(log2(p / 0.05)) END AS s FROM x)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN s < 0 THEN s / max(CASE WHEN s < 0 THEN -s END) OVER w WHEN s > 0 THEN s / max(CASE WHEN s > 0 THEN s END) OVER w ELSE s END, 6) AS score FROM y WINDOW w AS (PARTITION BY l_returnflag)""")
def phospho_scores(spark, d):
    li = V.read(spark, d, "lineitem").filter("l_discount > 0").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_discount").alias("p"), (F.col("l_tax") - 0.04).alias("fold_change"))
    return S.site_scores(li, 0.05, "up", 0.01, ["l_returnflag"]).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


@query(f"""WITH {V.FEAT}, x AS (SELECT sample, fid, ln(1 + CASE WHEN abs(value) >= 20 THEN abs(value) ELSE 0 END) AS m FROM feat), q AS (SELECT fid, quantile_cont(m, 0.95) AS top FROM x WHERE m > 0 GROUP BY fid),
    c AS (SELECT sample, x.fid, CASE WHEN top IS NULL THEN m ELSE least(m, top) END AS m FROM x LEFT JOIN q USING (fid)) SELECT sample, fid, round(CASE WHEN max(m) OVER w > 0 THEN m / max(m) OVER w ELSE 0 END, 6) AS scaled FROM c WINDOW w AS (PARTITION BY fid)""")
def scaled_magnitudes(spark, d):
    f = V.feat(spark, d).select("sample", "fid", "value")
    return S.scaled_magnitude(f, "value", ["fid"], "log", 20, 0.05).select("sample", "fid", F.round("scaled", 6).alias("scaled"))


@query(f"WITH {V.FEAT}, q AS (SELECT fid, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM feat GROUP BY fid) SELECT sample, fid, round(greatest(least(value, hi), lo), 6) AS clipped FROM feat JOIN q USING (fid)")
def clip_quantiles(spark, d):
    return S.clipped(V.feat(spark, d).select("sample", "fid", "value"), "value", ["fid"], 0.1).select("sample", "fid", F.round("clipped", 6).alias("clipped"))


@query("SELECT l_returnflag, round(sum(CAST(round(abs(m) * (1 - v * sign(m)), 6) AS DECIMAL(18,6))), 4)::DOUBLE AS error FROM (SELECT l_returnflag, l_tax - 0.04 AS m, CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END AS v FROM lineitem) GROUP BY 1")
def signed_error(spark, d):
    li = V.read(spark, d, "lineitem")
    e = S.signed_error(F.col("l_tax") - 0.04, F.when(F.col("l_linestatus") == "F", 1).otherwise(-1))
    return li.groupBy("l_returnflag").agg(F.round(F.sum(F.round(e, 6).cast("decimal(18,6)")), 4).cast("double").alias("error"))


@query(f"WITH {GATES} SELECT array_to_string(list_concat(coalesce(pos, []), list_transform(coalesce(neg, []), lambda x: 'NOT ' || x)), ' AND ') || ' -> y' || o AS reaction FROM gates")
def reaction_text(spark, d):
    """One reaction an order."""
    literal = lambda sign: F.collect_list(F.when(F.col("interaction") == sign, F.col("s")))
    gates = _order_gates(spark, d).groupBy("o").agg(literal(1).alias("pos"), literal(-1).alias("neg"))
    return gates.select(S.reaction_text(F.col("pos"), F.col("neg"), F.concat(F.lit("y"), F.col("o").cast("string"))).alias("reaction"))


@query(f"WITH {V.FEAT} SELECT sample, CAST(max(CAST(value > 100 AS INTEGER)) AS INTEGER) AS or_, CAST(min(CAST(value > 100 AS INTEGER)) AS INTEGER) AS and_, CAST(sum(CAST(value > 100 AS INTEGER)) % 2 AS INTEGER) AS xor_, sum(CASE WHEN (value > 100) <> (role = 'output') THEN 1 ELSE 0 END)::BIGINT AS hamming FROM feat GROUP BY sample")
def or_and_xor_by_user(spark, d):
    b = (F.col("value") > 100).cast("int")
    return V.feat(spark, d).groupBy("sample").agg(F.max(b).alias("or_"), F.min(b).alias("and_"), (F.sum(b) % 2).cast("int").alias("xor_"), F.sum(F.when((F.col("value") > 100) != (F.col("role") == "output"), 1).otherwise(0)).alias("hamming"))


# --- results ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {V.FEAT}, u AS (SELECT fid || (sample_ix % 9) AS item, count(DISTINCT role) AS active_in FROM feat GROUP BY 1)
    SELECT CASE WHEN active_in = 3 THEN 'shared core' WHEN active_in > 1 THEN 'partially shared' ELSE 'context-specific' END AS category, active_in, count(*) AS size, array_to_string((list(item ORDER BY item))[1:6], ',') AS first FROM u GROUP BY active_in""")
def usage_categories(spark, d):
    active = V.feat(spark, d).select(F.concat("fid", (F.col("sample_ix") % 9).cast("string")).alias("item"), F.col("role").alias("condition"))
    return R.usage_categories(active, 3)


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def topk_balance(spark, d):
    return R.top_by_size(V.read(spark, d, "customer"), ["c_nationkey"], "c_acctbal", 3, "c_custkey").select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_brand, round(avg(p_size), 6) AS mean FROM part GROUP BY 1 ORDER BY avg(p_size) DESC, 1 LIMIT 10")
def group_mean_rank(spark, d):
    return R.group_means(V.read(spark, d, "part"), "p_brand", "p_size", 10).select("p_brand", F.round("mean", 6).alias("mean"))


@query(f"WITH {V.HYPER} SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'vertex' AS kind, v FROM hyper UNION ALL SELECT 'centre', CAST(eix AS VARCHAR) FROM hyper GROUP BY eix HAVING count(*) > 2) GROUP BY kind")
def plot_model(spark, d):
    e = V.hyper(spark, d).withColumn("interaction", F.lit(None).cast("int"))
    nodes, _ = R.plot_model(NetGraph(e, G.incidence(e).select("v").distinct()))
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {V.TRADE} SELECT '  "' || s || '" -> "' || t || '" [arrowhead=' || CASE WHEN weight % 2 = 0 THEN 'normal' ELSE 'tee' END || '];' AS line FROM trade UNION ALL SELECT '  "' || v || '";' FROM (SELECT s AS v FROM trade UNION SELECT t FROM trade)""")
def dot_text(spark, d):
    return IO.dot_lines(trade_graph(spark, d)).select("line")


@query(f"WITH {V.TRADE} SELECT v, CASE WHEN bool_and(k = 's') THEN 'input' WHEN bool_and(k = 't') THEN 'output' ELSE 'inner' END AS kind FROM (SELECT s AS v, 's' AS k FROM trade UNION ALL SELECT t, 't' FROM trade) GROUP BY v")
def graph_ends(spark, d):
    return R.ends_of(V.trade(spark, d))


@query(f"WITH {V.HYPER} SELECT v, count(*) FILTER (WHERE side = 's') AS out_degree, count(*) FILTER (WHERE side = 't') AS in_degree FROM hyper GROUP BY v")
def degrees(spark, d):
    return R.degrees(NetGraph(V.hyper(spark, d), spark.createDataFrame([], "v string")))


@query(f"WITH {V.TRADE}, m AS (SELECT max(weight) AS m FROM trade) SELECT {EIX}, CASE WHEN weight % 2 = 0 THEN 'red' ELSE 'blue' END AS colour, round(0.5 + 4.5 * weight / m, 6) AS width FROM trade, m")
def edge_styles(spark, d):
    return R.edge_styles(trade_edges(spark, d).select("eix", (F.col("weight") * F.col("interaction")).alias("value"))).select("eix", "colour", F.round("width", 6).alias("width"))


@query("""SELECT o_orderstatus AS condition, round(sum(o_totalprice) FILTER (WHERE p = '1'), 2) AS o_1, round(sum(o_totalprice) FILTER (WHERE p = '2'), 2) AS o_2,
    CAST(count(DISTINCT o_custkey) FILTER (WHERE p = '1') AS DOUBLE) AS p_1, CAST(count(DISTINCT o_custkey) FILTER (WHERE p = '2') AS DOUBLE) AS p_2 FROM (SELECT *, substr(o_orderpriority, 1, 1) AS p FROM orders) GROUP BY 1""")
def observed_series(spark, d):
    """Sums as what is observed beside numbers of customers as what is predicted."""
    o = V.read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("condition"), F.substring("o_orderpriority", 1, 1).alias("v"))
    predicted = o.agg(F.count_distinct("o_custkey").cast("double").alias("value"))
    return R.observed_and_predicted(o.agg(F.round(F.sum("o_totalprice"), 2).alias("value")), predicted, ["1", "2"])


@query(f"""WITH {V.TRADE}, ends AS (SELECT s AS v FROM trade UNION SELECT t FROM trade)
    SELECT 'gate' AS part, v, -1::BIGINT AS eix, 0::BIGINT AS value FROM ends UNION ALL SELECT 'target', t, {EIX.replace(" AS eix", "")}, 1 FROM trade UNION ALL SELECT 'source', s, {EIX.replace(" AS eix", "")}, 1 FROM trade
    UNION ALL SELECT 'interaction', '', {EIX.replace(" AS eix", "")}, CASE WHEN weight % 2 = 0 THEN 1 ELSE -1 END FROM trade UNION ALL SELECT 'has_source', '', {EIX.replace(" AS eix", "")}, 1 FROM trade""")
def presolve_report(spark, d):
    """What a signalling program reads off the trade network."""
    from ..operators import signalling

    return signalling.presolve_report(trade_graph(spark, d)).select("part", F.coalesce("v", F.lit("")).alias("v"), F.coalesce("eix", F.lit(-1)).alias("eix"), "value")


# --- models ----------------------------------------------------------------------------------------------------------


def _sizes(variables: DataFrame, con: DataFrame, terms: DataFrame) -> DataFrame:
    """(part, n, total): how many rows of each kind and block a model has, and what they sum to."""
    v = variables.groupBy(F.concat(F.lit("variables "), "name").alias("part")).agg(F.count("*").alias("n"), F.sum("ub").alias("total"))
    c = con.groupBy(F.concat(F.lit("constraints "), "block").alias("part")).agg(F.count("*").alias("n"), F.sum("rhs").alias("total"))
    t = terms.groupBy(F.concat(F.lit("terms "), "block").alias("part")).agg(F.count("*").alias("n"), F.sum("coef").alias("total"))
    return v.unionByName(c).unionByName(t).select("part", "n", F.round("total", 6).alias("total"))


_EV = f"{V.TRADE}, e AS (SELECT count(*) AS e FROM trade), n AS (SELECT count(*) AS v FROM (SELECT s FROM trade UNION SELECT t FROM trade))"


@query(f"""WITH {_EV} SELECT 'variables flow' AS part, 2 * e AS n, 2000.0 * e AS total FROM e UNION ALL SELECT 'constraints flow_balance', 2 * v, 0 FROM n UNION ALL SELECT 'terms flow_balance', 4 * e, 0 FROM e""")
def flow_model_rows(spark, d):
    g = trade_graph(spark, d)
    return _sizes(*M.flow(g.edges, g.vertices, 2))


@query(f"""WITH {_EV} SELECT 'variables on' AS part, e AS n, 1.0 * e AS total FROM e UNION ALL SELECT 'constraints on_lb', e, 0 FROM e UNION ALL SELECT 'constraints on_ub', e, 0 FROM e
    UNION ALL SELECT 'terms on_lb', e, e FROM e UNION ALL SELECT 'terms on_ub', 2 * e, -999 * e FROM e""")
def indicator_rows(spark, d):
    g = trade_graph(spark, d)
    return _sizes(*M.indicator(M.flow(g.edges, g.vertices)[0], "on"))


@query(f"""WITH {_EV} SELECT 'variables on_pos' AS part, e AS n, 1.0 * e AS total FROM e UNION ALL SELECT 'variables on_neg', e, 0 FROM e UNION ALL SELECT 'constraints on_once', e, e FROM e UNION ALL SELECT 'constraints on_low', e, 0 FROM e
    UNION ALL SELECT 'constraints on_high', e, 0 FROM e UNION ALL SELECT 'terms on_once', 2 * e, 2 * e FROM e UNION ALL SELECT 'terms on_low', 2 * e, 0.5 * e FROM e UNION ALL SELECT 'terms on_high', 3 * e, -998.5 * e FROM e""")
def nonzero_rows(spark, d):
    g = trade_graph(spark, d)
    return _sizes(*M.nonzero_indicator(M.flow(g.edges, g.vertices)[0], "on", 0.5))


@query(f"""WITH {_EV} SELECT 'variables layer' AS part, 2 * v AS n, 2.0 * v * 24 AS total FROM n UNION ALL SELECT 'constraints layer_fwd', 2 * e, -48 * e FROM e UNION ALL SELECT 'terms layer_fwd', 6 * e, -50 * e FROM e""")
def acyclic_rows(spark, d):
    g = trade_graph(spark, d)
    return _sizes(*M.acyclic(g.edges, g.vertices, 2, "x", 25))


@query(f"""WITH {V.FEAT}, u AS (SELECT sample_ix, count(*) AS k FROM feat GROUP BY 1) SELECT 'variables any' AS part, count(*) AS n, 1.0 * count(*) AS total FROM u UNION ALL SELECT 'constraints any_lo', count(*), 0 FROM u UNION ALL SELECT 'constraints any_hi', count(*), 0 FROM u
    UNION ALL SELECT 'terms any_lo', sum(k + 1)::BIGINT, 0 FROM u UNION ALL SELECT 'terms any_hi', sum(k + 1)::BIGINT, sum(k - 1) FROM u""")
def gate_rows(spark, d):
    """The OR of each user's event types as linear rows."""
    cells = V.feat(spark, d).select(F.lit("x").alias("name"), F.col("sample_ix").alias("r"), F.abs(F.hash("fid")).cast("long").alias("c"))
    return _sizes(*M.gate(cells, "or", "any"))


@query(f"""WITH {V.TRADE}, f AS (SELECT s, t, weight, (CAST(s AS BIGINT) * 100 + CAST(t AS BIGINT)) % 3 AS x FROM trade), b AS (SELECT v, sum(x) AS net FROM (SELECT s AS v, -x AS x FROM f UNION ALL SELECT t, x FROM f) GROUP BY v)
    SELECT (SELECT CAST(sum(weight * x) AS DOUBLE) FROM f) AS objective, (SELECT CAST(sum(abs(net)) AS DOUBLE) FROM b) AS violation""")
def evaluate_solution(spark, d):
    """Objective and violation of a given flow, whoever made it."""
    g = trade_graph(spark, d)
    p = M.Problem.empty(spark)
    v, con, terms = M.flow(g.edges, g.vertices)
    p = p.add_variables(v).add((con, terms)).minimise(C.linear(g.edges.select(F.lit("flow").alias("name"), F.col("eix").alias("vr"), F.lit(0).alias("vc"), F.col("weight").alias("coef"))), name="cost")
    solution = g.edges.select(F.lit("flow").alias("name"), F.col("eix").alias("r"), F.lit(0).cast("long").alias("c"), (F.col("eix") % 3).cast("double").alias("value"))
    checked, values = M.evaluate(p, solution)
    return values.select(F.col("value").alias("objective")).crossJoin(checked.agg(F.sum("violation").alias("violation")))  # one row by one row


UND = "und AS (SELECT least(s, t) AS s, greatest(s, t) AS t, sum(weight) AS weight FROM rtrade GROUP BY 1, 2)"


def _region_graph(spark, d):
    return V.region_trade(spark, d).groupBy(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.sum("weight").alias("weight")).withColumn("eix", F.col("s").cast("long") * 10 + F.col("t").cast("long"))


@query(f"""WITH RECURSIVE {V.REGION_TRADE}, {UND}, e AS (SELECT *, row_number() OVER (ORDER BY s, t) - 1 AS i FROM und), masks AS (SELECT range AS mask FROM range(1024)),
    chosen AS (SELECT mask, s, t, weight FROM masks, e WHERE (mask >> CAST(i AS INTEGER)) & 1 = 1), both_ways AS (SELECT mask, s, t FROM chosen UNION ALL SELECT mask, t, s FROM chosen),
    r AS (SELECT mask, '0' AS v FROM masks UNION SELECT r.mask, b.t FROM r JOIN both_ways b ON b.mask = r.mask AND b.s = r.v)
    SELECT min(cost) AS best FROM (SELECT mask FROM r WHERE v IN ('0', '2', '4') GROUP BY mask HAVING count(DISTINCT v) = 3) JOIN (SELECT mask, sum(weight) AS cost FROM chosen GROUP BY mask) USING (mask)""")
def steiner_region(spark, d):
    return C.steiner_by_enumeration(_region_graph(spark, d), ["0", "2", "4"])


@query(f"""WITH RECURSIVE {V.REGION_TRADE}, {UND}, e AS (SELECT *, row_number() OVER (ORDER BY s, t) - 1 AS i FROM und), masks AS (SELECT range AS mask FROM range(1024)),
    chosen AS (SELECT mask, s, t, weight FROM masks, e WHERE (mask >> CAST(i AS INTEGER)) & 1 = 1), both_ways AS (SELECT mask, s, t FROM chosen UNION ALL SELECT mask, t, s FROM chosen),
    r AS (SELECT mask, '0' AS v FROM masks UNION SELECT r.mask, b.t FROM r JOIN both_ways b ON b.mask = r.mask AND b.s = r.v), prize AS (SELECT s AS v, sum(weight) / 3 AS prize FROM rtrade GROUP BY s)
    SELECT round(min(coalesce(cost, 0) - gain), 4) AS best FROM (SELECT mask, sum(prize) AS gain FROM r JOIN prize USING (v) GROUP BY mask) LEFT JOIN (SELECT mask, sum(weight) AS cost FROM chosen GROUP BY mask) USING (mask)""")
def pcst_region(spark, d):
    """The prize-collecting tree from region 0 as a program, solved exactly."""
    from ..model import conform

    arcs = _region_graph(spark, d)
    edges = conform(arcs.select("eix", side(F.col("s")).alias("src"), side(F.col("t")).alias("tgt"), F.lit("undirected").alias("edge_type"), "weight"))
    vertices = G.incidence(edges).select("v").distinct().select(F.col("v").cast("long").alias("vix"), "v", F.lit(None).cast("map<string,string>").alias("attrs"))
    prizes = V.region_trade(spark, d).groupBy(F.col("s").alias("v")).agg((F.sum("weight") / 3).alias("prize"))
    p = C.steiner_tree(NetGraph(edges, vertices), prizes, "0", prizes)
    solution = L.solve({"p": p})
    return solution.agg(F.round(F.first("objective"), 4).alias("best"))


@query(f"""WITH {V.FEAT}, p AS (SELECT sample AS condition, max(CAST(value > 100 AS INTEGER)) FILTER (WHERE fid = 'click') AS a, max(CAST(value > 100 AS INTEGER)) FILTER (WHERE fid = 'view') AS b, max(CAST(value > 100 AS INTEGER)) FILTER (WHERE fid = 'error') AS e FROM feat GROUP BY 1),
    q AS (SELECT condition, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(e, 0) AS e FROM p), w AS (SELECT *, CASE WHEN a = 1 AND e = 0 THEN 1 WHEN b = 1 THEN 1 ELSE 0 END AS x FROM q)
    SELECT condition, CAST(x AS INTEGER) AS x, CAST(CASE WHEN x = 1 AND b = 1 THEN 1 ELSE 0 END AS INTEGER) AS y FROM w""")
def boolean_simulate(spark, d):
    """X <- click and not error, or view; Y <- X and view: each user a condition."""
    reactions = spark.createDataFrame([(0, ["click"], ["error"], "x"), (1, ["view"], [], "x"), (2, ["x", "view"], [], "y")], "rid long, pos array<string>, neg array<string>, product string")
    f = V.feat(spark, d)
    stimuli = f.filter(F.col("fid").isin("click", "view", "error")).select(F.col("sample").alias("condition"), F.col("fid").alias("v"), (F.col("value") > 100).cast("int").alias("value"))
    state = C.boolean_simulation(reactions, stimuli, f.select(F.col("sample").alias("condition")).distinct())
    on = lambda v: F.max(F.when(F.col("v") == v, F.col("state")))
    return state.groupBy("condition").agg(on("x").alias("x"), on("y").alias("y"))


@query("SELECT c_mktsegment AS sample, round(least(10, 0.5 * least(count(*) / 40.0, 8)) , 6) AS growth FROM customer GROUP BY 1")
def fba_lp(spark, d):
    """Growth of a four-step network per market segment, whose size bounds its uptake."""
    from ..model import literal_edges

    rows = [((), {"A": 1.0}, {"id": "uptake", "default_lb": 0.0, "default_ub": 8.0}), ({"A": 2.0}, {"B": 1.0}, {"id": "convert", "default_lb": 0.0, "default_ub": 1000.0}), ({"B": 1.0}, (), {"id": "growth", "default_lb": 0.0, "default_ub": 10.0})]
    g = NetGraph.of_edges(literal_edges(spark, rows))
    segments = V.read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("sample")).agg(F.count("*").alias("k")).orderBy("sample").collect()  # five rows
    table = spark.createDataFrame([(i, r["sample"], min(r["k"] / 40.0, 8.0)) for i, r in enumerate(segments)], "c long, sample string, ub double")
    bounds = C.resolved_bounds(g.edges, table.select("c", F.lit("uptake").alias("id"), F.lit(0.0).alias("lb"), "ub"), table)
    p = C.fba(g, bounds, table.select(F.lit("growth").alias("id"), "c", F.lit(None).cast("double").alias("weight")))
    flux = L.solve({"fba": p}).filter("name = 'flow'").join(g.edges.filter("id = 'growth'").select(F.col("eix").alias("r")), "r")
    return flux.join(table, "c").select("sample", F.round("value", 6).alias("growth"))


@query("SELECT round(0.05 * 3 - sum(least(10, 0.5 * least(count_ / 40.0, 8))), 6) AS objective FROM (SELECT count(*) AS count_ FROM customer GROUP BY c_mktsegment)")
def fba_coupled(spark, d):
    """The growth network of all segments as one program that charges 0.05 for each reaction any segment uses; a second, worse way
    from A to B stays shut."""
    from ..model import literal_edges

    rows = [((), {"A": 1.0}, {"id": "uptake", "default_lb": 0.0, "default_ub": 8.0}), ({"A": 2.0}, {"B": 1.0}, {"id": "convert", "default_lb": 0.0, "default_ub": 1000.0}), ({"A": 3.0}, {"B": 1.0}, {"id": "waste", "default_lb": 0.0, "default_ub": 1000.0}), ({"B": 1.0}, (), {"id": "growth", "default_lb": 0.0, "default_ub": 10.0})]
    g = NetGraph.of_edges(literal_edges(spark, rows))
    segments = V.read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("sample")).agg(F.count("*").alias("k")).orderBy("sample").collect()  # five rows
    table = spark.createDataFrame([(i, min(r["k"] / 40.0, 8.0)) for i, r in enumerate(segments)], "c long, ub double")
    bounds = C.resolved_bounds(g.edges, table.select("c", F.lit("uptake").alias("id"), F.lit(0.0).alias("lb"), "ub"), table)
    p = C.fba(g, bounds, table.select(F.lit("growth").alias("id"), "c", F.lit(None).cast("double").alias("weight")), coupling=0.05)
    return L.solve({"fba": p}).agg(F.round(F.first("objective"), 6).alias("objective"))


HALVES = ", ".join(f"d{2 * k} AS (SELECT x.a, y.b, min(x.d + y.d) AS d FROM d{k} x JOIN d{k} y ON x.b = y.a GROUP BY 1, 2)" for k in (1, 2, 4, 8, 16))


@query(f"""WITH {V.TRADE}, w AS (SELECT s AS a, t AS b, weight AS d FROM trade UNION ALL SELECT t, s, weight FROM trade), d1 AS (SELECT a, b, min(d) AS d FROM (SELECT * FROM w UNION ALL SELECT DISTINCT a, a, 0.0 FROM w) GROUP BY 1, 2), {HALVES},
    halves AS (SELECT * FROM (VALUES ('0', '7', '13', '21'), ('0', '13', '7', '21'), ('0', '21', '7', '13')) AS h(p, q, r, s)),
    best AS (SELECT min(a.d + b.d + m.d + c.d + e.d) AS x FROM d32 m, halves h JOIN d32 a ON a.a = h.p JOIN d32 b ON b.a = h.q JOIN d32 c ON c.a = h.r JOIN d32 e ON e.a = h.s WHERE a.b = m.a AND b.b = m.a AND c.b = m.b AND e.b = m.b)
    SELECT x AS cost, x AS of_edges FROM best""")
def steiner_nations(spark, d):
    """The least tree that joins four nations over the trade network, and what its edges cost; in SQL, two junctions and the paths
    between them."""
    from . import trees

    arcs = G.arcs(trade_graph(spark, d).edges).select("eix", "s", "t", "weight")
    cost, edges = trees.steiner(arcs, ["0", "7", "13", "21"])
    total = arcs.join(edges, "eix").agg(F.sum("weight").alias("of_edges"))
    return cost.crossJoin(total)  # one row by one row


@query(f"""WITH RECURSIVE {V.REGION_TRADE}, {UND}, e AS (SELECT *, row_number() OVER (ORDER BY s, t) - 1 AS i FROM und), masks AS (SELECT range AS mask FROM range(1024)),
    chosen AS (SELECT mask, s, t, weight FROM masks, e WHERE (mask >> CAST(i AS INTEGER)) & 1 = 1), both_ways AS (SELECT mask, s, t FROM chosen UNION ALL SELECT mask, t, s FROM chosen),
    prize AS (SELECT s AS v, sum(weight) / 3 AS prize FROM rtrade GROUP BY s), r AS (SELECT mask, v AS root, v FROM masks, prize UNION SELECT r.mask, r.root, b.t FROM r JOIN both_ways b ON b.mask = r.mask AND b.s = r.v)
    SELECT round(min(coalesce(cost, 0) - gain), 4) AS best FROM (SELECT mask, root, sum(prize) AS gain FROM r JOIN prize USING (v) GROUP BY mask, root) LEFT JOIN (SELECT mask, sum(weight) AS cost FROM chosen GROUP BY mask) USING (mask)""")
def pcst_best_root(spark, d):
    """The prize-collecting tree over regions from whichever root is best."""
    from . import trees

    prizes = V.region_trade(spark, d).groupBy(F.col("s").alias("v")).agg((F.sum("weight") / 3).alias("prize"))
    best, _ = trees.prize_collecting(_region_graph(spark, d), prizes)
    return best.select(F.round("objective", 4).alias("best"))


#: Every choice of one or no parent for regions 1 to 4, kept if all that have one hang on region 0, with the signs they then have.
PARENTS = f"""{V.REGION_TRADE}, opt AS (SELECT t AS v, s AS p, CASE WHEN weight % 2 = 0 THEN 1 ELSE -1 END AS g FROM rtrade WHERE t <> '0' UNION ALL SELECT x, NULL, 0 FROM (VALUES ('1'), ('2'), ('3'), ('4')) AS n(x)),
    pick AS (SELECT row_number() OVER () AS id, a.p AS p1, a.g AS g1, b.p AS p2, b.g AS g2, c.p AS p3, c.g AS g3, e.p AS p4, e.g AS g4 FROM opt a, opt b, opt c, opt e WHERE a.v = '1' AND b.v = '2' AND c.v = '3' AND e.v = '4'),
    up AS (SELECT id, '1' AS v, p1 AS p, g1 AS g FROM pick UNION ALL SELECT id, '2', p2, g2 FROM pick UNION ALL SELECT id, '3', p3, g3 FROM pick UNION ALL SELECT id, '4', p4, g4 FROM pick),
    live AS (SELECT id, '0' AS v, 1 AS state FROM pick UNION ALL SELECT up.id, up.v, live.state * up.g FROM live JOIN up ON up.id = live.id AND up.p = live.v),
    sizes AS (SELECT id, count(p) AS n FROM up GROUP BY id), whole AS (SELECT id, n FROM sizes JOIN (SELECT id, count(*) - 1 AS m FROM live GROUP BY id) USING (id) WHERE n = m)"""


@query(f"""WITH RECURSIVE {PARENTS}, cost AS (SELECT id, n + 1 AS edges, 2 - coalesce(sum(state) FILTER (WHERE v = '1'), 0) + coalesce(sum(state) FILTER (WHERE v = '3'), 0) AS error FROM whole JOIN live USING (id) GROUP BY id, n),
    best AS (SELECT min(struct_pack(x := error + 0.001 * edges, error := error, edges := edges)) AS b FROM cost) SELECT 'error' AS name, CAST(b.error AS DOUBLE) AS value FROM best UNION ALL SELECT 'edges', CAST(b.edges AS DOUBLE) FROM best""")
def carnival_small(spark, d):
    """Signals from region 0 to two measured regions over the region network, signs by parity."""
    arcs = V.region_trade(spark, d).withColumn("interaction", F.when(F.col("weight") % 2 == 0, 1).otherwise(-1))
    g = NetGraph.of_arcs(arcs, order=["s", "t"])
    rows = [("c", "0", "input", 1.0), ("c", "1", "output", 1.0), ("c", "3", "output", -1.0)]
    p, _ = C.carnival(g, spark.createDataFrame(rows, "condition string, v string, role string, value double"), 1e-3)
    solution = L.solve({"carnival": p})
    return M.evaluate(p, solution)[1].select("name", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE {PARENTS}, cost AS (SELECT id, n AS edges, sum(CASE v WHEN '2' THEN 1 WHEN '3' THEN -2 WHEN '4' THEN -1 ELSE 0 END) AS score, bool_or(v = '1') AS one FROM whole JOIN live USING (id) GROUP BY id, n),
    fit AS (SELECT * FROM cost WHERE id IN (SELECT id FROM up WHERE p = '0') AND (NOT one OR id IN (SELECT id FROM up WHERE p = '1'))),
    best AS (SELECT min(struct_pack(x := score + 0.01 * edges, score := score, edges := edges)) AS b FROM fit) SELECT 'score' AS name, CAST(b.score AS DOUBLE) AS value FROM best UNION ALL SELECT 'edges', CAST(b.edges AS DOUBLE) FROM best""")
def phonemes_small(spark, d):
    """Scored regions explained from region 0; in SQL, the best of all trees, as the network is complete."""
    arcs = V.region_trade(spark, d)
    g = NetGraph.of_arcs(arcs, order=["s", "t"])
    score = spark.createDataFrame([("c", "2", 1.0), ("c", "3", -2.0), ("c", "4", -1.0)], "condition string, v string, score double")
    p, _ = C.phonemes(g, spark.createDataFrame([("c", "0")], "condition string, v string"), score, 1e-2)
    solution = L.solve({"phonemes": p})
    return M.evaluate(p, solution)[1].select("name", F.round("value", 6).alias("value"))


# --- files and exchange ------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, tag: str) -> str:
    import uuid

    from ..storage import scratch_folder

    return f"{scratch_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@query(f"WITH {V.TRADE} SELECT s, t, CAST(CASE WHEN weight % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS interaction FROM trade")
def sif_scan(spark, d):
    """The trade network as a signed arc file, with a self-loop and a repeated row that reading drops."""
    path = _scratch(spark, "sif")
    rows = V.trade(spark, d).select("s", F.when(F.col("weight") % 2 == 0, 1).otherwise(-1).alias("i"), "t")
    loop = spark.createDataFrame([("0", 1, "0")], "s string, i int, t string")
    rows.unionByName(rows).unionByName(loop).write.csv(path, sep="\t")
    return IO.read_sif(spark, path, distinct=True)


@query(f"WITH {V.TRADE} SELECT {EIX}, weight FROM trade")
def graph_json_round_trip(spark, d):
    path = _scratch(spark, "json")
    IO.save_json(trade_graph(spark, d), path)
    return IO.load_json(spark, path).edges.select("eix", "weight")


@query(f"WITH {V.FEAT} SELECT sample, fid, role, value FROM feat")
def features_json_round_trip(spark, d):
    return D.FeatureSet.from_json(features(spark, d).to_json()).features.select("sample", "fid", "role", "value")


@query(f"WITH {V.HYPER} SELECT eix, v, a FROM hyper")
def graph_from_incidence(spark, d):
    """Back from coordinates to hyperedges and to coordinates again."""
    e = V.hyper(spark, d)
    again = IO.graph_from_incidence(G.incidence(e, values=True).select("eix", "v", "a"))
    return G.incidence(again.edges, values=True).select("eix", "v", "a")


@query(f"WITH {V.TRADE} SELECT s, t, 'directed' AS edge_type, CAST(CASE WHEN weight % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS interaction, weight FROM trade")
def edge_list_back(spark, d):
    """A graph to an exchange list, to a graph and to a list again."""
    again = IO.graph_from_edge_list(IO.edge_list(trade_graph(spark, d)))
    return IO.edge_list(again).select("s", "t", "edge_type", "interaction", "weight")


@query(f"WITH {V.TRADE} SELECT s, t, weight FROM trade")
def edge_list(spark, d):
    return IO.edge_list(trade_graph(spark, d)).select("s", "t", "weight")


@query(f"WITH {V.FEAT} SELECT sample AS layer, fid AS v, role FROM feat WHERE mapping = 'vertex'")
def condition_layers(spark, d):
    return IO.condition_layers(features(spark, d)).select("layer", "v", "role")


@query(f"""WITH {V.FEAT}, e AS (SELECT role AS condition, sum(abs(CASE WHEN value > 150 THEN 1 ELSE 0 END - CASE WHEN k > 50 THEN 1 ELSE 0 END))::BIGINT AS error, count(*) FILTER (WHERE value > 150) AS n_selected, count(*) FILTER (WHERE value > 150 AND k > 50) AS n_active FROM feat GROUP BY 1) SELECT * FROM e""")
def condition_results(spark, d):
    f = V.feat(spark, d).select(F.col("role").alias("condition"), F.concat_ws("/", "sample", "fid").alias("v"), (F.col("value") > 150).alias("sel"), (F.col("extra")["k"].cast("int") > 50).alias("obs"))
    pick = lambda c: f.select("condition", "v", F.col(c).cast("int").alias("value"))
    reactions = f.select("condition", F.col("v").alias("rid"), F.col("sel").alias("selected"), (F.col("sel") & F.col("obs")).alias("active"))
    return IO.condition_results(pick("obs"), pick("sel"), reactions).select("condition", "error", "n_selected", "n_active")


@query("SELECT o_orderkey, len(list(DISTINCT l_partkey)) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def stoichiometry_lists(spark, d):
    li = V.read(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("reaction"), F.col("l_partkey").cast("string").alias("metabolite"), F.lit(-1.0).alias("coef")).distinct()
    return S.stoichiometry(rows).select(F.col("reaction").alias("o_orderkey"), F.size("metabolites").cast("long").alias("n"))


@query("SELECT event_id, '{\"a\":\"' || event_type || '\",\"b\":\"' || user_id || '\"}' AS j FROM events")
def canonical_maps(spark, d):
    """Maps in any order give the same JSON."""
    e = V.read(spark, d, "events")
    m = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))).otherwise(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.col("user_id").cast("string")))
    return e.select("event_id", S.canonical_json(m).alias("j"))


@query("SELECT event_id, CAST(CASE WHEN try_cast(substr(event_type, 1, 1) || '' AS DOUBLE) IS NOT NULL THEN 1 WHEN event_id % 3 = 0 THEN 1 WHEN value - 50 >= 0 THEN 1 ELSE -1 END AS INTEGER) AS sign FROM events")
def sign_coercion(spark, d):
    """Text to a sign; what is no number counts as plus."""
    e = V.read(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise((F.col("value") - 50).cast("string"))
    return e.select("event_id", S.sign(text).alias("sign"))


@query(f"""WITH {V.HIER}, n AS (SELECT 'n:' || n_nationkey AS v, n_regionkey AS r FROM nation), l1 AS (SELECT v, 1 / (1 + exp(-(0.1 * r))) AS x FROM n),
    l2 AS (SELECT 'c:' || c_custkey AS v, 1 / (1 + exp(-0.1 * l1.x)) AS x FROM customer JOIN l1 ON l1.v = 'n:' || c_nationkey) SELECT v, round(x, 6) AS x FROM l1 UNION ALL SELECT v, round(x, 6) FROM l2""")
def neural_forward(spark, d):
    """A forward pass down the hierarchy to customers, each arc weighing 0.1 and region r giving r."""
    from ..operators import neural

    n, c = V.read(spark, d, "nation"), V.read(spark, d, "customer")
    arcs = n.select((-F.col("n_nationkey") - 1).cast("long").alias("eix"), F.concat(F.lit("r:"), "n_regionkey").alias("s"), F.concat(F.lit("n:"), "n_nationkey").alias("t"))
    arcs = arcs.unionByName(c.select(F.col("c_custkey").alias("eix"), F.concat(F.lit("n:"), "c_nationkey").alias("s"), F.concat(F.lit("c:"), "c_custkey").alias("t"))).withColumn("interaction", F.lit(1))
    inputs = V.read(spark, d, "region").select(F.lit("one").alias("sample"), F.concat(F.lit("r:"), "r_regionkey").alias("v"), F.col("r_regionkey").cast("double").alias("x"))
    out = neural.forward(neural.topology(arcs), arcs.select("eix", F.lit(0.1).alias("w")), spark.createDataFrame([], "v string, b double"), inputs)
    return out.filter("v NOT LIKE 'r:%'").select("v", F.round("x", 6).alias("x"))

"""Graphs and features derived from the star-schema tables, each as a Spark plan and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def hier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer -> order: a forest that grows with the data."""
    n, c, o = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    a = n.select(_id("r", "n_regionkey").alias("s"), _id("n", "n_nationkey").alias("t"))
    b = c.select(_id("n", "c_nationkey").alias("s"), _id("c", "c_custkey").alias("t"))
    return a.unionByName(b).unionByName(o.select(_id("c", "o_custkey").alias("s"), _id("o", "o_orderkey").alias("t")))


HIER = """hier AS (SELECT 'r:' || n_regionkey AS s, 'n:' || n_nationkey AS t FROM nation
    UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders)"""


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, t, rev): what suppliers of nation t sold to customers of nation s. Nations and suppliers are joined after the large
    tables have been summed by customer nation and supplier."""
    li, o, c, s = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    sold = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    part = sold.groupBy("c_nationkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("rev"))
    return part.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("t")).agg(F.sum("rev").alias("rev"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, t, weight): the two nations that each nation buys most from, weight in thousands."""
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.col("rev").desc(), "t"))
    top = revenue(spark, sf_dir).filter("s <> t").withColumn("rn", rank).filter("rn <= 2")
    return top.select(F.col("s").cast("string").alias("s"), F.col("t").cast("string").alias("t"), F.floor(F.col("rev") / 1000).cast("double").alias("weight"))


TRADE = """revenue AS (SELECT c_nationkey AS s, s_nationkey AS t, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS rev
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
trade AS (SELECT CAST(s AS VARCHAR) AS s, CAST(t AS VARCHAR) AS t, CAST(floor(rev / 1000) AS DOUBLE) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY s ORDER BY rev DESC, t) AS rn FROM revenue WHERE s <> t) WHERE rn <= 2)"""


def region_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, t, weight): line items between regions, a complete graph of five."""
    li, o, c, s, n = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    counts = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "l_suppkey").agg(F.count("*").alias("k"))
    a = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("s"))
    b = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("t"))
    placed = counts.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(a, "c_nationkey").join(b, "s_nationkey")
    return placed.filter("s <> t").groupBy(F.col("s").cast("string").alias("s"), F.col("t").cast("string").alias("t")).agg(F.sum("k").cast("double").alias("weight"))


REGION_TRADE = """rtrade AS (SELECT CAST(a.n_regionkey AS VARCHAR) AS s, CAST(b.n_regionkey AS VARCHAR) AS t, CAST(count(*) AS DOUBLE) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2)"""


def hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a hyperedge from its parts, with their quantities, to its customer; eix is the order."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    parts = li.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    src = parts.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(_id("p", "l_partkey").alias("v"), F.col("q").alias("coef")))).alias("src"))
    tgt = F.array(F.struct(_id("c", "o_custkey").alias("v"), F.lit(1.0).alias("coef")))
    return src.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("eix"), "src", tgt.alias("tgt"), F.lit("directed").alias("edge_type"))


HYPER = """hyper AS (SELECT o_orderkey AS eix, 'p:' || l_partkey AS v, 's' AS side, -sum(l_quantity) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
    UNION ALL SELECT o_orderkey, 'c:' || o_custkey, 't', 1.0 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as samples and event types as features: value, mapping and role by rule."""
    e = read(spark, sf_dir, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    k = F.min(F.get_json_object("props", "$.k").cast("int"))
    g = e.groupBy("user_id", "event_type").agg(cents.alias("cents"), k.alias("k"), F.min("event_id").alias("first_id"))
    role = F.when(F.col("cents") > 20_000, "output").when(F.col("cents") > 5_000, "input").otherwise("none")
    mapping = F.when(F.col("event_type").isin("click", "view"), "vertex").when(F.col("event_type") == "purchase", "edge").otherwise("none")
    return g.select(F.col("user_id").cast("string").alias("sample"), F.col("user_id").alias("sample_ix"), F.col("first_id").alias("pos"), F.col("event_type").alias("fid"), mapping.alias("mapping"), role.alias("role"), (F.col("cents") / 100.0).alias("value"), F.create_map(F.lit("k"), F.col("k").cast("string")).alias("extra"))


FEAT = """feat AS (SELECT CAST(user_id AS VARCHAR) AS sample, user_id AS sample_ix, first_id AS pos, event_type AS fid,
    CASE WHEN event_type IN ('click', 'view') THEN 'vertex' WHEN event_type = 'purchase' THEN 'edge' ELSE 'none' END AS mapping,
    CASE WHEN cents > 20000 THEN 'output' WHEN cents > 5000 THEN 'input' ELSE 'none' END AS role, cents / 100.0 AS value, k
    FROM (SELECT user_id, event_type, sum(CAST(round(value * 100) AS BIGINT)) AS cents, min(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k, min(event_id) AS first_id
          FROM events GROUP BY 1, 2))"""

"""A symbol graph over the star schema: its definition as DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ACCESSIBILITIES, empty_docs, normalised

PART_PROJECT = "p_brand"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accessibility(k):
    return F.get(F.array(*map(F.lit, ACCESSIBILITIES)), (k % 6).cast("int"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with their key k: regions, nations, suppliers, customers, orders and parts."""
    t = lambda n: table(spark, d, n)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", F.concat_ws(".", "r_name", "n_name").alias("nation"))
    null = F.lit(None).cast("string")

    def rows(df, prefix, kind, key, name, fqn, project, returns=null, node_kind=F.lit("Real")):
        k = F.col(key).cast("long")
        return df.select(F.concat(F.lit(prefix), k.cast("string")).alias("id"), F.lit(kind).alias("kind"), name.alias("display_name"), fqn.alias("fqn"), k.alias("k"), project.alias("project_origin"), node_kind.alias("node_kind"), returns.alias("return_type"))

    dot = lambda *c: F.concat_ws(".", *c)
    customers = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    owners = customers.select("c_custkey", "r_name", dot("nation", "c_name").alias("owner"))
    orders = t("orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
    order_name = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    all_ = (
        rows(t("region"), "N:r", "Namespace", "r_regionkey", F.col("r_name"), F.col("r_name"), F.col("r_name"))
        .union(rows(t("nation").join(nations.select(F.col("n_nationkey").alias("nk"), "r_name", "nation"), F.col("n_nationkey") == F.col("nk")), "T:n", "Type", "n_nationkey", F.col("n_name"), F.col("nation"), F.col("r_name")))
        .union(rows(t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")), "P:s", "Property", "s_suppkey", F.col("s_name"), dot("nation", "s_name"), F.col("r_name")))
        .union(rows(customers, "M:c", "Method", "c_custkey", F.col("c_name"), dot("nation", "c_name"), F.col("r_name"), F.col("c_mktsegment")))
        .union(rows(orders, "F:o", "Field", "o_orderkey", order_name, dot("owner", order_name), F.col("r_name"), F.col("o_orderstatus")))
        .union(rows(t("part"), "T:p", "Type", "p_partkey", F.col("p_name"), dot("p_brand", "p_name"), F.col("p_brand"), null, F.when(F.col("p_partkey") % 4 == 0, "Stub").otherwise("Real")))
    )
    k = F.col("k")
    text = lambda c: c.cast("string")
    p = lambda name, type_, default: F.struct(name.alias("name"), type_.alias("type_name"), default.alias("default_value"))
    parameters = F.when(F.col("kind") == "Method", F.array(p(F.concat(F.lit("a"), text(k % 3)), F.concat(F.lit("T"), text(k % 5)), null), p(F.lit("b"), F.lit("int"), text(k % 2))))
    constraints = F.when((F.col("project_origin").startswith("Brand")) & (k % 2 == 0), F.array(F.struct(F.lit("T").alias("type_parameter_name"), F.array(F.lit("class"), F.lit("IDisposable")).alias("constraints"))))
    return all_.withColumns({"accessibility": accessibility(k), "summary": F.when(k % 3 != 0, F.concat(F.lit("About "), F.col("display_name"))), "params": parameters, "limits": constraints, "previous_ids": F.array().cast("array<string>")})


def finished(df: DataFrame) -> DataFrame:
    """The canonical node columns of symbols()."""
    flag = F.lit(False)
    whole = F.transform("params", lambda p: F.struct(p["name"], p["type_name"], p["default_value"], flag.alias("is_params"), flag.alias("is_ref"), flag.alias("is_out"), flag.alias("is_in"), flag.alias("is_optional")))
    line = (F.col("k") % 1000).cast("int")
    span = F.when(F.col("kind") != "Namespace", F.struct(F.concat(F.col("project_origin"), F.lit("/f"), (F.col("k") % 50).cast("string"), F.lit(".cs")).alias("file_path"), line.alias("start_line"), F.lit(0).alias("start_column"), line.alias("end_line"), F.lit(0).alias("end_column")))
    return normalised(df.withColumns({"docs": empty_docs(F.col("summary")), "parameters": whole, "generic_constraints": F.col("limits"), "span": span}))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return finished(symbols(spark, d))


def links(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the keys of both ends (from_k, to_k)."""
    t = lambda n: table(spark, d, n)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", "r_name")
    customers = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.col("r_name").alias("c_region"))
    suppliers = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("r_name").alias("s_region"))
    orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", F.col("c_region").alias("o_region"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")

    def rows(df, a, ak, b, bk, kind, scope):
        end = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        return df.select(end(a, ak).alias("from_id"), end(b, bk).alias("to_id"), F.lit(kind).alias("kind"), scope.alias("scope"), F.col(ak).cast("long").alias("from_k"), F.col(bk).cast("long").alias("to_k"))

    inner = F.lit("IntraProject")
    to_part = F.when(F.col("l_partkey") % 4 == 0, "External").otherwise("CrossProject")
    # dealt by order, so neither the distinct pairs nor their join with the orders need another shuffle
    called = lines.select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct().join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return (
        rows(t("nation"), "N:r", "n_regionkey", "T:n", "n_nationkey", "Contains", inner)
        .union(rows(suppliers, "T:n", "s_nationkey", "P:s", "s_suppkey", "Contains", inner))
        .union(rows(customers, "T:n", "c_nationkey", "M:c", "c_custkey", "Contains", inner))
        .union(rows(orders, "M:c", "o_custkey", "F:o", "o_orderkey", "Contains", inner))
        .union(rows(lines.select("l_orderkey", "l_partkey").distinct(), "F:o", "l_orderkey", "T:p", "l_partkey", "References", to_part))
        .union(rows(lines.select("l_suppkey", "l_partkey").distinct(), "P:s", "l_suppkey", "T:p", "l_partkey", "Implements", to_part))
        .union(rows(called, "F:o", "l_orderkey", "P:s", "l_suppkey", "Calls", F.when(F.col("o_region") == F.col("s_region"), "IntraProject").otherwise("CrossProject")))
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).select("from_id", "to_id", "kind", "scope")


def before(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Snapshot A: symbols whose key does not end in 3, and the edges that leave them."""
    return finished(symbols(spark, d).where("k % 10 <> 3")), links(spark, d).where("from_k % 10 <> 3").select("from_id", "to_id", "kind", "scope")


def after(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Snapshot B: symbols whose key does not end in 7, edited by rules of their key, and the edges that leave them."""
    k = F.col("k")
    first = F.get("params", F.lit(0))
    retyped = lambda add: F.struct(first["name"].alias("name"), F.concat(first["type_name"], F.lit(add)).alias("type_name"), first["default_value"].alias("default_value"))
    second = F.get("params", F.lit(1))
    params = F.when(k % 19 == 0, F.array(retyped("X"), second)).when(k % 23 == 0, F.array(first)).when(k % 29 == 0, F.array(retyped("?"), second)).otherwise(F.col("params"))
    edited = symbols(spark, d).where("k % 10 <> 7").withColumns({
        "return_type": F.when(k % 5 == 1, F.concat("return_type", F.lit("?"))).when(k % 5 == 2, F.concat("return_type", F.lit("Z"))).otherwise(F.col("return_type")),
        "accessibility": F.when(k % 7 == 1, accessibility(k + 1)).otherwise(F.col("accessibility")),
        "summary": F.when(k % 11 == 0, F.concat(F.coalesce("summary", F.lit("")), F.lit(" edited"))).otherwise(F.col("summary")),
        "params": F.when(F.col("params").isNotNull(), params),
        "limits": F.when(F.col("limits").isNotNull() & (k % 6 == 0), F.array(F.struct(F.lit("T").alias("type_parameter_name"), F.array(F.lit("class")).alias("constraints")))).otherwise(F.col("limits")),
        "previous_ids": F.when(k % 13 == 0, F.array("id")).otherwise(F.col("previous_ids")),
        "id": F.when(k % 13 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")),
    })
    return finished(edited), later_kinds(links(spark, d).where("from_k % 10 <> 7"))


def later_kinds(of: DataFrame) -> DataFrame:
    """The edges of snapshot B from links that it has."""
    kind = F.when((F.col("kind") == "Calls") & (F.col("to_k") % 17 == 0), "References").otherwise(F.col("kind"))
    return of.withColumn("kind", kind).select("from_id", "to_id", "kind", "scope")


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """before() and after(), for queries that read both: an edge is told which snapshots have it when it is made, so the tables are dealt once for the two."""
    k = F.col("from_k")
    # a null is of neither
    has = F.array(F.when(k % 10 != 3, F.lit(False)), F.when(k % 10 != 7, F.lit(True)))
    told = links(spark, d).select("*", F.explode(has).alias("later"))
    return before(spark, d)[0], told.where("not later").select("from_id", "to_id", "kind", "scope"), after(spark, d)[0], later_kinds(told.where("later"))


SQL = """
WITH g0 AS (
  SELECT 'N:r' || r_regionkey AS id, 'Namespace' AS kind, r_name AS display_name, r_name AS fqn, r_regionkey::BIGINT AS k, r_name AS project_origin, 'Real' AS node_kind, NULL::VARCHAR AS return_type FROM region
  UNION ALL SELECT 'T:n' || n_nationkey, 'Type', n_name, r_name || '.' || n_name, n_nationkey, r_name, 'Real', NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'P:s' || s_suppkey, 'Property', s_name, r_name || '.' || n_name || '.' || s_name, s_suppkey, r_name, 'Real', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'M:c' || c_custkey, 'Method', c_name, r_name || '.' || n_name || '.' || c_name, c_custkey, r_name, 'Real', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'F:o' || o_orderkey, 'Field', 'o' || o_orderkey, r_name || '.' || n_name || '.' || c_name || '.o' || o_orderkey, o_orderkey, r_name, 'Real', o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'T:p' || p_partkey, 'Type', p_name, p_brand || '.' || p_name, p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN 'Stub' ELSE 'Real' END, NULL FROM part),
acc AS (SELECT ['Public', 'Internal', 'Protected', 'Private', 'ProtectedInternal', 'PrivateProtected'] AS names),
g_nodes AS (
  SELECT g0.*, names[(k % 6 + 1)::INT] AS accessibility, CASE WHEN k % 3 <> 0 THEN 'About ' || display_name END AS summary,
    CASE WHEN kind = 'Method' THEN 'a' || (k % 3) END AS p1, CASE WHEN kind = 'Method' THEN 'T' || (k % 5) END AS t1, CASE WHEN kind = 'Method' THEN 2 ELSE 0 END AS np,
    CASE WHEN project_origin LIKE 'Brand%' AND k % 2 = 0 THEN 'class,IDisposable' ELSE '' END AS limits,
    CASE WHEN kind <> 'Namespace' THEN project_origin || '/f' || (k % 50) || '.cs' END AS path
  FROM g0, acc),
s_region AS (SELECT s_suppkey, s_nationkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o_region AS (SELECT o_orderkey, o_custkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g_edges AS (
  SELECT 'N:r' || n_regionkey AS from_id, 'T:n' || n_nationkey AS to_id, 'Contains' AS kind, 'IntraProject' AS scope, n_regionkey::BIGINT AS from_k, n_nationkey::BIGINT AS to_k FROM nation
  UNION ALL SELECT 'T:n' || s_nationkey, 'P:s' || s_suppkey, 'Contains', 'IntraProject', s_nationkey, s_suppkey FROM supplier
  UNION ALL SELECT 'T:n' || c_nationkey, 'M:c' || c_custkey, 'Contains', 'IntraProject', c_nationkey, c_custkey FROM customer
  UNION ALL SELECT 'M:c' || o_custkey, 'F:o' || o_orderkey, 'Contains', 'IntraProject', o_custkey, o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'F:o' || l_orderkey, 'T:p' || l_partkey, 'References', CASE WHEN l_partkey % 4 = 0 THEN 'External' ELSE 'CrossProject' END, l_orderkey, l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'P:s' || l_suppkey, 'T:p' || l_partkey, 'Implements', CASE WHEN l_partkey % 4 = 0 THEN 'External' ELSE 'CrossProject' END, l_suppkey, l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'F:o' || l_orderkey, 'P:s' || l_suppkey, 'Calls', CASE WHEN o.r_name = s.r_name THEN 'IntraProject' ELSE 'CrossProject' END, l_orderkey, l_suppkey FROM lineitem JOIN o_region o ON l_orderkey = o_orderkey JOIN s_region s ON l_suppkey = s_suppkey),
a_nodes AS (SELECT *, NULL::VARCHAR AS old_id FROM g_nodes WHERE k % 10 <> 3),
a_edges AS (SELECT * FROM g_edges WHERE from_k % 10 <> 3),
b_nodes AS (
  SELECT CASE WHEN k % 13 = 0 THEN id || 'x' ELSE id END AS id, kind, display_name, fqn, k, project_origin, node_kind,
    CASE WHEN k % 5 = 1 THEN return_type || '?' WHEN k % 5 = 2 THEN return_type || 'Z' ELSE return_type END AS return_type,
    CASE WHEN k % 7 = 1 THEN names[((k + 1) % 6 + 1)::INT] ELSE accessibility END AS accessibility,
    CASE WHEN k % 11 = 0 THEN coalesce(summary, '') || ' edited' ELSE summary END AS summary, p1,
    CASE WHEN k % 19 = 0 THEN t1 || 'X' WHEN k % 23 = 0 THEN t1 WHEN k % 29 = 0 THEN t1 || '?' ELSE t1 END AS t1,
    CASE WHEN k % 19 <> 0 AND k % 23 = 0 AND np = 2 THEN 1 ELSE np END AS np,
    CASE WHEN limits <> '' AND k % 6 = 0 THEN 'class' ELSE limits END AS limits, path,
    CASE WHEN k % 13 = 0 THEN id END AS old_id
  FROM g_nodes, acc WHERE k % 10 <> 7),
b_edges AS (SELECT from_id, to_id, CASE WHEN kind = 'Calls' AND to_k % 17 = 0 THEN 'References' ELSE kind END AS kind, scope, from_k, to_k FROM g_edges WHERE from_k % 10 <> 7)
"""

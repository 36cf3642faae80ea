"""Roll-ups and differences of solutions: several projects in one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import diff
from .coverage import candidates, percent
from .graph import UNKNOWN, real


def owned(nodes: DataFrame, project_name: str) -> DataFrame:
    """nodes whose missing project is the snapshot's."""
    return nodes.withColumn("project_origin", F.coalesce("project_origin", F.lit(project_name)))


def projects(nodes: DataFrame, edges: DataFrame, project_name: str = "(unknown)") -> DataFrame:
    """(project, node_count, edge_count, coverage_percent): an inner edge counts for each project it touches."""
    mine = owned(real(nodes), project_name)
    count = mine.groupBy(F.col("project_origin").alias("project")).agg(F.count("*").alias("node_count"))
    of = mine.select("id", "project_origin")
    inner = edges.where("scope = 'IntraProject'").join(of.toDF("from_id", "a"), "from_id", "left").join(of.toDF("to_id", "b"), "to_id", "left")
    touched = inner.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("project")).where("project is not null").groupBy("project").agg(F.count("*").alias("edge_count"))
    documented = candidates(mine).groupBy(F.col("project_origin").alias("project")).agg(percent(F.count("docs.summary"), F.count("*")).alias("coverage_percent"))
    out = count.join(touched, "project", "left").join(documented, "project", "left")
    return out.select("project", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.coalesce("coverage_percent", F.lit(0.0)).alias("coverage_percent"))


def dependency_dag(nodes: DataFrame, edges: DataFrame, project_name: str = "(unknown)") -> DataFrame:
    """(project, depends_on): projects that cross-project edges between real symbols lead to, sorted."""
    of = owned(real(nodes), project_name).select("id", "project_origin")
    cross = edges.where("scope = 'CrossProject'").join(of.toDF("from_id", "project"), "from_id").join(of.toDF("to_id", "target"), "to_id").where("project <> target")
    return cross.groupBy("project").agg(F.array_sort(F.collect_set("target")).alias("depends_on"))


def totals(nodes: DataFrame) -> DataFrame:
    """One row: real and stub symbols, and whether there is one project at most."""
    return nodes.agg(F.count_if(F.col("node_kind") == "Real").alias("real_count"), F.count_if(F.col("node_kind") == "Stub").alias("stub_count"), (F.countDistinct("project_origin") <= 1).alias("single_project"))


def project_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project, status): added, removed or surviving."""
    names = lambda df: real(df).where("project_origin is not null").select(F.col("project_origin").alias("project")).distinct()
    both = names(before).withColumn("a", F.lit(True)).join(names(after).withColumn("b", F.lit(True)), "project", "full_outer")
    return both.select("project", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("surviving").alias("status"))


def inner_diff(before: DataFrame, before_edges: DataFrame, after: DataFrame, after_edges: DataFrame) -> DataFrame:
    """The semantic diff of every surviving project at once: real symbols and inner edges only."""
    survive = project_changes(before, after).where("status = 'surviving'").select(F.col("project").alias("project_origin"))
    nodes = lambda df: real(df).join(survive, "project_origin", "left_semi")

    def edges(own, of):
        return of.where("scope = 'IntraProject'").join(own.select(F.col("id").alias("from_id"), "project_origin"), "from_id").select("from_id", "to_id", "kind", "scope", "project_origin")

    a, b = nodes(before), nodes(after)
    return diff.semantic_diff(a, edges(a, before_edges), b, edges(b, after_edges), by=["project_origin"])


def cross_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (source, target, kind) of cross-project edges, ends as project::id."""
    of = real(nodes).select("id", "project_origin")
    named = edges.where("scope = 'CrossProject'").join(of.toDF("from_id", "a"), "from_id", "left").join(of.toDF("to_id", "b"), "to_id", "left")
    end = lambda p, i: F.concat(F.coalesce(p, F.lit("(unknown)")), F.lit("::"), i)
    return named.select(end("a", "from_id").alias("source"), end("b", "to_id").alias("target"), "kind").distinct()


def cross_edge_changes(before: DataFrame, before_edges: DataFrame, after: DataFrame, after_edges: DataFrame) -> DataFrame:
    """(source, target, kind, status): cross-project edges added and removed; a change of scope alone is none.

    Both sides' edges are dealt by source once and by target once, and those whose ends
    keep their projects cancel there. Names decide about the rest. Edges with other ids could
    only have the same names where a colon leaves open what the project is: these never cancel by ids.
    """
    later = F.col("later")
    cross = "scope = 'CrossProject'"
    dealt = diff.sides(before_edges.where(cross), after_edges.where(cross), "from_id", "to_id", "kind").repartition("from_id")
    edges = dealt.groupBy("from_id", "to_id", "kind").agg(F.bool_or(~later).alias("was"), F.bool_or(later).alias("stays"))
    name = F.coalesce("project_origin", F.lit(UNKNOWN))
    of = diff.sides(real(before), real(after), "id", "project_origin").groupBy("id").agg(*(F.array_sort(F.collect_set(F.when(later == side, name))).alias(c) for c, side in (("x", False), ("y", True))))
    named = edges.join(of.toDF("from_id", "ax", "ay"), "from_id", "left").join(of.toDF("to_id", "bx", "by"), "to_id", "left")
    projects = ["ax", "ay", "bx", "by"]
    none = F.array(F.lit(UNKNOWN))
    named = named.withColumns({c: F.when(F.size(c) > 0, F.col(c)).otherwise(none) for c in projects})
    known = F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & F.col("kind").isNotNull()
    same = F.col("was") & F.col("stays") & (F.col("ax") == F.col("ay")) & (F.col("bx") == F.col("by"))
    open_ = F.exists(F.concat(*projects), lambda p: p.contains(":"))
    for i in ("from_id", "to_id"):
        open_ = open_ | F.col(i).startswith(":") | F.col(i).contains("::")
    # where names tell their ids, only the names of one pair of ids can cancel each other: decided in its row, without a shuffle
    crossed = lambda held, a, b: F.when(F.col(held), F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: F.struct(p.alias("p"), q.alias("q")))))).otherwise(F.array().cast("array<struct<p:string,q:string>>"))
    left = named.where(~(known & same) | open_).select("from_id", "to_id", "kind", (known & ~open_).alias("alone"), crossed("was", "ax", "bx").alias("b"), crossed("stays", "ay", "by").alias("a"))
    alone = F.col("alone")
    rest = lambda x, y, value: F.transform(F.when(alone, F.array_except(x, y)).otherwise(F.col(x)), lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), F.lit(value).alias("later"), alone.alias("settled")))
    pairs = left.select("from_id", "to_id", "kind", F.inline(F.concat(rest("b", "a", False), rest("a", "b", True))))
    end = lambda p, i: F.concat(p, F.lit("::"), i)
    rows = pairs.select(end("p", "from_id").alias("source"), end("q", "to_id").alias("target"), "kind", "later", "settled")
    status = lambda added: F.when(added, "added").otherwise("removed").alias("status")
    # a null equals nothing: such rows of the two sides stay apart
    apart = F.when(F.col("source").isNull() | F.col("target").isNull() | F.col("kind").isNull(), later)
    told = rows.where("not settled").groupBy("source", "target", "kind", apart.alias("apart")).agg(F.bool_and(later).alias("added"), F.bool_and(~later).alias("removed"))
    out = lambda df, added: df.select("source", "target", "kind", status(F.col(added)))
    return out(rows.where("settled"), "later").union(out(told.where("added or removed"), "added"))

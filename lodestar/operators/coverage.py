"""Documentation coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import namespace_of
from ..model import DOC_KINDS, PUBLIC_SURFACE


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, to one decimal, half to even; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / whole * 100.0, 1))


# Fixed value: the attribute that takes a symbol out of documentation coverage.
OPT_OUT = "ExcludeFromDocCoverage"


def opted_in(nodes: DataFrame) -> DataFrame:
    """nodes without those whose attributes (array<string>, if there is such a column) opt out of coverage."""
    if "attributes" not in nodes.columns:
        return nodes
    return nodes.where(~F.coalesce(F.exists("attributes", lambda a: a.isin(OPT_OUT, f"{OPT_OUT}Attribute")), F.lit(False)))


def candidates(nodes: DataFrame, project: str | None = None) -> DataFrame:
    """Real public-surface symbols of the kinds that should be documented."""
    found = opted_in(nodes).where((F.col("node_kind") == "Real") & F.col("kind").isin(DOC_KINDS) & F.col("accessibility").isin(PUBLIC_SURFACE))
    return found if project is None else found.where(F.col("project_origin") == project)


def counted(grouped) -> DataFrame:
    total, documented = F.count("*"), F.count("docs.summary")
    return grouped.agg(total.alias("total"), documented.alias("documented"), percent(documented, total).alias("coverage_percent"))


def by_project(nodes: DataFrame, project: str | None = None) -> DataFrame:
    return counted(candidates(nodes, project).groupBy(F.coalesce("project_origin", F.lit("(unknown)")).alias("project")))


def by_namespace(nodes: DataFrame, project: str | None = None) -> DataFrame:
    return counted(candidates(nodes, project).groupBy(namespace_of(F.col("fqn")).alias("namespace")))


def by_kind(nodes: DataFrame, project: str | None = None) -> DataFrame:
    return counted(candidates(nodes, project).groupBy("kind"))


def overall(nodes: DataFrame, project: str | None = None) -> DataFrame:
    return counted(candidates(nodes, project).groupBy())


def doc_coverage(nodes: DataFrame, project: str | None = None) -> DataFrame:
    """All groupings in one pass: (grouping, key, total, documented, coverage_percent)."""
    keyed = candidates(nodes, project).select("kind", "docs.summary", F.coalesce("project_origin", F.lit("(unknown)")).alias("project"), namespace_of(F.col("fqn")).alias("namespace"))
    total, documented = F.count("*"), F.count("summary")
    level = F.grouping_id("project", "namespace", "kind")
    sets = keyed.groupingSets([["project"], ["namespace"], ["kind"], []], "project", "namespace", "kind")
    return sets.agg(level.alias("level"), total.alias("total"), documented.alias("documented"), percent(documented, total).alias("coverage_percent")).select(
        F.when(F.col("level") == 3, "project").when(F.col("level") == 5, "namespace").when(F.col("level") == 6, "kind").otherwise("overall").alias("grouping"),
        F.coalesce("project", "namespace", "kind", F.lit("")).alias("key"), "total", "documented", "coverage_percent",
    )


def undocumented(nodes: DataFrame, threshold: float = 80.0, shown: int = 20) -> DataFrame:
    """One row: the share of public symbols with a summary, whether it is under the threshold, and the first undocumented ids."""
    public = opted_in(nodes).where((F.col("node_kind") == "Real") & (F.col("accessibility") == "Public"))
    first = public.where(F.col("docs.summary").isNull()).orderBy("id").limit(shown).agg(F.array_sort(F.collect_list("id")).alias("first"))
    total, documented = F.count("*"), F.count("docs.summary")
    share = public.agg(total.alias("total"), documented.alias("documented"), percent(documented, total).alias("coverage_percent"))
    return share.withColumn("under", F.col("coverage_percent") < threshold).join(F.broadcast(first))


def parity(nodes: DataFrame) -> DataFrame:
    """Public members without a summary."""
    return opted_in(nodes).where((F.col("node_kind") == "Real") & (F.col("accessibility") == "Public") & F.col("docs.summary").isNull()).select("id", "kind", "display_name")


def suspicious_edits(nodes: DataFrame) -> DataFrame:
    """Symbols whose attributes (array<string>) say obsolete or nullable while their docs do not mention it."""
    text = F.lower(F.concat_ws(" ", "docs.summary", "docs.remarks"))
    obsolete = F.array_contains("attributes", "Obsolete") & ~text.rlike("obsolete|deprecated")
    nullable = F.exists("attributes", lambda a: a.isin("AllowNull", "MaybeNull", "NotNullWhen", "MaybeNullWhen")) & ~text.contains("null")
    return nodes.where(obsolete | nullable).select("id", F.when(obsolete, "obsolete").otherwise("nullable").alias("reason"))

"""Differences of two snapshots: a plain one by id, and a semantic one by category.

The plain one is one full outer join of the nodes and keeps its differing rows in the
checkpoint folder, as it reads them several times. The semantic one deals the nodes of both
sides by id once, and the edges by their source once; each id's rows meet there, and a
filter on id goes through to the inputs, which it would not through a full outer join.
`semantic_diff` compares whole tables of many
projects at once when `by` names a column that both sides share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CHANGE_CATEGORIES, PUBLIC_SURFACE, rank
from .graph import stored

ARROW = "→"


def graph_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change, summary): Added, Removed and Modified symbols; a rename is a Modified one.

    An added symbol whose previous ids name removed ones is a rename of the first of them;
    a removed id is used up by one symbol, the smallest by id.
    """
    sides = [df.select("id", F.struct("display_name", "fqn", "accessibility", "kind", F.col("docs.summary").alias("summary"), *more).alias(name)) for df, name, more in ((before, "x", ()), (after, "y", ("previous_ids",)))]
    # one join carries both sides; what is looked up again are only the ids on one side alone
    both = stored(sides[0].join(sides[1], "id", "full_outer").where("x is null or y is null or not (x.display_name <=> y.display_name and x.fqn <=> y.fqn and x.accessibility <=> y.accessibility and x.kind <=> y.kind and x.summary <=> y.summary)"))
    removed, added = both.where("y is null").select("id"), both.where("x is null").select("id", "y.previous_ids")
    olds = added.select("id", F.posexplode("previous_ids").alias("place", "old")).join(removed.withColumnRenamed("id", "old"), "old", "left_semi")
    first = olds.groupBy("id").agg(F.min_by("old", "place").alias("old"))
    renames = first.groupBy("old").agg(F.min("id").alias("id"))
    arrow = lambda name, x, y: F.concat(F.lit(f"{name}: "), F.coalesce(x, F.lit("")), F.lit(f" {ARROW} "), F.coalesce(y, F.lit("")))
    columns = {"name": "display_name", "fqn": "fqn", "accessibility": "accessibility", "kind": "kind"}
    texts = [F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), arrow(name, F.col(f"x.{c}"), F.col(f"y.{c}"))) for name, c in columns.items()]
    texts.append(F.when(~F.col("x.summary").eqNullSafe(F.col("y.summary")), F.lit("doc changed")))
    common = both.where("x is not null and y is not null").select("id", F.concat_ws("; ", *texts).alias("summary"))
    entry = lambda df, change, summary: df.select("id", F.lit(change).alias("change"), summary.alias("summary"))
    return (
        entry(renames, "Modified", F.concat(F.lit("renamed from "), F.col("old")))
        .union(entry(removed.join(renames.select(F.col("old").alias("id")), "id", "left_anti"), "Removed", F.lit("symbol removed")))
        .union(entry(added.join(renames, "id", "left_anti"), "Added", F.lit("symbol added")))
        .union(entry(common, "Modified", F.col("summary")))
    )


def base_type(name: Column) -> Column:
    return F.regexp_replace(name, r"\?+$", "")


def only_nullability(before: Column, after: Column) -> Column:
    """Whether two type names, both given, differ in trailing question marks alone."""
    return F.coalesce((base_type(before) == base_type(after)) & (before != after), F.lit(False))


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def parameter_changes(before: Column, after: Column) -> Column:
    """Positional changes: (change, name, old_type, new_type, old_default, new_default)."""
    none = F.lit(None).cast("string")

    def one(b: Column, a: Column) -> Column:
        made = lambda change, name, *rest: F.struct(F.lit(change).alias("change"), name.alias("name"), *(c.alias(n) for c, n in zip(rest, ("old_type", "new_type", "old_default", "new_default"))))
        changed = (differs(b["type_name"], a["type_name"]) & ~only_nullability(b["type_name"], a["type_name"])) | differs(b["name"], a["name"]) | differs(b["default_value"], a["default_value"])
        return (
            F.when(b.isNull(), made("Added", a["name"], none, a["type_name"], none, a["default_value"]))
            .when(a.isNull(), made("Removed", b["name"], b["type_name"], none, b["default_value"], none))
            .when(changed, made("Modified", a["name"], b["type_name"], a["type_name"], b["default_value"], a["default_value"]))
        )

    return F.filter(F.zip_with(before, after, one), lambda c: c.isNotNull())


def sides(before: DataFrame, after: DataFrame, *columns: str | Column) -> DataFrame:
    """columns of both tables as one, with later: whether a row is of the second."""
    return before.select(*columns, F.lit(False).alias("later")).union(after.select(*columns, F.lit(True).alias("later")))


def parents(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(id, old_parent, new_parent): the first source, in edge order, of Contains edges into a symbol, on either side."""
    into = sides(before.where("kind = 'Contains'"), after.where("kind = 'Contains'"), *keys, F.col("to_id").alias("id"), "from_id")
    return into.groupBy(*keys, "id").agg(F.min(F.when(~F.col("later"), F.col("from_id"))).alias("old_parent"), F.min(F.when(F.col("later"), F.col("from_id"))).alias("new_parent"))


def dependency_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(id, removed_edges, added_edges), edges as (to_id, kind): differences of a symbol's outgoing edges.

    Kinds of one pair of ends are compared as multisets: of repeated edges those without
    a partner of the same kind count.
    """
    # dealt by source once: the counts of an edge and the lists of its source need no other shuffle
    dealt = sides(before, after, *keys, "from_id", "to_id", "kind").repartition(*keys, "from_id")
    both = dealt.groupBy(*keys, "from_id", "to_id", "kind").agg(F.sum(F.when(F.col("later"), 1).otherwise(-1)).alias("more")).where("more <> 0")
    edge = F.struct("to_id", "kind")
    times = lambda n: F.array_repeat(edge, n.cast("int"))
    gather = lambda cond, n: F.array_sort(F.flatten(F.collect_list(F.when(cond, times(n)))))
    return both.groupBy(*keys, F.col("from_id").alias("id")).agg(gather(F.col("more") < 0, -F.col("more")).alias("removed_edges"), gather(F.col("more") > 0, F.col("more")).alias("added_edges"))


def comparable(docs: Column) -> Column:
    """A doc comment with its maps as sorted entries, as maps have no equality."""
    fields = ["summary", "remarks", "returns", "examples", "exceptions", "see_also"]
    pairs = lambda c: F.array_sort(F.map_entries(docs[c]))
    return F.when(docs.isNotNull(), F.struct(*(docs[f].alias(f) for f in fields), pairs("params").alias("params"), pairs("type_params").alias("type_params")))


def semantic_diff(before: DataFrame, before_edges: DataFrame, after: DataFrame, after_edges: DataFrame, by: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """One row for each change: id, parent_id, change_type, category, severity, description and the details.

    Severity is by the accessibility before; additions never break, doc changes inform.
    Of repeated ids the greatest row counts. `by` columns, such as a project, are part of
    the key of both tables. Of `categories` alone, if given: edges are then only compared
    for Dependency.
    """
    keys, asked = by or [], categories or CHANGE_CATEGORIES
    body = ["display_name", "accessibility", "return_type", "parameters", "generic_constraints", "docs"]
    order = F.struct(*body[:-1], comparable(F.col("docs")).alias("docs"))
    greatest = lambda later: F.max_by(F.struct(*body), F.when(F.col("later") == later, order))
    # dealt before they are aggregated, as ids seldom repeat and the state of an aggregate holds a row twice
    dealt = sides(before, after, *keys, "id", *body).repartition(*keys, "id")
    # a null equals nothing: such rows of the two sides stay apart
    known = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in [*keys, "id"]))
    packed = dealt.groupBy(*keys, "id", F.when(~known, F.col("later")).alias("apart")).agg(greatest(False).alias("b"), greatest(True).alias("a")).drop("apart")
    if "Dependency" in asked:
        packed = packed.join(dependency_changes(before_edges, after_edges, keys), [*keys, "id"], "left")
    else:
        packed = packed.withColumns({c: F.lit(None).cast("array<struct<to_id:string,kind:string>>") for c in ("removed_edges", "added_edges")})
    joined = packed.join(parents(before_edges, after_edges, keys), [*keys, "id"], "left")
    b, a = F.col("b"), F.col("a")
    both = b.isNotNull() & a.isNotNull()
    breaks = F.when(b["accessibility"].isin(PUBLIC_SURFACE), "Breaking").otherwise("NonBreaking")
    changes = parameter_changes(b["parameters"], a["parameters"])
    joined = joined.withColumn("parameter_changes", F.when(both, changes))
    returns = differs(b["return_type"], a["return_type"]) & ~only_nullability(b["return_type"], a["return_type"])
    text = lambda c: F.coalesce(c, F.lit(""))
    quoted = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else text(p) for p in parts))

    empty = {
        "parameter_changes": F.lit(None).cast("array<struct<change:string,name:string,old_type:string,new_type:string,old_default:string,new_default:string>>"),
        "old_value": F.lit(None).cast("string"), "new_value": F.lit(None).cast("string"), "type_parameter": F.lit(None).cast("string"),
        "removed": F.lit(None).cast("array<string>"), "added": F.lit(None).cast("array<string>"),
        "removed_edges": F.lit(None).cast("array<struct<to_id:string,kind:string>>"), "added_edges": F.lit(None).cast("array<struct<to_id:string,kind:string>>"),
    }

    def change(kind: str, category: str, severity: Column, description: Column, **detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("change_type"), F.lit(category).alias("category"), severity.alias("severity"), description.alias("description"), *((detail.get(k, v)).cast(dict_type(k)).alias(k) for k, v in empty.items()))

    def dict_type(k: str) -> str:
        return {"parameter_changes": "array<struct<change:string,name:string,old_type:string,new_type:string,old_default:string,new_default:string>>", "removed": "array<string>", "added": "array<string>", "removed_edges": "array<struct<to_id:string,kind:string>>", "added_edges": "array<struct<to_id:string,kind:string>>"}.get(k, "string")

    pc = F.col("parameter_changes")
    shared = F.exists(F.zip_with(b["parameters"], a["parameters"], lambda x, y: only_nullability(x["type_name"], y["type_name"])), lambda v: F.coalesce(v, F.lit(False)))
    null_return = only_nullability(b["return_type"], a["return_type"])
    re, ae = F.col("removed_edges"), F.col("added_edges")
    n_edges = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    # The wording of the descriptions.
    single = [
        F.when(b.isNull(), change("Added", "Signature", F.lit("NonBreaking"), quoted("Symbol '", a["display_name"], "' added."))),
        F.when(a.isNull(), change("Removed", "Signature", breaks, quoted("Symbol '", b["display_name"], "' removed."))),
        F.when(both & (returns | (F.size(pc) > 0)), change("Modified", "Signature", breaks, F.when(returns, quoted("Return type changed from '", b["return_type"], "' to '", a["return_type"], "'.")).otherwise(quoted("Parameter signature changed: ", F.size(pc).cast("string"), " parameter(s) modified.")), parameter_changes=pc, old_value=b["return_type"], new_value=a["return_type"])),
        F.when(both & (null_return | shared), change("Modified", "Nullability", breaks, F.when(null_return, quoted("Nullability changed on return type: '", b["return_type"], f"' {ARROW} '", a["return_type"], "'.")).otherwise("Nullability changed on parameter type."), old_value=b["return_type"], new_value=a["return_type"])),
        F.when(both & differs(b["accessibility"], a["accessibility"]), change("Modified", "Accessibility", breaks, quoted("Accessibility changed from '", b["accessibility"], "' to '", a["accessibility"], "'."), old_value=b["accessibility"], new_value=a["accessibility"])),
        F.when(both & (re.isNotNull() | ae.isNotNull()), change("Modified", "Dependency", breaks, quoted("Dependency edges changed: ", n_edges(re), " removed, ", n_edges(ae), " added."), removed_edges=re, added_edges=ae)),
        F.when(both & differs(comparable(b["docs"]), comparable(a["docs"])), change("Modified", "DocComment", F.lit("Informational"), F.lit("Documentation comment changed."), old_value=b["docs"]["summary"], new_value=a["docs"]["summary"])),
    ]
    of = lambda side: F.map_from_entries(F.transform(side["generic_constraints"], lambda c: F.struct(c["type_parameter_name"], c["constraints"])))
    names = F.array_sort(F.array_union(F.transform(b["generic_constraints"], lambda c: c["type_parameter_name"]), F.transform(a["generic_constraints"], lambda c: c["type_parameter_name"])))
    got = lambda m, k: F.coalesce(F.try_element_at(m, k), F.array().cast("array<string>"))

    def constraint(k: Column) -> Column:
        gone, new_ = F.array_except(got(of(b), k), got(of(a), k)), F.array_except(got(of(a), k), got(of(b), k))
        return F.when((F.size(gone) > 0) | (F.size(new_) > 0), change("Modified", "Constraint", breaks, quoted("Generic constraints changed for type parameter '", k, "'."), type_parameter=k, removed=gone, added=new_))

    constraints = F.when(both, F.transform(names, constraint)).otherwise(F.array())
    all_ = F.filter(F.concat(F.array(*single), constraints), lambda c: c.isNotNull() & c["category"].isin(asked))
    parent = F.when(F.col("a").isNull(), F.col("old_parent")).otherwise(F.col("new_parent"))
    out = joined.select(*keys, "id", parent.alias("parent_id"), F.explode(all_).alias("c"))
    return out.select(*keys, "id", "parent_id", "c.*")


def in_order(changes: DataFrame) -> DataFrame:
    """changes by id, category and type parameter."""
    return changes.orderBy("id", rank("category", CHANGE_CATEGORIES), "type_parameter")


def summary(changes: DataFrame) -> DataFrame:
    """One row of counts by type and severity."""
    n = lambda column, value: F.count_if(F.col(column) == value)
    return changes.agg(
        F.count("*").alias("total"), n("change_type", "Added").alias("added"), n("change_type", "Removed").alias("removed"), n("change_type", "Modified").alias("modified"),
        n("severity", "Breaking").alias("breaking"), n("severity", "NonBreaking").alias("non_breaking"), n("severity", "Informational").alias("informational"),
    )

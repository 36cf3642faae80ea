"""Lookup, neighbourhood and closure operators over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EDGE_KINDS, rank

UNKNOWN = "(unknown)"


def real(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_kind = 'Real'")


def symbol(nodes: DataFrame, id_: str) -> DataFrame:
    """The real symbol of an id: no row or one."""
    return real(nodes).where(F.col("id") == id_)


def resolve_fqn(nodes: DataFrame, fqn: str) -> DataFrame:
    """One row (matches, projects, id, status): found, ambiguous (several projects) or none; id is the first match."""
    found = real(nodes).where(F.col("fqn") == fqn)
    return found.agg(
        F.count("*").alias("matches"),
        F.array_sort(F.collect_set(F.coalesce("project_origin", F.lit(UNKNOWN)))).alias("projects"),
        F.min("id").alias("first_id"),
    ).select(
        "matches",
        "projects",
        F.when(F.size("projects") <= 1, F.col("first_id")).alias("id"),
        F.when(F.col("matches") == 0, "none").when(F.size("projects") > 1, "ambiguous").otherwise("found").alias("status"),
    )


def ambiguous_fqns(nodes: DataFrame) -> DataFrame:
    """Names that symbols of several projects share."""
    return real(nodes).groupBy("fqn").agg(F.count("*").alias("matches"), F.countDistinct(F.coalesce("project_origin", F.lit(UNKNOWN))).alias("projects")).where("projects > 1")


def details(nodes: DataFrame, edges: DataFrame, id_: str | None = None, most: int | None = None) -> DataFrame:
    """(id, parent_id, child_ids, related_ids) of one real symbol or of all that nodes has.

    The parent is the greatest source of incoming Contains edges, children keep repeats,
    and related symbols are the distinct other ends of edges of other kinds. Only edges of
    these symbols are gathered. With `most`, lists end after so many, in order, and
    child_count and related_count tell how many there are; a hub then costs no long row.
    """
    ids = (symbol(nodes, id_) if id_ else real(nodes)).select("id")
    touching = edges if id_ is None else edges.where((F.col("from_id") == id_) | (F.col("to_id") == id_))
    if most is not None:
        return first_ends(ids, touching, most)
    of = lambda ends: ends.join(ids.distinct(), "id", "left_semi")
    contains = touching.where("kind = 'Contains'")
    other = touching.where("kind <> 'Contains'")
    parent = of(contains.select(F.col("to_id").alias("id"), F.col("from_id").alias("end"))).groupBy("id").agg(F.max("end").alias("parent_id"))
    children = of(contains.select(F.col("from_id").alias("id"), F.col("to_id").alias("end")))
    related = of(other.select(F.col("from_id").alias("id"), F.col("to_id").alias("end")).union(other.select("to_id", "from_id")))
    children = children.groupBy("id").agg(F.array_sort(F.collect_list("end")).alias("child_ids"))
    related = related.groupBy("id").agg(F.array_sort(F.collect_set("end")).alias("related_ids"))
    out = ids.join(parent, "id", "left").join(children, "id", "left").join(related, "id", "left")
    none = F.array().cast("array<string>")
    return out.select("id", "parent_id", F.coalesce("child_ids", none).alias("child_ids"), F.coalesce("related_ids", none).alias("related_ids"))


def first_ends(ids: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """details() of ids with `most`: (id, parent_id, child_ids, related_ids, child_count, related_count).

    All ends are dealt by id once and sorted once: by that order the first ends are known, and from a symbol's last end
    how many there are, so no more than a few rows of each symbol go on. The ids are hashed beside them, not sorted.
    """
    end = lambda role, id_, end: F.struct(F.lit(role).alias("role"), F.col(id_).alias("id"), F.col(end).alias("end"))
    held = F.array(end("parent", "to_id", "from_id"), end("child", "from_id", "to_id"))
    near = F.array(end("related", "from_id", "to_id"), end("related", "to_id", "from_id"))
    ends = edges.where("kind is not null").select(F.inline(F.when(F.col("kind") == "Contains", held).otherwise(near)))
    own = Window.partitionBy("id", "role").orderBy("end")
    place = F.when(F.col("role") == "related", F.dense_rank().over(own)).otherwise(F.row_number().over(own)).cast("long")
    mine = ends.join(ids.distinct().hint("shuffle_hash"), "id", "left_semi").withColumns({"n": place, "last": F.lead("role").over(own).isNull()})
    of = lambda role, value: F.when(F.col("role") == role, F.col(value))
    first = lambda role: F.when((F.col("role") == role) & (F.col("n") <= most), F.col("end"))
    found = mine.where(F.col("last") | (F.col("n") <= most) & (F.col("role") != "parent")).groupBy("id").agg(
        F.max(of("parent", "end")).alias("parent_id"),
        F.array_sort(F.collect_list(first("child"))).alias("child_ids"),
        F.array_sort(F.collect_set(first("related"))).alias("related_ids"),
        F.max(of("child", "n")).alias("child_count"),
        F.max(of("related", "n")).alias("related_count"),
    )
    none, counts = F.array().cast("array<string>"), ("child_count", "related_count")
    return ids.join(found, "id", "left").select("id", "parent_id", *(F.coalesce(c, none).alias(c) for c in ("child_ids", "related_ids")), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def neighbour_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, children, related) of all real symbols: how long the lists of details() would be, without gathering them; a hub costs no more than its edges."""
    both = edges.where("kind <> 'Contains'").select(F.col("from_id").alias("id"), F.col("to_id").alias("end")).union(edges.where("kind <> 'Contains'").select("to_id", "from_id"))
    related = both.distinct().groupBy("id").agg(F.count("*").alias("related"))
    children = edges.where("kind = 'Contains'").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("children"))
    return real(nodes).select("id").join(children, "id", "left").join(related, "id", "left").fillna(0, ["children", "related"]).select("id", "children", "related")


def neighbours(edges: DataFrame, id_: str, relation: str = "children", offset: int = 0, limit: int = 200) -> DataFrame:
    """(id) a page of a symbol's children (repeats kept) or related symbols, in order."""
    if relation == "children":
        ends = edges.where((F.col("from_id") == id_) & (F.col("kind") == "Contains")).select(F.col("to_id").alias("id"))
    else:
        near = edges.where((F.col("kind") != "Contains") & ((F.col("from_id") == id_) | (F.col("to_id") == id_)))
        ends = near.select(F.explode(F.filter(F.array(F.when(near.from_id == id_, near.to_id), F.when(near.to_id == id_, near.from_id)), lambda e: e.isNotNull())).alias("id")).distinct()
    return ends.orderBy("id").offset(offset).limit(min(limit, 200))


def references(nodes: DataFrame, edges: DataFrame, id_: str, cross_project_only: bool = False, offset: int = 0, limit: int = 0) -> DataFrame:
    """A bag of edges that leave or reach a symbol (a self-loop twice), with the projects of both ends.

    Outgoing edges come first; paging holds only with a limit, of 200 at most. Ends that
    are stubs or have no node have no project.
    """
    near = edges.where((F.col("from_id") == id_) | (F.col("to_id") == id_))
    if cross_project_only:
        near = near.where("scope = 'CrossProject'")
    bag = near.where(F.col("from_id") == id_).withColumn("direction", F.lit("outgoing")).unionByName(near.where(F.col("to_id") == id_).withColumn("direction", F.lit("incoming")))
    projects = real(nodes).select("id", "project_origin")
    bag = bag.join(projects.toDF("from_id", "from_project"), "from_id", "left").join(projects.toDF("to_id", "to_project"), "to_id", "left")
    bag = bag.select("direction", "from_id", "to_id", "kind", "scope", "from_project", "to_project")
    if limit <= 0:
        return bag
    return bag.orderBy(F.desc("direction"), "from_id", "to_id", rank("kind", EDGE_KINDS)).offset(offset).limit(min(limit, 200))


def implementations(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    """Real symbols with an Implements or Inherits edge to a symbol, a row for each edge."""
    incoming = edges.where((F.col("to_id") == id_) & F.col("kind").isin("Implements", "Inherits")).select(F.col("from_id").alias("id"), F.col("kind").alias("relation"))
    return real(nodes).join(incoming, "id").select("id", "relation", "kind", "display_name", "project_origin")


def overview(nodes: DataFrame, edges: DataFrame, first: int | None = 100, types: int = 20, children: int = 10) -> dict[str, DataFrame]:
    """Sections of a project overview over its first symbols by id (all without `first`): namespaces, stats, types with their first children."""
    page = real(nodes) if first is None else real(nodes).orderBy("id").limit(first)
    namespaces = page.where("kind = 'Namespace'").select("id", "display_name", "fqn")
    stats = page.groupBy("kind").agg(F.count("*").alias("n"))
    top = page.where(F.col("kind").isin("Type", "Delegate")).orderBy("id").limit(types)
    owned = edges.where("kind = 'Contains'").join(top.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    within = Window.partitionBy("from_id").orderBy("to_id")
    kept = owned.withColumn("n", F.row_number().over(within)).where(F.col("n") <= children).groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_list("to_id")).alias("children"))
    return {"namespaces": namespaces, "stats": stats, "types": top.select("id", "display_name", "fqn").join(kept, "id", "left")}


def dirty_set(edges: DataFrame, seeds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(name) the seeds and all that depends on them: edges (from_project depends on to_project), names without case.

    A loop of joins towards the fixpoint: the frontier holds only new names, so cycles end
    it. What is found is written to the checkpoint folder each round.
    """
    depends = edges.select(F.lower("from_project").alias("name"), F.lower("to_project").alias("on")).distinct()
    found = seeds.select(F.lower("name").alias("name")).distinct()
    frontier = found
    for _ in range(most_rounds):
        new = depends.join(frontier.withColumnRenamed("name", "on"), "on").select("name").distinct().join(found, "name", "left_anti")
        frontier = stored(new)
        if frontier.isEmpty():
            return found
        found = stored(found.union(frontier))
    raise RuntimeError("the dependency graph is deeper than most_rounds")


def topological_levels(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, level): 0 for projects that depend on none, else one more than the highest dependency.

    Peels off a level each round; dependencies on unknown projects and on itself are left
    out. Raises ValueError if a cycle is left.
    """
    left = projects.select(F.lower("name").alias("name")).distinct()
    depends = edges.select(F.lower("from_project").alias("name"), F.lower("to_project").alias("on")).distinct().join(left, "name", "left_semi").join(left.withColumnRenamed("name", "on"), "on", "left_semi").where("name <> on")
    done, level = None, 0
    left, depends = stored(left), stored(depends)
    while not left.isEmpty():
        free = stored(left.join(depends, "name", "left_anti"))
        if free.isEmpty():
            raise ValueError("the project graph has a cycle")
        tagged = free.withColumn("level", F.lit(level))
        done = tagged if done is None else done.union(tagged)
        left, depends = stored(left.join(free, "name", "left_anti")), stored(depends.join(free.withColumnRenamed("name", "on"), "on", "left_anti"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0))


def peeled(depends: DataFrame) -> DataFrame:
    """Edges (name, on) that are left after taking off, again and again, nodes without an edge in or out."""
    depends = stored(depends)
    n = depends.count()
    while n:
        kept = depends.join(depends.select(F.col("name").alias("on")).distinct(), "on", "left_semi").select("name", "on")
        kept = stored(kept.join(kept.select(F.col("on").alias("name")).distinct(), "name", "left_semi").select("name", "on"))
        m = kept.count()
        if m == n:
            break
        depends, n = kept, m
    return depends


def cyclic(edges: DataFrame) -> DataFrame:
    """(name) every project that depends on itself, directly or by way of others; one between two cycles does not.

    What peeling leaves is split by colours: each node takes the greatest name that leads
    to it, and the nodes of a colour that lead to the node of that name are a strongly
    connected component. Components go, the rest is peeled, until nothing is left.
    """
    depends = edges.select(F.lower("from_project").alias("name"), F.lower("to_project").alias("on")).distinct()
    found = depends.where("name = on").select("name")
    depends = peeled(depends.where("name <> on"))
    while not depends.isEmpty():
        colours = depends.select("name").union(depends.select("on")).distinct().withColumn("colour", F.col("name"))
        while True:
            ahead = depends.join(colours, "name").groupBy(F.col("on").alias("name")).agg(F.max("colour").alias("more"))
            after = stored(colours.join(ahead, "name", "left").select("name", F.greatest("colour", "more").alias("colour"), (F.col("more") > F.col("colour")).alias("changed")))
            colours = after.select("name", "colour")
            if after.where("changed").isEmpty():
                break
        inner = stored(depends.join(colours, "name").join(colours.toDF("on", "on_colour"), "on").where("colour = on_colour").select("name", "on", "colour"))
        members = frontier = stored(colours.where("name = colour"))
        while not frontier.isEmpty():
            frontier = stored(inner.join(frontier.select(F.col("name").alias("on")), "on").select("name", "colour").distinct().join(members, ["name", "colour"], "left_anti"))
            members = stored(members.union(frontier))
        large = members.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        found = found.union(members.join(large, "colour", "left_semi").select("name"))
        gone = members.select("name")
        depends = peeled(depends.join(gone, "name", "left_anti").join(gone.toDF("on"), "on", "left_anti").select("name", "on"))
    return found.distinct()


def cycle_list(edges: DataFrame) -> DataFrame:
    """(cycle, place, name): cycles of a project graph as a table, each closed by its first name again.

    Only projects on a cycle reach the driver, where a depth-first search closes the cycles.
    """
    on = cyclic(edges)
    depends = edges.select(F.lower("from_project").alias("a"), F.lower("to_project").alias("b")).distinct()
    pairs = depends.join(on.toDF("a"), "a", "left_semi").join(on.toDF("b"), "b", "left_semi").collect()
    rows = [(i, k, name) for i, found in enumerate(cycles([(r.a, r.b) for r in pairs])) for k, name in enumerate(found)]
    return edges.sparkSession.createDataFrame(rows, "cycle int, place int, name string")


def cycles(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles of a small project graph by depth-first search, each closed by its first name again."""
    ahead: dict[str, list[str]] = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    found, state = [], dict.fromkeys(ahead, 0)
    for start in sorted(ahead):
        path: list[str] = []
        todo = [(start, iter(sorted(ahead[start])))] if not state[start] else []
        if todo:
            state[start] = 1
            path.append(start)
        while todo:
            name, rest = todo[-1]
            for after in rest:
                if state[after] == 1:
                    found.append([*path[path.index(after) :], after])
                elif not state[after]:
                    state[after] = 1
                    path.append(after)
                    todo.append((after, iter(sorted(ahead[after]))))
                    break
            else:
                state[name] = 2
                path.pop()
                todo.pop()
    return found


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share; a local master without one gets a temporary folder."""
    import tempfile

    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoints-")


def stored(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the session's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()

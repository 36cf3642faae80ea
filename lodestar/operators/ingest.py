"""Incremental ingestion: manifests, merges, scopes, stubs and target-framework choice."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EDGE_KINDS, rank

# Framework types that never become stubs.
PRIMITIVES = [
    "System.Object", "System.String", "System.Boolean", "System.Byte", "System.SByte", "System.Int16", "System.UInt16", "System.Int32",
    "System.UInt32", "System.Int64", "System.UInt64", "System.Single", "System.Double", "System.Decimal", "System.Char", "System.Void",
    "System.IntPtr", "System.UIntPtr", "System.Threading.Tasks.Task", "System.Threading.Tasks.Task`1",
    "System.Collections.Generic.IEnumerable`1", "System.Collections.Generic.IList`1", "System.Collections.Generic.IReadOnlyList`1",
    "System.Collections.Generic.ICollection`1", "System.Collections.Generic.IDictionary`2", "System.ValueType", "System.Enum",
    "System.Attribute", "System.Exception", "System.IDisposable", "System.EventArgs",
]
EDGE_KEY = ["from_id", "to_id", "kind"]


def sorted_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("id")


def sorted_edges(edges: DataFrame) -> DataFrame:
    """Edges by both ends and then the place of their kind in its enumeration."""
    return edges.orderBy("from_id", "to_id", rank("kind", EDGE_KINDS))


def manifest_diff(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(path, change): Added, Modified and Removed files of two (path, sha256) manifests; without a first one all are Added."""
    if before is None:
        return after.select("path", F.lit("Added").alias("change"))
    both = before.withColumnRenamed("sha256", "a").join(after.withColumnRenamed("sha256", "b"), "path", "full_outer").where("not (a <=> b)")
    return both.select("path", F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Removed").otherwise("Modified").alias("change"))


def project_manifest(files: DataFrame, references: list[str], framework: str) -> DataFrame:
    """A manifest with two entries more, that change with the project's references and framework."""
    extra = files.sparkSession.createDataFrame([("__project_refs__", ";".join(sorted(references))), ("__tfm__", framework)], "path string, sha256 string")
    return files.select("path", "sha256").unionByName(extra.select("path", F.sha2("sha256", 256).alias("sha256")))


def structure_changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two project tables have other sets of paths."""
    a, b = (df.select(F.lower("path").alias("path")).distinct() for df in (before, after))
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())


def folders(path: Column) -> Column:
    """All folders above a path, in lower case."""
    parts = F.split(F.lower(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def below(nodes: DataFrame, directories: DataFrame) -> DataFrame:
    """(id) of nodes whose source lies below one of the directories, by an equi-join over their folders."""
    above = nodes.where("span is not null").select("id", F.explode(folders(F.col("span.file_path"))).alias("folder"))
    return above.join(directories.select(F.lower(F.rtrim("directory", F.lit("/"))).alias("folder")), "folder", "left_semi").select("id").distinct()


def merge_nodes(previous: DataFrame, changed_directories: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes after a partial rebuild: previous ones outside the changed directories (directory) and not emitted again, then the new ones.

    Nodes without a span stay until they are emitted again.
    """
    stale = below(previous, changed_directories)
    return previous.join(stale, "id", "left_anti").join(new.select("id"), "id", "left_anti").unionByName(new)


def merge_edges(previous: DataFrame, previous_nodes: DataFrame, changed_directories: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after a partial rebuild: previous ones whose source is outside the changed directories and that are not emitted again, then the new ones.

    Both tables and the stale sources are dealt by source once and sorted once: a source's
    mark comes before its edges, and new edges before previous ones of the same key, so
    running windows decide and hold no rows. A null equals nothing.
    """
    stale = below(previous_nodes, changed_directories).where("id is not null")
    marks = stale.select(*(F.col("id").alias(c) if c == "from_id" else F.lit(None).cast(previous.schema[c].dataType).alias(c) for c in previous.columns), F.lit(0).alias("tag_"))
    rows = marks.union(new.select(*previous.columns, F.lit(1))).union(previous.select("*", F.lit(2)))
    seen = lambda tag, by: F.max(F.col("tag_") == tag).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    of_source = seen(0, Window.partitionBy("from_id").orderBy("to_id", "kind", "tag_"))
    of_key = seen(1, Window.partitionBy(*EDGE_KEY).orderBy("tag_"))
    known = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in EDGE_KEY))
    told = rows.repartition("from_id").withColumns({"stale_": F.col("from_id").isNotNull() & of_source, "again_": known & of_key})
    return told.where("tag_ = 1 or tag_ = 2 and not stale_ and not again_").select(*previous.columns)


def file_changes(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, change_kind, affected_symbol_ids) of a manifest diff; removed files affect none that is left."""
    held = nodes.where("span is not null").groupBy(F.col("span.file_path").alias("path")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    none = F.array().cast("array<string>")
    ids = F.when(F.col("change") == "Removed", none).otherwise(F.coalesce("ids", none))
    return changes.join(held, "path", "left").select(F.col("path").alias("file_path"), F.col("change").alias("change_kind"), ids.alias("affected_symbol_ids"))


def enrich(edges: DataFrame, detected: DataFrame) -> DataFrame:
    """edges with the detected ones that no edge of the same ends and kind stands for yet."""
    return edges.unionByName(detected.dropDuplicates(EDGE_KEY).join(edges.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti"))


def framework_version(name: Column) -> Column:
    """(major, minor) of a project name's framework suffix: (netX.Y) gives X+100 and Y, (netNN) gives 0 and NN, in tenths where under 100."""
    inside = F.when(name.contains("(") & name.endswith(")"), F.substring_index(F.rtrim(name, F.lit(")")), "(", -1))
    # one bracket closes the suffix, and a suffix of another kind has no version
    inside = F.when(F.concat(F.lit("("), inside, F.lit(")")) == F.right(name, F.length(inside) + 2), inside)
    numbers = F.when(F.startswith(inside, F.lit("net")), F.split(F.substring(inside, 4, 1 << 20), "\\."))
    digits = F.transform(numbers, lambda x: F.when((x != "") & (F.translate(x, "0123456789", "") == ""), x).try_cast("int"))
    first, second = F.get(digits, 0), F.get(digits, 1)
    made = lambda a, b: F.struct(a.cast("int").alias("major"), b.cast("int").alias("minor"))
    return (
        F.when((F.size(digits) == 2) & first.isNotNull() & second.isNotNull(), made(first + 100, second))
        .when((F.size(digits) == 1) & first.isNotNull(), made(F.lit(0), F.when(first < 100, first * 10).otherwise(first)))
        .otherwise(made(F.lit(0), F.lit(0)))
    )


def latest_framework(projects: DataFrame) -> DataFrame:
    """Of projects (name, path) with one path, case aside, the one of the highest framework version; ties go to the first name."""
    order = Window.partitionBy(F.lower("path")).orderBy(F.desc("version"), "name")
    versioned = projects.withColumn("version", framework_version(F.col("name")))
    return versioned.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "version")


def scoped(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with scope by the ends' projects: no target project or a stub is External, another project CrossProject."""
    of = nodes.select("id", "project_origin", "node_kind")
    joined = edges.drop("scope").join(of.toDF("from_id", "a", "ak"), "from_id", "left").join(of.toDF("to_id", "b", "bk"), "to_id", "left")
    external = F.col("b").isNull() | (F.col("bk") == "Stub")
    scope = F.when(external, "External").when(~F.col("a").eqNullSafe(F.col("b")), "CrossProject").otherwise("IntraProject")
    return joined.select("from_id", "to_id", "kind", scope.alias("scope"))


def stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, display_name): missing targets of external Inherits and Implements edges, but for framework types, each once."""
    name = F.regexp_replace("to_id", "^[A-Z]:", "")
    wanted = edges.where("scope = 'External' and kind in ('Inherits', 'Implements')").select(F.col("to_id").alias("id"), name.alias("fqn")).distinct()
    return wanted.where(~F.col("fqn").isin(PRIMITIVES)).join(nodes.select("id"), "id", "left_anti").select("id", F.element_at(F.split("fqn", r"\."), -1).alias("display_name"))


#: The columns that hashed() adds.
HASHED = [f"h{i}_" for i in range(4)]


def hashed(df: DataFrame) -> DataFrame:
    """df with four hashes of quarters of the SHA-256 of each row's JSON, which is made once a row, whatever number of sums reads it."""
    line = df.withColumn("h_", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))
    return line.select(*df.columns, *(F.xxhash64(F.substring("h_", 1 + 16 * i, 16)).alias(c) for i, c in enumerate(HASHED)))


def digest() -> list[Column]:
    """Aggregates of hashed() rows that do not hang on their order: their number n, and sums s0 to s7 of pieces of 24 bits, whose sums hold 2^39 rows."""
    piece = lambda c, shift: F.coalesce(F.sum(F.shiftrightunsigned(F.col(c), shift).bitwiseAND(F.lit(0xFFFFFF))), F.lit(0))
    return [F.count(F.lit(1)).alias("n"), *(piece(c, shift).alias(f"s{2 * i + j}") for i, c in enumerate(HASHED) for j, shift in enumerate((40, 16)))]


def hash_of(nodes: dict, edges: dict) -> str:
    """The content hash from the digests of both tables, by name."""
    text = lambda d: "{" + ",".join(f'"{k}":{int(d[k])}' for k in ("n", *(f"s{i}" for i in range(8)))) + "}"
    return hashlib.sha256(f"{text(nodes)}|{text(edges)}".encode()).hexdigest()


def content_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (content_hash): independent of row order and time stamps.

    Rows are hashed apart and their hashes summed over a modulus, so nothing is gathered.
    """
    a, b = (hashed(df).agg(*digest()) for df in (nodes, edges))
    text = lambda df: F.to_json(F.struct("*"))
    both = a.select(text(a).alias("a")).join(F.broadcast(b.select(text(b).alias("b"))))
    return both.select(F.sha2(F.concat_ws("|", "a", "b"), 256).alias("content_hash"))


# Fixed value: the summary of a symbol that has no documentation of its own.
NO_DOCUMENTATION = "No documentation provided."
VISIBLE = ["Public", "Protected", "ProtectedInternal"]


def visible(nodes: DataFrame) -> DataFrame:
    """Symbols that other projects can see; an implicit column, if any, leaves compiler-made ones out."""
    kept = nodes.where(F.col("accessibility").isin(VISIBLE))
    return kept.where(~F.coalesce("implicit", F.lit(False))) if "implicit" in nodes.columns else kept


def stamped(nodes: DataFrame, project: str) -> DataFrame:
    """nodes with their project set."""
    return nodes.withColumn("project_origin", F.lit(project))


def documented(nodes: DataFrame, own: DataFrame, inherited: DataFrame | None = None) -> DataFrame:
    """nodes with docs: their own (id, docs), else inherited ones, else a placeholder summary."""
    from ..model import empty_docs

    out = nodes.drop("docs").join(own.select("id", F.col("docs").alias("_own")), "id", "left")
    out = out.join(inherited.select("id", F.col("docs").alias("_base")), "id", "left") if inherited is not None else out.withColumn("_base", F.lit(None).cast(out.schema["_own"].dataType))
    return out.withColumn("docs", F.coalesce("_own", "_base", empty_docs(F.lit(NO_DOCUMENTATION)))).select(*nodes.columns)


def type_references(uses: DataFrame) -> DataFrame:
    """References edges of (from_id, type_id, arguments array<string>, special boolean).

    Of a generic type only its arguments count, arrays stand for their element, and
    special types give no edge; repeats stay, one for each use.
    """
    plain = lambda t: F.regexp_replace(t, r"(\[,*\])+$", "")
    targets = F.when(F.size("arguments") > 0, F.transform("arguments", plain)).otherwise(F.array(plain(F.col("type_id"))))
    return uses.where(~F.coalesce("special", F.lit(False))).select("from_id", F.explode(targets).alias("to_id"), F.lit("References").alias("kind"), F.lit("IntraProject").alias("scope"))

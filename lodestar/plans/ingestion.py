"""Queries of what ingestion decides: comments, manifests, builders, redaction, stored search and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import namespace_of
from ..operators import coverage, govern, graph, ingest, lookup, search, sketches
from ..sources import extract_json, files, jsdoc, open_json, parsers
from . import demo_graph as g
from .catalog import bm25_sql, joined, ranked, saved
from .registered import query


def suppliers(spark, d):
    return g.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("m"))


def text(c):
    return F.col(c).cast("string")


def filled(template: str):
    """A template with {k}, {m} and {name} of suppliers."""
    out = F.lit(template)
    for c in ("k", "m", "name"):
        out = F.replace(out, F.lit(f"{{{c}}}"), text(c))
    return out


def filled_sql(template: str) -> str:
    quoted = "'" + template.replace("'", "''") + "'"
    return f"replace(replace(replace({quoted}, '{{k}}', s_suppkey::VARCHAR), '{{m}}', s_nationkey::VARCHAR), '{{name}}', s_name)"


#: Sources of four shapes, by the supplier's key.
SCRIPTS = [
    "// {k}\n/**\n * Sums {name} {@link Type{m}}.\n *\n * More.\n * @param {number} a the {k} first\n * @param [b=1] - second\n * @returns {Promise<{x: string}>} the sum\n * @see Other{m}\n * @see {@link Third}\n */\nfunction f() {}\n",
    "const s = '/** no {k} */';\n/** Short {k}. */\n",
    "/**\n * @remarks first\n * @remarks at {m}\n *   and on\n * @throws {RangeError} if {k}\n * @exception Oops when\n * @template T type {m}\n * @example\n * run({k});\n */\n",
    "/* plain {k} */ const t = `/** ${x} */`;\n",
]
PICK = "CASE s_suppkey % 4 {} END"


def by_key(values: list[str | None]) -> str:
    return PICK.format(" ".join(f"WHEN {i} THEN {'NULL' if v is None else filled_sql(v)}" for i, v in enumerate(values)))


@query(f"""SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END AS line, {by_key(['Sums {name} {@link Type{m}}.' + chr(10) * 2 + 'More.', 'Short {k}.', None, None])} AS summary, {by_key([None, None, 'at {m}' + chr(10) + '  and on', None])} AS remarks,
{by_key(['a=the {k} first;b=- second', '', '', ''])} AS params, {by_key(['', '', 'T=type {m}', ''])} AS type_params, {by_key(['the sum', None, None, None])} AS returns, {by_key(['', '', 'run({k});', ''])} AS examples,
{by_key(['', '', '{RangeError}=if {k};Oops=when', ''])} AS exceptions, {by_key(['Other{m};{@link Third}', '', '', ''])} AS see_also FROM supplier WHERE s_suppkey % 4 < 3""", graph_sql=False)
def jsdoc_parse(spark, d):
    """Doc comments found in sources and taken apart."""
    k = F.col("k") % 4
    source = F.when(k == 0, filled(SCRIPTS[0])).when(k == 1, filled(SCRIPTS[1])).when(k == 2, filled(SCRIPTS[2])).otherwise(filled(SCRIPTS[3]))
    found = suppliers(spark, d).select("k", F.explode(jsdoc.comments(source)).alias("c")).select("k", "c.line", jsdoc.jsdocs(F.col("c.body")).alias("d"))
    pairs = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(f"d.{c}"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    thrown = F.array_join(F.transform("d.exceptions", lambda e: F.concat(e["type"], F.lit("="), e["description"])), ";")
    return found.select("k", "line", "d.summary", "d.remarks", pairs("params").alias("params"), pairs("type_params").alias("type_params"), "d.returns", F.array_join("d.examples", ";").alias("examples"), thrown.alias("exceptions"), F.array_join("d.see_also", ";").alias("see_also"))


@query("""SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 5 > 2 THEN NULL ELSE '<summary>Of ' || (c_custkey - c_custkey % 5) || '</summary>' END AS xml FROM customer""", graph_sql=False)
def inheritdoc_resolve(spark, d):
    """Every fifth customer is documented; the next ones inherit from the one before, by name or from their natural base, which a chain asks for once; the last of five names itself."""
    k = F.col("c_custkey")
    before = F.concat(F.lit("c"), (k - 1).cast("string"))
    own = F.concat(F.lit("c"), k.cast("string"))
    xml = F.when(k % 5 == 0, F.concat(F.lit("<summary>Of "), k.cast("string"), F.lit("</summary>"))).when(k % 5 == 2, "<inheritdoc/>").when(k % 5 == 4, F.concat(F.lit("<inheritdoc cref='"), own, F.lit("'/>"))).otherwise(F.concat(F.lit("<inheritdoc cref='"), before, F.lit("'/>")))
    docs = g.table(spark, d, "customer").select(own.alias("id"), xml.alias("xml"), before.alias("base_id"))
    return parsers.resolve_inherited(docs.select("id", "xml"), docs.select("id", "base_id"))


@query("SELECT from_id AS id, coalesce(min(to_id) FILTER (kind = 'Overrides'), min(to_id)) AS base_id FROM (SELECT from_id, to_id, CASE WHEN from_k % 3 = 0 AND to_k % 2 = 0 THEN 'Overrides' ELSE kind END AS kind FROM g_edges WHERE kind = 'Implements') GROUP BY 1")
def natural_bases(spark, d):
    even = (F.expr("cast(substr(from_id, 4) as bigint)") % 3 == 0) & (F.expr("cast(substr(to_id, 4) as bigint)") % 2 == 0)
    edges = g.edges(spark, d).where("kind = 'Implements'")
    return parsers.natural_bases(edges.withColumn("kind", F.when(even, "Overrides").otherwise(F.col("kind"))))


@query("SELECT 'src/' || s_suppkey || '.cs' AS path, sha256(s_name) AS sha256 FROM supplier UNION ALL SELECT '__project_refs__', sha256('A;B') UNION ALL SELECT '__tfm__', sha256('net9.0')", graph_sql=False)
def project_manifest(spark, d):
    made = suppliers(spark, d).select(filled("src/{k}.cs").alias("path"), F.sha2("name", 256).alias("sha256"))
    return ingest.project_manifest(made, ["B", "A"], "net9.0")


@query("""SELECT coalesce(project_origin, '(unknown)') AS project, count(*) AS total, count(summary) AS documented, round_even(count(summary) / count(*) * 100.0, 1) AS coverage_percent
FROM g_nodes WHERE node_kind = 'Real' AND kind IN ('Type', 'Method', 'Property', 'Constructor', 'Delegate', 'Event', 'Field') AND accessibility IN ('Public', 'Protected', 'ProtectedInternal') AND k % 5 > 1 GROUP BY 1""")
def coverage_with_opt_out(spark, d):
    k = F.expr("cast(regexp_replace(id, '^[A-Z]:[a-z]', '') as bigint)") % 5
    tagged = g.nodes(spark, d).withColumn("attributes", F.when(k == 0, F.array(F.lit("Other"), F.lit("ExcludeFromDocCoverage"))).when(k == 1, F.array(F.lit("ExcludeFromDocCoverageAttribute"))).when(k == 2, F.array(F.lit("Obsolete"))))
    return coverage.by_project(tagged)


@query("SELECT id, CASE WHEN NOT starts_with(path, 'ASIA/') THEN path END AS path FROM g_nodes WHERE path IS NOT NULL")
def spans_redacted(spark, d):
    nodes = g.nodes(spark, d).where("span is not null")
    allowed = govern.allowed(F.col("span.file_path"), ["**"], deny=["ASIA/**"])
    return govern.redact_spans(nodes, allowed).select("id", F.col("span.file_path").alias("path"))


FILES = "WITH f AS (SELECT CASE s_suppkey % 6 WHEN 0 THEN 'src/a' || s_suppkey || '.cs' WHEN 1 THEN 'src\\gen\\b' || s_suppkey || '.cs' WHEN 2 THEN 'App/t' || s_suppkey || 'Tests.cs' WHEN 3 THEN 'web/c' || s_suppkey || '.tsx' WHEN 4 THEN 'web/node_modules/d' || s_suppkey || '.ts' ELSE 'web/' || s_suppkey || '/tsconfig.json' END AS path FROM supplier)\n"


def some_files(spark, d):
    k = F.col("k") % 6
    path = F.when(k == 0, filled("src/a{k}.cs")).when(k == 1, filled("src\\gen\\b{k}.cs")).when(k == 2, filled("App/t{k}Tests.cs")).when(k == 3, filled("web/c{k}.tsx")).when(k == 4, filled("web/node_modules/d{k}.ts")).otherwise(filled("web/{k}/tsconfig.json"))
    return suppliers(spark, d).select(path.alias("path"))


@query(FILES + "SELECT path FROM f WHERE starts_with(path, 'src/')", graph_sql=False)
def files_included(spark, d):
    return files.source_files(some_files(spark, d), include=["**/*.cs"], exclude=["**/gen/**"])


@query(FILES + "SELECT path FROM f WHERE regexp_matches(path, '\\.tsx$|/tsconfig\\.json$')", graph_sql=False)
def files_of_scripts(spark, d):
    return files.typescript_files(some_files(spark, d))


@query("SELECT id, project_origin AS project, CASE WHEN k % 3 <> 0 THEN summary WHEN k % 2 = 0 THEN 'From the base' ELSE 'No documentation provided.' END AS summary FROM g_nodes WHERE accessibility IN ('Public', 'Protected', 'ProtectedInternal')")
def built_nodes(spark, d):
    """Visible symbols with their own docs, a base's, or the placeholder."""
    nodes = ingest.visible(g.nodes(spark, d))
    k = F.expr("cast(regexp_replace(id, '^[A-Z]:[a-z]', '') as bigint)")
    own = nodes.where("docs is not null").select("id", "docs")
    base = nodes.where(k % 2 == 0).select("id", g.empty_docs(F.lit("From the base")).alias("docs"))
    return ingest.documented(nodes, own, base).select("id", F.col("project_origin").alias("project"), "docs.summary")


@query("""SELECT 'M:' || s_suppkey AS from_id, t AS to_id, 'References' AS kind, 'IntraProject' AS scope FROM supplier, LATERAL (SELECT unnest(CASE s_suppkey % 4 WHEN 0 THEN ['T:N' || s_nationkey] WHEN 1 THEN ['T:A', 'T:N' || s_nationkey] WHEN 2 THEN ['T:N' || s_nationkey] ELSE [] END) AS t)""", graph_sql=False)
def type_reference_edges(spark, d):
    k = F.col("k") % 4
    uses = suppliers(spark, d).select(filled("M:{k}").alias("from_id"), F.when(k == 2, filled("T:N{m}[][,]")).when(k == 1, F.lit("T:List")).otherwise(filled("T:N{m}")).alias("type_id"),
                                      F.when(k == 1, F.array(F.lit("T:A"), filled("T:N{m}[]"))).otherwise(F.array().cast("array<string>")).alias("arguments"), (k == 3).alias("special"))
    return ingest.type_references(uses)


@query("SELECT 'S' || s_suppkey AS id, s_name AS display_name, 'P' || s_nationkey AS project_origin, 'Does ' || s_suppkey AS summary, 'E' || s_nationkey || '=if bad' AS thrown, 'x' || s_suppkey AS parameter FROM supplier", graph_sql=False)
def extractor_nodes(spark, d):
    """Nodes of an extractor's JSON, one snapshot for each supplier."""
    body = filled('{"projectName": "P{m}", "nodes": [{"id": {"value": "S{k}"}, "kind": "Method", "displayName": "{name}", "docComment": {"summary": "Does {k}", "throws": {"E{m}": "if bad"}}, "parameters": [{"name": "x{k}", "typeName": "number"}]}], "edges": []}')
    made = extract_json.nodes(suppliers(spark, d).select(F.from_json(body, extract_json.SNAPSHOT).alias("s")).select("s.*"))
    thrown = F.array_join(F.transform("docs.exceptions", lambda e: F.concat(e["type"], F.lit("="), e["description"])), ";")
    return made.select("id", "display_name", "project_origin", "docs.summary", thrown.alias("thrown"), F.get("parameters", F.lit(0))["name"].alias("parameter"))


@query(bm25_sql(["about", "order", "supplier#7"], "AND n.project_origin = 'ASIA'").replace("g_nodes", "a_nodes") + "SELECT id, score, kind, display_name, project_origin FROM top WHERE place <= 20")
def search_stored_project(spark, d):
    """A project's best from the stored blocks."""
    store = saved(spark, d)
    latest = store.latest("demo")
    store.build_index(latest)
    return ranked(search.search(store.load(latest)[0], "about order Supplier#7", store.index(latest), project="ASIA", limit=20))


@query(""", o AS (SELECT DISTINCT id, e FROM (SELECT from_id AS id, to_id AS e FROM g_edges WHERE kind <> 'Contains' UNION ALL SELECT to_id, from_id FROM g_edges WHERE kind <> 'Contains'))
SELECT n.id, coalesce(c.l, '') AS child_ids, coalesce(c.n, 0) AS child_count, coalesce(r.l, '') AS related_ids, coalesce(r.n, 0) AS related_count FROM g_nodes n
LEFT JOIN (SELECT from_id, count(*) AS n, array_to_string(list_sort(list(to_id))[1:5], ',') AS l FROM g_edges WHERE kind = 'Contains' GROUP BY 1) c ON n.id = c.from_id
LEFT JOIN (SELECT id, count(*) AS n, array_to_string(list_sort(list(e))[1:5], ',') AS l FROM o GROUP BY 1) r ON n.id = r.id WHERE node_kind = 'Real' AND kind IN ('Namespace', 'Type', 'Property')""")
def symbol_detail_pages(spark, d):
    """The first five of each list, and how many there are."""
    some = g.nodes(spark, d).where("kind in ('Namespace', 'Type', 'Property')")
    found = graph.details(some, g.edges(spark, d), most=5)
    return found.select("id", joined("child_ids").alias("child_ids"), "child_count", joined("related_ids").alias("related_ids"), "related_count")


@query("SELECT project_origin AS project, count(*) AS n, true AS ids_within, true AS namespaces_within, true AS top_within FROM g_nodes WHERE node_kind = 'Real' GROUP BY 1")
def sketch_bounds(spark, d):
    """Figures of sketches beside exact ones: whether they keep their bounds."""
    nodes = g.nodes(spark, d).where("node_kind = 'Real'")
    exact = nodes.groupBy(F.col("project_origin").alias("p")).agg(F.countDistinct("id").alias("ids"), F.countDistinct(namespace_of(F.col("fqn"))).alias("spaces"))
    most = nodes.groupBy(F.col("project_origin").alias("q"), namespace_of(F.col("fqn")).alias("s")).agg(F.count("*").alias("c")).groupBy("q").agg(F.max("c").alias("largest"))
    found = sketches.figures(sketches.sketch(nodes)).join(exact, F.col("project") == F.col("p")).join(most, F.col("project") == F.col("q"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1), F.col(b) * 0.06)
    top = F.coalesce(F.array_max(F.transform("top", lambda t: t["n"])), F.lit(0))
    return found.select("project", "n", near("symbols", "ids").alias("ids_within"), near("namespaces", "spaces").alias("namespaces_within"), ((top <= F.col("largest")) & (top + F.col("cut") >= F.col("largest"))).alias("top_within"))


@query("SELECT from_id AS id, count(*) AS n, array_to_string(list_sort(list(to_id)), ',') AS targets FROM g_edges WHERE kind = 'Contains' AND from_id IN ('N:r0', 'N:r1') GROUP BY 1")
def neighbours_of_regions(spark, d):
    edges = g.edges(spark, d)
    rows = [graph.neighbours(edges, id_, "children", limit=200).withColumn("of", F.lit(id_)) for id_ in ("N:r0", "N:r1")]
    return rows[0].union(rows[1]).groupBy(F.col("of").alias("id")).agg(F.count("*").alias("n"), joined(F.array_sort(F.collect_list("id"))).alias("targets"))


@query(""", x AS (SELECT id FROM a_nodes WHERE node_kind = 'Real' AND kind IN ('Type', 'Property')) SELECT x.id, (SELECT max(from_id) FROM a_edges WHERE kind = 'Contains' AND to_id = x.id) AS parent_id,
coalesce((SELECT string_agg(to_id, ',' ORDER BY to_id) FROM a_edges WHERE kind = 'Contains' AND from_id = x.id), '') AS child_ids,
coalesce((SELECT string_agg(DISTINCT e, ',' ORDER BY e) FROM (SELECT to_id AS e FROM a_edges WHERE kind <> 'Contains' AND from_id = x.id UNION ALL SELECT from_id FROM a_edges WHERE kind <> 'Contains' AND to_id = x.id)), '') AS related_ids FROM x""")
def symbol_details_stored(spark, d):
    """Details of types and properties from the stored tables by id."""
    store = saved(spark, d)
    found = store.lookup(store.latest("demo"))
    some = lookup.Lookup(found.nodes.where("kind in ('Type', 'Property')"), found.ends)
    return lookup.details(some).withColumns({c: joined(c) for c in ("child_ids", "related_ids")})


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) FILTER ((props->>'$.k')::BIGINT IS NULL) AS without, 'OBJECT<k: BIGINT>' AS shape FROM events GROUP BY 1", graph_sql=False)
def open_props(spark, d):
    """Members of props without a schema, and the schema that they turn out to have."""
    v = g.table(spark, d, "events").select("event_type", F.try_parse_json("props").alias("v"))
    k = F.try_variant_get("v", "$.k", "bigint")
    return v.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.count_if(k.isNull()).alias("without"), F.schema_of_variant_agg("v").alias("shape"))


@query("""SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'E' || s_nationkey || '=if ' || s_suppkey WHEN 1 THEN 'E' || s_nationkey || '=;F=when ' || s_suppkey ELSE 'E' || s_nationkey || '=so' END AS thrown,
CASE s_suppkey % 3 WHEN 1 THEN 'a;b' || s_suppkey ELSE 'a' || s_suppkey END AS see, CASE s_suppkey % 3 WHEN 2 THEN '{"since":' || s_suppkey || '}' END AS unknown FROM supplier""", graph_sql=False)
def open_docs(spark, d):
    """Doc comments in three forms of throws and see, with members that nobody knows."""
    k = F.col("k") % 3
    body = F.when(k == 0, filled('{"throws": {"E{m}": "if {k}"}, "see": "a{k}"}')).when(k == 1, filled('{"throws": [{"type": "E{m}"}, "F: when {k}"], "see": ["a", "b{k}"]}')).otherwise(filled('{"throws": "E{m} so", "see": {"first": "a{k}"}, "since": {k}}'))
    v = suppliers(spark, d).select("k", F.try_parse_json(body).alias("v"))
    found = v.select("k", open_json.docs(F.col("v")).alias("d"), open_json.unknown(F.col("v")).alias("unknown"))
    thrown = F.array_join(F.transform("d.exceptions", lambda e: F.concat(e["type"], F.lit("="), e["description"])), ";")
    return found.select("k", thrown.alias("thrown"), F.array_join("d.see_also", ";").alias("see"), "unknown")

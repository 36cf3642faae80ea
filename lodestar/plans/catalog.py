"""Every query of the library by name, with its SQL twin.

The twins share only the definition of the demo graph with the DataFrame code; what the
operators compute is written out again in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import coverage, crosslang, diff, govern, graph, ingest, review, search, solution
from ..sources import parsers, table_functions
from ..store import SnapshotStore
from . import demo_graph as g
from . import events, indexes  # noqa: F401  register their queries
from .registered import ORACLE, QUERIES, query


def joined(column: str, sep: str = ",") -> F.Column:
    return F.array_join(column, sep)


# -- coverage ------------------------------------------------------------------------------------

CANDIDATES = """, c AS (SELECT * FROM g_nodes WHERE node_kind = 'Real' AND kind IN ('Type', 'Method', 'Property', 'Constructor', 'Delegate', 'Event', 'Field')
  AND accessibility IN ('Public', 'Protected', 'ProtectedInternal')),
k AS (SELECT *, CASE WHEN contains(fqn, '.') THEN regexp_replace(fqn, '\\.[^.]*$', '') ELSE '(global)' END AS namespace FROM c)
"""
COUNTS = "count(*) AS total, count(summary) AS documented, round_even(count(summary) / count(*) * 100.0, 1) AS coverage_percent FROM k"


@query(CANDIDATES + f"SELECT coalesce(project_origin, '(unknown)') AS project, {COUNTS} GROUP BY 1")
def coverage_by_project(spark, d):
    return coverage.by_project(g.nodes(spark, d))


@query(CANDIDATES + f"SELECT namespace, {COUNTS} GROUP BY 1")
def coverage_by_namespace(spark, d):
    return coverage.by_namespace(g.nodes(spark, d))


@query(CANDIDATES + f"SELECT kind, {COUNTS} GROUP BY 1")
def coverage_by_kind(spark, d):
    return coverage.by_kind(g.nodes(spark, d))


@query(CANDIDATES + f"SELECT {COUNTS}")
def coverage_overall(spark, d):
    return coverage.overall(g.nodes(spark, d))


@query(CANDIDATES + f"""SELECT CASE WHEN grouping(project_origin) = 0 THEN 'project' WHEN grouping(namespace) = 0 THEN 'namespace' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'overall' END AS "grouping",
  coalesce(project_origin, namespace, kind, '') AS key, {COUNTS} GROUP BY GROUPING SETS ((project_origin), (namespace), (kind), ())""")
def coverage_grouping_sets(spark, d):
    return coverage.doc_coverage(g.nodes(spark, d))


@query("""SELECT count(*) AS total, count(summary) AS documented, round_even(count(summary) / count(*) * 100.0, 1) AS coverage_percent, round_even(count(summary) / count(*) * 100.0, 1) < 80 AS under,
  (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM g_nodes WHERE node_kind = 'Real' AND accessibility = 'Public' AND summary IS NULL ORDER BY id LIMIT 20)) AS first
  FROM g_nodes WHERE node_kind = 'Real' AND accessibility = 'Public'""")
def analyzer_coverage(spark, d):
    return coverage.undocumented(g.nodes(spark, d)).withColumn("first", joined("first"))


@query("SELECT id, kind, display_name FROM g_nodes WHERE node_kind = 'Real' AND accessibility = 'Public' AND summary IS NULL")
def analyzer_doc_parity(spark, d):
    return coverage.parity(g.nodes(spark, d))


@query("SELECT id, CASE WHEN k % 2 = 0 THEN 'obsolete' ELSE 'nullable' END AS reason FROM g_nodes WHERE CASE WHEN k % 2 = 0 THEN NOT regexp_matches(lower(coalesce(summary, '')), 'obsolete|deprecated') ELSE NOT contains(lower(coalesce(summary, '')), 'null') END")
def analyzer_suspicious_edit(spark, d):
    tagged = g.nodes(spark, d).withColumn("attributes", F.when(F.expr("cast(regexp_replace(id, '^[A-Z]:[a-z]', '') as bigint) % 2 = 0"), F.array(F.lit("Obsolete"))).otherwise(F.array(F.lit("MaybeNull"))))
    return coverage.suspicious_edits(tagged)


# -- search --------------------------------------------------------------------------------------

CAMEL = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \t\r\n]+'), lambda t: t <> '')"
PARTS = r"regexp_split_to_array(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1' || chr(1) || '\2', 'g'), '([A-Z])([A-Z][a-z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
CAMEL_TOKENS = "list_transform(flatten(list_transform(" + CAMEL + f", lambda t: CASE WHEN len({PARTS}) > 1 THEN list_concat([t], {PARTS}) ELSE [t] END)), lambda t: lower(t))"
STOPS = "'a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with'"
STANDARD = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_'']+'), lambda t: NOT list_contains([" + STOPS + "], t))"
POSTINGS = f""", docs AS (SELECT id, 'name' AS field, {CAMEL_TOKENS.format('display_name')} AS tokens FROM g_nodes WHERE node_kind = 'Real'
  UNION ALL SELECT id, 'fqn', {CAMEL_TOKENS.format('fqn')} FROM g_nodes WHERE node_kind = 'Real'
  UNION ALL SELECT id, 'doc', {STANDARD.format('summary')} FROM g_nodes WHERE node_kind = 'Real'),
terms AS (SELECT id, field, len(tokens) AS length, unnest(tokens) AS term FROM docs),
p AS (SELECT field, term, id, length, count(*) AS tf FROM terms GROUP BY ALL),
st AS (SELECT field, (SELECT count(*) FROM g_nodes WHERE node_kind = 'Real') AS documents, sum(tf) / (SELECT count(*) FROM g_nodes WHERE node_kind = 'Real') AS average_length FROM p GROUP BY field)
"""


def bm25_sql(tokens: list[str], extra: str = "") -> str:
    wanted = ", ".join(f"('{t}', {tokens.count(t)})" for t in sorted(set(tokens)))
    return POSTINGS + f""", q(term, times) AS (VALUES {wanted}),
h AS (SELECT p.*, times, count(*) OVER (PARTITION BY field, p.term) AS df FROM p JOIN q ON p.term = q.term),
w AS (SELECT h.*, documents, average_length, CASE WHEN h.field = 'doc' THEN 1.2 ELSE 2.0 END AS k1, CASE WHEN h.field = 'doc' THEN 0.75 ELSE 0.5 END AS b FROM h JOIN st ON h.field = st.field),
s AS (SELECT id, sum(times * ln(1 + (documents - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average_length))) AS score FROM w GROUP BY id),
r AS (SELECT n.id, round(score, 4) AS score, n.kind, n.display_name, n.project_origin, score AS exact FROM s JOIN g_nodes n ON s.id = n.id {extra}),
top AS (SELECT *, row_number() OVER (ORDER BY round(exact, 10) DESC, id) AS place FROM r QUALIFY place <= 50)
"""


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 4))


@query(bm25_sql(["blue", "widget", "nation_3"]) + "SELECT id, score, kind, display_name, project_origin FROM top WHERE place <= 20")
def search_bm25(spark, d):
    return ranked(search.search(g.nodes(spark, d), "blue widget NATION_3", limit=20))


@query(bm25_sql(["red", "ring", "red"], "AND n.project_origin = 'Brand#7'") + "SELECT id, score, kind, display_name, project_origin FROM top WHERE place <= 20")
def search_bm25_project(spark, d):
    return ranked(search.search(g.nodes(spark, d), "red ring red", project="Brand#7", limit=20))


@query(bm25_sql(["about", "nation_5"]) + "SELECT id, score, kind, display_name, project_origin FROM top WHERE kind = 'Type' ORDER BY place LIMIT 10")
def search_kind_postfilter(spark, d):
    return ranked(search.search(g.nodes(spark, d), "About NATION_5", kind="type", limit=10))


@query(bm25_sql(["small", "ring"]) + "SELECT id, score, kind, display_name, project_origin FROM top WHERE place > 10 AND place <= 25")
def search_offset_limit(spark, d):
    return ranked(search.search(g.nodes(spark, d), "small ring", offset=10, limit=15))


@query("SELECT id, 1.0::DOUBLE AS score, kind, display_name, project_origin FROM g_nodes WHERE node_kind = 'Real' ORDER BY id LIMIT 100 OFFSET 40")
def search_wildcard(spark, d):
    return search.search(g.nodes(spark, d), "*", offset=40, limit=500)


@query("SELECT id, 1.0::DOUBLE AS score, kind, display_name, project_origin FROM g_nodes WHERE node_kind = 'Real' AND (contains(lower(display_name), 'customer#00000001') OR contains(lower(coalesce(summary, '')), 'customer#00000001'))")
def search_substring(spark, d):
    return search.substring_search(g.nodes(spark, d), "Customer#00000001")


@query(f", t AS (SELECT id, {CAMEL_TOKENS.format(chr(39) + 'XMLParser getRef' + chr(39) + ' || display_name')} AS tokens FROM g_nodes) SELECT id, array_to_string(tokens, ' ') AS tokens FROM t")
def tokens_camel(spark, d):
    return g.nodes(spark, d).select("id", F.array_join(text.camel_tokens(F.concat(F.lit("XMLParser getRef"), "display_name")), " ").alias("tokens"))


@query("SELECT doc_id, array_to_string(" + STANDARD.format("text") + ", ' ') AS tokens FROM documents", graph_sql=False)
def tokens_standard(spark, d):
    return g.table(spark, d, "documents").select("doc_id", F.array_join(text.standard_tokens(F.col("text")), " ").alias("tokens"))


@query(POSTINGS + "SELECT field, count(*) AS postings, count(DISTINCT term) AS terms, sum(tf)::BIGINT AS tokens FROM p GROUP BY field")
def postings_stats(spark, d):
    return search.postings(g.nodes(spark, d)).groupBy("field").agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.sum("tf").alias("tokens"))


# -- lookup --------------------------------------------------------------------------------------

DETAIL = """, x AS (SELECT id FROM g_nodes WHERE node_kind = 'Real' {0}) SELECT x.id, (SELECT max(from_id) FROM g_edges WHERE kind = 'Contains' AND to_id = x.id) AS parent_id,
  coalesce((SELECT string_agg(to_id, ',' ORDER BY to_id) FROM g_edges WHERE kind = 'Contains' AND from_id = x.id), '') AS child_ids,
  coalesce((SELECT string_agg(DISTINCT e, ',' ORDER BY e) FROM (SELECT to_id AS e FROM g_edges WHERE kind <> 'Contains' AND from_id = x.id UNION ALL SELECT from_id FROM g_edges WHERE kind <> 'Contains' AND to_id = x.id)), '') AS related_ids FROM x"""


@query(DETAIL.format("AND id = 'P:s7'"))
def symbol_detail(spark, d):
    return graph.details(g.nodes(spark, d), g.edges(spark, d), "P:s7").withColumns({c: joined(c) for c in ("child_ids", "related_ids")})


@query(DETAIL.format("AND kind IN ('Type', 'Namespace')"))
def symbol_details_of_types(spark, d):
    types = g.nodes(spark, d).where("kind in ('Type', 'Namespace')")
    return graph.details(types, g.edges(spark, d)).withColumns({c: joined(c) for c in ("child_ids", "related_ids")})


@query(""", o AS (SELECT DISTINCT id, e FROM (SELECT from_id AS id, to_id AS e FROM g_edges WHERE kind <> 'Contains' UNION ALL SELECT to_id, from_id FROM g_edges WHERE kind <> 'Contains'))
SELECT n.id, coalesce(c.n, 0) AS children, coalesce(r.n, 0) AS related FROM g_nodes n LEFT JOIN (SELECT from_id, count(*) AS n FROM g_edges WHERE kind = 'Contains' GROUP BY 1) c ON n.id = c.from_id LEFT JOIN (SELECT id, count(*) AS n FROM o GROUP BY 1) r ON n.id = r.id WHERE node_kind = 'Real'""")
def symbol_neighbour_counts(spark, d):
    return graph.neighbour_counts(g.nodes(spark, d), g.edges(spark, d))


@query("SELECT DISTINCT CASE WHEN from_id = 'P:s3' THEN to_id ELSE from_id END AS id FROM g_edges WHERE kind <> 'Contains' AND 'P:s3' IN (from_id, to_id) ORDER BY id LIMIT 50 OFFSET 20")
def symbol_neighbours_page(spark, d):
    return graph.neighbours(g.edges(spark, d), "P:s3", "related", offset=20, limit=50)


RESOLVE = """, f AS (SELECT * FROM g_nodes WHERE node_kind = 'Real' AND fqn = '{0}') SELECT count(*) AS matches, coalesce(string_agg(DISTINCT project_origin, ',' ORDER BY project_origin), '') AS projects,
  CASE WHEN count(DISTINCT project_origin) <= 1 THEN min(id) END AS id, CASE WHEN count(*) = 0 THEN 'none' WHEN count(DISTINCT project_origin) > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM f"""


@query(RESOLVE.format("Brand#7.red ring"))
def fqn_resolve(spark, d):
    return graph.resolve_fqn(g.nodes(spark, d), "Brand#7.red ring").withColumn("projects", joined("projects"))


@query(RESOLVE.format("ASIA.NOWHERE"))
def fqn_missing(spark, d):
    return graph.resolve_fqn(g.nodes(spark, d), "ASIA.NOWHERE").withColumn("projects", joined("projects"))


@query("SELECT display_name AS fqn, count(*) AS matches, count(DISTINCT project_origin) AS projects FROM g_nodes WHERE node_kind = 'Real' GROUP BY 1 HAVING count(DISTINCT project_origin) > 1")
def fqn_ambiguous(spark, d):
    return graph.ambiguous_fqns(g.nodes(spark, d).withColumn("fqn", F.col("display_name")))


REFERENCES = """, b AS (SELECT 'outgoing' AS direction, * FROM g_edges WHERE from_id = 'P:s3' UNION ALL SELECT 'incoming', * FROM g_edges WHERE to_id = 'P:s3')
SELECT direction, from_id, to_id, b.kind, scope, x.project_origin AS from_project, y.project_origin AS to_project FROM b
LEFT JOIN (SELECT * FROM g_nodes WHERE node_kind = 'Real') x ON from_id = x.id LEFT JOIN (SELECT * FROM g_nodes WHERE node_kind = 'Real') y ON to_id = y.id"""


@query(REFERENCES)
def references_all(spark, d):
    return graph.references(g.nodes(spark, d), g.edges(spark, d), "P:s3")


@query(REFERENCES + " WHERE scope = 'CrossProject'")
def references_cross_project(spark, d):
    return graph.references(g.nodes(spark, d), g.edges(spark, d), "P:s3", cross_project_only=True)


@query(REFERENCES + " ORDER BY direction DESC, from_id, to_id LIMIT 15 OFFSET 5")
def references_page(spark, d):
    return graph.references(g.nodes(spark, d), g.edges(spark, d), "P:s3", offset=5, limit=15)


@query("SELECT n.id, e.kind AS relation, n.kind, display_name, project_origin FROM g_edges e JOIN g_nodes n ON n.id = from_id WHERE to_id = 'T:p11' AND e.kind IN ('Implements', 'Inherits') AND node_kind = 'Real'")
def implementations(spark, d):
    return graph.implementations(g.nodes(spark, d), g.edges(spark, d), "T:p11")


def overview_of(spark, d, section):
    return graph.overview(g.nodes(spark, d), g.edges(spark, d), first=None)[section]


@query("SELECT kind, count(*) AS n FROM g_nodes WHERE node_kind = 'Real' GROUP BY kind")
def project_overview_stats(spark, d):
    return overview_of(spark, d, "stats")


@query("SELECT id, display_name, fqn FROM g_nodes WHERE node_kind = 'Real' AND kind = 'Namespace'")
def project_overview_namespaces(spark, d):
    return overview_of(spark, d, "namespaces")


@query(""", ty AS (SELECT id, display_name, fqn FROM g_nodes WHERE node_kind = 'Real' AND kind IN ('Type', 'Delegate') ORDER BY id LIMIT 20),
ch AS (SELECT from_id, to_id FROM g_edges WHERE kind = 'Contains' QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY to_id) <= 10)
SELECT id, display_name, fqn, string_agg(to_id, ',' ORDER BY to_id) AS children FROM ty LEFT JOIN ch ON id = from_id GROUP BY ALL""")
def project_overview_types(spark, d):
    return overview_of(spark, d, "types").withColumn("children", joined("children"))


# -- solution ------------------------------------------------------------------------------------

@query(""", e AS (SELECT DISTINCT ed.rowid_ AS r, project_origin AS project FROM (SELECT *, row_number() OVER () AS rowid_ FROM g_edges WHERE scope = 'IntraProject') ed JOIN g_nodes n ON n.id IN (from_id, to_id) AND node_kind = 'Real'),
ec AS (SELECT project, count(*) AS edge_count FROM e GROUP BY 1),
cc AS (SELECT project_origin AS project, round_even(count(summary) / count(*) * 100.0, 1) AS coverage_percent FROM g_nodes WHERE node_kind = 'Real' AND kind IN ('Type', 'Method', 'Property', 'Field') AND accessibility IN ('Public', 'Protected', 'ProtectedInternal') GROUP BY 1)
SELECT n.project_origin AS project, count(*) AS node_count, coalesce(any_value(edge_count), 0) AS edge_count, coalesce(any_value(coverage_percent), 0.0) AS coverage_percent FROM g_nodes n
LEFT JOIN ec ON n.project_origin = ec.project LEFT JOIN cc ON n.project_origin = cc.project WHERE node_kind = 'Real' GROUP BY 1""")
def solution_projects(spark, d):
    return solution.projects(g.nodes(spark, d), g.edges(spark, d))


@query("""SELECT a.project_origin AS project, string_agg(DISTINCT b.project_origin, ',' ORDER BY b.project_origin) AS depends_on FROM g_edges JOIN g_nodes a ON from_id = a.id JOIN g_nodes b ON to_id = b.id
WHERE scope = 'CrossProject' AND a.node_kind = 'Real' AND b.node_kind = 'Real' AND a.project_origin <> b.project_origin GROUP BY 1""")
def solution_dag(spark, d):
    return solution.dependency_dag(g.nodes(spark, d), g.edges(spark, d)).withColumn("depends_on", joined("depends_on"))


@query("SELECT count(*) FILTER (node_kind = 'Real') AS real_count, count(*) FILTER (node_kind = 'Stub') AS stub_count, count(DISTINCT project_origin) <= 1 AS single_project FROM g_nodes")
def solution_totals(spark, d):
    return solution.totals(g.nodes(spark, d))


def solution_sides(spark, d):
    (an, ae), (bn, be) = g.before(spark, d), g.after(spark, d)
    return an.where("project_origin <> 'Brand#3'"), ae, bn.where("project_origin <> 'Brand#5'"), be


@query(""", a AS (SELECT DISTINCT project_origin AS project FROM a_nodes WHERE node_kind = 'Real' AND project_origin <> 'Brand#3'), b AS (SELECT DISTINCT project_origin AS project FROM b_nodes WHERE node_kind = 'Real' AND project_origin <> 'Brand#5')
SELECT coalesce(a.project, b.project) AS project, CASE WHEN a.project IS NULL THEN 'added' WHEN b.project IS NULL THEN 'removed' ELSE 'surviving' END AS status FROM a FULL JOIN b ON a.project = b.project""")
def solution_diff_projects(spark, d):
    an, _, bn, _ = solution_sides(spark, d)
    return solution.project_changes(an, bn)


CROSS = """, a AS (SELECT DISTINCT coalesce(x.project_origin, '(unknown)') || '::' || from_id AS source, coalesce(y.project_origin, '(unknown)') || '::' || to_id AS target, e.kind FROM a_edges e
  LEFT JOIN (SELECT * FROM a_nodes WHERE node_kind = 'Real') x ON from_id = x.id LEFT JOIN (SELECT * FROM a_nodes WHERE node_kind = 'Real') y ON to_id = y.id WHERE scope = 'CrossProject'),
b AS (SELECT DISTINCT coalesce(x.project_origin, '(unknown)') || '::' || from_id AS source, coalesce(y.project_origin, '(unknown)') || '::' || to_id AS target, e.kind FROM b_edges e
  LEFT JOIN (SELECT * FROM b_nodes WHERE node_kind = 'Real') x ON from_id = x.id LEFT JOIN (SELECT * FROM b_nodes WHERE node_kind = 'Real') y ON to_id = y.id WHERE scope = 'CrossProject')
"""


@query(CROSS + "SELECT *, 'added' AS status FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'removed' FROM (FROM a EXCEPT FROM b)")
def solution_diff_cross_edges(spark, d):
    return solution.cross_edge_changes(*g.both(spark, d))


# -- diffs ---------------------------------------------------------------------------------------

GRAPH_DIFF = """, rem AS (SELECT id FROM a_nodes WHERE id NOT IN (SELECT id FROM b_nodes)), ad AS (SELECT id, old_id FROM b_nodes WHERE id NOT IN (SELECT id FROM a_nodes)),
ren AS (SELECT id, old_id FROM ad WHERE old_id IN (SELECT id FROM rem)),
com AS (SELECT a.id, concat_ws('; ', CASE WHEN a.accessibility <> b.accessibility THEN 'accessibility: ' || a.accessibility || ' → ' || b.accessibility END, CASE WHEN a.summary IS DISTINCT FROM b.summary THEN 'doc changed' END) AS summary FROM a_nodes a JOIN b_nodes b ON a.id = b.id),
gd AS (SELECT id, 'Modified' AS change, 'renamed from ' || old_id AS summary FROM ren UNION ALL SELECT id, 'Removed', 'symbol removed' FROM rem WHERE id NOT IN (SELECT old_id FROM ren)
  UNION ALL SELECT id, 'Added', 'symbol added' FROM ad WHERE id NOT IN (SELECT id FROM ren) UNION ALL SELECT id, 'Modified', summary FROM com WHERE summary <> '')
"""


def plain_diff(spark, d):
    return diff.graph_diff(g.before(spark, d)[0], g.after(spark, d)[0])


@query(GRAPH_DIFF + "SELECT * FROM gd")
def graph_diff(spark, d):
    return plain_diff(spark, d)


@query(GRAPH_DIFF + "SELECT id, replace(summary, 'renamed from ', '') AS old_id FROM gd WHERE summary LIKE 'renamed from %'")
def graph_diff_renames(spark, d):
    return plain_diff(spark, d).where("summary like 'renamed from %'").select("id", F.expr("substring(summary, 14)").alias("old_id"))


PUBLIC = "('Public', 'Protected', 'ProtectedInternal')"
CHANGES = f""", cmp AS (SELECT a.id, a.display_name, a.return_type AS r0, b.return_type AS r1, a.t1 AS t0, b.t1, a.np AS n0, b.np AS n1, a.accessibility AS x0, b.accessibility AS x1, a.summary AS s0, b.summary AS s1, a.limits AS l0, b.limits AS l1,
  CASE WHEN a.accessibility IN {PUBLIC} THEN 'Breaking' ELSE 'NonBreaking' END AS sev FROM a_nodes a JOIN b_nodes b ON a.id = b.id),
cm AS (SELECT *, coalesce(rtrim(r0, '?') = rtrim(r1, '?') AND r0 <> r1, false) AS rn, coalesce(rtrim(t0, '?') = rtrim(t1, '?') AND t0 <> t1, false) AS tn FROM cmp),
cp AS (SELECT *, r0 IS DISTINCT FROM r1 AND NOT rn AS rc, (CASE WHEN t0 IS DISTINCT FROM t1 AND NOT tn THEN 1 ELSE 0 END + CASE WHEN n0 <> n1 THEN 1 ELSE 0 END) AS np FROM cm),
ec AS (SELECT coalesce(a.from_id, b.from_id) AS id, coalesce(b.n, 0) - coalesce(a.n, 0) AS more FROM (SELECT from_id, to_id, kind, count(*) AS n FROM a_edges GROUP BY ALL) a FULL JOIN (SELECT from_id, to_id, kind, count(*) AS n FROM b_edges GROUP BY ALL) b ON a.from_id = b.from_id AND a.to_id = b.to_id AND a.kind = b.kind),
ed AS (SELECT id, sum(greatest(-more, 0))::BIGINT AS gone, sum(greatest(more, 0))::BIGINT AS new FROM ec WHERE more <> 0 GROUP BY id),
par_a AS (SELECT to_id AS id, min(from_id) AS parent_id FROM a_edges WHERE kind = 'Contains' GROUP BY 1), par_b AS (SELECT to_id AS id, min(from_id) AS parent_id FROM b_edges WHERE kind = 'Contains' GROUP BY 1),
c0 AS (
  SELECT id, 'Added' AS change_type, 'Signature' AS category, 'NonBreaking' AS severity, 'Symbol ''' || display_name || ''' added.' AS description, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value, 0 AS parameter_count, NULL::VARCHAR AS type_parameter, '' AS removed, '' AS added, 0 AS gone, 0 AS new FROM b_nodes WHERE id NOT IN (SELECT id FROM a_nodes)
  UNION ALL SELECT id, 'Removed', 'Signature', CASE WHEN accessibility IN {PUBLIC} THEN 'Breaking' ELSE 'NonBreaking' END, 'Symbol ''' || display_name || ''' removed.', NULL, NULL, 0, NULL, '', '', 0, 0 FROM a_nodes WHERE id NOT IN (SELECT id FROM b_nodes)
  UNION ALL SELECT id, 'Modified', 'Signature', sev, CASE WHEN rc THEN 'Return type changed from ''' || coalesce(r0, '') || ''' to ''' || coalesce(r1, '') || '''.' ELSE 'Parameter signature changed: ' || np || ' parameter(s) modified.' END, r0, r1, np, NULL, '', '', 0, 0 FROM cp WHERE rc OR np > 0
  UNION ALL SELECT id, 'Modified', 'Nullability', sev, CASE WHEN rn THEN 'Nullability changed on return type: ''' || r0 || ''' → ''' || r1 || '''.' ELSE 'Nullability changed on parameter type.' END, r0, r1, 0, NULL, '', '', 0, 0 FROM cp WHERE rn OR tn
  UNION ALL SELECT id, 'Modified', 'Constraint', sev, 'Generic constraints changed for type parameter ''T''.', NULL, NULL, 0, 'T', 'IDisposable', '', 0, 0 FROM cp WHERE l0 <> l1
  UNION ALL SELECT id, 'Modified', 'Accessibility', sev, 'Accessibility changed from ''' || x0 || ''' to ''' || x1 || '''.', x0, x1, 0, NULL, '', '', 0, 0 FROM cp WHERE x0 <> x1
  UNION ALL SELECT cp.id, 'Modified', 'Dependency', sev, 'Dependency edges changed: ' || gone || ' removed, ' || new || ' added.', NULL, NULL, 0, NULL, '', '', gone, new FROM cp JOIN ed ON cp.id = ed.id
  UNION ALL SELECT id, 'Modified', 'DocComment', 'Informational', 'Documentation comment changed.', s0, s1, 0, NULL, '', '', 0, 0 FROM cp WHERE s0 IS DISTINCT FROM s1),
ch AS (SELECT c0.*, CASE WHEN change_type = 'Removed' THEN par_a.parent_id ELSE par_b.parent_id END AS parent_id FROM c0 LEFT JOIN par_a ON c0.id = par_a.id LEFT JOIN par_b ON c0.id = par_b.id)
"""


def changes(spark: SparkSession, d: str, categories: list[str] | None = None) -> DataFrame:
    return diff.semantic_diff(*g.both(spark, d), categories=categories)


def flat(df: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    words = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return df.select("id", "parent_id", "change_type", "category", "severity", "description", "old_value", "new_value", F.coalesce(F.size("parameter_changes"), F.lit(0)).alias("parameter_count"), "type_parameter", words("removed").alias("removed"), words("added").alias("added"), n("removed_edges").alias("gone"), n("added_edges").alias("new"))


@query(CHANGES + "SELECT * FROM ch")
def symbol_diff(spark, d):
    return flat(changes(spark, d))


def by_category(category: str):
    def run(spark, d):
        return flat(changes(spark, d, [category]))

    run.__name__ = f"symbol_diff_{category.lower()}"
    query(CHANGES + f"SELECT * FROM ch WHERE category = '{category}'")(run)


for _category in ("Signature", "Nullability", "Constraint", "Accessibility", "Dependency", "DocComment"):
    by_category(_category)


@query(CHANGES + """SELECT count(*) AS total, count(*) FILTER (change_type = 'Added') AS added, count(*) FILTER (change_type = 'Removed') AS removed, count(*) FILTER (change_type = 'Modified') AS modified,
count(*) FILTER (severity = 'Breaking') AS breaking, count(*) FILTER (severity = 'NonBreaking') AS non_breaking, count(*) FILTER (severity = 'Informational') AS informational FROM ch""")
def diff_summary(spark, d):
    return diff.summary(changes(spark, d))


@query(CHANGES.replace("a_nodes WHERE", "a_nodes WHERE project_origin <> 'Brand#3' AND node_kind = 'Real' AND").replace("FROM a_nodes)", "FROM a_nodes WHERE project_origin <> 'Brand#3' AND node_kind = 'Real')").replace("b_nodes WHERE", "b_nodes WHERE project_origin <> 'Brand#5' AND node_kind = 'Real' AND").replace("FROM b_nodes)", "FROM b_nodes WHERE project_origin <> 'Brand#5' AND node_kind = 'Real')").replace("a.id = b.id),\ncm", "a.id = b.id AND a.node_kind = 'Real' AND a.project_origin NOT IN ('Brand#3', 'Brand#5')),\ncm").replace("FROM a_edges", "FROM a_edges WHERE scope = 'IntraProject'").replace("FROM b_edges", "FROM b_edges WHERE scope = 'IntraProject'").replace("'IntraProject' WHERE", "'IntraProject' AND")
       + "SELECT project_origin, change_type, category, count(*) AS n FROM ch JOIN (SELECT id, project_origin FROM a_nodes UNION SELECT id, project_origin FROM b_nodes) p ON ch.id = p.id WHERE project_origin NOT IN ('Brand#3', 'Brand#5') GROUP BY ALL")
def solution_diff_inner(spark, d):
    return solution.inner_diff(*solution_sides(spark, d)).groupBy("project_origin", "change_type", "category").agg(F.count("*").alias("n"))


# -- review --------------------------------------------------------------------------------------

VIS = "list_position(['Private', 'PrivateProtected', 'Internal', 'Protected', 'ProtectedInternal', 'Public'], {0})"
UNUSUAL = CHANGES + f""", un AS (
  SELECT 'MassSignatureChange' AS kind, parent_id AS id, 'Type ''' || parent_id || ''' has ' || count(*) || ' signature changes, exceeding the threshold of 5.' AS description FROM ch WHERE category = 'Signature' AND parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) > 5
  UNION ALL SELECT 'AccessibilityWidening', id, 'Accessibility of ''' || id || ''' widened from ' || old_value || ' to ' || new_value || '.' FROM ch WHERE category = 'Accessibility' AND {VIS.format('new_value')} > {VIS.format('old_value')}
  UNION ALL SELECT 'NullabilityRegression', id, 'Return type of ''' || id || ''' became nullable (''' || old_value || ''' → ''' || new_value || '''). Callers must handle null.' FROM ch WHERE category = 'Nullability' AND old_value NOT LIKE '%?' AND new_value LIKE '%?'
  UNION ALL SELECT 'ConstraintRemoval', id, 'Generic constraints removed from ''' || id || ''' for type parameter ''T'': [IDisposable].' FROM ch WHERE category = 'Constraint' AND removed <> '')
"""
FINDINGS = UNUSUAL + """, fi AS (SELECT ch.id, list_extract(string_split(ch.id, '.'), -1) AS display_name, CASE WHEN severity = 'Breaking' THEN 'Breaking' WHEN severity = 'NonBreaking' AND ch.id IN (SELECT id FROM un) THEN 'Warning' ELSE 'Info' END AS severity, category, ch.description,
  CASE category WHEN 'Constraint' THEN 'where T : [IDisposable]' WHEN 'Dependency' THEN gone || ' edges removed' ELSE old_value END AS before,
  CASE category WHEN 'Constraint' THEN NULL WHEN 'Dependency' THEN new || ' edges added' ELSE new_value END AS after,
  CASE WHEN category = 'Signature' AND severity = 'Breaking' THEN 'Update all callers to match the new signature.' WHEN category = 'Signature' THEN 'Review call sites — signature changed but impact may be limited.'
    WHEN category = 'Nullability' THEN 'Ensure all callers handle the updated nullability annotation.' WHEN category = 'Constraint' THEN 'Verify that removing constraints does not break callers that relied on them.'
    WHEN category = 'Accessibility' THEN 'Verify intent: widening accessibility increases public API surface.' WHEN category = 'Dependency' THEN 'Review dependency edge changes for unintended coupling.' END AS remediation
  FROM ch WHERE NOT (severity = 'Informational' AND category = 'DocComment'))
"""


@query(UNUSUAL + "SELECT kind, id, description FROM un")
def review_unusual(spark, d):
    return review.unusual(changes(spark, d)).drop("remediation")


@query(FINDINGS + "SELECT * FROM fi")
def review_findings(spark, d):
    return review.findings(changes(spark, d))


@query(FINDINGS + """SELECT count(*) FILTER (severity = 'Breaking') AS breaking, count(*) FILTER (severity = 'Warning') AS warning, count(*) FILTER (severity = 'Info') AS info,
  (SELECT count(*) FROM ch WHERE category = 'DocComment') AS trivial_filtered, CASE WHEN count(*) FILTER (severity = 'Breaking') > 0 THEN 'high' WHEN count(*) FILTER (severity = 'Warning') > 0 THEN 'medium' ELSE 'low' END AS overall_risk FROM fi""")
def review_summary(spark, d):
    return review.review_summary(changes(spark, d))


@query(FINDINGS + ", sc AS (SELECT to_id, string_agg(from_id, ',' ORDER BY from_id) AS s FROM b_edges GROUP BY 1) SELECT id, category, severity, coalesce(s, '') AS impact_scope FROM fi LEFT JOIN sc ON id = to_id")
def review_impact(spark, d):
    found = review.findings(changes(spark, d))
    return review.impact(found, g.after(spark, d)[1]).select("id", "category", "severity", joined("impact_scope").alias("impact_scope"))


@query(FINDINGS + ", sc AS (SELECT to_id, count(*) AS n FROM b_edges GROUP BY 1) SELECT id, category, severity, coalesce(n, 0) AS impacted FROM fi LEFT JOIN sc ON id = to_id")
def review_impact_counts(spark, d):
    return review.impact_counts(review.findings(changes(spark, d)), g.after(spark, d)[1]).select("id", "category", "severity", "impacted")


@query(CHANGES + "SELECT id, list_extract(string_split(id, '.'), -1) AS display_name, change_type, category, description FROM ch WHERE severity = 'Breaking'")
def breaking_changes(spark, d):
    return review.breaking(changes(spark, d))


@query(FINDINGS + f""", ca AS (SELECT count(*)::INT AS n, coalesce(string_agg(from_id, ',' ORDER BY from_id), '') AS callers FROM b_edges WHERE to_id = 'P:s1' AND kind = 'Calls')
SELECT id, change_type, category, CASE severity WHEN 'Breaking' THEN 'breaking' WHEN 'NonBreaking' THEN 'non-breaking' ELSE 'informational' END AS severity, description,
  CASE category WHEN 'Dependency' THEN gone || ' edges removed' ELSE old_value END AS before, CASE category WHEN 'Dependency' THEN new || ' edges added' ELSE new_value END AS after,
  CASE WHEN category = 'Accessibility' AND {VIS.format('new_value')} > {VIS.format('old_value')} THEN 'Public API surface increased. This symbol is now accessible to more consumers.'
    WHEN category = 'Dependency' THEN 'Dependency edges changed. This may affect callers that rely on specific coupling.' WHEN category = 'DocComment' THEN 'Documentation was updated. No runtime impact expected.' ELSE description END AS why_it_matters,
  n AS caller_count, callers, CASE category WHEN 'Accessibility' THEN 'Verify intent: widening accessibility increases public API surface.' WHEN 'Dependency' THEN 'Review dependency edge changes for unintended coupling.' END AS remediation
FROM ch, ca WHERE id = 'P:s1'""")
def explain_change(spark, d):
    return review.explain(changes(spark, d), g.after(spark, d)[1], "P:s1").withColumn("callers", joined("callers"))


# -- ingestion -----------------------------------------------------------------------------------

FILES = """WITH a AS (SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 23 <> 0),
b AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) AS sha256 FROM documents WHERE doc_id % 17 <> 0),
md AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'Added' WHEN b.path IS NULL THEN 'Removed' ELSE 'Modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.sha256 IS DISTINCT FROM b.sha256)
"""


def manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = g.table(spark, d, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    before = docs.where("doc_id % 23 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    after = docs.where("doc_id % 17 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return before, after


@query(FILES + "SELECT * FROM md", graph_sql=False)
def manifest_diff(spark, d):
    return ingest.manifest_diff(*manifests(spark, d))


@query("SELECT source || '/' || doc_id AS path, 'Added' AS change FROM documents", graph_sql=False)
def manifest_diff_first(spark, d):
    docs = g.table(spark, d, "documents")
    return ingest.manifest_diff(None, docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256")))


@query(FILES + ", n AS (SELECT doc_id, source || '/' || (doc_id - doc_id % 2) AS file_path FROM documents) SELECT path AS file_path, change AS change_kind, CASE WHEN change = 'Removed' THEN '' ELSE coalesce(string_agg('D:' || doc_id, ',' ORDER BY 'D:' || doc_id), '') END AS affected_symbol_ids FROM md LEFT JOIN n ON path = n.file_path GROUP BY path, change", graph_sql=False)
def file_change_records(spark, d):
    docs = g.table(spark, d, "documents")
    path = F.concat_ws("/", "source", (F.col("doc_id") - F.col("doc_id") % 2).cast("string"))
    nodes = docs.select(F.concat(F.lit("D:"), F.col("doc_id").cast("string")).alias("id"), F.struct(path.alias("file_path")).alias("span"))
    return ingest.file_changes(ingest.manifest_diff(*manifests(spark, d)), nodes).withColumn("affected_symbol_ids", joined("affected_symbol_ids"))


def directories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ASIA",), ("Brand#1",), ("brand#2/",)], "directory string")


IN_CHANGED = "(path IS NOT NULL AND regexp_matches(lower(path), '^(asia|brand#1|brand#2)/'))"


@query(f", new AS (SELECT * FROM b_nodes WHERE {IN_CHANGED}), m AS (SELECT id, summary FROM a_nodes WHERE NOT coalesce({IN_CHANGED}, false) AND id NOT IN (SELECT id FROM new) UNION ALL SELECT id, summary FROM new) SELECT * FROM m")
def incremental_merge_nodes(spark, d):
    dirs = directories(spark)
    after = g.after(spark, d)[0]
    new = after.join(ingest.below(after, dirs), "id", "left_semi")
    return ingest.merge_nodes(g.before(spark, d)[0], dirs, new).select("id", "docs.summary")


@query(f", new AS (SELECT from_id, to_id, kind FROM b_edges WHERE from_id IN (SELECT id FROM b_nodes WHERE {IN_CHANGED})), stale AS (SELECT id FROM a_nodes WHERE {IN_CHANGED}) "
       "SELECT o.from_id, o.to_id, o.kind FROM a_edges o ANTI JOIN stale ON o.from_id = stale.id ANTI JOIN new ON o.from_id = new.from_id AND o.to_id = new.to_id AND o.kind = new.kind UNION ALL SELECT * FROM new")
def incremental_merge_edges(spark, d):
    dirs = directories(spark)
    (an, ae), (bn, be) = g.before(spark, d), g.after(spark, d)
    mine = ingest.below(bn, dirs).withColumnRenamed("id", "from_id")
    return ingest.merge_edges(ae, an, dirs, be.join(mine, "from_id", "left_semi")).select("from_id", "to_id", "kind")


@query("SELECT to_id AS id, regexp_replace(to_id, '^[A-Z]:', '') AS display_name FROM (SELECT DISTINCT to_id FROM g_edges WHERE scope = 'External' AND kind IN ('Implements', 'Inherits')) WHERE to_id NOT IN (SELECT id FROM g_nodes WHERE node_kind = 'Real')")
def stub_synthesis(spark, d):
    return ingest.stubs(g.edges(spark, d), graph.real(g.nodes(spark, d)))


@query("SELECT from_id, to_id, e.kind, CASE WHEN b.id IS NULL OR b.node_kind = 'Stub' THEN 'External' WHEN a.project_origin IS DISTINCT FROM b.project_origin THEN 'CrossProject' ELSE 'IntraProject' END AS scope FROM b_edges e LEFT JOIN b_nodes a ON from_id = a.id LEFT JOIN b_nodes b ON to_id = b.id")
def edge_scope(spark, d):
    nodes, edges = g.after(spark, d)
    return ingest.scoped(edges, nodes)


@query("""WITH p AS (SELECT p_name || list_extract(['(net8.0)', '(net472)', '(net48)', '(net10.1)', ''], (p_partkey % 5 + 1)::INT) AS name, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand || '/' || p_type) ELSE p_brand || '/' || p_type END AS path FROM part),
v AS (SELECT *, regexp_extract(name, '\\(net(\\d+)\\.(\\d+)\\)$', 1) AS ma, regexp_extract(name, '\\(net(\\d+)\\.(\\d+)\\)$', 2) AS mi, regexp_extract(name, '\\(net(\\d+)\\)$', 1) AS ol FROM p),
w AS (SELECT *, CASE WHEN ma <> '' THEN ma::INT + 100 ELSE 0 END AS x, CASE WHEN ma <> '' THEN mi::INT WHEN ol <> '' THEN CASE WHEN ol::INT < 100 THEN ol::INT * 10 ELSE ol::INT END ELSE 0 END AS y FROM v)
SELECT name, lower(path) AS path FROM w QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY x DESC, y DESC, name) = 1""", graph_sql=False)
def tfm_dedup(spark, d):
    k = F.col("p_partkey")
    path = F.concat_ws("/", "p_brand", "p_type")
    suffix = F.get(F.array(*map(F.lit, ("(net8.0)", "(net472)", "(net48)", "(net10.1)", ""))), (k % 5).cast("int"))
    made = g.table(spark, d, "part").select(F.concat("p_name", suffix).alias("name"), F.when(k % 2 == 0, F.upper(path)).otherwise(path).alias("path"))
    return ingest.latest_framework(made).withColumn("path", F.lower("path"))


@query("""WITH p AS (SELECT p_partkey, 'src/' || CASE WHEN p_partkey % 7 = 0 THEN 'base' ELSE '' END || replace(p_name, ' ', '') || list_extract(['', 'Tests', 'test', 'Fixture', 'Spec', 'Steps'], (p_partkey % 6 + 1)::INT) || '.cs' AS path FROM part)
SELECT path, regexp_matches(lower(path), '/[^/]*(test|tests|fixture|spec|specs|steps)\\.cs$') AND NOT contains(lower(path), '/base') AS skipped FROM p""", graph_sql=False)
def test_file_filter(spark, d):
    k = F.col("p_partkey")
    suffix = F.get(F.array(*map(F.lit, ("", "Tests", "test", "Fixture", "Spec", "Steps"))), (k % 6).cast("int"))
    path = F.concat(F.lit("src/"), F.when(k % 7 == 0, "base").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("")), suffix, F.lit(".cs"))
    return g.table(spark, d, "part").select(path.alias("path")).withColumn("skipped", text.is_test_file(F.col("path")))


test_file_filter.__test__ = False


def saved(spark: SparkSession, d: str) -> SnapshotStore:
    """A store of its own in the checkpoint folder, with both snapshots of the demo graph, the first saved twice."""
    store = SnapshotStore(spark, f"{graph.shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    for side in (g.before, g.after, g.before):
        store.save(*side(spark, d), "demo")
    return store


@query("SELECT 'demo' AS project_name, (SELECT count(*) FROM a_nodes)::INT AS node_count, (SELECT count(*) FROM a_edges)::INT AS edge_count UNION ALL SELECT 'demo', (SELECT count(*) FROM b_nodes), (SELECT count(*) FROM b_edges)")
def snapshot_list(spark, d):
    return saved(spark, d).entries().select("project_name", "node_count", "edge_count")


@query("SELECT n.id, n.kind, n.summary, coalesce(e.n, 0) AS outgoing FROM a_nodes n LEFT JOIN (SELECT from_id, count(*) AS n FROM a_edges GROUP BY 1) e ON n.id = e.from_id")
def snapshot_latest(spark, d):
    """What is read back of the snapshot that was saved last."""
    nodes, edges = saved(spark, d).load()
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("outgoing"))
    return nodes.select("id", "kind", "docs.summary").join(out, "id", "left").fillna(0, ["outgoing"])


@query(bm25_sql(["blue", "widget", "nation_3"]).replace("g_nodes", "a_nodes") + "SELECT id, score, kind, display_name, project_origin FROM top WHERE place <= 20")
def search_stored_index(spark, d):
    """The search over an index that was built and stored once."""
    store = saved(spark, d)
    latest = store.latest("demo")
    store.build_index(latest)
    return ranked(search.search(store.load(latest)[0], "blue widget NATION_3", store.index(latest), limit=20))


# -- project graphs ------------------------------------------------------------------------------

def project_edges(spark: SparkSession, d: str, acyclic: bool) -> DataFrame:
    k = F.col("n_nationkey")
    to = F.floor(k / 2) if acyclic else (k * 3 + 1) % 25
    end = lambda c, up: F.concat(F.lit("P" if up else "p"), c.cast("int").cast("string"))
    return g.table(spark, d, "nation").where(k > 0).select(end(k, True).alias("from_project"), end(to, False).alias("to_project"))


@query("""WITH RECURSIVE e AS (SELECT 'p' || n_nationkey AS name, 'p' || ((n_nationkey * 3 + 1) % 25) AS dep FROM nation WHERE n_nationkey > 0),
d(name) AS (SELECT 'p' || r_regionkey FROM region WHERE r_regionkey < 2 UNION SELECT e.name FROM e JOIN d ON e.dep = d.name) SELECT name FROM d""", graph_sql=False)
def dirty_set(spark, d):
    seeds = g.table(spark, d, "region").where("r_regionkey < 2").select(F.concat(F.lit("P"), F.col("r_regionkey").cast("string")).alias("name"))
    return graph.dirty_set(project_edges(spark, d, acyclic=False), seeds)


@query("WITH RECURSIVE t(n, level) AS (SELECT 0, 0 UNION ALL SELECT n_nationkey, level + 1 FROM nation JOIN t ON n_nationkey > 0 AND n_nationkey // 2 = n) SELECT 'p' || n AS name, level FROM t", graph_sql=False)
def topo_levels(spark, d):
    names = g.table(spark, d, "nation").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("name"))
    return graph.topological_levels(names, project_edges(spark, d, acyclic=True))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation WHERE n_nationkey > 0),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT DISTINCT 'p' || a AS name FROM r WHERE a = b""", graph_sql=False)
def cycles(spark, d):
    return graph.cyclic(project_edges(spark, d, acyclic=False))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation WHERE n_nationkey > 0),
r(origin, place, n) AS (SELECT a, b, 1 FROM e UNION ALL SELECT origin, e.b, n + 1 FROM r JOIN e ON r.place = e.a WHERE r.place <> origin AND n < 25),
c AS (SELECT origin, n FROM r WHERE place = origin), m(a, b) AS (SELECT origin, origin FROM c UNION SELECT m.a, e.b FROM m JOIN e ON m.b = e.a)
SELECT DISTINCT 'p' || low AS first, n::INT AS length FROM c JOIN (SELECT a, min(b) AS low FROM m GROUP BY a) ON origin = a""", graph_sql=False)
def cycle_lengths(spark, d):
    """Each cycle by its smallest project and its length; projects have one dependency each here, so cycles do not overlap."""
    listed = graph.cycle_list(project_edges(spark, d, acyclic=False))
    number = F.expr("cast(substring(name, 2) as int)")
    return listed.groupBy("cycle").agg(F.concat(F.lit("p"), F.min(number).cast("string")).alias("first"), F.max("place").alias("length")).drop("cycle")


# -- scripts and code ----------------------------------------------------------------------------

SCRIPTS = """, scripts AS (SELECT 'T:script/' || s_suppkey AS id, s_suppkey AS k FROM supplier),
projects AS (SELECT project_origin, min(id) AS id FROM g_nodes WHERE kind = 'Namespace' GROUP BY 1),
old AS (SELECT id AS from_id, 'dotnet-build:./src/' || list_extract(['africa', 'ASIA.csproj', 'none'], (k % 3 + 1)::INT) AS to_id, 'Invokes' AS kind FROM scripts
  UNION ALL SELECT id, 'AFRICA.NATION_' || (k % 25), 'References' FROM scripts UNION ALL SELECT 'T:script/0', 'N:r0', 'Invokes'),
s1 AS (SELECT from_id, min(p.id) AS to_id, 'Invokes' AS kind FROM old JOIN projects p ON contains(lower(to_id), lower(project_origin)) WHERE kind = 'Invokes' AND contains(to_id, ':./') GROUP BY from_id, old.to_id),
s2 AS (SELECT from_id, n.id AS to_id, 'References' AS kind FROM old JOIN g_nodes n ON n.fqn = old.to_id AND n.kind = 'Type' WHERE old.kind = 'References'),
s4 AS (SELECT s.id AS from_id, n.id AS to_id, 'References' AS kind FROM scripts s JOIN g_nodes n ON n.kind = 'Type' AND s.k % 4 = 1 AND (ends_with(n.fqn, 'NATION_' || (s.k % 25)) OR contains(n.fqn, '.NATION_' || (s.k % 25)))
  UNION ALL SELECT s.id, p.id, 'Invokes' FROM scripts s JOIN projects p ON s.k % 4 = 1 AND p.project_origin = 'EUROPE'),
xl AS (SELECT DISTINCT x.* FROM (FROM s1 UNION ALL FROM s2 UNION ALL FROM s4) x ANTI JOIN old ON x.from_id = old.from_id AND x.to_id = old.to_id AND x.kind = old.kind)
"""


def with_scripts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    id_ = F.concat(F.lit("T:script/"), k.cast("string"))
    line = F.concat(F.lit("dotnet test './src/EUROPE.csproj' --filter \"FullyQualifiedName~NATION_"), (k % 25).cast("string"), F.lit("\""))
    suppliers = g.table(spark, d, "supplier")
    from ..model import empty_docs, normalised

    scripts = normalised(suppliers.select(id_.alias("id"), F.lit("Script").alias("kind"), F.lit("Public").alias("accessibility"), empty_docs(F.when(k % 4 == 1, line)).alias("docs")))
    scope = F.lit("IntraProject").alias("scope")
    target = F.get(F.array(*map(F.lit, ("africa", "ASIA.csproj", "none"))), (k % 3).cast("int"))
    old = suppliers.select(id_.alias("from_id"), F.concat(F.lit("dotnet-build:./src/"), target).alias("to_id"), F.lit("Invokes").alias("kind"), scope)
    old = old.union(suppliers.select(id_, F.concat(F.lit("AFRICA.NATION_"), (k % 25).cast("string")), F.lit("References"), scope))
    old = old.union(spark.createDataFrame([("T:script/0", "N:r0", "Invokes", "IntraProject")], "from_id string, to_id string, kind string, scope string"))
    return g.nodes(spark, d).unionByName(scripts), old


@query(SCRIPTS + "SELECT *, 'CrossProject' AS scope FROM xl")
def xlang_detect(spark, d):
    return crosslang.detect(*with_scripts(spark, d))


@query(SCRIPTS + "SELECT from_id, to_id, kind, 'IntraProject' AS scope FROM old UNION ALL SELECT *, 'CrossProject' FROM xl")
def xlang_enrich(spark, d):
    nodes, edges = with_scripts(spark, d)
    return ingest.enrich(edges, crosslang.detect(nodes, edges))


# -- artifact files ------------------------------------------------------------------------------

def parsed(through, spark: SparkSession, d: str, path: str, lines: list[str]) -> DataFrame:
    """What parsers.parse(), or another way `through` a parser, makes of one file for each supplier: {k} in its path and lines is the supplier's key, {m} the key modulo 3."""
    k = F.col("s_suppkey")
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), k.cast("string")), F.lit("{m}"), (k % 3).cast("string"))
    made = g.table(spark, d, "supplier").select(filled(path).alias("path"), filled("\n".join(lines) + "\n").alias("text"))
    return through(made, "/r").select("row", "id", "kind", "display_name", "start_line", "end_line", "summary", "remarks", "from_id", "to_id")


def expected(nodes: list[tuple], edges: list[tuple] = ()) -> str:
    """SQL of the rows that parsed() should give, from templates with {k} and {m}: (id, kind, name, start, end, summary, remarks) and (from, to, kind)."""
    def filled(x) -> str:
        if x is None or isinstance(x, int):
            return "NULL" if x is None else str(x)
        return "replace(replace('" + x.replace("'", "''") + "', '{k}', k::VARCHAR), '{m}', (k % 3)::VARCHAR)"

    rows = ["SELECT 'node', " + ", ".join(map(filled, n)) + ", NULL, NULL FROM s" for n in nodes]
    rows += [f"SELECT 'edge', NULL, {filled(kind)}, NULL, NULL, NULL, NULL, NULL, {filled(a)}, {filled(b)} FROM s" for a, b, kind in edges]
    types = {"row": "VARCHAR", "id": "VARCHAR", "kind": "VARCHAR", "display_name": "VARCHAR", "start_line": "INT", "end_line": "INT", "summary": "VARCHAR", "remarks": "VARCHAR", "from_id": "VARCHAR", "to_id": "VARCHAR"}
    return f"WITH s AS (SELECT s_suppkey AS k FROM supplier), x({', '.join(types)}) AS ({' UNION ALL '.join(rows)}) SELECT " + ", ".join(f"{c}::{t} AS {c}" for c, t in types.items()) + " FROM x"


_IMAGE = "T:docker/s{k}/Dockerfile::Stage/"


@query(expected(
    [(_IMAGE + "base", "DockerStage", "Stage: base", 1, 4, None, None), (_IMAGE + "1", "DockerStage", "Stage: 1", 5, 9, None, None),
     (_IMAGE + "base::Instruction/2_WORKDIR", "DockerInstruction", "WORKDIR /src/{k}", 2, 2, None, None), (_IMAGE + "base::Instruction/3_RUN", "DockerInstruction", "RUN dotnet restore  && dotnet build {m}", 3, 3, None, None),
     (_IMAGE + "1::Instruction/6_COPY", "DockerInstruction", "COPY --from=BASE /src/{k} /app", 6, 6, "COPY --from=BASE /src/{k} /app", None), (_IMAGE + "1::Instruction/7_EXPOSE", "DockerInstruction", "EXPOSE 808{m}", 7, 7, None, None),
     (_IMAGE + "1::Instruction/9_ENTRYPOINT", "DockerInstruction", "ENTRYPOINT [\"p\", \"--name-of-{m}\", \"a-rather-long-argument-that-has-to-be-...", 9, 9, None, None)],
    [*((_IMAGE + x.split("::")[0], _IMAGE + x, "Contains") for x in ("base::Instruction/2_WORKDIR", "base::Instruction/3_RUN", "1::Instruction/6_COPY", "1::Instruction/7_EXPOSE", "1::Instruction/9_ENTRYPOINT")),
     (_IMAGE + "1", _IMAGE + "base", "DependsOn"), (_IMAGE + "base::Instruction/3_RUN", "T:tool/dotnet/restore", "Invokes"), (_IMAGE + "base::Instruction/3_RUN", "T:tool/dotnet/build", "Invokes")],
), graph_sql=False)
def dockerfile_parse(spark, d, through=parsers.parse):
    return parsed(through, spark, d, "/r/s{k}/Dockerfile", ["FROM sdk:{k} AS base", "WORKDIR /src/{k}", "RUN dotnet restore \\", "  && dotnet build {m}", "from run:{m}", "COPY --from=BASE /src/{k} /app", "EXPOSE 808{m}", "# last", 'ENTRYPOINT ["p", "--name-of-{m}", "a-rather-long-argument-that-has-to-be-cut"]'])


_SH = "T:script/sh/s{k}/go.sh"


@query(expected(
    [(_SH, "Script", "go.sh", 1, 10, "Builds {k}.", "#!/usr/bin/env bash"), (_SH + "::Function/build{m}", "ScriptFunction", "build{m}()", 4, 7, None, None)],
    [(_SH, _SH + "::Function/build{m}", "Contains"), (_SH, "T:tool/dotnet/test", "Invokes"), (_SH, "T:script/sh/s{k}/lib/a{m}.sh", "Imports"), (_SH, "T:script/sh/s{k}/lib/a{m}.sh", "Invokes"), (_SH, "T:script/sh/s{k}/run{k}.sh", "Invokes")],
), graph_sql=False)
def shell_parse(spark, d, through=parsers.parse):
    return parsed(through, spark, d, "/r/s{k}/go.sh", ["#!/usr/bin/env bash", "# Builds {k}.", "echo", "build{m}() {", '  echo "${x}"', "  dotnet test p{k}", "}", "", "source ./lib/a{m}.sh", "true && ./run{k}.sh --fast"])


_PS = "T:script/ps1/s{k}/go.ps1"


@query(expected(
    [(_PS, "Script", "go.ps1", 1, 14, "Ships {k} at once", None), (_PS + "::Function/Send-P{m}", "ScriptFunction", "Send-P{m}", 9, 13, None, None),
     (_PS + "::Function/Send-P{m}::Param/Path", "ScriptParameter", "Path", 9, 9, "Mandatory parameter", None), (_PS + "::Function/Send-P{m}::Param/Times", "ScriptParameter", "Times", 9, 9, None, None)],
    [(_PS, "T:module/Pester{m}", "Imports"), (_PS, "T:script/ps1/./lib/b{k}.ps1", "Imports"), (_PS, "T:tool/dotnet/publish", "Invokes"), (_PS, "T:System.IO.Path", "References"), (_PS, _PS + "::Function/Send-P{m}", "Contains"),
     (_PS + "::Function/Send-P{m}", _PS + "::Function/Send-P{m}::Param/Path", "Contains"), (_PS + "::Function/Send-P{m}", _PS + "::Function/Send-P{m}::Param/Times", "Contains")],
), graph_sql=False)
def powershell_parse(spark, d, through=parsers.parse):
    return parsed(through, spark, d, "/r/s{k}/go.ps1", ["<#", ".SYNOPSIS", "Ships {k}", "  at once", ".NOTES", "#>", "#Requires -Modules Pester{m}", ". .\\lib\\b{k}.ps1", "function Send-P{m} {", " param([Parameter(Mandatory = $true)][string]$Path, [int]$Times = 3)", " & dotnet Publish p{k}", " [System.IO.Path]::GetFullPath('x')", "}"])


@query(expected(
    [("T:msbuild-target/b{k}.targets/Pack", "BuildTarget", "Pack", 3, 3, "MSBuild target 'Pack'", None), ("T:msbuild-prop/b{k}.targets/V{m}", "BuildProperty", "V{m}", 2, 2, "MSBuild property 'V{m}' = {k}", "Condition: c{m}"), ("T:msbuild-task/b{k}.targets/T{k}", "BuildTask", "T{k}", 4, 4, "MSBuild task 'T{k}' from f.dll", None)],
    [*(("T:msbuild-target/b{k}.targets/Pack", f"T:msbuild-target/b{{k}}.targets/{x}", "DependsOn") for x in ("A", "B{m}", "C")), ("T:msbuild-task/b{k}.targets/T{k}", "T:assembly/f.dll", "References")],
), graph_sql=False)
def msbuild_parse(spark, d, through=parsers.parse):
    return parsed(through, spark, d, "/r/b{k}.targets", ['<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003">', '<PropertyGroup><V{m} Condition="c{m}">{k}</V{m}></PropertyGroup>', '<Target Name="Pack" DependsOnTargets="A; B{m};" AfterTargets="C"/>', '<UsingTask TaskName="T{k}" AssemblyFile="f.dll"/>', "</Project>"])


@query(expected([("T:dotnet-tool/t{k}", "Tool", "t{k}", 2, 2, "dotnet tool v1.{m}.{k}; commands: run{k}, x", None), ("T:dotnet-tool/bare{m}", "Tool", "bare{m}", 3, 3, "dotnet tool vunknown; commands: (none)", None)]), graph_sql=False)
def dotnet_tools_parse(spark, d, through=parsers.parse):
    return parsed(through, spark, d, "/r/s{k}/dotnet-tools.json", ['{"version": 1, "tools": {', '"t{k}": {"version": "1.{m}.{k}", "commands": ["run{k}", "x"]},', '"bare{m}": {}}}'])


_CI = "T:ci/github/c{k}.yml"


@query(expected(
    [(_CI, "CIWorkflow", "CI {k}", 1, 1, "Triggers: push, pull_request", None), (_CI + "::Job/build", "CIJob", "build", 4, 4, None, "runs-on: host{m}"), (_CI + "::Job/ship", "CIJob", "Ship it", 9, 9, None, None),
     (_CI + "::Job/build::Step/0_get_it@v{m}", "CIStep", "get/it@v{m}", 7, 7, None, None), (_CI + "::Job/build::Step/1_Make_{k}", "CIStep", "Make {k}", 8, 8, None, None)],
    [(_CI, _CI + "::Job/build", "Contains"), (_CI, _CI + "::Job/ship", "Contains"), (_CI + "::Job/ship", _CI + "::Job/build", "DependsOn"), (_CI + "::Job/build", _CI + "::Job/build::Step/0_get_it@v{m}", "Contains"), (_CI + "::Job/build", _CI + "::Job/build::Step/1_Make_{k}", "Contains"),
     (_CI + "::Job/build::Step/0_get_it@v{m}", "T:ci/action/get/it@v{m}", "Invokes"), (_CI + "::Job/build::Step/1_Make_{k}", "T:ci/cmd/dotnet build", "Invokes"), (_CI + "::Job/build::Step/1_Make_{k}", "T:ci/cmd/dotnet test", "Invokes")],
), graph_sql=False)
def workflow_parse(spark, d, through=parsers.parse):
    """Needs a YAML reader on the executors."""
    return parsed(through, spark, d, "/r/.github/workflows/c{k}.yml", ["name: CI {k}", "on: [push, pull_request]", "jobs:", "  build:", "    runs-on: host{m}", "    steps:", "    - uses: get/it@v{m}", "    - {name: Make {k}, run: 'dotnet build && dotnet test; dotnet build'}", "  ship:", "    name: Ship it", "    needs: build"])


_AZ = "T:ci/azure/azure-pipelines.yml"


@query(expected(
    [(_AZ, "CIWorkflow", "azure-pipelines.yml", 1, 1, "Triggers: main{k}", None), (_AZ + "::Job/J{k}", "CIJob", "Job {m}", 3, 3, None, None), (_AZ + "::Job/J{k}::Step/0_T{k}@1", "CIStep", "T{k}@1", 7, 7, None, None)],
    [(_AZ, _AZ + "::Job/J{k}", "Contains"), (_AZ + "::Job/J{k}", _AZ + "::Job/A{m}", "DependsOn"), (_AZ + "::Job/J{k}", _AZ + "::Job/J{k}::Step/0_T{k}@1", "Contains"), (_AZ + "::Job/J{k}::Step/0_T{k}@1", "T:ci/task/T{k}@1", "Invokes")],
), graph_sql=False)
def pipeline_file_parse(spark, d, through=parsers.parse):
    """Needs a YAML reader on the executors."""
    return parsed(through, spark, d, "/r/s{k}/azure-pipelines.yml", ["trigger: [main{k}]", "jobs:", "- job: J{k}", "  displayName: Job {m}", "  dependsOn: [A{m}]", "  steps:", "  - task: T{k}@1"])


@query("""SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'About ' || s_name WHEN 1 THEN '[Parse warning] About ' || s_name WHEN 2 THEN '[Parse warning] <summary>' || s_name END AS summary,
CASE WHEN s_suppkey % 4 < 2 THEN 'p' || s_suppkey || '=the ' || s_nationkey ELSE '' END AS params, CASE WHEN s_suppkey % 4 = 0 THEN 'T:N' || s_nationkey ELSE '' END AS see FROM supplier""", graph_sql=False)
def xmldoc_parse(spark, d):
    k, text_ = F.col("s_suppkey"), lambda c: F.col(c).cast("string")
    body = F.concat(F.lit("<summary>About\n   "), "s_name", F.lit("</summary><param name='p"), text_("s_suppkey"), F.lit("'>the "), text_("s_nationkey"), F.lit("</param>"))
    see = F.concat(F.lit("<seealso cref='T:N"), text_("s_nationkey"), F.lit("'/>"))
    xml = F.when(k % 4 == 0, F.concat(F.lit("<member>"), body, see, F.lit("</member>"))).when(k % 4 == 1, body).when(k % 4 == 2, F.concat(F.lit("<summary>"), "s_name"))
    found = g.table(spark, d, "supplier").select(k.alias("k"), xml.alias("xml")).select("k", parsers.xml_docs(F.col("xml")).alias("docs"))
    pairs = F.transform(F.map_entries("docs.params"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("k", "docs.summary", F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("params"), F.coalesce(F.array_join("docs.see_also", ","), F.lit("")).alias("see"))


def lateral(function: str):
    """A way through a parser: its table function, called in SQL for each row of the files."""
    def through(files: DataFrame, base: str) -> DataFrame:
        table_functions.register(files.sparkSession)
        return files.sparkSession.sql(f"SELECT r.* FROM {{files}} f, LATERAL {function}(f.path, f.text, '{base}') r", files=files)

    return through


def in_sql(name: str, function: str) -> None:
    """Registers a parser's query once more, by its table function."""
    first = QUERIES[name]
    QUERIES[f"{name}_in_sql"] = lambda spark, d: first(spark, d, lateral(function))
    ORACLE[f"{name}_in_sql"] = ORACLE[name]


for _name, _function in (("dockerfile_parse", "parse_dockerfile"), ("shell_parse", "parse_shell"), ("powershell_parse", "parse_powershell"), ("msbuild_parse", "parse_msbuild"), ("dotnet_tools_parse", "parse_dotnet_tools"), ("workflow_parse", "parse_workflow"), ("pipeline_file_parse", "parse_pipeline")):
    in_sql(_name, _function)


# -- governance ----------------------------------------------------------------------------------

PHRASE = "CASE doc_id % 7 WHEN 0 THEN ' Ignore  previous instruction' WHEN 1 THEN ' YOU ARE NOW' WHEN 2 THEN ' the System Prompt' WHEN 3 THEN ' forget everything, act as me' WHEN 4 THEN ' disregard this' ELSE '' END"
MARKED = f"text || {PHRASE}"
for _p in (r"ignore\s+previous\s+instructions?", r"you\s+are\s+now\b", r"\bsystem\s+prompt\b", r"forget\s+everything", r"\bact\s+as\b", r"\bdisregard\b"):
    MARKED = f"regexp_replace({MARKED}, '({_p})', '[SUSPICIOUS: \\1]', 'gi')"


def phrased() -> F.Column:
    k = F.col("doc_id") % 7
    phrases = [" Ignore  previous instruction", " YOU ARE NOW", " the System Prompt", " forget everything, act as me", " disregard this"]
    out = F.lit("")
    for i, p in enumerate(phrases):
        out = F.when(k == i, p).otherwise(out)
    return F.concat("text", out)


@query(f"SELECT doc_id, {MARKED} AS sanitized, {MARKED} <> text || {PHRASE} AS warning FROM documents", graph_sql=False)
def injection_scan(spark, d):
    docs = g.table(spark, d, "documents")
    return docs.select("doc_id", text.marked(phrased()).alias("sanitized"), text.is_suspicious(phrased()).alias("warning"))


@query("SELECT event_id, 'user(' || length(user_id::VARCHAR) || '), type(' || length(event_type) || ')' AS summary, regexp_replace(regexp_replace(props || event_type, 'PURCHASE', '[REDACTED]', 'gi'), '\\d+', '[REDACTED]', 'g') AS redacted FROM events", graph_sql=False)
def audit_redaction(spark, d):
    arguments = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    return g.table(spark, d, "events").select("event_id", govern.input_summary(arguments).alias("summary"), text.redacted(F.concat("props", "event_type"), ["PURCHASE", r"\d+"]).alias("redacted"))


@query("""SELECT event_id, place, place <= 3 AS accepted, CASE WHEN place > 3 THEN (w + 3600000000 - us) // 1000 END AS retry_after_ms FROM (SELECT event_id, us, us - us % 3600000000 AS w, row_number() OVER (PARTITION BY user_id, us - us % 3600000000 ORDER BY ts, event_id) AS place
FROM (SELECT *, epoch_us(ts) AS us FROM events))""", graph_sql=False)
def rate_limit_fixed_window(spark, d):
    calls = g.table(spark, d, "events").select("event_id", "ts", "user_id")
    return govern.fixed_window(calls, limit=3, seconds=3600, keys=("user_id",), time="ts").select("event_id", "place", "accepted", "retry_after_ms")


@query("SELECT id, path, regexp_matches(lower(path), '^(asia|brand#1[0-9])/.*\\.cs$') AND NOT regexp_matches(lower(path), '/f7\\.cs$') AS allowed FROM g_nodes WHERE path IS NOT NULL")
def path_allowlist(spark, d):
    nodes = g.nodes(spark, d).where("span is not null").select("id", F.col("span.file_path").alias("path"))
    return nodes.withColumn("allowed", govern.allowed(F.col("path"), ["asia/**/*.cs", "Brand#1?/*.cs"], deny=["**/f7.cs"]))


@query(r"SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::BIGINT AS links, coalesce(array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' '), '') AS targets FROM pages", graph_sql=False)
def parse_html_refs(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return g.table(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("links"), F.array_join(found, " ").alias("targets"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1", graph_sql=False)
def parse_json_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return g.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search over the demo graph."""
    return search_bm25(spark, sf_dir)


from . import ingestion  # noqa: E402, F401  registers its queries, which use what is defined here

import pytest
from graphs import doc, edges, ids, node, nodes

from lodestar.operators import coverage, graph, search, solution


@pytest.fixture(scope="module")
def corpus(spark):
    return nodes(
        spark,
        node("M:GetSymbol", name="GetSymbol"),
        node("M:Unrelated", name="Unrelated", docs=doc("GetSymbol is used here")),
        node("M:GetReferences", name="GetReferences"),
        node("T:XMLParser", "Type", name="XMLParser"),
        node("T:Stub", "Type", name="GetSymbol", node_kind="Stub"),
        node("M:Other", name="getSymbol", project="Q"),
    )


def test_names_rank_over_docs(corpus):
    got = [r.id for r in search.search(corpus, "GetSymbol").collect()]
    assert got[0] in ("M:GetSymbol", "M:Other") and "T:Stub" not in got and got.index("M:GetSymbol") < got.index("M:Unrelated")


def test_camel_parts_and_acronyms_match(corpus):
    assert "M:GetReferences" in ids(search.search(corpus, "references"))
    assert ids(search.search(corpus, "XML")) == ["T:XMLParser"]
    assert search.search(corpus, "nothinglikethis").count() == 0
    assert search.query_tokens("MyApp.Services.AuthService XMLParser75") == ["myapp.services.authservice", "my", "app.services.auth", "service", "xmlparser75", "xml", "parser75"]


def test_project_filter_kind_and_paging(corpus):
    assert ids(search.search(corpus, "getSymbol", project="Q")) == ["M:Other"]
    assert search.search(corpus, "GetSymbol", kind="type").count() == 0
    assert search.search(corpus, "*").count() == 5 and search.search(corpus, "*", offset=4, limit=9).count() == 1
    assert search.search(corpus, "GetSymbol", offset=50).count() == 0
    assert ids(search.substring_search(corpus, "USED here")) == ["M:Unrelated"]


def test_statistics_of_nodes_are_those_of_the_index(corpus):
    index = search.postings(corpus)
    key = lambda df: sorted(tuple(r) for r in df.select("field", "documents", "average_length").collect())
    assert key(search.node_statistics(corpus)) == key(search.statistics(index, corpus))
    assert search.search(corpus, "getSymbol used", index=index).collect() == search.search(corpus, "getSymbol used").collect()


def test_kind_comes_after_the_top_fifty(spark):
    many = nodes(spark, *[node(f"M:{i:03}", name="word") for i in range(60)], node("T:zz", "Type", name="word filler filler filler"))
    assert search.search(many, "word", kind="Type").count() == 0 and search.search(many, "word", limit=100).count() == 50


def test_lengths_as_bytes_keep_few_digits(spark):
    from pyspark.sql import functions as F

    got = [r.x for r in spark.range(1, 41).select(search.byte315(F.col("id").cast("int")).alias("x")).collect()]
    assert got[0] == 1 and got == sorted(got) and len(set(got)) < 12 and all(abs(x - i) / i < 0.6 for i, x in enumerate(got, 1))


def test_lookup(spark):
    n = nodes(spark, node("T:A", "Type"), node("M:A.x"), node("M:A.y"), node("T:S", "Type", node_kind="Stub"), node("M:dup1", fqn="Same"), node("M:dup2", fqn="Same", project="Q"))
    e = edges(spark, ("T:A", "M:A.x", "Contains"), ("T:A", "M:A.y", "Contains"), ("T:B", "M:A.x", "Contains"), ("M:A.x", "M:A.x", "Calls"), ("M:A.x", "T:S", "References"), ("M:A.y", "T:A", "Implements"))
    row = graph.details(n, e, "M:A.x").first()
    assert (row.parent_id, row.child_ids, row.related_ids) == ("T:B", [], ["M:A.x", "T:S"])
    assert graph.details(n, e).where("id = 'T:A'").first().child_ids == ["M:A.x", "M:A.y"]
    assert graph.details(n, e, "T:S").count() == 0
    refs = [(r.direction, r.kind, r.to_project) for r in graph.references(n, e, "M:A.x").collect()]
    assert sorted(refs) == [("incoming", "Calls", "P"), ("incoming", "Contains", "P"), ("incoming", "Contains", "P"), ("outgoing", "Calls", "P"), ("outgoing", "References", None)]
    page = graph.references(n, e, "M:A.x", offset=1, limit=2).collect()
    assert [r.direction for r in page] == ["outgoing", "incoming"]
    assert graph.references(n, e, "T:S").count() == 1
    assert ids(graph.implementations(n, e, "T:A")) == ["M:A.y"]
    assert graph.resolve_fqn(n, "Same").first().status == "ambiguous" and graph.resolve_fqn(n, "T:A").first().id == "T:A" and graph.resolve_fqn(n, "T:S").first().status == "none"


def projects(spark, *pairs):
    return spark.createDataFrame(list(pairs), "from_project string, to_project string")


def names(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "name string")


def test_closures_levels_and_cycles(spark):
    diamond = projects(spark, ("A", "B"), ("a", "C"), ("B", "D"), ("C", "d"))
    assert ids(graph.dirty_set(diamond, names(spark, "D")), "name") == ["a", "b", "c", "d"]
    assert ids(graph.dirty_set(diamond, names(spark, "B", "X")), "name") == ["a", "b", "x"]
    levels = {r.name: r.level for r in graph.topological_levels(names(spark, "A", "B", "C", "D"), diamond).collect()}
    assert levels == {"d": 0, "b": 1, "c": 1, "a": 2}
    ring = projects(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"))
    assert ids(graph.dirty_set(ring, names(spark, "b")), "name") == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        graph.topological_levels(names(spark, "a", "b", "c", "d"), ring)
    assert ids(graph.cyclic(ring), "name") == ["a", "b", "c"] and graph.cyclic(diamond).count() == 0
    assert graph.cycles([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]) == [["a", "b", "c", "a"]]
    assert graph.cycles([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d")]) == [] and graph.cycles([("a", "a")]) == [["a", "a"]]


def test_coverage(spark):
    n = nodes(spark, node("M:A.B.x", docs=doc("d")), node("M:A.B.y"), node("M:z", "Field", access="Protected", docs=doc("d")), node("M:i", access="Internal"), node("N:n", "Namespace"), node("T:S", "Type", node_kind="Stub"))
    row = coverage.overall(n).first()
    assert (row.total, row.documented, row.coverage_percent) == (3, 2, 66.7)
    assert {r.namespace: r.total for r in coverage.by_namespace(n).collect()} == {"M:A.B": 2, "(global)": 1}
    assert {(r.grouping, r.key, r.total) for r in coverage.doc_coverage(n).collect()} == {("project", "P", 3), ("namespace", "M:A.B", 2), ("namespace", "(global)", 1), ("kind", "Method", 2), ("kind", "Field", 1), ("overall", "", 3)}
    empty = coverage.overall(n.limit(0)).first()
    assert (empty.total, empty.coverage_percent) == (0, 0.0)


def test_solution_rollups(spark):
    n = nodes(spark, node("a", project="A"), node("b", project="B"), node("b2", project="B"), node("s", project="S", node_kind="Stub"))
    e = edges(spark, ("a", "b", "Calls", "CrossProject"), ("b", "b2", "Calls", "IntraProject"), ("a", "b", "Calls", "IntraProject"), ("a", "s", "Calls", "CrossProject"))
    assert {r.project: (r.node_count, r.edge_count) for r in solution.projects(n, e).collect()} == {"A": (1, 1), "B": (2, 2)}
    assert [tuple(r) for r in solution.dependency_dag(n, e).collect()] == [("A", ["B"])]
    t = solution.totals(n).first()
    assert (t.real_count, t.stub_count, t.single_project) == (3, 1, False)
    b = nodes(spark, node("a", project="A", returns="int"), node("c", project="C"))
    assert {r.project: r.status for r in solution.project_changes(n, b).collect()} == {"A": "surviving", "B": "removed", "C": "added"}
    assert [(r.project_origin, r.category) for r in solution.inner_diff(n, e.where("scope = 'x'"), b, e.where("scope = 'x'")).collect()] == [("A", "Signature")]
    assert {r.status for r in solution.cross_edge_changes(n, e, b, e.limit(0)).collect()} == {"removed"}


def test_projects_between_cycles_are_on_none(spark):
    pairs = [("A", "b"), ("B", "A"), ("b", "X"), ("X", "C"), ("C", "D"), ("D", "C"), ("D", "E"), ("S", "S"), ("Q", "A")]
    table = spark.createDataFrame(pairs, "from_project string, to_project string")
    assert ids(graph.cyclic(table), "name") == ["a", "b", "c", "d", "s"]
    listed = {}
    for r in graph.cycle_list(table).orderBy("cycle", "place").collect():
        listed.setdefault(r.cycle, []).append(r.name)
    assert sorted(listed.values()) == [["a", "b", "a"], ["c", "d", "c"], ["s", "s"]]
    assert graph.cyclic(table.limit(0)).count() == 0 and graph.cycle_list(table.limit(0)).count() == 0


def test_overlapping_cycles_match_brute_force(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        pairs = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(18)]
        reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
        for _ in range(14):
            for a in reach:
                reach[a] |= set().union(*(reach.get(b, set()) for b in reach[a]))
        assert ids(graph.cyclic(spark.createDataFrame(pairs, "from_project string, to_project string")), "name") == sorted(a for a in reach if a in reach[a])


def test_attributes_opt_out_of_coverage(spark):
    from pyspark.sql import functions as F

    from lodestar.operators import coverage

    tagged = nodes(spark, node("M:a"), node("M:b"), node("M:c")).withColumn("attributes", F.when(F.col("id") == "M:a", F.array(F.lit("ExcludeFromDocCoverageAttribute"))).when(F.col("id") == "M:b", F.array(F.lit("Other"))))
    assert ids(coverage.parity(tagged)) == ["M:b", "M:c"] and coverage.overall(tagged).first().total == 2

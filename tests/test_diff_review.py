import pytest
from graphs import doc, edges, ids, node, nodes, param

from lodestar.operators import diff, review


def changes(spark, before, after, be=(), ae=()):
    return diff.semantic_diff(nodes(spark, *before), edges(spark, *be), nodes(spark, *after), edges(spark, *ae))


def only(df):
    (row,) = df.collect()
    return row


def test_equal_snapshots_have_no_changes(spark):
    rows = [node("T:A", params=[param("a", "int")], docs=doc("s", params={"a": "x", "b": "y"}), limits=[("T", ["class"])])]
    assert changes(spark, rows, rows).count() == 0
    assert only(diff.summary(changes(spark, rows, rows))).total == 0


def test_added_and_removed_are_mirror_images(spark):
    a, b = [node("M:A.x"), node("M:A.y", access="Internal")], [node("M:A.z")]
    there = {(r.id, r.change_type, r.severity) for r in changes(spark, a, b).collect()}
    assert there == {("M:A.x", "Removed", "Breaking"), ("M:A.y", "Removed", "NonBreaking"), ("M:A.z", "Added", "NonBreaking")}
    back = {(r.id, r.change_type) for r in changes(spark, b, a).collect()}
    assert back == {("M:A.x", "Added"), ("M:A.y", "Added"), ("M:A.z", "Removed")}


@pytest.mark.parametrize(
    ("before", "after", "category", "severity", "description"),
    [
        (node("M:A"), node("M:A", returns="int"), "Signature", "Breaking", "Return type changed from 'string' to 'int'."),
        (node("M:A", returns=None), node("M:A", returns="int"), "Signature", "Breaking", "Return type changed from '' to 'int'."),
        (node("M:A"), node("M:A", params=[param("x", "int")]), "Signature", "Breaking", "Parameter signature changed: 1 parameter(s) modified."),
        (node("M:A", params=[param("x", "int")]), node("M:A", params=[param("y", "int")]), "Signature", "Breaking", "Parameter signature changed: 1 parameter(s) modified."),
        (node("M:A", params=[param("x", "int", "1")]), node("M:A", params=[param("x", "int", "2")]), "Signature", "Breaking", "Parameter signature changed: 1 parameter(s) modified."),
        (node("M:A"), node("M:A", returns="string?"), "Nullability", "Breaking", "Nullability changed on return type: 'string' → 'string?'."),
        (node("M:A", params=[param("x", "T")]), node("M:A", params=[param("x", "T?")]), "Nullability", "Breaking", "Nullability changed on parameter type."),
        (node("M:A", access="Internal"), node("M:A"), "Accessibility", "NonBreaking", "Accessibility changed from 'Internal' to 'Public'."),
        (node("M:A"), node("M:A", access="Private"), "Accessibility", "Breaking", "Accessibility changed from 'Public' to 'Private'."),
        (node("M:A", limits=[("T", ["class"])]), node("M:A", limits=[("T", ["new()"])]), "Constraint", "Breaking", "Generic constraints changed for type parameter 'T'."),
        (node("M:A", docs=doc("a")), node("M:A", docs=doc("b")), "DocComment", "Informational", "Documentation comment changed."),
        (node("M:A"), node("M:A", docs=doc("b")), "DocComment", "Informational", "Documentation comment changed."),
    ],
)
def test_single_changes(spark, before, after, category, severity, description):
    row = only(changes(spark, [before], [after]))
    assert (row.category, row.severity, row.description, row.change_type) == (category, severity, description, "Modified")


def test_order_of_maps_is_no_change_but_order_of_lists_is(spark):
    a = node("M:A", docs=doc("s", params={"a": "1", "b": "2"}, examples=["x", "y"]))
    assert changes(spark, [a], [node("M:A", docs=doc("s", params={"b": "2", "a": "1"}, examples=["x", "y"]))]).count() == 0
    assert changes(spark, [a], [node("M:A", docs=doc("s", params={"a": "1", "b": "2"}, examples=["y", "x"]))]).count() == 1


def test_several_type_parameters_give_a_change_each(spark):
    got = changes(spark, [node("M:A", limits=[("T", ["class"]), ("U", ["struct"])])], [node("M:A", limits=[("U", []), ("V", ["new()"])])]).collect()
    assert {(r.type_parameter, tuple(r.removed), tuple(r.added)) for r in got} == {("T", ("class",), ()), ("U", ("struct",), ()), ("V", (), ("new()",))}


def test_dependencies_are_multisets_of_kinds(spark):
    rows = [node("M:A"), node("M:B")]
    be = [("M:A", "M:B", "Calls"), ("M:A", "M:B", "References"), ("M:A", "M:B", "References"), ("M:A", "X", "Calls")]
    ae = [("M:A", "M:B", "Calls"), ("M:A", "M:B", "References"), ("M:A", "X", "Returns")]
    row = only(changes(spark, rows, rows, be, ae))
    assert sorted(map(tuple, row.removed_edges)) == [("M:B", "References"), ("X", "Calls")]
    assert sorted(map(tuple, row.added_edges)) == [("X", "Returns")]
    assert row.description == "Dependency edges changed: 2 removed, 1 added."


def test_parent_is_of_the_side_that_has_the_symbol(spark):
    got = {r.id: r.parent_id for r in changes(spark, [node("M:x"), node("M:z")], [node("M:y"), node("M:z", returns="int")], [("T:Old", "M:x", "Contains"), ("T:Old", "M:z", "Contains")], [("T:New", "M:y", "Contains"), ("T:Old", "M:z", "Contains")]).collect()}
    assert got == {"M:x": "T:Old", "M:y": "T:New", "M:z": "T:Old"}


def test_results_do_not_depend_on_partitions(spark):
    a = [node(f"M:{i}", returns=f"t{i % 3}", access=["Public", "Internal"][i % 2]) for i in range(40)]
    b = [node(f"M:{i}", returns=f"t{i % 4}", docs=doc("d") if i % 5 == 0 else None) for i in range(3, 43)]
    none = edges(spark, ("x", "y", "Calls"))
    got = [sorted(map(str, diff.semantic_diff(nodes(spark, *a).repartition(n), none, nodes(spark, *b).repartition(n), none).collect())) for n in (1, 7, 31)]
    assert got[0] == got[1] == got[2]


def test_graph_diff_finds_renames_once(spark):
    a = nodes(spark, node("T:Old"), node("T:Gone"), node("T:Same", docs=doc("x")))
    b = nodes(spark, node("T:New", previous=["T:Never", "T:Old"]), node("T:Other", previous=["T:Old"]), node("T:Same", access="Internal", docs=doc("y")))
    got = {r.id: (r.change, r.summary) for r in diff.graph_diff(a, b).collect()}
    assert got == {
        "T:New": ("Modified", "renamed from T:Old"),
        "T:Other": ("Added", "symbol added"),
        "T:Gone": ("Removed", "symbol removed"),
        "T:Same": ("Modified", "accessibility: Public → Internal; doc changed"),
    }


def test_unusual_patterns(spark):
    before = [node(f"M:T.{i}", access="Internal") for i in range(6)] + [node("M:n"), node("M:w", access="Private"), node("M:c", limits=[("T", ["class"])])]
    after = [node(f"M:T.{i}", access="Internal", returns="int") for i in range(6)] + [node("M:n", returns="string?"), node("M:w", access="Protected"), node("M:c", limits=[("T", [])])]
    inside = [("T:T", f"M:T.{i}", "Contains") for i in range(6)]
    got = review.unusual(changes(spark, before, after, inside, inside)).collect()
    assert {(r.kind, r.id) for r in got} == {("MassSignatureChange", "T:T"), ("NullabilityRegression", "M:n"), ("AccessibilityWidening", "M:w"), ("ConstraintRemoval", "M:c")}
    assert next(r.description for r in got if r.id == "T:T") == "Type 'T:T' has 6 signature changes, exceeding the threshold of 5."


def test_findings_filter_escalate_and_sum_up(spark):
    before = [node("M:d", docs=doc("a")), node("M:w", access="Private"), node("M:i", access="Internal")]
    after = [node("M:d", docs=doc("b")), node("M:w", access="Internal"), node("M:i", access="Internal", returns="int")]
    c = changes(spark, before, after)
    assert {(r.id, r.severity) for r in review.findings(c).collect()} == {("M:w", "Warning"), ("M:i", "Info")}
    assert ids(review.findings(c, verbose=True)) == ["M:d", "M:i", "M:w"]
    s = only(review.review_summary(c))
    assert (s.breaking, s.warning, s.info, s.trivial_filtered, s.overall_risk) == (0, 1, 1, 1, "medium")
    assert [r.id for r in review.in_order(review.findings(c)).collect()] == ["M:w", "M:i"]


def test_impact_and_explanations(spark):
    c = changes(spark, [node("M:x.f"), node("M:y")], [node("M:x.f", returns="int"), node("M:y")])
    after = edges(spark, ("M:y", "M:x.f", "Calls"), ("M:z", "M:x.f", "References"), ("M:y", "M:x.f", "Calls"))
    assert only(review.impact(review.findings(c), after)).impact_scope == ["M:y", "M:y", "M:z"]
    row = only(review.explain(c, after, "M:x.f"))
    assert row.callers == ["M:y", "M:y"] and row.caller_count == 2 and row.severity == "breaking"
    assert row.why_it_matters == "This Return type changed from 'string' to 'int'. Any caller will fail to compile."
    assert only(review.breaking(c)).display_name == "f"
    assert review.explain(c, after, "M:y").count() == 0


def test_of_repeated_ids_the_greatest_row_counts(spark):
    small, great = node("M:A", returns="int"), node("M:A", returns="string")
    for before in ([small, great], [great, small]):
        assert changes(spark, before, [great]).count() == 0
        assert only(changes(spark, before, [small])).description == "Return type changed from 'string' to 'int'."


def test_a_mass_change_marks_its_parent_once(spark):
    before = [node("T:A", "Type"), *(node(f"M:A.{i}") for i in range(7))]
    after = [node("T:A", "Type"), *(node(f"M:A.{i}", returns="int") for i in range(7))]
    own = [("T:A", f"M:A.{i}", "Contains") for i in range(7)]
    made = changes(spark, before, after, own, own)
    odd = only(review.unusual(made))
    assert (odd.kind, odd.id) == ("MassSignatureChange", "T:A") and "7 signature changes" in odd.description and odd.remediation
    assert {r.severity for r in review.findings(made).collect()} == {"Breaking"}


def test_diff_shuffles_each_edge_once_and_filters_reach_the_inputs(spark, tmp_path):
    """Both sides meet in one exchange by id; a filter on id is applied before it, so one symbol's changes need not deal all."""
    made = [nodes(spark, node("a", returns="int"), node("b")), edges(spark, ("a", "b", "Calls")), nodes(spark, node("a"), node("c")), edges(spark, ("a", "c", "Calls"))]
    tables = []
    for k, df in enumerate(made):
        df.write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    changes = diff.semantic_diff(*tables)
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan
    one = changes.where("id = 'a'")
    assert sorted((r.category, r.change_type) for r in one.collect()) == [("Dependency", "Modified"), ("Signature", "Modified")]
    scans = one._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1:]
    assert scans and all("EqualTo(id,a)" in x or "EqualTo(from_id,a)" in x or "EqualTo(to_id,a)" in x for x in scans)


def test_null_ids_of_two_sides_stay_apart(spark):
    first, second = (nodes(spark, node("a")).withColumn("id", diff.F.lit(None).cast("string")) for _ in range(2))
    none = edges(spark, ("a", "b", "Calls")).limit(0)
    assert sorted(r.change_type for r in diff.semantic_diff(first, none, second, none).collect()) == ["Added", "Removed"]

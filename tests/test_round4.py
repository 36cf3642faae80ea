"""Steps that large tables ask for: rows hashed once, nothing kept that one pass gives, edges dealt once."""

import random

import pytest
from graphs import doc, edges, node, nodes, param
from pyspark.sql import functions as F

from lodestar.operators import blockmax, diff, graph, ingest, review, solution


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_is_hashed_once(spark):
    made = ingest.content_hash(nodes(spark, node("M:A")), edges(spark, ("a", "b", "Calls")))
    # one of each table's rows, one of the text of their sums
    assert plan(made).count("sha2(") == 3


def test_every_row_and_repeat_counts_in_the_digest(spark):
    rows = [("a", "b", "Calls"), ("a", "c", "Calls"), ("b", "c", "Inherits")]
    told = lambda *r: ingest.hashed(edges(spark, *r)).agg(*ingest.digest()).first()
    assert told(*rows) == told(*rows[::-1])
    assert len({tuple(told(*r)) for r in (rows, rows[:2], [*rows, rows[0]], [*rows, rows[1]], [("a", "b", "Uses"), *rows[1:]])}) == 5


def test_an_index_keeps_its_places_only(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(blockmax, "stored", lambda df, of=blockmax.stored: kept.append(df) or of(df))
    index = blockmax.build(nodes(spark, node("M:B", name="RedRed", docs=doc("red x red y red")), node("M:A", name="x", docs=None)))
    found = {(r.field, r.term, r.id): (r.tf, r.length) for r in index.postings().collect() if r.field == "doc"}
    assert found == {("doc", "red", "M:B"): (3, 5), ("doc", "x", "M:B"): (1, 5), ("doc", "y", "M:B"): (1, 5)}
    assert len(kept) == 1


def two_sides(spark):
    rng = random.Random(4)
    pick = lambda xs: rng.choice(xs)

    def side():
        made = [node(f"M:N.m{i}", access=pick(["Public", "Internal", "Private"]), returns=pick(["string", "string?", "int"]), params=pick([[], [param("a", "int")]]), limits=pick([[], [("T", ["class"])]]), docs=pick([None, doc("s")])) for i in range(40) if rng.random() < 0.9]
        links = [("M:N.m0", f"M:N.m{i}", "Contains") for i in range(1, 12)] + [(f"M:N.m{rng.randrange(40)}", f"M:N.m{rng.randrange(40)}", "Calls") for _ in range(60)]
        return nodes(spark, *made), edges(spark, *links)

    return *side(), *side()


@pytest.mark.parametrize("category", ["Signature", "Nullability", "Constraint", "Accessibility", "Dependency", "DocComment"])
def test_a_category_alone_is_what_a_filter_leaves(spark, category):
    sides = two_sides(spark)
    only = diff.semantic_diff(*sides, categories=[category])
    want = diff.semantic_diff(*sides).where(F.col("category") == category)
    assert sorted(map(repr, only.collect())) == sorted(map(repr, want.collect()))
    # edges are compared for dependencies alone
    assert ("collect_list" in plan(only)) == (category == "Dependency")


def test_findings_mark_what_unusual_names_and_keep_nothing(spark, monkeypatch):
    changes = diff.semantic_diff(*two_sides(spark)).localCheckpoint()
    odd = {r.id for r in review.unusual(changes).collect()}
    monkeypatch.setattr(type(changes), "checkpoint", None)
    found, all_ = review.findings(changes).collect(), changes.collect()
    assert odd and any(k.kind == "MassSignatureChange" for k in review.unusual(changes).collect())
    tier = lambda r: "Breaking" if r.severity == "Breaking" else "Warning" if r.severity == "NonBreaking" and r.id in odd else "Info"
    want = sorted((r.id, tier(r), r.category, r.description) for r in all_ if r.category != "DocComment")
    assert sorted((r.id, r.severity, r.category, r.description) for r in found) == want
    total = review.review_summary(changes).first()
    assert (total.breaking, total.warning, total.info) == tuple(sum(t == s for _, t, _, _ in want) for s in ("Breaking", "Warning", "Info"))
    assert total.trivial_filtered == len(all_) - len(want)


def test_cross_edges_cancel_as_their_names_do(spark):
    rng = random.Random(9)
    names, projects = ["a", "b", ":c", "x::c", "c", None], ["P", "P:", "P::x", None, "Q"]

    def side():
        made = nodes(spark, *(node(i or "", project=rng.choice(projects), node_kind=rng.choice(["Real", "Real", "Stub"])) for i in names * 2 if i))
        return made, spark.createDataFrame([(rng.choice(names), rng.choice(names), rng.choice(["Calls", "Uses"]), rng.choice(["CrossProject", "CrossProject", "External"])) for _ in range(60)], "from_id string, to_id string, kind string, scope string")

    for _ in range(4):
        (an, ae), (bn, be) = side(), side()
        a, b = ({tuple(r) for r in solution.cross_edges(*s).collect()} for s in ((an, ae), (bn, be)))
        open_ = lambda r: None in r
        want = {(*r, "added") for r in b if r not in a or open_(r)} | {(*r, "removed") for r in a if r not in b or open_(r)}
        got = solution.cross_edge_changes(an, ae, bn, be)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "LeftAnti" not in plan(got)


def test_first_ends_are_sorted_once_and_equal_whole_lists(spark):
    rng = random.Random(5)
    names = [f"M:{i}" for i in range(9)]
    rows = [(rng.choice(names), rng.choice(names), rng.choice(("Contains", "Contains", "Calls", "Inherits"))) for _ in range(120)]
    n = nodes(spark, *(node(x) for x in [*names, "M:0", "M:alone"]), node("M:stub", node_kind="Stub"))
    e = edges(spark, *rows, ("M:stub", "M:1", "Calls"))
    whole = graph.details(n, e)
    for id_ in (None, "M:1"):
        want = [(r.id, r.parent_id, r.child_ids[:3], r.related_ids[:3], len(r.child_ids), len(r.related_ids)) for r in whole.collect() if id_ in (None, r.id)]
        assert sorted(map(tuple, graph.details(n, e, id_, most=3).collect())) == sorted(want)
    text = plan(graph.details(n, e, most=3))
    # one order of all ends, and the edges are read once
    assert text.count("Window [") == 1 and text.count("inline(") == 1 and "Union" not in text

"""Steps that larger tables ask for: an input computed once, what is decided beside its rows, hashes of columns."""

import random
from pathlib import Path

from graphs import edges, node, nodes
from pyspark.sql import functions as F

from lodestar.operators import ingest, solution
from lodestar.plans import demo_graph as g

DATA = Path("/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_merge_reads_new_edges_once_and_keeps_what_joins_keep(spark):
    rng = random.Random(7)
    names = ["a", "b", "c", "d", None]
    side = lambda n: [(rng.choice(names), rng.choice(names), rng.choice(["Calls", "Uses", None]), f"s{i}") for i in range(n)]
    for _ in range(4):
        old, new = side(80), side(12)
        frame = lambda rows: spark.createDataFrame(rows, "from_id string, to_id string, kind string, scope string")
        made = nodes(spark, node("a", path="x/one/f.cs"), node("b", path="x/two/f.cs"), node("c"))
        got = ingest.merge_edges(frame(old), made, spark.createDataFrame([("X/One/",)], "directory string"), frame(new).withColumn("scope", F.upper("scope")))
        keys = {r[:3] for r in new if None not in r[:3]}
        want = [r for r in old if r[0] != "a" and r[:3] not in keys] + [(*r[:3], r[3].upper()) for r in new]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    # no join asks for the new edges a second time
    assert "LeftAnti" not in plan(got)


def test_cross_edges_with_plain_names_are_settled_in_their_rows(spark):
    made = lambda project: nodes(spark, node("a", project=project), node("b", project="Q"))
    frame = lambda *rows: edges(spark, *((*r, "CrossProject") for r in rows))
    got = solution.cross_edge_changes(made("P"), frame(("a", "b", "Calls"), ("b", "a", "Uses")), made("R"), frame(("a", "b", "Calls"), ("a", "b", "Uses")))
    want = [("P::a", "Q::b", "Calls", "removed"), ("Q::b", "P::a", "Uses", "removed"), ("R::a", "Q::b", "Calls", "added"), ("R::a", "Q::b", "Uses", "added")]
    assert sorted(map(tuple, got.collect())) == want
    # they do not go on to the comparison by names
    assert "settled" in plan(got) and "Union" in plan(got)


def test_both_sides_have_the_edges_of_each(spark):
    an, ae, bn, be = g.both(spark, str(DATA))
    for got, want in (((an, ae), g.before(spark, str(DATA))), ((bn, be), g.after(spark, str(DATA)))):
        assert got[0].schema == want[0].schema and got[1].columns == want[1].columns
        assert got[1].exceptAll(want[1]).isEmpty() and want[1].exceptAll(got[1]).isEmpty()

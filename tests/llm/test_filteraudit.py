"""The filter audit against applying every order to every document."""

import itertools
import re

import pytest
from test_operators import SCHEMA, made_docs

from lodestar.llm import filteraudit


def brute(rows, labels):
    texts = [r[1] or "" for r in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for r, t in zip(rows, texts):
        if r[0] is not None:
            first[t] = min(first.get(t, r[0]), r[0])
    fails = []
    for r, t in zip(rows, texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and r[0] > first[t]}
        fails.append({k for k, v in f.items() if v})
    out, shapley = {}, {}
    for part in {r[3] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[3] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    made = made_docs()
    more = ["SHOUT " * 250, "a b " * 150, "50% off & more", " ".join(f"w{i}" for i in range(199)), " ".join(f"w{i}" for i in range(200)), "É" * 40 + "A", "A" + "b" * 49, "A" + "b" * 48, "\x0b \t"]
    made += [(200 + i, t, None, ["src1", None, ""][i % 3], None, None) for i, t in enumerate(more + more[:4])]
    return made


@pytest.fixture(scope="module")
def labels():
    return [(i, i % 2, int(i % 3 == 0)) for i in range(0, 210, 2)] + [(4, None, None), (5, 0, 1), (5, 1, 0), (None, 1, 1), (7, None, 1), (9999, 1, 1)]


def test_matches_every_order(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("bucket", "part").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2)
    got = filteraudit.audit(docs, marks).collect()
    assert len(got) == len(set(map(tuple, got))) == 600 * len({r[3] or "" for r in rows})
    assert set(map(tuple, got)) == brute(rows, labels)


def test_hot_copies_and_hot_source(spark):
    rows = [(i, "same text", None, "hot", None, None) for i in range(3000)] + [(None, "same text", None, "hot", None, None)] * 50 + [(-1, "same text", None, "cold", None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.part, r.step): r for r in filteraudit.audit(docs, none).where("filter_order = 'EABCD'").collect()}
    assert (got["hot", 1].kept, got["hot", 1].removed, got["hot", 1].good_lost) == (50, 3000, 0)
    assert (got["cold", 1].kept, got["cold", 1].removed) == (2, 0)
    assert set(map(tuple, filteraudit.audit(docs, none).collect())) == brute(rows, [])


def test_empty_tables(spark):
    docs, marks = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(docs, marks).count() == 0


def test_the_lattice():
    assert len(filteraudit.edges()) == 80 and len(filteraudit.steps()) == 600
    assert {(s, f) for _, _, s, f in filteraudit.steps()} == set(filteraudit.edges())


def test_long_texts(spark):
    rows = [(1, "Word " * 400_000, None, "s", None, None), (2, " ".join(map(str, range(200_000))), None, "s", None, None), (3, "Word " * 400_000, None, "s", None, None)]
    assert set(map(tuple, filteraudit.audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")).collect())) == brute(rows, [(3, 1, 1)])

"""The vector index against comparing every query with every vector."""

import numpy as np
import pytest

from lodestar.operators import vectors

DATA = "/root/testdata/sf0.1"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        at = np.flatnonzero(ids == q)[0]
        d = np.sqrt(((x.astype(np.float64) - x[at]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), d[i]) for i in order]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(30, 24))
    x = (heads[rng.integers(0, 30, 1500)] + rng.normal(scale=0.4, size=(1500, 24))).astype(np.float32)
    x[700:720] = x[3]  # equal vectors rank by id
    ids = rng.permutation(4000)[:1500]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    return ids, x, spark.createDataFrame(rows, "id long, vector array<float>").repartition(5)


def got(df):
    out = {}
    for r in df.orderBy("query", "place").collect():
        out.setdefault(r.query, []).append((r.id, r.distance))
    return out


@pytest.mark.parametrize("shard", [1 << 16, 40])
def test_exact_search_is_brute_force(table, shard, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", shard)
    ids, x, df = table
    index = vectors.build(df, lists=20)
    asked = df.where("id % 40 = 0").withColumnRenamed("id", "query")
    for probes in (1, 5):
        found = got(vectors.search(index, asked, k=10, probes=probes, candidates=15, exact=True))
        want = brute(ids, x, sorted(i for i in ids if i % 40 == 0), 10)
        assert {q: [i for i, _ in v] for q, v in found.items()} == {int(q): [i for i, _ in v] for q, v in want.items()}
        assert all(np.allclose([d for _, d in v], [d for _, d in want[q]]) for q, v in found.items())


def test_exact_search_measures_less_than_everything(table):
    ids, x, df = table
    index = vectors.build(df, lists=40)
    asked = df.where("id % 40 = 0").select(vectors.F.col("id").alias("query"), "vector", vectors.F.lit(1.0).cast("double").alias("reach"))
    radius = index.radius
    probed = vectors.asked(index, asked, lambda d, reach: d - radius <= reach[:, None])
    assert vectors.scanned(index, probed, None).count() < 0.5 * len(ids) * asked.count()


@pytest.mark.parametrize("shard, block", [(100, 1 << 18), (1 << 16, 7)])
def test_exact_search_answers_with_few_rows_whatever_the_bounds_leave(table, shard, block, monkeypatch):
    """Without a bound every pair is compared, but a share of the vectors answers with k rows a query."""
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "QUERIES", block)
    ids, x, df = table
    index = vectors.build(df, lists=20)
    asked = df.where("id % 40 = 0").select(vectors.F.col("id").alias("query"), "vector", vectors.F.lit(float("inf")).alias("reach"))
    found = vectors.compared(index, asked, 10)
    queries = [int(i) for i in ids if i % 40 == 0]
    assert found.count() <= 10 * len(queries) * -(-len(ids) // shard)
    want = brute(ids, x, queries, 10)
    assert {q: [i for i, _ in v] for q, v in got(vectors.ranked(found, 10)).items()} == {q: [i for i, _ in v] for q, v in want.items()}
    # copies of a query's vector lie at the distance zero and rank by id
    copies = sorted(int(i) for i in [ids[3], *ids[700:720]])
    one = df.where(f"id = {copies[0]}").select(vectors.F.col("id").alias("query"), "vector", vectors.F.lit(0.0).alias("reach"))
    assert [i for i, _ in got(vectors.ranked(vectors.compared(index, one, 5), 5))[copies[0]]] == copies[1:6]


def test_recall_on_the_drivers_vectors(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
    index = vectors.build(df)
    assert index.codes.count() == df.count()
    found = got(vectors.search(index, df.where("id % 100 = 0").withColumnRenamed("id", "query")))
    t = df.toPandas()
    want = brute(t.id.to_numpy(), np.stack(t.vector), list(found), 10)
    assert len(found) == 20
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 10 for q in found]) >= 0.9


def test_index_is_stored_and_read_back(spark, table, tmp_path):
    _, _, df = table
    index = vectors.build(df, lists=100)
    index.save(str(tmp_path))
    again = vectors.load(spark, str(tmp_path))
    asked = df.where("id % 100 = 0").withColumnRenamed("id", "query")
    assert got(vectors.search(again, asked)) == got(vectors.search(index, asked))


def test_plan_has_no_pairing_of_all_rows(table):
    _, _, df = table
    index = vectors.build(df, lists=20)
    plan = vectors.search(index, df.withColumnRenamed("id", "query"), exact=True)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 0.0]), (2, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    index = vectors.build(df)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.0, 0.0, 1.0]), (None, [0.0, 1.0])], "query long, vector array<float>")
    assert [(r.query, r.id, r.place) for r in vectors.search(index, asked, exact=True).orderBy("place").collect()] == [(1, 7, 1), (1, 2, 2), (1, 2, 3)]
    unit = vectors.build(df, cosine=True)
    assert {(r.id, tuple(r.vector)) for r in unit.vectors.collect()} >= {(1, (1.0, 0.0)), (2, (0.0, 1.0)), (7, (0.0, 0.0))}
    empty = vectors.build(df.limit(0))
    assert vectors.search(empty, asked.limit(0)).count() == 0

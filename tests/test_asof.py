"""Joins on time against row-by-row versions; sessions and bounded repeats as streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import asof
from lodestar.streaming import audit

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + datetime.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(12)
    left = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", at(rng.randrange(5000) / 2)) for i in range(900)]
    left += [(900, None, at(5)), (901, "hot", None), (902, "nowhere", at(100)), (903, "hot", at(-50))]
    right = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}", at(rng.randrange(2500)), i) for i in range(300)]
    right += [("hot", at(40), 1000), ("hot", at(40), 1001), (None, at(1), 5), ("k1", None, 6)]
    return left, right, spark.createDataFrame(left, "id int, k string, t timestamp_ntz").repartition(3), spark.createDataFrame(right, "k string, since timestamp_ntz, version int").repartition(3)


@pytest.mark.parametrize("rows", [50_000, 20, 1])
def test_asof_matches_looking_for_each_row(tables, rows, monkeypatch):
    monkeypatch.setattr(asof, "ROWS", rows)
    left, right, a, b = tables
    want = set()
    for i, k, t in left:
        before = [(s, v) for key, s, v in right if key == k and k is not None and s is not None and t is not None and s <= t]
        want.add((i, k, t, *((max(before)[1], max(before)[0]) if before else (None, None))))
    got = asof.asof(a, b, ["k"], "t", "since", ["version", "since"], tie="version")
    assert got.columns == ["id", "k", "t", "version", "since"]
    assert set(map(tuple, got.collect())) == want and got.count() == len(left)


def test_asof_plan_has_no_theta_join(tables):
    _, _, a, b = tables
    plan = asof.asof(a, b, ["k"], "t", "since", ["version"], tie="version")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = asof.within(a, b.withColumn("until", F.col("since") + F.expr("interval 90 seconds")), ["k"], "t", "since", "until", ["version"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_asof_of_empty_tables(tables):
    _, _, a, b = tables
    assert asof.asof(a.limit(0), b, ["k"], "t", "since", ["version"]).count() == 0
    none = asof.asof(a, b.limit(0), ["k"], "t", "since", ["version"])
    assert none.count() == a.count() and none.where("version is not null").count() == 0


def test_intervals_match_looking_for_each_row(spark, tables):
    left, right, a, b = tables
    rng = random.Random(3)
    spans = [(k, s, rng.choice([None, s + datetime.timedelta(seconds=rng.randrange(-5, 400))]), v) for k, s, v in right if s is not None]
    want = sorted((i, v) for i, k, t in left for key, s, e, v in spans if t is not None and k is not None and key == k and s <= t and (e is None or t < e))
    c = spark.createDataFrame(spans, "k string, since timestamp_ntz, until timestamp_ntz, version int")
    got = asof.within(a, c, ["k"], "t", "since", "until", ["version"])
    assert got.columns == ["id", "k", "t", "version"]
    assert sorted((r.id, r.version) for r in got.collect()) == want
    assert asof.within(a.limit(0), c, ["k"], "t", "since", "until", ["version"]).count() == 0


def test_times_without_a_zone_are_taken_as_they_stand(spark):
    df = spark.sql("select timestamp_ntz'2024-03-31 02:30:00' as a, timestamp'2024-01-01 00:00:00 UTC' as b")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(asof.micros("a"), asof.micros("b")).first() == (1_711_852_200_000_000, 1_704_067_200_000_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def calls(spark, folder, rows):
    spark.createDataFrame([(i, c, "t", datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)) for i, c, s in rows], "call_id long, caller string, tool string, timestamp timestamp").coalesce(1).write.mode("append").parquet(folder)


def streamed(spark, folder, made, out, ck):
    stream = spark.readStream.schema("call_id long, caller string, tool string, timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    q = made(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.read.parquet(out).collect()


def test_sessions_come_once_when_they_are_over(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    calls(spark, folder, [(1, "a", 0), (2, "a", 100), (3, "b", 50), (4, "a", 900)])
    calls(spark, folder, [(5, "a", 1000), (6, "b", 5000)])
    made = lambda s: audit.sessions(s, "10 minutes", late="1 minute")
    got = sorted((r.caller, r.calls, (r.ended - r.began).total_seconds()) for r in streamed(spark, folder, made, out, ck))
    assert got == [("a", 2, 100.0), ("a", 2, 100.0), ("b", 1, 0.0)]
    calls(spark, folder, [(7, "a", 100), (8, "c", 9000)])  # the first is behind the watermark
    got = sorted((r.caller, r.calls) for r in streamed(spark, folder, made, out, ck))
    assert got == [("a", 2), ("a", 2), ("b", 1), ("b", 1)]


def test_repeated_calls_are_dropped_across_batches(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    calls(spark, folder, [(1, "a", 0), (1, "a", 5), (2, "a", 10)])
    calls(spark, folder, [(2, "a", 20), (3, "a", 30)])
    assert sorted(r.call_id for r in streamed(spark, folder, audit.once_each, out, ck)) == [1, 2, 3]
    calls(spark, folder, [(3, "a", 40), (4, "a", 50)])
    assert sorted(r.call_id for r in streamed(spark, folder, audit.once_each, out, ck)) == [1, 2, 3, 4]

"""Token buckets with timers against the driver's buckets on a replay."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.api import Buckets
from lodestar.streaming import limits

START = 1_704_067_200.0


def made(spark, tmp_path, rows):
    spark.createDataFrame(rows, "call_id long, caller string, tool string, at double").coalesce(1).select("call_id", "caller", "tool", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))


def run(spark, tmp_path, **kw):
    schema = "call_id long, caller string, tool string, timestamp timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limits.limited(stream, **kw).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(tmp_path / "out")).collect(), rows


def replay(rows, limit, seconds):
    """Buckets of the driver, one set for each caller, with the calls' times as their clock."""
    clock, held, out = [0.0], {}, {}
    for call, caller, tool, at in sorted(rows, key=lambda r: (r[3], r[0])):
        clock[0] = at
        buckets = held.setdefault(caller, Buckets({"query": limit, "ingestion": limit}, seconds, lambda: clock[0]))
        wait = buckets.take(tool)
        out[call] = (wait == 0, wait)
    return out


def test_equal_to_the_drivers_buckets_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"c{i}", ("search_symbols", "ingest_project")[i % 2], float(START)) for i in range(6)]
    for i in range(6, 400):
        rows.append((i, f"c{rng.randrange(6)}", rng.choice(["search_symbols", "get_symbol", "ingest_project"]), START + round(i * 1.7 + rng.random(), 3)))
    rows.sort(key=lambda r: r[3])
    kw = dict(limits={"query": 5, "ingestion": 2}, seconds=60, late="1 hour", idle=100_000)
    for a in range(0, 300, 100):
        made(spark, tmp_path, rows[a : a + 100])
    first, _ = run(spark, tmp_path, **kw)
    assert len(first) == 300
    made(spark, tmp_path, rows[300:])
    got, _ = run(spark, tmp_path, **kw)
    want = {}
    for kind, limit in (("ingest", 2), ("", 5)):
        mine = [r for r in rows if r[2].startswith("ingest") == bool(kind)]
        want |= replay(mine, limit, 60)
    assert {r.call_id: (r.accepted, r.retry_after_ms) for r in got} == want
    assert any(not ok for ok, _ in want.values())


def test_idle_callers_leave_no_state(spark, tmp_path):
    made(spark, tmp_path, [(i, f"c{i % 20}", "search_symbols", START + i) for i in range(60)])
    made(spark, tmp_path, [(100 + i, "busy", "search_symbols", START + 1000.0 + i) for i in range(3)])
    made(spark, tmp_path, [(200 + i, "busy", "search_symbols", START + 1400.0 + i) for i in range(3)])
    made(spark, tmp_path, [(300, "c3", "search_symbols", START + 1450.0)])
    got, states = run(spark, tmp_path, limits={"query": 2, "ingestion": 2}, seconds=60, late="0 seconds", idle=120)
    assert max(states) >= 20 and states[-1] <= 6
    by = {r.call_id: r.accepted for r in got}
    assert len(by) == 67 and by[300] and [by[100 + i] for i in range(3)] == [True, True, False] == [by[200 + i] for i in range(3)]
    assert sum(by[i] for i in range(60)) == 40


def test_waiting_calls_are_let_through_by_the_timer(spark, tmp_path):
    made(spark, tmp_path, [(i, "c", "search_symbols", START + i) for i in range(7)])
    made(spark, tmp_path, [(50, "other", "search_symbols", START + 70.0)])
    made(spark, tmp_path, [(51, "other", "search_symbols", START + 200.0)])
    got, _ = run(spark, tmp_path, limits={"query": 2, "ingestion": 2}, seconds=60, late="0 seconds", queue=3)
    by = {r.call_id: (r.accepted, r.waited_ms) for r in got}
    assert by[0] == by[1] == (True, 0) and by[5] == by[6] == (False, 0)
    assert by[2] == (True, 58_000) and by[3] == (True, 57_000) and by[4] == (True, 116_000)
    assert {r.call_id: r.retry_after_ms for r in got if not r.accepted} == {5: 55_000, 6: 54_000}


@pytest.mark.parametrize("anchor", [None, START - 30.0])
def test_periods_count_from_the_anchor(spark, tmp_path, anchor):
    made(spark, tmp_path, [(i, "c", "search_symbols", START + 10.0 * i) for i in range(8)])
    got, _ = run(spark, tmp_path, limits={"query": 1, "ingestion": 1}, seconds=60, late="1 hour", anchor=anchor)
    taken = sorted(r.call_id for r in got if r.accepted)
    assert taken == ([0, 6] if anchor is None else [0, 3])

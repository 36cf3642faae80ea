"""Queries over the event stream's table: what held at a moment, and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof
from ..streaming import audit
from . import demo_graph as g
from .registered import query

#: A signup saves a snapshot of one of 40 projects; every other event is a call of one, made with the snapshot of an hour before.
CALLS = """WITH e AS (SELECT *, user_id % 40 AS project FROM events),
s AS (SELECT project, ts AS saved_at, max(event_id) AS snapshot FROM e WHERE event_type = 'signup' GROUP BY project, ts),
c AS (SELECT event_id, project, ts, ts - INTERVAL 1 HOUR AS opened FROM e WHERE event_type <> 'signup'),
n AS (SELECT c.*, s.snapshot, s.saved_at FROM c ASOF LEFT JOIN s ON c.project = s.project AND c.ts >= s.saved_at),
h AS (SELECT n.*, s.snapshot AS held FROM n ASOF LEFT JOIN s ON n.project = s.project AND n.opened >= s.saved_at)
"""


def calls_and_snapshots(spark, d):
    events = g.table(spark, d, "events").withColumn("project", F.col("user_id") % 40)
    snapshots = events.where("event_type = 'signup'").select("project", F.col("ts").alias("saved_at"), F.col("event_id").alias("snapshot"))
    calls = events.where("event_type <> 'signup'").select("event_id", "project", "ts", (F.col("ts") - F.expr("interval 1 hour")).alias("opened"))
    return calls, snapshots


@query(CALLS + "SELECT event_id, project, snapshot, epoch_us(ts) - epoch_us(saved_at) AS age_us, held, held IS DISTINCT FROM snapshot AS stale FROM h", graph_sql=False)
def snapshot_in_force(spark, d):
    """For each call the snapshot in force, how old it was, and whether the one held since an hour ago had become stale."""
    calls, snapshots = calls_and_snapshots(spark, d)
    now = asof.asof(calls, snapshots, ["project"], "ts", "saved_at", ["snapshot", "saved_at"], tie="snapshot")
    then = asof.asof(now, snapshots.withColumnsRenamed({"snapshot": "held", "saved_at": "held_since"}), ["project"], "opened", "held_since", ["held"], tie="held")
    age = asof.micros("ts") - asof.micros("saved_at")
    return then.select("event_id", "project", "snapshot", age.alias("age_us"), "held", (~F.col("held").eqNullSafe(F.col("snapshot"))).alias("stale"))


@query(CALLS + "SELECT project, count(*) AS calls, count(*) FILTER (held IS DISTINCT FROM snapshot) AS stale, count(*) FILTER (snapshot IS NULL) AS before_any FROM h GROUP BY project", graph_sql=False)
def stale_calls_by_project(spark, d):
    found = snapshot_in_force(spark, d)
    return found.groupBy("project").agg(F.count("*").alias("calls"), F.count_if("stale").alias("stale"), F.count_if(F.col("snapshot").isNull()).alias("before_any"))


@query("""WITH e AS (SELECT *, user_id % 40 AS project FROM events), v AS (SELECT event_id AS snapshot, project, ts AS since, lead(ts) OVER (PARTITION BY project ORDER BY ts, event_id) AS until FROM e WHERE event_type = 'signup')
SELECT v.snapshot, v.project, count(*) AS calls FROM e JOIN v ON e.project = v.project AND e.ts >= v.since AND (e.ts < v.until OR v.until IS NULL) WHERE e.event_type <> 'signup' GROUP BY v.snapshot, v.project""", graph_sql=False)
def calls_of_each_snapshot(spark, d):
    """Calls made while a snapshot was the project's latest, by intervals of validity."""
    from pyspark.sql import Window

    calls, snapshots = calls_and_snapshots(spark, d)
    until = F.lead("saved_at").over(Window.partitionBy("project").orderBy("saved_at", "snapshot"))
    found = asof.within(calls, snapshots.withColumn("until", until), ["project"], "ts", "saved_at", "until", ["snapshot"])
    return found.groupBy("snapshot", "project").agg(F.count("*").alias("calls"))


@query("""WITH g AS (SELECT user_id, ts, event_type, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS began_us, epoch_us(max(ts)) - epoch_us(min(ts)) AS length_us, count(*) AS calls FROM r GROUP BY user_id, k""", graph_sql=False)
def caller_sessions(spark, d):
    """Sessions of each user with pauses under half an hour."""
    calls = g.table(spark, d, "events").select("user_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("tool"))
    found = audit.sessions(calls, "30 minutes", ("user_id",))
    began, ended = asof.micros("began"), asof.micros("ended")
    return found.select("user_id", began.alias("began_us"), (ended - began).alias("length_us"), "calls")

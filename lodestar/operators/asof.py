"""Joins on time: the last row before a moment, and the intervals that a moment lies in.

An as-of join merges two tables as sorted streams: rows of both are tagged, united and dealt
by key and time bucket, and in each bucket the last value of the right side runs along the
left one. What held at a bucket's start is carried over from the last bucket before that had
a value: one row a key and bucket. So a key with a third of all rows is many buckets, and
nothing is joined on an inequality. Buckets are as long as it takes for the largest key to
have about ROWS rows in each.

An interval join gives an interval to each time bucket that it touches, and meets the
moments of that bucket there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key and bucket, about, and buckets that one interval is given to, on average.
ROWS, TOUCHED = 50_000, 2


def micros(time: str) -> Column:
    """Microseconds since 1970 of a column; a time without a zone is taken as it stands, whatever zone the session has."""
    day, clock = f"unix_date(CAST(`{time}` AS date)) * 86400000000", f"hour(`{time}`) * 3600000000 + minute(`{time}`) * 60000000L + CAST(extract(SECOND FROM `{time}`) * 1000000 AS bigint)"
    return F.expr(f"CASE WHEN typeof(`{time}`) = 'timestamp_ntz' THEN {day} + {clock} ELSE unix_micros(CAST(`{time}` AS timestamp)) END")


def bucket_length(times: DataFrame, keys: list[str]) -> int:
    """Microseconds of a bucket for rows (keys, at), from the largest key and the whole span; three figures reach the driver."""
    by = times.groupBy(*keys).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    r = by.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if r.n is None:
        return 1
    return max(1, (r.hi - r.lo + 1) // max(1, -(-r.n // ROWS)))


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, columns: list[str], tie: str | None = None) -> DataFrame:
    """left with `columns` of right's last row of the same keys at or before `time`; null where there is none.

    Of right rows of one time the one with the greatest `tie` counts (the greatest of the
    columns without one). Left rows without a time or key get nulls; right rows without are
    left out. Columns of left of the same names must not exist.
    """
    value = F.struct(*(F.col(c) for c in columns))
    order = F.struct(micros(right_time).alias("at"), (F.col(tie) if tie else value).alias("tie"))
    known = right.where(reduce(lambda a, c: a & F.col(c).isNotNull(), keys, F.col(right_time).isNotNull()))
    rows = F.struct(*(F.col(c) for c in left.columns))
    none_left, none_value = F.lit(None).cast(left.select(rows.alias("r")).schema["r"].dataType), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    ours = left.select(*keys, micros(time).alias("at"), F.lit(1).alias("side"), none_value.alias("value"), F.lit(None).cast(right.select(order.alias("o")).schema["o"].dataType).alias("order"), rows.alias("row"))
    theirs = known.select(*keys, micros(right_time).alias("at"), F.lit(0).alias("side"), value.alias("value"), order.alias("order"), none_left.alias("row"))
    both = ours.union(theirs)
    length = bucket_length(both.select(*keys, "at"), keys)
    both = both.withColumn("bucket", F.floor(F.col("at") / length))
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.col("at").asc_nulls_first(), "side", F.col("order.tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.withColumn("found", F.last("value", ignorenulls=True).over(inside)).where("side = 1")
    # what each bucket leaves behind, and what the ones before it left
    left_behind = theirs.withColumn("bucket", F.floor(F.col("at") / length)).groupBy(*keys, "bucket").agg(F.max_by("value", "order").alias("behind"))
    asked = ours.where("at is not null").select(*keys, F.floor(F.col("at") / length).alias("bucket")).distinct()
    marks = asked.withColumn("behind", none_value).union(left_behind.select(*keys, "bucket", "behind")).groupBy(*keys, "bucket").agg(F.first("behind", ignorenulls=True).alias("behind"))
    ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("bucket").alias("_bucket"), F.last("behind", ignorenulls=True).over(ahead.partitionBy(*keys)).alias("carried"))
    met = run.join(carried, reduce(lambda a, k: a & (F.col(k) == F.col(f"_{k}")), keys, F.col("bucket") == F.col("_bucket")), "left")
    held = F.when(F.col("at").isNotNull(), F.coalesce("found", "carried"))
    return met.withColumn("held", held).select("row.*", *(F.col(f"held.{c}").alias(c) for c in columns))


def within(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """points once for each interval [start, end) of the same keys that `time` lies in, with `columns` of it.

    An interval without an end is open; it and longer ones than usual go to as many buckets as
    they touch up to the last moment. Empty and reversed intervals hold nothing.
    """
    at = micros(time)
    last = points.agg(F.max(at)).first()[0]
    if last is None:
        return points.select("*", *(intervals.schema[c] and F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in columns)).limit(0)
    spans = intervals.where(F.col(start).isNotNull()).select(*(F.col(k).alias(f"_{k}") for k in keys), micros(start).alias("_lo"), F.least(F.coalesce(micros(end), F.lit(last + 1)), F.lit(last + 1)).alias("_hi"), *(F.col(c).alias(f"_of_{c}") for c in columns)).where("_lo < _hi")
    mean = spans.agg(F.avg(F.col("_hi") - F.col("_lo"))).first()[0] or 1
    length = max(1, int(mean / TOUCHED))
    dealt = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / length), F.floor((F.col("_hi") - 1) / length))))
    moments = points.withColumns({"_at": at}).withColumn("_slot", F.floor(F.col("_at") / length))
    on = reduce(lambda a, k: a & (F.col(k) == F.col(f"_{k}")), keys, F.col("_slot") == F.col("_bucket"))
    return moments.join(dealt, on).where("_at >= _lo and _at < _hi").select(*points.columns, *(F.col(f"_of_{c}").alias(c) for c in columns))

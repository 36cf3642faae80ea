"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a schedule: knots (t, w) over training time 0 to 1, linear between
them. Its integral is the source's weight in the whole mix; the mix has as many words as
the corpus, no source gets over `most` times its own words, and what that leaves over is
shared again by weight. A source's documents lie in hash order on one line of its words,
repeated up to `most` times; the target cuts that line. The integral of the schedule up
to t, times the target, is the source's demand by t, so the demand's inverse at a
document's place on the line is its training position, and sorting all documents by
position gives the mix its changing proportions. The document across the cut is taken in
part, so each source comes within a word of its target.

Places on the line are prefix sums over hash buckets that grow in number with the rows:
a source with a third of all rows is spread over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import checkpointed, unused

#: Documents that one bucket of a source's line holds, on average.
PER_BUCKET = 20_000
#: The key of the null source; other keys are an s and the source.
NULL_SOURCE = ""


def size_of(text: Column) -> Column:
    """How many runs outside 0x20 and 0x09-0x0D a text has; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def cycling(rank: Column) -> Column:
    """The schedule of the source at a rank: weights 1, 2, 3, repeating, rising in even ranks and falling in odd ones."""
    w = (rank % 3 + 1).cast("double")
    tilt = F.when(rank % 2 == 0, F.lit(0.5)).otherwise(F.lit(1.5))
    knot = lambda t, v: F.struct(F.lit(float(t)).alias("t"), v.alias("w"))
    return F.array(knot(0, w * tilt), knot(1, w * (F.lit(2.0) - tilt)))


def pieces_of(knots: Column) -> Column:
    """The linear pieces of a schedule, with the integral before each."""
    n = F.size(knots)
    piece = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(F.get(knots, i - 1)["t"].alias("t"), F.get(knots, i - 1)["w"].alias("w"), (F.get(knots, i)["t"] - F.get(knots, i - 1)["t"]).alias("d"), F.get(knots, i)["w"].alias("v")),
    )
    before = lambda i: F.aggregate(F.slice(piece, 1, i), F.lit(0.0), lambda a, p: a + p["d"] * (p["w"] + p["v"]) / 2)
    return F.transform(piece, lambda p, i: F.struct(p["t"].alias("t"), p["w"].alias("w"), p["d"].alias("d"), p["v"].alias("v"), before(i).alias("before")))


def integral(knots: Column) -> Column:
    return F.aggregate(pieces_of(knots), F.lit(0.0), lambda a, p: a + p["d"] * (p["w"] + p["v"]) / 2)


def inverse(pieces: Column, total: Column, share: Column) -> Column:
    """The time by which a schedule of that total has given out `share` (0 to 1) of it."""
    need = share * total
    p = F.element_at(F.filter(pieces, lambda q: q["before"] <= need), -1)
    a = (p["v"] - p["w"]) / F.nullif(p["d"], F.lit(0.0)) / 2
    c = need - p["before"]
    # a x^2 + w x = c, in the form that also holds for a = 0
    x = 2 * c / F.nullif(p["w"] + F.sqrt(F.greatest(F.lit(0.0), p["w"] * p["w"] + 4 * a * c)), F.lit(0.0))
    return F.least(F.lit(1.0), p["t"] + F.coalesce(F.least(x, p["d"]), F.lit(0.0)))


def targets(sizes: DataFrame, schedule: Callable[[Column], Column], most: float) -> DataFrame:
    """(source, source_size, rank, pieces, total, target) from (source, source_size), one row for each source.

    Sources rank by code point, null last. Each gets the common level times its weight, or
    its limit. By limit over weight, let the first k sources be at their limit and the rest
    share what is left: this level rises with k until the next source is under its limit,
    and falls after, so the level is the greatest of them, from one running sum.
    """
    everywhere = Window.orderBy(F.col("source") == NULL_SOURCE, "source")
    s = sizes.withColumn("rank", F.row_number().over(everywhere) - 1)
    s = s.withColumn("pieces", pieces_of(schedule(F.col("rank")))).withColumn("total", integral(schedule(F.col("rank")))).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy((F.col("limit") / F.nullif("total", F.lit(0.0))).asc_nulls_last(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full, gone = (F.coalesce(F.sum(c).over(by), F.lit(0.0)) for c in ("limit", "total"))
    level = (F.sum("source_size").over(whole) - full) / F.nullif(F.sum("total").over(whole) - gone, F.lit(0.0))
    s = s.withColumn("level", level).withColumn("level", F.coalesce(F.max("level").over(whole), F.lit(0.0)))
    return s.select("source", "source_size", "rank", "pieces", "total", F.least("limit", F.col("level") * F.col("total")).alias("target"))


def mix(docs: DataFrame, schedule: Callable[[Column], Column] = cycling, most: int = 3) -> DataFrame:
    """docs with size, source_size, target, taken, positions (one for each time it is taken) and position, the first of them.

    Columns of docs of these names are replaced. A null text has size 0; a null source is
    a source of its own, the last. Documents of size 0 are taken with 0 words. Equal rows
    share a hash and lie next to each other; reruns agree up to the order of equal rows.
    An empty table gives an empty table.
    """
    made = ["size", "source_size", "target", "taken", "positions", "position"]
    docs = docs.drop(*made)
    h, source, bucket, own, s_, b_, offset, pieces, total, goal_ = unused(docs, "h", "source", "bucket", "own", "s", "b", "offset", "pieces", "total", "goal")
    text = F.col("text").cast("string")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(NULL_SOURCE))
    buckets = max(16, -(-docs.count() // PER_BUCKET))
    keyed = docs.withColumns({"size": size_of(text), h: F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), text)), source: key})
    # the line is in hash order, so buckets are ranges of the hash
    keyed = keyed.withColumn(bucket, F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)).cast("int"))
    sums = checkpointed(keyed.groupBy(F.col(source).alias("source"), F.col(bucket).alias("b")).agg(F.sum("size").alias("words")))
    of = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), schedule, most).withColumnRenamed("source", "s")
    ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    of = sums.select("source", "b", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset")).join(of, F.col("source") == F.col("s"))
    of = of.select(F.col("source").alias(s_), F.col("b").alias(b_), F.col("offset").alias(offset), "source_size", "target", F.col("pieces").alias(pieces), F.col("total").alias(total))
    within = Window.partitionBy(source, bucket).orderBy(h, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn(own, F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(of, (F.col(source) == F.col(s_)) & (F.col(bucket) == F.col(b_))).withColumn(goal_, F.round("target").cast("long"))
    goal = F.col(goal_)
    starts = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.col(offset) + F.col(own) + k * F.col("source_size"))
    turns = F.filter(starts, lambda x: x < goal)
    share = lambda x: F.least(F.lit(1.0), x.cast("double") / F.nullif(F.col("target"), F.lit(0.0)))
    out = joined.withColumns({
        "taken": F.aggregate(turns, F.lit(0).cast("long"), lambda a, x: a + F.least(F.col("size"), goal - x)),
        "positions": F.transform(turns, lambda x: inverse(F.col(pieces), F.col(total), share(x))),
    })
    return out.withColumn("position", F.get("positions", F.lit(0))).select(*docs.columns, *made)


def in_order(mixed: DataFrame) -> DataFrame:
    """The training stream: one row for each time a document is taken, range-sorted by position; documents that are not taken go."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", "doc_id")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position) of every row of documents, range-sorted by position."""
    mixed = mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: DuckDB's twin of digest() with the schedule cycling().
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat_ws(':', doc_id::VARCHAR, text)) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS level FROM w),
t AS (SELECT source, source_size, w, w * CASE WHEN rank % 2 = 0 THEN 0.5 ELSE 1.5 END AS w0, least(most, max(level) OVER () * w) AS target FROM l),
p AS (SELECT d.*, source_size, w, w0, target, round(target)::BIGINT AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, w - w0 AS a, least(1.0, start / nullif(target, 0.0)) * w AS c FROM p)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (CASE WHEN start < goal THEN least(size, goal - start) ELSE 0 END + CASE WHEN start + source_size < goal THEN least(size, goal - start - source_size) ELSE 0 END
   + CASE WHEN start + 2 * source_size < goal THEN least(size, goal - start - 2 * source_size) ELSE 0 END)::BIGINT AS taken,
  CASE WHEN start < goal THEN round(least(1.0, coalesce(least(2 * c / nullif(w0 + sqrt(greatest(0.0, w0 * w0 + 4 * a * c)), 0.0), 1.0), 0.0)), 9) END AS position
FROM q
"""

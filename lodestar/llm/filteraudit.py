"""How filters interact, for every order they could be applied in.

Five filters have 120 orders and 600 steps, but a step sees only which filters came
before it: there are 80 pairs of (filters applied, filter next), the edges of the lattice
of subsets. A document is boiled down to the filters it fails; documents of a part that
fail the same ones are counted first, these counts go to the 80 edges, and each order
reads its five edges along its path from the empty set to the full one.

Texts are read once, into a row of ids, part, hash and failures. Labels meet these rows
by doc_id. Copies are told by their hash: rows are counted by (hash, part, labels) before
the copies of one text are brought together, so a text with a third of all rows is a row
for each part there.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters in the order of their bits.
FILTERS = "ABCDE"
WHITE = "[\\x20\\x09-\\x0D]+"
#: The bit of E, the one filter that no single text can tell.
COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> list[Column]:
    """Conditions of filters A to D on a text."""
    words = F.array_remove(F.split(text, WHITE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]


def edges() -> list[tuple[int, int]]:
    """(filters applied before, filter next), as bits."""
    return [(s, k) for k in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> k & 1]


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step from 1, filters applied before, filter next) of every order."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        out += [(name, i + 1, sum(1 << k for k in order[:i]), f) for i, f in enumerate(order)]
    return out


def failed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents by part and the set of filters they fail, with how many are labelled good and toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures(F.col("text")))), F.lit(0))
    rows = narrow.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), bits.alias("fails"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # a row without an id meets no label; a key of its own keeps such rows apart
    key = F.coalesce("doc_id", F.xxhash64("hash", F.monotonically_increasing_id()))
    met = rows.withColumn("key", key).join(marks, (F.col("key") == F.col("labelled")) & F.col("doc_id").isNotNull(), "left")
    kinds = ["hash", "part", "fails", "good", "toxic"]
    met = met.select("doc_id", "hash", "part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    ids = met.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    # of each kind of row: how many, how many have the least id or none
    known = F.col("doc_id").isNotNull()
    texts = ids.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown"))
    first = F.min("least.doc_id").over(Window.partitionBy("hash"))
    alone = F.col("unknown") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    told = texts.withColumn("first", first).select("part", "good", "toxic", "fails", "n", alone.alias("alone"))
    split = told.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("fails").alias("fails"), F.col("alone").alias("n")), F.struct((F.col("fails") + COPY).alias("fails"), (F.col("n") - F.col("alone")).alias("n")))).alias("x"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(F.lit(0))).alias(c)
    return split.groupBy("part", F.col("x.fails").alias("fails")).agg(F.sum("x.n").alias("n"), of("good"), of("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every source, order and step.

    A null or empty text has no words: it fails A, and E behind a smaller id. A null source
    is the empty part. A row without a doc_id has no label, is no copy, and makes no other
    row one; rows that share a doc_id and text are not copies of each other. A document with
    several label rows is good or toxic if one of them says so. Columns that are not needed
    are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    reached = F.explode(F.array(*(F.struct(F.lit(s).alias("before"), F.lit(k).alias("filter")) for s, k in edges()))).alias("e")
    at = failed(docs, labels).select("part", "fails", "n", "good", "toxic", reached).select("*", "e.*")
    this, earlier = F.expr("fails & shiftleft(1, filter)") > 0, F.expr("fails & before") > 0
    total = lambda when, of: F.sum(F.when(when, F.col(of)).otherwise(F.lit(0)))
    # an edge lies on as many orders as there are orders of the filters before it and of those after it
    orders = F.element_at(F.array(*(F.lit(math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count())) for s in range((1 << len(FILTERS)) - 1))), F.col("before") + 1)
    summed = at.groupBy("part", "before", "filter").agg(
        total(~this & ~earlier, "n").alias("kept"), total(this & ~earlier, "n").alias("removed"), total(this & earlier, "n").alias("redundant"),
        total(F.col("fails") == F.expr("shiftleft(1, filter)"), "n").alias("unique_fails"), total(this & ~earlier, "good").alias("good_lost"), total(this & ~earlier, "toxic").alias("toxic_lost"),
    )
    # the 80 edges of a part are one group
    summed = summed.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "filter")))
    paths = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, before int, filter int"))
    return summed.join(paths, ["before", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: DuckDB's twin of audit(): every order applied to every kind of document, step by step.
ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(w.doc_id > first, false) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
k AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(p.x, q.x, r.x, s.x, u.x) AS filter_order FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
z AS (SELECT filter_order, s.step AS step, substr(filter_order, s.step, 1) AS f, string_split(substr(filter_order, 1, s.step - 1), '') AS past FROM o, range(1, 6) s(step)),
y AS (SELECT k.*, filter_order, step, f, contains(fails, f) AS this, list_has_any(string_split(fails, ''), past) AND fails <> '' AND step > 1 AS earlier FROM k, z),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT this AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN this AND NOT earlier THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN this AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN this AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN this AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
"""

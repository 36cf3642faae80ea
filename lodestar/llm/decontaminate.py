"""Benchmark decontamination by template windows, with DataFrame functions only.

A text's words lose their case and edge punctuation; numbers, units and names become
typed placeholders, their values kept as slots. A benchmark item is known by its windows
of WINDOW canonical words, at every offset. Documents are first blocked: any equal window
holds one of the document's blocks of BLOCK words at a multiple of BLOCK, so only
documents with a block that the benchmark has (at any offset) are looked at further, and
no match is lost. Their windows are hash-joined to the benchmark's. Matches along one
diagonal (document place less item place) are an occurrence; it counts if each slot value
of the item stands for one value in the document throughout, which lets copies with
other numbers and names through to the verdict and stops chance overlaps of patterns. A
window with fewer than PLAIN words that are no placeholders is known by its values, so a
table of numbers matches only itself. Items too short for a window are looked for as they
are, word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import unused

WINDOW = 8
BLOCK = 4
#: Words of a window that have to be no placeholders for it to match with other values.
PLAIN = 2
#: Words in a row that are evidence whatever share of the item they are, and the fewest words of an item that is looked for.
RUN, FEWEST = 20, 3
#: Benchmark windows up to which they are broadcast; a larger benchmark is joined by shuffle.
BROADCAST_WINDOWS = 500_000
EDGES = ".,;:!?\"'`()[]{}<>*%$#&|~_=/\\-"
UNITS = ["kg", "mg", "km", "cm", "mm", "ml", "mph", "kmh", "lb", "lbs", "oz", "ft", "mile", "miles", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "kilograms", "grams", "liters", "litres", "hour", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent", "degrees", "usd", "eur", "stunden", "minuten", "heures", "horas"]
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical(text: Column) -> Column:
    """An array of (word, value): canonical words, and for placeholders the value they stand for."""
    def word(raw: Column, i: Column, all_: Column) -> Column:
        plain = F.btrim(F.lower(raw), F.lit(EDGES))
        before = F.get(all_, i - 1)
        inner = (i > 0) & ~before.rlike(r"[.!?:]$")
        name = (raw != F.lower(raw)) & raw.rlike(r"^\p{Lu}\p{Ll}") & inner
        kind = F.when(plain.rlike(r"^[^\p{L}]*\d[^\p{L}]*$"), F.lit(NUMBER)).when(plain.isin(UNITS), F.lit(UNIT)).when(name, F.lit(NAME)).otherwise(plain)
        return F.struct(kind.alias("word"), plain.alias("value"))

    raw = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    # words of edge characters alone are left out, as they come and go with formatting
    return let(raw, lambda a: F.filter(F.transform(a, lambda x, i: word(x, i, a)), lambda w: w["word"] != ""))


def blocks(words: Column, every: int) -> Column:
    """Hashes of BLOCK words each, at multiples of `every`."""
    def hashes(w: Column) -> Column:
        last = F.size(w) - BLOCK
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(every))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, BLOCK)))

    return let(F.transform(words, lambda x: x["word"]), hashes)


def windows(words: Column) -> Column:
    """(h, at, slots) of each window of WINDOW words; a slot is (kind, value)."""
    def each(w: Column) -> Column:
        last = F.size(w) - WINDOW
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: let(
                F.slice(w, i + 1, WINDOW),
                lambda s: let(
                    F.filter(s, lambda x: x["word"].isin(NUMBER, UNIT, NAME)),
                    lambda slots: F.struct(F.when(F.size(slots) <= WINDOW - PLAIN, F.xxhash64(F.transform(s, lambda x: x["word"]))).otherwise(F.xxhash64(F.transform(s, lambda x: x["value"]), F.lit(1))).alias("h"), i.alias("at"), slots.alias("slots")),
                ),
            ),
        )

    return let(words, each)


def longest_run(places: Column) -> Column:
    """The length of the longest run of neighbours among distinct numbers."""
    step = lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"] + 1, a["n"] + 1).otherwise(F.lit(1)).alias("n"), F.greatest(a["most"], F.when(x == a["last"] + 1, a["n"] + 1).otherwise(F.lit(1))).alias("most"))
    return F.aggregate(F.array_sort(places), F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most")), step)["most"]


def verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id) of the items (item_id, words) of FEWEST to WINDOW - 1 words that a document has as they are."""
    sizes = sorted(r[0] for r in items.select(F.size("words")).distinct().collect())
    if not sizes:
        return docs.select("doc_id", "text_hash", F.lit(None).cast("long").alias("item_id")).limit(0)
    values = lambda c: F.transform(c, lambda x: x["value"])

    def all_of(w: Column) -> Column:
        def of(n: int) -> Column:
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, n)))

        return F.array_distinct(F.concat(*map(of, sizes)))

    mine = docs.select("doc_id", "text_hash", F.explode(let(values(canonical(F.col("text"))), all_of)).alias("h"))
    return mine.join(items.select("item_id", F.xxhash64(values(F.col("words"))).alias("h")), "h").select("doc_id", "text_hash", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc_id, text_hash, items, best): documents that hold at least `share` of an item's windows, or RUN of its words in a row.

    Items under WINDOW canonical words match where all their words stand in a row, values
    and all; under FEWEST words they are no evidence and never match, nor do null or empty
    texts; an empty benchmark matches nothing. Equal rows (doc_id and text) are one.
    """
    all_items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), canonical(F.col("text").cast("string")).alias("words"))
    items = all_items.where(F.size("words") >= WINDOW)
    found = items.select("item_id", F.explode(windows(F.col("words"))).alias("w")).select("item_id", "w.h", F.col("w.at").alias("item_at"), F.col("w.slots").alias("item_slots"))
    seen = items.select(F.explode(blocks(F.col("words"), 1)).alias("b")).distinct()
    small = found.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else lambda df: df
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    blocked = docs.select("doc_id", "text_hash", F.explode(blocks(canonical(F.col("text")), BLOCK)).alias("b")).join(hint(seen), "b", "left_semi").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).distinct()
    near = docs.join(blocked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")), "left_semi")
    own = near.select("doc_id", "text_hash", F.explode(windows(canonical(F.col("text")))).alias("w")).select("doc_id", "text_hash", "w.h", "w.at", "w.slots")
    matched = own.join(hint(found), "h").select("doc_id", "text_hash", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), F.zip_with("item_slots", "slots", lambda a, b: F.struct(a["word"].alias("kind"), a["value"].alias("item_value"), b["value"].alias("value"))).alias("slots"))
    along = matched.groupBy("doc_id", "text_hash", "item_id", "diagonal").agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    kinds = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["item_value"])))
    consistent = along.where(F.size(kinds) == F.size("slots")).withColumn("run", longest_run(F.col("places")))
    total = items.select("item_id", (F.size("words") - WINDOW + 1).alias("total")).groupBy("item_id").agg(F.max("total").alias("total"))
    covered = consistent.groupBy("doc_id", "text_hash", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.max("run").alias("run")).join(hint(total), "item_id").withColumn("part", F.least(F.lit(1.0), F.col("n") / F.col("total")))
    hits = covered.where((F.col("part") >= share) | (F.col("run") > RUN - WINDOW)).select("doc_id", "text_hash", "item_id", "part")
    short = all_items.where(F.size("words").between(FEWEST, WINDOW - 1))
    hits = hits.union(verbatim(docs, short).withColumn("part", F.lit(1.0)))
    return hits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("part").alias("best"))


def label(docs: DataFrame, benchmark: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc_id, contaminated, items, best) of every row of documents; repeated rows stay."""
    hits = contaminated(docs, benchmark, share).withColumnRenamed("doc_id", "id")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    joined = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_hash")), "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("best", F.lit(0.0)).alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.3) -> DataFrame:
    """docs, all columns whatever their names, without the rows that label() marks."""
    id_, h = unused(docs, "id", "h")
    hits = contaminated(docs, benchmark, share).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(h))
    return docs.join(hits, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h)), "left_anti")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(share: float = 0.3) -> str:
    """DuckDB's twin of label(), for documents with one row for each doc_id."""
    units = "'kg','mg','km','cm','mm','ml','mph','kmh','lb','lbs','oz','ft','mile','miles','meter','meters','metre','metres','kilometers','kilometres','kilograms','grams','liters','litres','hour','hours','minutes','seconds','days','weeks','months','years','dollars','euros','cents','percent','degrees','usd','eur','stunden','minuten','heures','horas'"
    tokens = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return rf"""
WITH raw AS (SELECT 'd' AS side, doc_id AS id, unnest({tokens}) AS x, generate_subscripts({tokens}, 1) AS i FROM documents
  UNION ALL SELECT 'b', item_id, unnest({tokens}), generate_subscripts({tokens}, 1) FROM benchmark),
pl AS (SELECT *, trim(lower(x), {_quoted(EDGES)}) AS value, lag(x) OVER (PARTITION BY side, id ORDER BY i) AS before FROM raw),
wo AS (SELECT side, id, i, value, CASE WHEN regexp_matches(value, '^[^\p{{L}}]*\d[^\p{{L}}]*$') THEN '{NUMBER}' WHEN value IN ({units}) THEN '{UNIT}'
  WHEN x <> lower(x) AND regexp_matches(x, '^\p{{Lu}}\p{{Ll}}') AND i > 1 AND NOT regexp_matches(before, '[.!?:]$') THEN '{NAME}' ELSE value END AS word FROM pl),
k AS (SELECT side, id, word, value, row_number() OVER (PARTITION BY side, id ORDER BY i) - 1 AS pos FROM wo WHERE word <> ''),
wi AS (SELECT side, id, pos, list(word) OVER z AS words, list(value) OVER z AS slots FROM k WINDOW z AS (PARTITION BY side, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
f AS (SELECT *, len(list_filter(words, lambda w: w IN ('{NUMBER}', '{UNIT}', '{NAME}'))) > {WINDOW - PLAIN} AS bare FROM wi WHERE len(words) = {WINDOW}),
m AS (SELECT d.id AS doc_id, b.id AS item_id, b.pos AS item_at, d.pos - b.pos AS diagonal, d.words, d.slots, b.slots AS item_slots FROM f d JOIN f b ON d.side = 'd' AND b.side = 'b' AND d.words = b.words AND (NOT d.bare OR d.slots = b.slots)),
s AS (SELECT doc_id, item_id, diagonal, unnest(words) AS kind, unnest(item_slots) AS item_value, unnest(slots) AS value FROM m),
bad AS (SELECT DISTINCT doc_id, item_id, diagonal FROM s WHERE kind IN ('{NUMBER}', '{UNIT}', '{NAME}') GROUP BY doc_id, item_id, diagonal, kind, item_value HAVING count(DISTINCT value) > 1),
tot AS (SELECT id AS item_id, count(*) AS total FROM f WHERE side = 'b' GROUP BY id),
ok AS (SELECT DISTINCT m.doc_id, m.item_id, m.diagonal, m.item_at FROM m ANTI JOIN bad ON m.doc_id = bad.doc_id AND m.item_id = bad.item_id AND m.diagonal = bad.diagonal),
isl AS (SELECT doc_id, item_id, diagonal, item_at - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY item_at) AS island FROM ok),
run AS (SELECT doc_id, item_id, max(n) AS run FROM (SELECT doc_id, item_id, diagonal, island, count(*) AS n FROM isl GROUP BY ALL) GROUP BY 1, 2),
cov AS (SELECT ok.doc_id, ok.item_id, least(1.0, count(DISTINCT item_at) / any_value(total)) AS part, any_value(run) AS run FROM ok JOIN tot ON ok.item_id = tot.item_id JOIN run ON ok.doc_id = run.doc_id AND ok.item_id = run.item_id GROUP BY ok.doc_id, ok.item_id),
sh AS (SELECT id AS item_id, count(*) AS n, list(value ORDER BY pos) AS words FROM k WHERE side = 'b' GROUP BY id HAVING count(*) BETWEEN {FEWEST} AND {WINDOW - 1}),
vb AS (SELECT DISTINCT w.id AS doc_id, item_id FROM wi w JOIN sh ON w.side = 'd' AND w.slots[1:n] = sh.words),
hit AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(part) AS best FROM (SELECT doc_id, item_id, part FROM cov WHERE part >= {share} OR run > {RUN - WINDOW} UNION SELECT doc_id, item_id, 1.0 FROM vb) GROUP BY doc_id)
SELECT d.doc_id, h.doc_id IS NOT NULL AS contaminated, coalesce(items, '') AS items, coalesce(best, 0.0)::DOUBLE AS best FROM documents d LEFT JOIN hit h ON d.doc_id = h.doc_id
"""

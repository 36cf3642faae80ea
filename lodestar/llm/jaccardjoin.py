"""Exact Jaccard join of shingle sets, by size: subsets of light sets, inverted lists for heavy ones.

A set of n shingles shares at least c(n) of them, percent of n, with any partner, and two
sets of a and b shingles are linked when they share need(a, b). So

* only shingles that two documents have count. Buckets of documents ask parts of the key
  space how many documents have each of their shingles (`exchange`), and a document that
  shares fewer than c(n) of its own with anybody is alone: most documents end here;
* equal sets are one from here on, however many documents have them;
* light sets, up to a boundary, list all their subsets of the sizes that they must share
  with some partner. Two sets with one such subset are linked if the subset is as large as
  they need, so each subset links its smallest set to the others, and nothing is verified;
* heavy sets scan the inverted lists of their rarest shared shingles, as many as c(n)
  leaves: a partner has one of these. Size, place and the parities of the two sets in 256
  bins rule pairs out without loss, and the sets of what is left are intersected.

The boundary is the size at which both ways together are estimated to cost least, from
exact counts of the sets, subsets and list entries of each size.

A list's sets are not all paired. Neighbours in the order of the sets' min-hashes are
linked first. Lists that still hold sets of different components are looked at again: one
round takes one pair for each pair of groups that seems to be linked, the last takes every
pair of sets in different components that was not tried before. A long list is dealt into
squares of TILE by TILE sets, so no task holds more of it.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange
from .components import connected_components
from .linededup import COUNT, TOLD, squeezed, unsqueezed
from .textops import U, all_words, as_bytes, checkpointed, lean, mix, small_batches

#: Bytes of text in a bucket, and that are taken apart at a time, so that arrays stay in a core's cache.
BUCKET_BYTES, PIECE = 4 << 20, 1 << 17
#: Sets of more shingles are never light: their subsets are too many at any cost of lists.
MOST_LIGHT = 20
#: The cost of comparing two entries of a list against that of making a row.
COMPARE = 0.05
#: Sets of a list that one task compares with as many others, and that it links in order, about.
TILE, NEAR = 1024, 256
#: 64-bit words of a set's parities.
WORDS = 4
ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], np.uint64)
ENTRY = ["key", "id", "n", "s", "place", "least", *(f"f{k}" for k in range(WORDS))]
PAIR = "u long, v long"


def partner(n, percent: int):
    """The fewest shingles that a set of n shares with any partner."""
    return -(-percent * n // 100)


def need(both, percent: int):
    """The fewest shingles that two sets of `both` shingles together share if they are linked."""
    return -(-percent * both // (100 + percent))


def sql_need(both: Column, percent: int) -> Column:
    return F.ceil(both * percent / float(100 + percent) - 1e-9)


def shingled(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each text, in ascending order; fewer words are one shingle."""
    doc, word = all_words(texts, PIECE)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    whole = np.arange(max(0, len(doc) - shingle + 1))
    whole = whole[doc[whole] == doc[whole + shingle - 1]]
    few = np.flatnonzero((count > 0) & (count < shingle))
    full = np.full(len(whole), int(ODD[-1]) * shingle % (1 << 64), np.uint64)
    short = count[few].astype(np.uint64) * ODD[-1]
    for j in range(shingle):
        full += word[whole + j] * ODD[j]
        has = count[few] > j
        short[has] += word[first[few[has]] + j] * ODD[j]
    docs, h = np.concatenate([doc[whole], few]), mix(np.concatenate([full, short]))
    order = np.argsort(h)
    order = order[np.argsort(docs[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    docs, h = docs[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (h[1:] != h[:-1])
    return docs[new], h[new]


def parities(keys: np.ndarray) -> np.ndarray:
    """For each of 64 * WORDS bins, whether an odd number of the keys falls into it."""
    bins = np.bincount((keys % U(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bins.astype(bool), bitorder="little").view(np.int64)


def marked(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n, id, reach, keys) of every row: the size of its set, and the set's id if it may have a partner.

    keys are the shingles that another document has, the rarest first; of equal sets of a
    bucket the first row has them. reach is how many rows the lists of its prefix have.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = exchange.sized(docs, of=BUCKET_BYTES)
    parts = max(64, buckets)
    dealt = exchange.bucketed(docs, buckets, ["doc_id", "text"])

    def ask(t: pa.Table) -> pa.Table:
        h = np.sort(shingled(as_bytes(t["text"]), shingle)[1])
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        entries = np.zeros(len(first), COUNT)
        entries["key"], entries["n"] = h[first] & U(0xFFFFFFFF), np.minimum(np.diff(np.append(first, len(h))), 65535)
        order, part = exchange.by_part(h[first], parts)
        made = exchange.packed(entries[order], part, exchange.bucket_of(t))
        return exchange.rows_table((p, b, squeezed(np.frombuffer(blob, COUNT))) for p, b, blob in made)

    def answer(t: pa.Table) -> pa.Table:
        blobs = [unsqueezed(b, COUNT) for b in t["blob"].to_pylist()]
        entries, index = np.concatenate(blobs), np.concatenate([np.arange(len(b)) for b in blobs])
        bucket = np.repeat(np.array(t["bucket"].to_pylist(), np.int64), [len(b) for b in blobs])
        order = np.argsort(entries["key"], kind="stable")
        key = entries["key"][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        asked = np.diff(np.append(first, len(key)))
        total = np.minimum(np.add.reduceat(entries["n"][order].astype(np.int64), first), 65535)
        shared = np.repeat(asked > 1, asked)
        told = np.zeros(int(shared.sum()), TOLD)
        told["at"], told["n"] = index[order[shared]], np.repeat(total, asked)[shared]
        # a bucket's answers ascend by their place in what it asked, which packs well
        by = np.argsort(told["at"], kind="stable")
        replies = exchange.replied(t["part"][0].as_py(), bucket[order[shared]][by], told[by])
        return exchange.rows_table((p, b, squeezed(np.frombuffer(blob, TOLD))) for p, b, blob in zip(*(replies[c].to_pylist() for c in ("part", "bucket", "blob"))))

    def finish(t: pa.Table, counts: pa.Table) -> pa.Table:
        texts = as_bytes(t["text"]) if len(t) else []
        doc, h = shingled(texts, shingle)
        keys, word, n = np.unique(h, return_inverse=True, return_counts=True)
        by_part, part = exchange.by_part(keys, parts)
        start = np.searchsorted(part, np.arange(parts))
        for p, blob in zip(counts["part"].to_pylist(), counts["blob"].to_pylist()):
            told = unsqueezed(blob, TOLD)
            n[by_part[start[p] + told["at"]]] = told["n"]
        df = np.minimum(n, 65535)[word]
        sizes = np.bincount(doc, minlength=len(texts))
        shared = np.bincount(doc[df > 1], minlength=len(texts))
        may = (sizes > 0) & (shared >= partner(sizes, percent))
        sums = np.zeros(len(texts), np.uint64)
        np.add.at(sums, doc, mix(h ^ ODD[5]))
        ids = mix(sums + sizes.astype(np.uint64) * ODD[7]).view(np.int64)
        use = np.flatnonzero(may[doc] & (df > 1))
        # hashes of a document ascend already
        use = use[np.argsort(df[use].astype(np.uint16), kind="stable")]
        use = use[np.argsort(doc[use].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
        first = np.searchsorted(doc[use], np.arange(len(texts) + 1))
        blobs, reach, seen = [None] * len(texts), [None] * len(texts), set()
        for i in np.flatnonzero(may).tolist():
            if ids[i] not in seen:
                seen.add(ids[i])
                mine = use[first[i] : first[i + 1]]
                blobs[i] = h[mine].tobytes()
                reach[i] = int(df[mine[: len(mine) - partner(int(sizes[i]), percent) + 1]].sum())
        columns = (t["doc_id"] if len(t) else pa.array([], pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64(), mask=~may), pa.array(reach, pa.int64()), pa.array(blobs, pa.binary()))
        return pa.table(list(columns), names=["doc_id", "n", "id", "reach", "keys"])

    return exchange.tell(dealt, exchange.ask(dealt, ask, answer), finish, "doc_id long, n long, id long, reach long, keys binary")


# -- light sets: subsets of fixed sizes -------------------------------------------------


def subset_sizes(n: int, most: int, percent: int) -> list[int]:
    """What a set of n needs to share with partners of up to `most` shingles."""
    return sorted({need(n + b, percent) for b in range(partner(n, percent), min(most, n * 100 // percent) + 1)})


def boundary(sets: DataFrame, percent: int) -> int:
    """The size up to which sets are light, by the estimated cost of both ways; the driver gets a row a size up to MOST_LIGHT."""
    by_size = {r.n: r for r in sets.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.count("*").alias("sets"), F.sum(F.octet_length("keys") / 8).alias("shared"), F.sum("reach").alias("reach")).collect()}

    def light(n: int, most: int) -> float:
        r = by_size[n]
        s = math.ceil(r.shared / r.sets)
        return r.sets * sum(math.comb(s, c) for c in subset_sizes(n, most, percent))

    def heavy(n: int) -> float:
        r = by_size[n]
        return r.shared - r.sets * (partner(n, percent) - 1) + COMPARE * r.reach

    def cost(most: int) -> float:
        return sum(light(n, most) for n in by_size if n <= most) + sum(heavy(n) for n in by_size if n >= partner(most + 1, percent))

    return min(range(MOST_LIGHT + 1), key=cost)


def light_links(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """(u, v): every linked set of up to `most` shingles with the smallest that it shares a subset of a needed size with."""

    def run(batches):
        for b in batches:
            ids, n = b.column("id").to_numpy(), b.column("n").to_numpy()
            keys = [mix(np.frombuffer(x, np.uint64) + ODD[9]) for x in b.column("keys").to_pylist()]
            groups: dict[tuple[int, int], list[int]] = {}
            for i, k in enumerate(keys):
                groups.setdefault((int(n[i]), len(k)), []).append(i)
            for (size, s), rows in groups.items():
                for at in range(0, len(rows), 64):
                    mine = rows[at : at + 64]
                    table = np.stack([keys[i] for i in mine])
                    for c in subset_sizes(size, most, percent):
                        if c > s:
                            continue
                        without = np.array(list(itertools.combinations(range(s), s - c)), np.int64).reshape(math.comb(s, c), s - c)
                        h = mix(table.sum(1, dtype=np.uint64)[:, None] - table[:, without].sum(2, dtype=np.uint64) + ODD[11:12] * U(c))
                        many = h.shape[1]
                        columns = (h.ravel().view(np.int64), np.repeat(ids[mine], many), np.full(h.size, size, np.int64), np.full(h.size, c, np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "id", "n", "c"])

    made = sets.where(F.col("n") <= most).select("id", "n", "keys").mapInArrow(lean(run), "key long, id long, n long, c long")
    first = made.groupBy("key").agg(F.min(F.struct("n", "id")).alias("first"), F.count("*").alias("m")).where("m > 1")
    met = made.join(first, "key").where((F.col("id") != F.col("first.id")) & (sql_need(F.col("n") + F.col("first.n"), percent) <= F.col("c")))
    return met.select(F.least("id", "first.id").alias("u"), F.greatest("id", "first.id").alias("v")).distinct()


# -- heavy sets: inverted lists -----------------------------------------------------------


def list_entries(sets: DataFrame, least: int, percent: int) -> DataFrame:
    """A row ENTRY for each prefix shingle of each set of `least` shingles or more, of lists with two sets at least, with m, the list's length."""

    def run(batches):
        for b in batches:
            rows = []
            for i, n, blob in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("keys").to_pylist()):
                keys = np.frombuffer(blob, np.uint64)
                prefix = keys[: len(keys) - partner(n, percent) + 1].view(np.int64)
                row = np.empty((len(prefix), len(ENTRY)), np.int64)
                row[:, 0], row[:, 1:4], row[:, 4] = prefix, (i, n, len(keys)), np.arange(len(prefix))
                row[:, 5], row[:, 6:] = mix(keys + ODD[13]).min().view(np.int64), parities(keys)
                rows.append(row)
            whole = np.concatenate(rows) if rows else np.zeros((0, len(ENTRY)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in whole.T], ENTRY)

    made = checkpointed(sets.where(F.col("n") >= least).select("id", "n", "keys").mapInArrow(lean(run), ", ".join(f"{c} long" for c in ENTRY)))
    long = made.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return checkpointed(made.join(long, "key"))


def may_link(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether size, place and parities of two entries of a list leave room for a link that this list is the first to show."""
    wanted = sql_need(a["n"] + b["n"], percent)
    differ = sum((F.bit_count(a[f"f{k}"].bitwiseXOR(b[f"f{k}"])) for k in range(WORDS)), F.lit(0))
    sized = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent
    return sized & (F.least(a["s"] - a["place"], b["s"] - b["place"]) >= wanted) & (differ <= a["s"] + b["s"] - 2 * wanted)


def neighbours(entries: DataFrame, percent: int) -> DataFrame:
    """(u, v): each set of a list with the one before it by min-hash, if they may be linked. A long list's min-hashes are dealt into ranges."""
    salt = F.pmod(F.xxhash64("least"), F.ceil(F.col("m") / F.lit(NEAR)))
    order = Window.partitionBy("key", "salt").orderBy("least", "n", "id")
    mine = ["id", "n", "s", "place", *(f"f{k}" for k in range(WORDS))]
    beside = entries.withColumn("salt", salt).select(*mine, F.lag(F.struct(*mine)).over(order).alias("p")).where("p is not null")
    found = beside.where(may_link({c: F.col(c) for c in mine}, {c: F.col(f"p.{c}") for c in mine}, percent))
    return found.select(F.least("id", "p.id").alias("u"), F.greatest("id", "p.id").alias("v")).distinct()


def tile_pairs(x: dict[str, np.ndarray], percent: int, every: bool, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile's entries in different components that may be linked; without `every`, one for each two groups that they join.

    side is 0 or 1 where the tile pairs two different runs of a list, else 2.
    """
    order = np.lexsort((mix(x["id"].view(np.uint64) + ODD[20 + turn]), x["n"]))
    ids, n, s, left, side = x["id"][order], x["n"][order], x["s"][order], (x["s"] - x["place"])[order], x["side"][order]
    f = x["f"][order]
    _, group = np.unique(x["root"][order], return_inverse=True)
    ends = np.searchsorted(n, n * 100 // percent, side="right")
    us, vs = [], []
    for i in range(len(ids) - 1):
        j = i + 1 + np.flatnonzero(group[i + 1 : ends[i]] != group[i])
        if side[i] < 2:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        wanted = need(n[i] + n[j], percent)
        j, wanted = (y[(np.minimum(left[j], left[i]) >= wanted)] for y in (j, wanted))
        differ = np.bitwise_count((f[j] ^ f[i]).view(np.uint64)).sum(1, dtype=np.int64)
        j = j[differ <= s[i] + s[j] - 2 * wanted]
        if not len(j):
            continue
        if not every:
            groups, at = np.unique(group[j], return_index=True)
            j = j[at]
            group[np.isin(group, groups)] = group[i]
        us.append(np.full(len(j), ids[i]))
        vs.append(ids[j])
    none = np.zeros(0, np.int64)
    us, vs = np.concatenate([none, *us]), np.concatenate([none, *vs])
    return np.minimum(us, vs), np.maximum(us, vs)


def open_pairs(entries: DataFrame, roots: DataFrame, percent: int, every: bool, turn: int) -> DataFrame:
    """(u, v) by tile_pairs() of all lists that hold sets of different components."""
    placed = entries.join(roots, F.col("id") == F.col("node"), "left").select(*ENTRY, "m", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    placed = placed.join(mixed, "key")
    tiles = F.ceil(F.col("m") / F.lit(TILE))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("id"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    a, b = F.least("salt", "other"), F.greatest("salt", "other")
    side = F.when(a == b, F.lit(2)).when(F.col("salt") == a, F.lit(0)).otherwise(F.lit(1))
    columns = ["key", "a", "b", "id", "root", "n", "s", "place", "side", *(f"f{k}" for k in range(WORDS))]
    rows = placed.select("key", a.alias("a"), b.alias("b"), "id", "root", "n", "s", "place", side.cast("long").alias("side"), *(f"f{k}" for k in range(WORDS)))

    def pairs(block: np.ndarray):
        x = {c: np.ascontiguousarray(block[:, k]) for k, c in enumerate(columns[:9])} | {"f": np.ascontiguousarray(block[:, 9:])}
        return tile_pairs(x, percent, every, turn)

    def run(batches):
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            blocks = []
            if batch is not None:
                got = np.column_stack([c.to_numpy() for c in batch.columns])
                cuts = np.flatnonzero((got[1:, :3] != got[:-1, :3]).any(1)) + 1
                parts = np.split(got, cuts)
                # a tile may go on from the batch before, and in the next one
                if held and len(got) and (held[-1][-1, :3] != got[0, :3]).any():
                    blocks.append(np.concatenate(held))
                    held = []
                for part in parts[:-1]:
                    blocks.append(np.concatenate([*held, part]))
                    held = []
                if len(got):
                    held.append(parts[-1])
            elif held:
                blocks.append(np.concatenate(held))
            found = [np.column_stack(pairs(block)) for block in blocks]
            found = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k].copy()) for k in (0, 1)], ["u", "v"])

    dealt = rows.repartition(exchange.shuffle_partitions(entries), "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(lean(run), PAIR).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, by the shingles themselves."""
    u, v = (sets.select(F.col("id").alias(c), F.col("n").alias(f"{c}n"), F.col("keys").alias(f"{c}k")) for c in "uv")

    def run(batches):
        for b in batches:
            both = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(b.column("uk").to_pylist(), b.column("vk").to_pylist())], np.int64)
            either = b.column("un").to_numpy() + b.column("vn").to_numpy() - both
            yield b.select(["u", "v"]).filter(pa.array(100 * both >= percent * either))

    return pairs.join(u, "u").join(v, "v").select("u", "v", "un", "vn", "uk", "vk").mapInArrow(lean(run), PAIR)


def set_roots(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the components of sets (id, n, reach, keys); sets without a link do not appear."""
    most = boundary(sets, percent)
    links = light_links(sets, most, percent)
    entries = list_entries(sets, partner(most + 1, percent), percent)
    tested = checkpointed(neighbours(entries, percent))
    links = checkpointed(links.union(verified(tested, sets, percent)))
    for turn in range(2):
        roots = connected_components(links)
        pairs = checkpointed(open_pairs(entries, roots, percent, turn == 1, turn).join(tested, ["u", "v"], "left_anti"))
        if not pairs.isEmpty():
            tested = tested.union(pairs)
            links = checkpointed(links.union(verified(pairs, sets, percent)))
    return connected_components(links)


def similar_documents(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Rows whose sets of distinct shingles have 100 * intersection >= percent * union are
    linked; component_id is the smallest doc_id that links reach, the row's own included.
    A text of fewer words is one shingle; one without words, or null, has none and is
    linked with nothing. A null doc_id is a row, and never a component_id unless its
    component has no other id. Rows of one doc_id and different texts are linked by their
    texts only. Repeated rows stay. Other columns are not read. An empty table gives an
    empty table.
    """
    small_batches(docs.sparkSession)
    rows = checkpointed(marked(docs, shingle, percent))
    sets = checkpointed(rows.where("keys is not null").select("id", "n", "reach", "keys").dropDuplicates(["id"]))
    roots = set_roots(sets, percent)
    # rows of equal sets are counted together before components are
    least = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("id", "component_id")
    alone = rows.where("id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    met = rows.where("id is not null").select("doc_id", "n", "id").join(named, "id").select("doc_id", "n", "component_id")
    return met.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


#: DuckDB's twin of similar_documents(): sets that share a shingle are compared, and links followed.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w),
k AS MATERIALIZED (SELECT row_number() OVER () AS id, s, len(s) AS n FROM (SELECT DISTINCT s FROM s WHERE len(s) > 0)),
x AS MATERIALIZED (SELECT id, n, x FROM (SELECT id, n, unnest(s) AS x FROM k) SEMI JOIN (SELECT x FROM (SELECT unnest(s) AS x FROM k) GROUP BY x HAVING count(*) > 1) y USING (x)),
m AS MATERIALIZED (SELECT * FROM x SEMI JOIN (SELECT id FROM x GROUP BY id, n HAVING 100 * count(*) >= 85 * n) y USING (id)),
p AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON a.x = b.x AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c(a, b) AS (SELECT id, id FROM k UNION SELECT c.a, p.v FROM c JOIN p ON c.b = p.u),
d AS (SELECT k.id, min(doc_id) AS least FROM s JOIN k USING (s) GROUP BY k.id),
e AS (SELECT a AS id, min(least) AS component_id FROM c JOIN d ON c.b = d.id GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(e.component_id, s.doc_id) AS component_id FROM s LEFT JOIN k USING (s) LEFT JOIN e ON k.id = e.id
"""

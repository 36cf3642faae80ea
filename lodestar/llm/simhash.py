"""SimHash near-duplicates: BK-trees over shards of fingerprints that agree on some bits.

Fingerprints within `radius` bits agree on one of radius+1 blocks of bits, and, among
the bits outside it, on one of radius+1 blocks again. Each such (block, block, bits)
is a shard, so a linked pair shares a shard, and no shard is larger than the
fingerprints that its free bits allow. A shard's task builds a BK-tree (children keyed
by their Hamming distance to the parent) and follows only edges within the radius.
Trees travel to shards by a shuffle, not by a broadcast: all trees together grow with
the corpus, and a broadcast of them has no size bound.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .components import connected_components
from .textops import U, as_bytes, checkpointed, mix, small_batches, unused

BITS = 64


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """Bit i is set where over half of the shingles' XXH64 have it; no word gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp long): the 64 bits of each text's SimHash, as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in as_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, fp long")


def blocks(positions: list[int], n: int) -> list[list[int]]:
    return [positions[i * len(positions) // n : (i + 1) * len(positions) // n] for i in range(n)]


def shard_masks(radius: int) -> list[int]:
    """Bit masks such that any two fingerprints within radius agree on all bits of one of them."""
    masks = []
    for block in blocks(list(range(BITS)), radius + 1):
        rest = [i for i in range(BITS) if i not in block]
        masks += [sum(1 << i for i in block + more) for more in blocks(rest, radius + 1)]
    return masks


class BKTree:
    """A Burkhard-Keller tree over integers under Hamming distance."""

    def __init__(self, root: int):
        self.root = (root, {})

    def add(self, value: int) -> None:
        node, children = self.root
        while True:
            d = (node ^ value).bit_count()
            if d == 0:
                return
            if d not in children:
                children[d] = (value, {})
                return
            node, children = children[d]

    def within(self, value: int, radius: int):
        """Members within radius of value; only edges from d-radius to d+radius are followed."""
        todo = [self.root]
        while todo:
            node, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                yield node
            todo += [children[k] for k in range(d - radius, d + radius + 1) if k in children]


def shard_links(members: list[int], radius: int, near_only: bool = False) -> list[tuple[int, int]]:
    """(member, representative) links that join the members of a shard just as all its links would; with near_only both ends lie within the radius."""
    root = {m: m for m in members}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree, met = BKTree(members[0]), []
    for m in members[1:]:
        for near in tree.within(m, radius):
            a, b = find(m), find(near)
            if a != b:
                root[max(a, b)] = min(a, b)
                met.append((m, near))
        tree.add(m)
    if near_only:
        return met
    return [(m, r) for m in members if (r := find(m)) != m]


def fingerprint_links(distinct: DataFrame, radius: int, near_only: bool = False) -> DataFrame:
    """(u, v) links between the fingerprints (fp) that keep all components of the within-radius graph; with near_only they are edges of that graph.

    Shards of one member drop out by a count before their members are gathered.
    """
    masks = shard_masks(radius)
    sharded = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("key")) for i, m in enumerate(masks)])).alias("s"), "fp").select(F.xxhash64("s.m", "s.key").alias("shard"), "fp")

    def run(batches):
        held, at = [], None

        def links(shard, fps):
            fps = sorted({x & (1 << 64) - 1 for x in fps})
            return shard_links(fps, radius, near_only) if len(fps) > 1 else []

        def table(pairs):
            a = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

        for b in batches:
            out = []
            shards, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(shards)] if len(shards) else [0]):
                if shards[lo] != at:
                    if len(held) > 1:
                        out += links(at, held)
                    held, at = [], shards[lo]
                held += fps[lo:hi].tolist()
            yield table(out)
        if len(held) > 1:
            yield table(links(at, held))

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sharded.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of documents.

    Texts whose fingerprints differ in at most `radius` bits are linked; component_id is
    the smallest doc_id that links reach. Equal fingerprints are one node, so exact copies
    cost nothing beyond their row. A null or empty text has fingerprint zero and links like
    any other. A null doc_id stays a row, and is never a component_id unless its component
    has no other id. Repeated rows stay. An empty table gives an empty table.
    """
    fps = checkpointed(fingerprints(docs, shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- similarity of 0.8 or more: BK-trees of SimHash words and then rare shingles propose, wide fingerprints thin out, shingle sets decide ----

WIDE = 4
#: Rows of the sample that tells common shingles, in how many of them a shingle is common, and how many are sent out.
SAMPLE, COMMON, MOST_COMMON = 20_000, 8, 200_000
#: Bits of the map that tells a scan which texts are asked for; others that share a bit are dropped by the join after it.
SLOTS = 1 << 24


def shingle_hashes(text: bytes, shingle: int) -> tuple[int, np.ndarray]:
    """A hash of the word sequence, and the XXH64 of each shingle in order; a text of fewer words is one shingle."""
    words = text.lower().split()
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).astype(np.int64).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist() if words else [0]
    digest = xxhash.xxh64_intdigest
    return digest(line, 7), np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE SimHash words of 64 bits from independent mixes of a set of shingle hashes."""
    ones = np.zeros((WIDE, BITS), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        h = hashes[at : at + (1 << 14)]
        for k in range(WIDE):
            ones[k] += np.unpackbits(mix(h + U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def allowed_bits(similarity: float, bits: int) -> int:
    """Differing bits expected of two fingerprints at a Jaccard similarity, and eight standard deviations.

    No pair at the similarity is lost to it in practice; what passes is still verified.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + 8 * np.sqrt(bits * p * (1 - p)))


def rarest(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order: common ones last, then by hash.

    Sets of a Jaccard similarity of `similarity` or more share one of these, whichever
    shingles count as common, as long as all sets are put into the same order.
    """
    n = len(hashes)
    keep = n - int(np.ceil(similarity * n - 1e-9)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.argsort(common[at] == hashes, kind="stable")]
    return hashes[:keep]


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingle hashes that many rows of a sample have, ascending. Of results nothing hangs on them, only the work does."""
    rate = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).select("text").distinct()

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(x, shingle)[1]) for x in as_bytes(b.column(0))]
            keys, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])

    counts = some.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "k").limit(MOST_COMMON).select("k").toArrow().column(0).to_numpy()
    return np.sort(found.view(np.uint64))


def verified(pairs: DataFrame, distinct: DataFrame, keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of `similarity` or more, by the sets themselves."""
    prints = distinct.select("id", "n", *(f"f{k}" for k in range(WIDE)))
    a, b = (prints.select(*(F.col(c).alias(x + c) for c in prints.columns)) for x in "uv")
    bits = sum((F.bit_count(F.col(f"uf{k}").bitwiseXOR(F.col(f"vf{k}"))) for k in range(WIDE)), F.lit(0))
    near = pairs.join(a, F.col("u") == F.col("uid")).join(b, F.col("v") == F.col("vid"))
    near = checkpointed(near.where((F.least("un", "vn") >= F.lit(similarity - 1e-9) * F.greatest("un", "vn")) & (bits <= allowed_bits(similarity, WIDE * BITS))).select("u", "v"))
    asked = near.select(F.col("u").alias("id")).union(near.select("v")).distinct().join(distinct.select("id", "first.doc", "first.h"), "id")
    slot = F.pmod(F.xxhash64("doc", "h"), F.lit(SLOTS))
    marked = np.zeros(SLOTS, bool)
    for r in asked.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect():
        # bucket b has the values from (b-1)*32768+1 on; value 0 alone is in bucket 0
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little"))
        marked[(bits + (r.b - 1) * 32768 + 1) % SLOTS if r.b > 0 else 0] = True
    wanted = keyed.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def sets(batches):
        mine = np.unpackbits(wanted.value).view(bool)
        for b in batches:
            b = b.filter(pa.array(mine[b.column("slot").to_numpy()]))
            blobs = [np.unique(shingle_hashes(x, shingle)[1]).tobytes() for x in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("h"), pa.array(blobs, pa.binary())], ["doc", "h", "set"])

    def decide(batches):
        for b in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in b.column(k).to_pylist()] for k in (2, 3))
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)], float)
            either = np.array([len(p) + len(q) for p, q in zip(x, y)], float) - both
            yield b.select(["u", "v"]).filter(pa.array(both >= (similarity - 1e-12) * either))

    found = keyed.select("doc", "h", slot.alias("slot"), "text").mapInArrow(sets, "doc long, h long, set binary")
    held = checkpointed(found.join(asked, ["doc", "h"]).select("id", "set").dropDuplicates(["id"]))
    full = near.join(held.select(F.col("id").alias("u"), F.col("set").alias("us")), "u").join(held.select(F.col("id").alias("v"), F.col("set").alias("vs")), "v")
    return full.select("u", "v", "us", "vs").mapInArrow(decide, "u long, v long")


def proposed(distinct: DataFrame, radius: int) -> DataFrame:
    """(u, v): pairs of ids that the BK-trees of operator 2 propose, by the first SimHash word of each.

    Each two fingerprints that a tree links are a pair by their smallest ids, and ids of one
    fingerprint are pairs with the smallest of them.
    """
    least = checkpointed(distinct.groupBy(F.col("f0").alias("fp")).agg(F.min("id").alias("least")))
    near = fingerprint_links(least.select("fp"), radius, near_only=True)
    met = near.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").select("a", "b")
    same = distinct.select(F.col("f0").alias("fp"), "id").join(least, "fp").where("id <> least").select("least", "id")
    return met.union(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def similar_roots(distinct: DataFrame, entries: DataFrame, keyed: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """(node, root) of the components of all pairs at the similarity.

    What the BK-trees propose is verified first, with neighbours by id among each shingle's members (key, id), so a large
    group becomes one component by a few links; at the similarity many fingerprints lie beyond the radius, so then every pair of members that is in
    different components still is verified, so no link that joins components is left out.
    """
    order = Window.partitionBy("key").orderBy("id")
    beside = entries.select("key", "id", F.lag("id").over(order).alias("before"), F.lead("id").over(order).alias("after"))
    shared = checkpointed(beside.where("before is not null or after is not null"))
    first = shared.where("before is not null").select(F.col("before").alias("u"), F.col("id").alias("v"))
    first = checkpointed(proposed(distinct, radius).union(first).distinct())
    links = checkpointed(verified(first, distinct, keyed, shingle, similarity))
    roots = connected_components(links)
    placed = shared.select("key", "id").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    placed = checkpointed(placed.join(mixed, "key"))
    prints = placed.join(distinct.select("id", "n", *(f"f{k}" for k in range(WIDE))), "id").select("key", "id", "root", "n", *(f"f{k}" for k in range(WIDE)))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    allowed = allowed_bits(similarity, WIDE * BITS)

    def pairs(rows: np.ndarray) -> list[np.ndarray]:
        """Pairs of ids in different components that may be similar; rows: (key, id, root, n, f0..f3) of one shingle."""
        rows = rows[np.argsort(rows[:, 1])]
        out = []
        for i in range(len(rows) - 1):
            x, more = rows[i], rows[i + 1 :]
            more = more[(more[:, 2] != x[2]) & (np.minimum(more[:, 3], x[3]) >= (similarity - 1e-9) * np.maximum(more[:, 3], x[3]))]
            more = more[np.bitwise_count((more[:, 4:] ^ x[4:]).view(np.uint64)).sum(1, dtype=np.int64) <= allowed]
            out.append(np.column_stack([np.full(len(more), x[1]), more[:, 1]]))
        return out

    def run(batches):
        held = np.zeros((0, 4 + WIDE), np.int64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = np.concatenate([held, np.column_stack([c.to_numpy() for c in b.columns])])
            # the last key may go on in the next batch
            cuts = np.flatnonzero(np.diff(held[:, 0])) + 1
            blocks = np.split(held, cuts)
            held = blocks.pop() if b is not None else held[:0]
            found = np.concatenate([np.zeros((0, 2), np.int64), *(p for block in blocks for p in pairs(block))])
            found = np.unique(found, axis=0) if len(found) else found
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["u", "v"])

    rest = prints.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct().join(first, ["u", "v"], "left_anti")
    return connected_components(links.union(verified(rest, distinct, keyed, shingle, similarity)))


def one_of_each_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """docs, all columns, with one row of each group of near-duplicates: the one with the smallest (doc_id, text hash).

    Groups are the components of all pairs of texts whose sets of shingles (five words)
    have a Jaccard similarity of `similarity` or more. Candidates are pairs whose SimHash
    words differ in `radius` bits at most, found by BK-trees in shards, and, for similar texts
    beyond it, pairs that share a shingle among the rarest of each set, which loses none;
    those whose wide SimHash
    fingerprints cannot be of similar texts go, and the others' sets are compared. Texts
    with one word sequence, letter case aside, are one node, and of equal rows one stays.
    A null text counts as empty; empty texts are one group. A null doc_id comes first. An
    empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(keyed, shingle))
    names = ["doc", "h", "id", "n", *(f"f{k}" for k in range(WIDE)), "keys"]

    def run(batches):
        for b in batches:
            got = [(i, np.unique(h)) for i, h in (shingle_hashes(x, shingle) for x in as_bytes(b.column("text")))]
            ids = pa.array(np.array([g[0] for g in got], np.uint64).view(np.int64))
            f = np.array([wide_fingerprint(g[1]) for g in got], np.uint64).reshape(-1, WIDE).view(np.int64)
            keys = pa.array([rarest(g[1], common.value, similarity).view(np.int64) for g in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("h"), ids, pa.array([len(g[1]) for g in got], pa.int64()), *(pa.array(f[:, k].copy()) for k in range(WIDE)), keys], names)

    fps = checkpointed(keyed.mapInArrow(run, "doc long, h long, id long, n long, " + ", ".join(f"f{k} long" for k in range(WIDE)) + ", keys array<long>"))
    prints = ["id", "n", *(f"f{k}" for k in range(WIDE))]
    distinct = checkpointed(fps.groupBy(*prints).agg(F.min(F.struct("doc", "h")).alias("first")))
    firsts = fps.join(distinct.select("id", "first.doc", "first.h"), ["id", "doc", "h"], "left_semi").dropDuplicates(["id"])
    entries = firsts.select("id", F.explode("keys").alias("key"))
    roots = similar_roots(distinct, entries, keyed, shingle, similarity, radius)
    chosen = distinct.join(roots, distinct.id == roots.node, "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first")).select("first.*")
    doc, h, first_doc, first_h = unused(docs, "doc", "h", "first_doc", "first_h")
    kept = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), h: F.xxhash64(F.col("text").cast("string"))})
    kept = kept.join(chosen.toDF(first_doc, first_h), (F.col(doc) == F.col(first_doc)) & (F.col(h) == F.col(first_h)), "left_semi")
    # the join has brought equal keys together: of rows with one doc_id and text the least stays
    columns = [F.col(c) for c in docs.columns]
    orderable = [c for c, t in zip(docs.columns, docs.schema) if not isinstance(t.dataType, (MapType, VariantType))]
    return kept.groupBy(doc, h).agg(F.min_by(F.struct(*columns), F.struct(*orderable)).alias("row")).select("row.*")

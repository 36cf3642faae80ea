"""Suffix-array dedup: removes every byte covered by a long string that also starts elsewhere.

Ranking every byte position would move a hundred times the input, so the suffix array is
sparse: each `length`-byte string picks one anchor, the place of the smallest hash of GRAM
bytes in it (leftmost of equals). Equal strings pick the same anchor, so strings can be
equal only where their anchors have equal surroundings, and no string is lost.

Anchors are ranked by prefix doubling. A rank starts as the name of the GRAM bytes at the
anchor. A round pairs it with the name of the bytes at the next offset; pairs are brought
together by their hash, a group's new rank is its first place, and anchors of a rank of
their own drop out. There are two rounds to each side, which take the offset to half a
string right of the anchor, and left of it, as every string has one of the two halves.
(The second of a pair is a name and not a rank, as there is no anchor at the offset.)
Where a whole span of strings that pick an anchor
is repeated, they are settled at once, and one anchor stands for all of that span. What is
left is ranked in steps of STEP neighbouring strings, by the bytes common to them, and at
last string by string, as the pair of the names of its halves. A name is a 64-bit hash of a
rolling polynomial; two are only compared where the names before agree, and what is
removed agrees in a pair of them at least.

Beside that, n_passages tells of shorter passages of words that occur in other texts: of
RUN runs of WORDS words, one after the other, the one with the smallest hash is picked, so
that two texts that share WORDS + RUN - 1 words in a row pick a common run. They ride along
with the first exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .textops import U, all_words, as_bytes, checkpointed, mix, powers, sorted_set, unpowers

GRAM = 32
#: Neighbouring strings that are ranked together before each is ranked alone.
STEP = 32
#: Slots of text hashes by which texts that are not asked for are left where they are. They bound what is broadcast.
SLOTS = 1 << 20
#: Words of a run, and how many runs in a row have one picked.
WORDS, RUN = 32, 19
KEY = np.dtype("<u8")
STRING = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("open", "u1")])
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"
#: done: settled within the bucket, without ranks. twice: the span occurs again in the bucket.
ANCHORS = "bucket int, text long, first int, last int, anchor int, done boolean, twice boolean, rank long, r1 long, r2 long, l1 long, l2 long, s1 long, s2 long"
FOUND = "bucket int, text long, first int, last int"
STEPS = "bucket int, text long, anchor int, first int, last int, open boolean, rank long, core long, h1 long, h2 long"


class Hashed:
    """Hashes of any span of a text from its prefix sums."""

    def __init__(self, text: bytes):
        b = np.frombuffer(text, np.uint8).astype(np.uint64) + U(1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * powers(len(b)), dtype=np.uint64)])
        self.down = unpowers(len(b) + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        """Hashes of [starts, ends); spans of another kind or length never agree but by chance."""
        raw = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * U(0x9FB21C651E98DF25) + U(kind * 0xD6E8FEB86659FD93 % (1 << 64)))

    def grams(self, width: int) -> np.ndarray:
        n = len(self.prefix) - width
        return mix((self.prefix[width:] - self.prefix[:n]) * self.down[:n])


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each window of x, whose lowest bits, as many as a place in a window takes, do not count."""
    n, rows = len(x) - width + 1, -(-len(x) // width)
    bits = U((width - 1).bit_length())
    padded = np.full(rows * width, np.iinfo(np.uint64).max)
    padded[: len(x)] = x
    # a place in a block of the window's width stands in for the lowest bits
    block = padded.reshape(rows, width) >> bits << bits | np.arange(width, dtype=np.uint64)
    prefix = np.minimum.accumulate(block, axis=1).ravel()[width - 1 : width - 1 + n]
    suffix = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    at, mask = np.arange(n), (U(1) << bits) - U(1)
    # a window is the end of one block and the start of the next; of equals the left one counts
    return np.where(suffix >> bits <= prefix >> bits, at // width * width + (suffix & mask).astype(np.int64), (at + width - 1) // width * width + (prefix & mask).astype(np.int64))


def segments(h: Hashed, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): the runs of string starts that pick the same anchor."""
    if size < length:
        return (np.zeros(0, np.int64),) * 3
    anchor = sliding_argmin(h.grams(GRAM), length - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return first, np.append(first[1:], len(anchor)) - 1, anchor[first]


def blocks(h: Hashed, size: int, length: int) -> dict[str, np.ndarray]:
    """The runs of string starts with one anchor, and the names around it.

    rank is the gram's name; r1 and r2 the next bytes up to half a string right of the anchor,
    l1 and l2 up to half a string left of the gram's end; s1 and s2 halve the whole span. A
    side that the text is too short for holds no string and is named by zero.
    """
    first, last, anchor = segments(h, size, length)
    half = length // 2
    near = (half + GRAM) // 2
    to_right, to_left = anchor + half <= size, anchor + GRAM >= half
    named = lambda ok, lo, hi, kind: np.where(ok, h.spans(np.clip(lo, 0, size), np.clip(hi, 0, size), kind) | U(1), U(0))
    middle = (first + last + length) // 2
    return {
        "first": first, "last": last, "anchor": anchor, "rank": h.spans(anchor, anchor + GRAM, 1),
        "r1": named(to_right, anchor + GRAM, anchor + near, 2), "r2": named(to_right, anchor + near, anchor + half, 3),
        "l1": named(to_left, anchor + GRAM - near, anchor, 4), "l2": named(to_left, anchor + GRAM - half, anchor + GRAM - near, 5),
        "s1": h.spans(first, middle, 6), "s2": h.spans(middle, last + length, 7),
    }


class Bucket:
    """The distinct texts of a bucket, by their hash, and how often each occurs."""

    def __init__(self, t: pa.Table):
        self.number = exchange.bucket_of(t)
        self.names = np.array(t["name"].to_pylist(), np.int64)
        self.all = as_bytes(t["text"])
        self.distinct: dict[int, bytes] = dict(zip(self.names.tolist(), self.all))
        self.times = np.unique(self.names, return_counts=True)

    def again(self, name: int) -> bool:
        return bool(self.times[1][np.searchsorted(self.times[0], name)] > 1)


def none_of(schema: str) -> pa.Table:
    """No rows of a schema."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]).empty_table()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def passages(texts: list[bytes]) -> list[np.ndarray]:
    """The names of the picked runs of words of each text, each once."""
    doc, h = all_words(texts)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a < WORDS + RUN - 1:
            out.append(np.zeros(0, np.uint64))
            continue
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[a:b] * powers(b - a), dtype=np.uint64)])
        named = mix((sums[WORDS:] - sums[:-WORDS]) * unpowers(b - a)[: b - a - WORDS + 1])
        out.append(sorted_set(mix(named[sorted_set(sliding_argmin(named, RUN))] ^ U(0xC2B2AE3D27D4EB4F))))
    return out


def gram_names(t: pa.Table, length: int) -> np.ndarray:
    """The gram names of a bucket's anchors and its picked runs of words, each once, or twice if the bucket has it several times."""
    b = Bucket(t)
    got = [np.zeros(0, np.uint64), *(np.repeat(x, 1 + b.again(name)) for name, x in zip(b.distinct, passages(list(b.distinct.values()))))]
    for name, text in b.distinct.items():
        h = Hashed(text)
        _, _, anchor = segments(h, len(text), length)
        got.append(np.repeat(h.spans(anchor, anchor + GRAM, 1), 1 + b.again(name)))
    keys, n = np.unique(np.concatenate(got), return_counts=True)
    return np.repeat(keys, np.minimum(n, 2))


def repeated(t: pa.Table) -> pa.Table:
    """To each bucket its names that were sent more than once."""
    entries, bucket, _ = exchange.unpacked(t, KEY)
    _, inverse, n = np.unique(entries, return_inverse=True, return_counts=True)
    use = (n > 1)[inverse]
    return exchange.replied(t["part"][0].as_py(), bucket[use], entries[use])


def anchors(t: pa.Table, told: pa.Table, length: int) -> pa.Table:
    """ANCHORS rows of a bucket: the anchors whose gram is repeated, those with one and the same span once."""
    b = Bucket(t)
    known = sorted_set(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, KEY) for x in told["blob"].to_pylist())]))
    found: dict[str, list] = {}
    shared = [int(among(x, known).sum()) for x in passages(list(b.distinct.values()))] if len(known) else []
    for name, text in b.distinct.items() if len(known) else ():
        h = Hashed(text)
        got = blocks(h, len(text), length)
        use = among(got["rank"], known)
        for k, v in got.items():
            found.setdefault(k, []).append(v[use])
        found.setdefault("text", []).append(np.full(int(use.sum()), name))
        found.setdefault("twice", []).append(np.full(int(use.sum()), b.again(name)))
    if not found:
        return none_of(ANCHORS)
    told_of = [(name, n) for name, n in zip(b.distinct, shared) if n]
    a = {k: np.concatenate(v) for k, v in found.items()}
    _, first, inverse, n = np.unique(np.stack([a["s1"], a["s2"]], axis=1).view([("a", "<u8"), ("b", "<u8")]).ravel(), return_index=True, return_inverse=True, return_counts=True)
    stands = np.zeros(len(inverse), bool)
    stands[first] = True
    twice = (n > 1)[inverse] | a["twice"]
    # runs that are settled here and follow each other in a text are one
    follows = np.zeros(len(inverse), bool)
    follows[1:] = ~stands[1:] & ~stands[:-1] & (a["text"][1:] == a["text"][:-1]) & (a["first"][1:] == a["last"][:-1] + 1)
    begins = np.flatnonzero(~follows)
    a["last"] = a["last"][(np.append(begins[1:], len(inverse)) - 1)[: len(begins)]]
    a |= {k: v[begins] for k, v in a.items() if k != "last"}
    inverse, stands, twice = inverse[begins], stands[begins], twice[begins]
    ints = lambda x: pa.array(x.astype(np.int32))
    # rows of a text's shared passages: none is at -1, their number stands for the last
    extra = pa.table([ints(np.full(len(told_of), b.number)), pa.array([x for x, _ in told_of], pa.int64()), ints(np.full(len(told_of), -1)), pa.array([n for _, n in told_of], pa.int32()), ints(np.full(len(told_of), -1)), pa.array([True] * len(told_of), pa.bool_()), pa.array([False] * len(told_of), pa.bool_()), *[pa.array([0] * len(told_of), pa.int64())] * 7], names=[f.split()[0] for f in ANCHORS.split(", ")])
    columns = [ints(np.full(len(inverse), b.number)), pa.array(a["text"]), ints(a["first"]), ints(a["last"]), ints(a["anchor"]), pa.array(~stands), pa.array(twice), *(signed(a[k]) for k in ("rank", "r1", "r2", "l1", "l2", "s1", "s2"))]
    return pa.concat_tables([pa.table(columns, names=extra.schema.names), extra])


def steps(t: pa.Table, told: pa.Table, length: int, step: int) -> pa.Table:
    """STEPS rows: the strings [first, last] of what is still in question, `step` neighbours at a time.

    Strings are dealt by their distance to the anchor, so equal ones fall into one step
    wherever their run begins. core names the bytes that all strings of a whole step have in
    common, h1 and h2 halve the bytes from the first to the last of these strings.
    """
    texts = Bucket(t).distinct if len(t) and len(told) else {}
    names = [f.split()[0] for f in STEPS.split(", ")]
    out: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in names}
    if texts:
        q = {c: np.array(told[c].to_pylist()) for c in ("text", "anchor", "first", "last", "open", "rank")}
        order = np.argsort(q["text"], kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(q["text"][order])) + 1):
            h = Hashed(texts[int(q["text"][mine[0]])])
            anchor, lo, hi = (q[c][mine].astype(np.int64) for c in ("anchor", "first", "last"))
            # the farthest string of a run has the greatest distance
            least, most = (anchor - hi) // step, (anchor - lo) // step
            n = most - least + 1
            row = np.repeat(np.arange(len(mine)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + least[row]
            near, far = anchor[row] - k * step, anchor[row] - k * step - step + 1
            first, last = np.maximum(far, lo[row]), np.minimum(near, hi[row])
            middle = (first + last + length) // 2
            mine = mine[row]
            made = {
                "text": q["text"][mine], "anchor": anchor[row], "first": first, "last": last, "open": q["open"][mine], "rank": q["rank"][mine],
                "core": (h.spans(near, far + length, 8) + k.astype(np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64),
                "h1": h.spans(first, middle, 9).view(np.int64), "h2": h.spans(middle, last + length, 10).view(np.int64),
            }
            for c, v in made.items():
                out[c].append(v)
    number = exchange.bucket_of(t) if len(t) else 0
    flat = {c: np.concatenate(v) for c, v in out.items() if c != "bucket"} | {"bucket": np.full(sum(map(len, out["text"])), number)}
    kinds = {"int": np.int32, "long": np.int64, "boolean": bool}
    return pa.table([pa.array(flat[f.split()[0]].astype(kinds[f.split()[1]])) for f in STEPS.split(", ")], names=names)


def single(t: pa.Table, told: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, STRING entry) of each string of what is still in question; equal strings have equal names of their halves."""
    q = steps(t, told, length, 1)
    entries = np.zeros(len(q), STRING)
    entries["h1"], entries["h2"], entries["open"] = (q[c].to_numpy() for c in ("h1", "h2", "open"))
    return q["text"].to_numpy(), q["first"].to_numpy(), entries


def string_names(entries: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.stack([entries["h1"], entries["h2"]], axis=1)).view([("a", "<u8"), ("b", "<u8")]).ravel()


def repeated_strings(t: pa.Table) -> pa.Table:
    """To each bucket its open strings that were sent more than once."""
    entries, bucket, _ = exchange.unpacked(t, STRING)
    _, inverse, n = np.unique(string_names(entries), return_inverse=True, return_counts=True)
    use = (n > 1)[inverse] & (entries["open"] == 1)
    return exchange.replied(t["part"][0].as_py(), bucket[use], entries[use])


def among(asked: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(asked), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)] == asked


def reranked(rows: DataFrame, pair: list[str]) -> DataFrame:
    """rows whose pair of names is shared by several rows, one of them open, with the group's first place as their rank.

    Groups are counted before the rows are dealt by them, so a hot pair is one row of the
    counts; the join's side of many rows is split where one key has most of them.
    """
    groups = rows.groupBy(*pair).agg(F.count("*").alias("n"), F.max("open").alias("any"), F.min("place").alias("least")).where("n > 1 and any")
    groups = groups.select(*(F.col(c).alias(f"_{c}") for c in pair), "least")
    on = [F.col(c) == F.col(f"_{c}") for c in pair]
    return rows.join(groups, on).withColumn("rank", F.col("least")).drop("least", *(f"_{c}" for c in pair))


def settled_by(rows: DataFrame, span: list[str], twice: str) -> DataFrame:
    """rows with `settled`, whether their span is repeated, and `stands`, whether they are the first of it or open."""
    groups = rows.groupBy(*span).agg(F.count("*").alias("n"), F.max(twice).alias("again"), F.min("place").alias("least")).where("n > 1 or again")
    groups = groups.select(*(F.col(c).alias(f"_{c}") for c in span), "least")
    joined = rows.join(groups, [F.col(c) == F.col(f"_{c}") for c in span], "left")
    return joined.withColumns({"settled": F.col("least").isNotNull(), "stands": F.col("least").isNull() | (F.col("least") == F.col("place"))}).drop("least", *(f"_{c}" for c in span))


def removal(texts: list[bytes], docs: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text the maximal runs [start, end) that strings starting in [first, last] cover."""
    out = []
    order = np.lexsort((first, docs))
    docs, first, end = docs[order], first[order], last[order] + length
    cut = np.searchsorted(docs, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        lo, hi = first[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]]
        if not len(lo):
            out.append(np.zeros((0, 2), np.int64))
            continue
        reach = np.maximum.accumulate(hi)
        new = np.concatenate([[True], lo[1:] > reach[:-1]])
        out.append(np.stack([lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]], axis=1))
    return out


def kept_of(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, length: int = 400, text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages) of every row of documents.

    n_passages counts picked runs of words that occur in another place too; nothing is
    removed for them. With text=True the remaining bytes follow in column kept. A null text is empty; a text
    shorter than `length` bytes keeps everything. Strings of the same row count as
    elsewhere if they start at another byte, overlapping or not; repeated rows are each
    other's elsewhere. Other columns are not read. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("name", F.xxhash64("text"))
    buckets = exchange.sized(docs, of=4 << 20)
    parts = max(64, buckets)
    dealt = exchange.bucketed(docs, buckets, ["doc_id", "text"])
    slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS)).alias("slot")

    def slots(told: DataFrame) -> DataFrame:
        """The slots of the texts that are told something: SLOTS rows at most."""
        return F.broadcast(told.select(slot("text")).distinct())

    def asked_for(told: DataFrame) -> DataFrame:
        """The documents of those slots, dealt as before; others stay."""
        return exchange.bucketed(docs.join(slots(told), slot("name") == F.col("slot"), "left_semi"), buckets, ["doc_id", "text"])

    def requests(t: pa.Table) -> pa.Table:
        keys = gram_names(t, length)
        return exchange.rows_table(exchange.packed(keys, exchange.part_of(keys, parts), exchange.bucket_of(t)))

    def find(t: pa.Table, told: pa.Table) -> pa.Table:
        return anchors(t, told, length) if len(t) else none_of(ANCHORS)

    found = exchange.tell(dealt, exchange.ask(dealt, requests, repeated), find, ANCHORS)
    found = checkpointed(found.withColumn("place", F.monotonically_increasing_id()))
    ranked = settled_by(found.where("not done"), ["s1", "s2"], "twice")
    ranked = checkpointed(ranked.withColumn("open", ~F.col("settled")))
    standing = ranked.where("stands").select("bucket", "text", "first", "last", "anchor", "open", "place", "rank", "r1", "r2", "l1", "l2")

    # doubling to the right, and to the left; strings with half of theirs right of the anchor, and the others
    half, split = length // 2, F.col("anchor") - (length - length // 2)
    sides = []
    for one, two, lo, hi in (("r1", "r2", F.greatest("first", split), F.col("last")), ("l1", "l2", F.col("first"), F.least("last", split - 1))):
        side = standing.where(F.col(one) != 0).withColumns({"first": lo, "last": hi}).where("first <= last").select("bucket", "text", "first", "last", "anchor", "open", "place", "rank", one, two)
        side = reranked(reranked(side, ["rank", one]), ["rank", two])
        sides.append(side.select("bucket", "text", "anchor", "first", "last", "open", "rank"))
    left = checkpointed(sides[0].union(sides[1]))

    # steps of neighbours: unlike in what all have in common they drop out, alike as a whole they are settled
    asked = exchange.tell(asked_for(left), left, lambda t, told: steps(t, told, length, STEP), STEPS)
    made = checkpointed(asked.withColumn("place", F.monotonically_increasing_id()))
    hulls = checkpointed(settled_by(reranked(made, ["rank", "core"]).withColumn("never", F.lit(False)), ["rank", "h1", "h2"], "never").drop("core", "h1", "h2", "never"))
    left = hulls.where("stands").select("bucket", "text", "anchor", "first", "last", (F.col("open") & ~F.col("settled")).alias("open"), "rank")

    # string by string, packed
    def strings(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return exchange.rows_table([])
        _, _, entries = single(t, told, length)
        distinct, n = np.unique(entries, return_counts=True)
        entries = np.repeat(distinct, np.minimum(n, 2))
        return exchange.rows_table(exchange.packed(entries, exchange.part_of(entries["h1"], parts), exchange.bucket_of(t)))

    def again(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return none_of(FOUND)
        texts, starts, entries = single(t, told.filter(told["blob"].is_null()), length)
        known = np.concatenate([np.zeros(0, STRING), *(np.frombuffer(b, STRING) for b in told["blob"].to_pylist() if b)])
        hit = np.isin(string_names(entries), string_names(known)) & (entries["open"] == 1)
        texts, starts = texts[hit], starts[hit]
        return pa.table([pa.array(np.full(len(texts), exchange.bucket_of(t), np.int32)), pa.array(texts), pa.array(starts), pa.array(starts)], names=["bucket", "text", "first", "last"])

    texts_left = asked_for(left)
    replies = exchange.tell(texts_left, left, strings, exchange.BLOB).groupBy("part").applyInArrow(exchange.one(repeated_strings), exchange.BLOB)
    told = left.withColumn("blob", F.lit(None).cast("binary")).unionByName(replies.select("bucket", "blob"), allowMissingColumns=True)
    gone = [hulls.where("open and settled").select("bucket", "text", "first", "last"), checkpointed(exchange.tell(texts_left, told, again, FOUND))]
    spans = ranked.where("settled").select("bucket", "text", "first", "last").union(found.where("done").select("bucket", "text", "first", "last")).union(gone[0]).union(gone[1])

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return none_of(SCHEMA + (", kept binary" if text else ""))
        names, texts = np.array(t["name"].to_pylist(), np.int64), as_bytes(t["text"])
        owner, first, last = (np.array(told[c].to_pylist(), np.int64) for c in ("text", "first", "last"))
        distinct, inverse = np.unique(names, return_inverse=True)
        shared = dict(zip(owner[first < 0].tolist(), last[first < 0].tolist()))
        owner, first, last = owner[first >= 0], first[first >= 0], last[first >= 0]
        runs = removal(list(range(len(distinct))), np.searchsorted(distinct, owner), first, last, length)
        runs = [runs[i] for i in inverse]
        left = [kept_of(x, r) for x, r in zip(texts, runs)]
        columns = {
            "doc_id": t["doc_id"].combine_chunks(),
            "n_bytes": pa.array([len(x) for x in texts], pa.int64()),
            "n_removed": pa.array([len(x) - len(y) for x, y in zip(texts, left)], pa.int64()),
            "n_spans": pa.array([len(r) for r in runs], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(y).hexdigest() for y in left], pa.string()),
            "n_passages": pa.array([shared.get(x, 0) for x in names.tolist()], pa.int64()),
        }
        return pa.table(columns | ({"kept": pa.array(left, pa.binary())} if text else {}))

    cut = exchange.tell(asked_for(spans), spans, finish, SCHEMA + (", kept binary" if text else ""))
    whole = docs.join(slots(spans), slot("name") == F.col("slot"), "left_anti")
    same = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(0).cast("long").alias("n_passages"), *([F.col("text").cast("binary").alias("kept")] if text else []))
    return cut.union(same)

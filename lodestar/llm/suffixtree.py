"""Language-model scores: a probabilistic suffix tree over bytes, beside an exact unigram base.

Symbols are the bytes of the lower-cased text, each run of white space after a word being
one space, and none before the first; the line feed, which that leaves free, ends a text
and fills the context before it. Contexts have up to NEAR symbols, or FAR. A context is
kept if it occurs `least` times or more and its next-symbol distribution diverges from the
one that its longest kept suffix gives (count times the Kullback-Leibler divergence of at
least `divergence` nats). Kept distributions mix with their suffix's in Witten-Bell's
manner, down to the uniform one. A text is scored by the longest kept suffix state at each
of its symbols.

All training texts are counted, in three passes. The first counts strings of NEAR + 1
symbols, which settles contexts of up to NEAR. A context of FAR symbols can occur `least`
times only if all strings of NEAR + 1 in it do: the second pass counts the hashes of such
contexts, and the third the next symbols of those whose hash occurs often enough. What the
filters let through by chance is counted exactly in the end, so they lose and add nothing.
Counts are merged, and contexts tested, on the executors, in parts by the newest two
symbols. `least` is a number of occurrences, so the tree grows with the corpus; it travels
in pieces of about PIECE entries, of which a worker holds one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .textops import SPACE, Shipped, U, all_words, as_bytes, checkpointed, crc_bucket, laid_out, mix, pieces, small_batches, sorted_set

NEAR, FAR = 5, 8
END_SYMBOL = 10
LEVELS = (*range(1, NEAR + 1), FAR)
#: The most slots of the filters between the passes, in bits, and the segments that they are merged by.
MOST_BITS, SEGMENTS = 33, 64
#: Symbols that are worked on at once, about; few enough for a processor's cache.
RUN = 1 << 18
#: Bytes of text whose words are found at a time, so that their arrays stay in a core's cache.
PIECE_BYTES = 1 << 17
#: Entries of a piece of the tree.
PIECE = 4_000_000
ASKED = np.dtype([("key", "<u8"), ("n", "<u4")])
TOLD = np.dtype([("at", "<u4"), ("n", "<u8")])
#: A slot of a table: key and value side by side, fetched as one.
SLOT = np.dtype([("key", "<u8"), ("value", "<f8")])
END = U(0xA5A5F00DE17DBEEF)
#: What stands in an empty slot of a table. A key of this value is never looked for: as a context it is eight bytes of 0xFF, which no text has.
EMPTY = U(0xFFFFFFFFFFFFFFFF)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double"
#: Rows of the tree: kind 0 has contexts with the logarithm of their share for unseen symbols, kind 1 context and next symbol with the logarithm of the
#: probability, kind 2 frequent strings of NEAR + 1 symbols with that of their last symbol in the longest kept state of NEAR symbols at most.
TREE = "part int, level int, kind int, keys binary, next binary, logs binary"


# -- symbols ---------------------------------------------------------------------------------------

def sequences(texts: list[bytes]):
    """Yields (document index, symbols before, symbols) of each piece of each text, in order."""
    doc, before = -1, np.full(FAR, END_SYMBOL, np.uint8)
    for chunk in pieces(texts, RUN):
        buf, docs, at = laid_out(chunk)
        space = SPACE[buf]
        keep = ~space
        keep[1:-1] |= space[1:-1] & ~space[:-2]
        symbols = np.where(space, np.uint8(32), buf)
        for k, lo in enumerate(at):
            hi = lo + len(chunk[k][1])
            s = symbols[lo:hi][keep[lo:hi]]
            if docs[k] != doc:
                doc, before = int(docs[k]), np.full(FAR, END_SYMBOL, np.uint8)
            yield doc, before, s
            before = np.concatenate([before, s])[-FAR:]


def runs(texts: list[bytes]):
    """Yields (document, context, next) arrays, an entry for each predicted symbol; a context is its FAR last symbols, the newest lowest."""
    docs: list[int] = []
    held: list[np.ndarray] = []
    size = 0
    for doc, before, s in sequences(texts):
        if docs and docs[-1] != doc:
            held[-1] = np.append(held[-1], np.uint8(END_SYMBOL))
            if size > RUN:
                yield coded(docs, held)
                docs, held, size = [], [], 0
        docs.append(doc)
        held.append(np.concatenate([before, s]))
        size += len(s)
    if docs:
        held[-1] = np.append(held[-1], np.uint8(END_SYMBOL))
        yield coded(docs, held)


def coded(docs: list[int], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate(held)
    sizes = np.array([len(h) for h in held])
    real = np.ones(len(flat) - FAR, bool)
    first = np.cumsum(sizes)[:-1]
    for j in range(FAR):
        real[first - FAR + j] = False
    # every place's FAR symbols, read as one number where they lie
    context = np.ndarray(len(flat) - FAR, ">u8", flat, strides=(1,))
    return np.repeat(docs, sizes - FAR), context[real].astype(np.uint64), flat[FAR:][real]


def low(context: np.ndarray, k: int) -> np.ndarray:
    """The newest k symbols of contexts."""
    return context if k == FAR else context & U((1 << 8 * k) - 1)


def part_of(context: np.ndarray, parts: int) -> np.ndarray:
    """The part of a context, by its newest two symbols."""
    return (mix(low(context, 2)) % U(parts)).astype(np.int64)


def slot_of(x: np.ndarray, bits: int) -> np.ndarray:
    return (x * U(0x9E3779B97F4A7C15) >> U(64 - bits)).astype(np.int64)


class Bits:
    """A bitmap of slots of keys, packed to stay in a processor's cache."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.bits = packed, int(np.log2(len(packed) * 8))

    @staticmethod
    def of(keys: np.ndarray) -> Bits:
        bits = max(10, int(np.log2(max(1, len(keys)))) + 4)
        marks = np.zeros(1 << bits, bool)
        marks[slot_of(keys, bits)] = True
        return Bits(np.packbits(marks, bitorder="little"))

    def has(self, x: np.ndarray) -> np.ndarray:
        at = slot_of(x, self.bits)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).view(bool)


# -- counts ----------------------------------------------------------------------------------------

def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n[:0]


class Counter:
    """Counts of 64-bit keys; keys wait as they are, to be sorted many at a time, and counts wait to be merged."""

    def __init__(self, wait: int = 6_000_000):
        self.wait, self.raw, self.waiting = wait, [], 0
        self.keys, self.n, self.counted = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.waiting += len(keys)
        if self.waiting > self.wait:
            self.count()

    def count(self) -> None:
        keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *self.raw]))
        self.raw, self.waiting = [], 0
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
        self.put(keys[cut[:-1]], np.diff(cut))

    def put(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Adds keys that are counted already."""
        self.keys.append(keys)
        self.n.append(n.astype(np.int64))
        self.counted += len(keys)
        if len(self.keys) > 1 and self.counted > max(self.wait, 2 * len(self.keys[0])):
            self.merge()

    def merge(self) -> None:
        keys, n = added(np.concatenate([np.zeros(0, np.uint64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.n]))
        self.keys, self.n, self.counted = [keys], [n], len(keys)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.raw:
            self.count()
        if len(self.keys) != 1:
            self.merge()
        return self.keys[0], self.n[0]


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of one length, the first as differences, by byte and compressed."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in (first, *columns[1:]))
    return len(first).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(blob: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 0, []
    widths = [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n * sum(widths), codec="zstd", asbytes=True), np.uint8)
    for k, w in zip(kinds, widths):
        out.append(np.ascontiguousarray(planes[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def in_parts(part: np.ndarray, level: int, *columns: np.ndarray):
    """Yields a batch (part, level, blob) for each part that the columns have rows of, which keep their order."""
    # places of 16 bits are sorted by counting
    order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(first.tolist(), np.append(first[1:], len(part)).tolist()):
        yield pa.RecordBatch.from_arrays([pa.array([part[lo]], pa.int32()), pa.array([level], pa.int32()), pa.array([squeezed(*(c[lo:hi] for c in columns))], pa.binary())], ["part", "level", "blob"])


def counted(docs: DataFrame, keys_of, parts: int, part, level: int) -> DataFrame:
    """(part, level, blob) of the counts of all keys that keys_of(document, context, next) gives, in parts by part(keys)."""
    def run(batches):
        held = Counter()
        for b in batches:
            for run_ in runs(as_bytes(b.column(0))):
                held.add(keys_of(*run_))
        keys, n = held.total()
        yield from in_parts(part(keys), level, keys, n)

    return docs.select("text").mapInArrow(run, "part int, level int, blob binary").repartition(parts, "part")


def merged(t: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
    held = Counter(2_000_000)
    for blob, k in zip(t["blob"].to_pylist(), t["level"].to_pylist()):
        if k == level:
            held.put(*unsqueezed(blob, np.uint64, np.int64))
    return held.total()


def often(counts: DataFrame, level: int, least: int, bits: int) -> Bits:
    """A bitmap of the slots of all keys of the counts that occur `least` times or more; segments of it are joined on the executors."""
    width = (1 << bits) // 8 // SEGMENTS

    def mark(t: pa.Table) -> pa.Table:
        keys, n = merged(t, level)
        at = np.unique(slot_of(keys[n >= least], bits))
        rows = []
        for segment in np.unique(at // (8 * width)).tolist():
            marks = np.zeros(8 * width, bool)
            marks[at[at // (8 * width) == segment] % (8 * width)] = True
            rows.append((segment, pa.compress(np.packbits(marks, bitorder="little").tobytes(), codec="zstd", asbytes=True)))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["segment", "bits"])

    def join(t: pa.Table) -> pa.Table:
        marks = np.zeros(width, np.uint8)
        for b in t["bits"].to_pylist():
            marks |= np.frombuffer(pa.decompress(b, decompressed_size=width, codec="zstd", asbytes=True), np.uint8)
        return pa.table([t["segment"].slice(0, 1), pa.array([marks.tobytes()], pa.binary())], names=["segment", "bits"])

    rows = counts.groupBy("part").applyInArrow(mark, "segment int, bits binary").groupBy("segment").applyInArrow(join, "segment int, bits binary").collect()
    out = np.zeros((SEGMENTS, width), np.uint8)
    for r in rows:
        out[r.segment] = np.frombuffer(r.bits, np.uint8)
    return Bits(out.ravel())


# -- the tree --------------------------------------------------------------------------------------

def tested(keys: np.ndarray, next_: np.ndarray, n: np.ndarray, below: np.ndarray, least: int, divergence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (context, next) in order of context with counts, and the probabilities that the suffix gives: the kept contexts and their
    shares for unseen symbols, which pairs are kept, their probabilities, and of all pairs the probability in the longest kept state."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, below, np.zeros(0, bool), below, below
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    total, kinds = np.add.reduceat(n, first).astype(float), np.diff(np.append(first, len(keys)))
    nats = np.add.reduceat(n * np.log(n / total[row] / below), first)
    keep = (total >= least) & (nats >= divergence)
    own = (n + kinds[row] * below) / (total + kinds)[row]
    use = keep[row]
    return keys[first[keep]], (kinds / (total + kinds))[keep], use, own[use], np.where(use, own, below)


class Table:
    """64-bit keys to numbers by open addressing, for arrays of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        number = np.arange(len(keys))
        # home and number as one key: a sort of numbers in place of one of their order
        joint = np.sort(slot_of(keys, self.bits) << 31 | number)
        home, order = joint >> 31, joint & ((1 << 31) - 1)
        at = np.maximum.accumulate(home - number) + number if len(keys) else home
        self.far = int((at - home).max()) if len(keys) else 0
        filled = np.zeros(len(keys), SLOT)
        filled["key"], filled["value"] = keys[order], values[order]
        # an empty slot has a key that no slot of its place can have
        self.rows = np.zeros((1 << self.bits) + self.far + 1, SLOT)
        self.rows["key"] = EMPTY
        self.rows[at] = filled

    def get(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values) of the asked keys."""
        at = slot_of(asked, self.bits)
        rows = self.rows[at]
        found, value = rows["key"] == asked, rows["value"]
        todo = np.flatnonzero(~found)
        todo = todo[rows["key"][todo] != EMPTY]
        for d in range(1, self.far + 1):
            if not len(todo):
                break
            rows = self.rows[at[todo] + d]
            hit = rows["key"] == asked[todo]
            found[todo[hit]], value[todo[hit]] = True, rows["value"][hit]
            todo = todo[~hit & (rows["key"] != EMPTY)]
        return found, value


def pair_key(context: np.ndarray, next_: np.ndarray) -> np.ndarray:
    return context * U(0xD6E8FEB86659FD93) + (next_.astype(np.uint64) + U(1)) * U(0xA0761D6478BD642F)


class Root:
    """Probabilities without a context and after one symbol, as dense tables."""

    def __init__(self, pairs: np.ndarray, least: int = 1, divergence: float = 0.0):
        """pairs: counts of (symbol before, next)."""
        n = pairs.sum(0).astype(float)
        kinds = max(1, (n > 0).sum())
        self.none = (n + kinds / 256) / (n.sum() + kinds)
        total, many = pairs.sum(1, keepdims=True), np.maximum((pairs > 0).sum(1, keepdims=True), 1)
        nats = (pairs * np.log(np.maximum(pairs, 1e-300) / np.maximum(total, 1) / self.none)).sum(1)
        keep = (total[:, 0] >= least) & (nats >= divergence)
        self.one = np.where(keep[:, None], (pairs + many * self.none) / (total + many), self.none)


class Piece:
    """Kept contexts of two symbols or more, of some parts."""

    def __init__(self, rows: list):
        self.share, self.pairs = {}, {}
        self.far: Bits | None = None
        usual = [(np.frombuffer(k, np.uint64), np.frombuffer(v, np.float32)) for _, kind, k, _, v in rows if kind == 2]
        self.usual = Table(*(np.concatenate(x) for x in zip(*usual))) if usual else Table(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        for level in LEVELS[1:]:
            mine = [r for r in rows if r[0] == level and r[1] < 2]
            contexts = [np.frombuffer(k, np.uint64) for _, kind, k, _, _ in mine if kind == 0]
            if sum(map(len, contexts)):
                if level == FAR:
                    self.far = Bits.of(np.concatenate(contexts))
                self.share[level] = Table(np.concatenate(contexts), np.concatenate([np.frombuffer(v, np.float32) for _, kind, _, _, v in mine if kind == 0]))
                keys = [pair_key(np.frombuffer(k, np.uint64), np.frombuffer(x, np.uint8)) for _, kind, k, x, _ in mine if kind == 1]
                self.pairs[level] = Table(np.concatenate(keys), np.concatenate([np.frombuffer(v, np.float32) for _, kind, _, _, v in mine if kind == 1]))

    def near(self, context: np.ndarray, next_: np.ndarray, root: np.ndarray) -> np.ndarray:
        """log10 of the probability of each next symbol in the longest kept state of NEAR symbols at most."""
        out = np.zeros(len(context))
        todo = np.arange(len(context))
        for level in sorted((k for k in self.share if k <= NEAR), reverse=True):
            c = low(context[todo], level)
            kept, share = self.share[level].get(c)
            mine = np.flatnonzero(kept)
            seen, value = self.pairs[level].get(pair_key(c[mine], next_[todo[mine]]))
            out[todo[mine]] += np.where(seen, value, share[mine])
            done = np.zeros(len(todo), bool)
            done[mine[seen]] = True
            todo = todo[~done]
        out[todo] += root[(context[todo] & U(255)).astype(np.int64) * 256 + next_[todo]]
        return out

    def log10(self, context: np.ndarray, next_: np.ndarray, root: np.ndarray) -> np.ndarray:
        """log10 of the probability of each next symbol in the longest kept state of its context.

        Symbols seen after a kept context of FAR symbols are settled by it. Of the others, frequent strings
        are looked up as a whole, the rest level by level.
        """
        out = np.zeros(len(context))
        todo = np.ones(len(context), bool)
        if FAR in self.share:
            mine = np.flatnonzero(self.far.has(context))
            seen, value = self.pairs[FAR].get(pair_key(context[mine], next_[mine]))
            out[mine[seen]], todo[mine[seen]] = value[seen], False
            mine = mine[~seen]
            kept, share = self.share[FAR].get(context[mine])
            out[mine[kept]] = share[kept]
        todo = np.flatnonzero(todo)
        context, next_ = context[todo], next_[todo]
        found, logs = self.usual.get(low(context, NEAR) << U(8) | next_.astype(np.uint64))
        rest = np.flatnonzero(~found)
        logs[rest] = self.near(context[rest], next_[rest], root)
        out[todo] += logs
        return out


class SuffixTree:
    """A root, and the pieces of the tree below it as broadcasts, of which one is held at a time."""

    def __init__(self, root: Root, shipped: list[Shipped], parts: int, piece_of: np.ndarray):
        self.root, self.shipped, self.parts, self.piece_of = np.log10(root.one).ravel(), shipped, parts, piece_of
        self.held: tuple[int, Piece | None] = (-1, None)

    def piece(self, i: int) -> Piece:
        if self.held[0] != i:
            self.held = (-1, None)
            self.held = (i, Piece(self.shipped[i].value))
            self.shipped[i].release()
        return self.held[1]

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text, its end included."""
        out = np.zeros(len(texts))
        for i in range(max(1, len(self.shipped))):
            for doc, context, next_ in runs(texts):
                if not self.shipped:
                    logs = self.root[(context & U(255)).astype(np.int64) * 256 + next_]
                elif len(self.shipped) == 1:
                    logs = self.piece(0).log10(context, next_, self.root)
                else:
                    mine = self.piece_of[part_of(context, self.parts)] == i
                    doc, logs = doc[mine], self.piece(i).log10(context[mine], next_[mine], self.root)
                out += np.bincount(doc, logs, len(texts))
        return out


def fit(docs: DataFrame, least: int = 500, divergence: float = 40.0) -> SuffixTree:
    """The tree of all texts of docs."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    parts = max(64, exchange.shuffle_partitions(docs))
    string = lambda doc, context, next_: low(context, NEAR) << U(8) | next_.astype(np.uint64)
    near = checkpointed(counted(docs, string, parts, lambda keys: part_of(keys >> U(8), parts), NEAR))

    def two(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                keys, n = unsqueezed(blob, np.uint64, np.int64)
                total += np.bincount((keys & U(0xFFFF)).astype(np.int64), n, 1 << 16).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    pairs = np.zeros(1 << 16)
    for r in near.select("blob").mapInArrow(two, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    root = Root(pairs.reshape(256, 256), least, divergence)
    # no more keys than this occur so often; eight slots for each
    bits = min(MOST_BITS, max(16, int(np.log2(max(1, pairs.sum() / least))) + 4))
    near_often = Shipped(spark, often(near, NEAR, least, bits))

    def candidates(doc: np.ndarray, context: np.ndarray, next_: np.ndarray) -> np.ndarray:
        # the strings in a context are the newest ones of the contexts before, so each is looked up once;
        # a text's first symbols have the padding in their contexts, which short contexts tell as well
        newest = near_often.value.has(low(context, NEAR + 1))
        back = FAR - NEAR - 1
        use = newest[back:] & (doc[back:] == doc[: len(doc) - back])
        for j in range(1, back + 1):
            use &= newest[back - j : len(newest) - j]
        return hashed(context[back:][use])

    hashes = counted(docs, candidates, parts, lambda keys: (keys % U(parts)).astype(np.int64), FAR)
    wanted = Shipped(spark, often(hashes, FAR, least, bits))

    def chosen(context: np.ndarray, next_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = wanted.value.has(hashed(context))
        return context[mine], next_[mine]

    far = far_counts(docs, chosen, parts)
    one = Shipped(spark, root.one)

    def grow(t: pa.Table) -> pa.Table:
        """Kept contexts of a part, level by level."""
        part = t["part"][0].as_py()
        keys, n = merged(t.filter(pa.compute.equal(t["level"], NEAR)), NEAR)
        rows, effective = [], None
        for level in LEVELS[1:]:
            if level <= NEAR:
                codes, c = added(keys if level == NEAR else keys & U((1 << 8 * (level + 1)) - 1), n)
                context, next_ = codes >> U(8), (codes & U(255)).astype(np.uint8)
            else:
                context, next_, c = far_of(t)
                codes = low(context, NEAR) << U(8) | next_.astype(np.uint64)
            if not len(c):
                continue
            if effective is None:
                below = one.value[(context & U(255)).astype(np.int64), next_]
            else:
                short, p = effective
                below = p[np.searchsorted(short, codes if level > NEAR else codes & U((1 << 8 * level) - 1))]
            kept, share, use, own, effective_p = tested(context, next_, c, below, least, divergence)
            effective = codes, effective_p
            if level == NEAR and (usual := c >= least // 2).any():
                rows.append((part, level, 2, codes[usual].tobytes(), b"", np.log10(effective_p[usual]).astype(np.float32).tobytes()))
            if len(kept):
                rows.append((part, level, 0, kept.tobytes(), b"", np.log10(share).astype(np.float32).tobytes()))
                rows.append((part, level, 1, context[use].tobytes(), next_[use].tobytes(), np.log10(own).astype(np.float32).tobytes()))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in TREE.split(", ")])

    tree = checkpointed(near.union(far).repartition(parts, "part").groupBy("part").applyInArrow(grow, TREE))
    sizes = {r.part: r.n for r in tree.groupBy("part").agg((F.sum(F.octet_length("logs")) / 4).alias("n")).collect()}
    piece_of, shipped, held, mine = np.zeros(parts, np.int64), [], 0, []

    def ship():
        rows = tree.where(F.col("part").isin(mine)).select("level", "kind", "keys", "next", "logs").collect()
        shipped.append(Shipped(spark, [(r.level, r.kind, bytes(r["keys"]), bytes(r.next), bytes(r.logs)) for r in rows]))

    for p, n in sorted(sizes.items()):
        if mine and held + n > PIECE:
            ship()
            held, mine = 0, []
        piece_of[p] = len(shipped)
        mine.append(p)
        held += n
    if mine:
        ship()
    return SuffixTree(root, shipped, parts, piece_of)


def hashed(context: np.ndarray) -> np.ndarray:
    """32 bits of a hash of each context."""
    return context * U(0xD6E8FEB86659FD93) >> U(32)


def far_counts(docs: DataFrame, chosen, parts: int) -> DataFrame:
    """(part, level, blob) of the counts of chosen (context of FAR symbols, next).

    A task counts 56 bits of a hash of the context with the symbol, and keeps the distinct contexts to tell
    the hashes by: two sorts of numbers in place of one of pairs.
    """
    def run(batches):
        held, contexts = Counter(), Counter()
        for b in batches:
            for _, context, next_ in runs(as_bytes(b.column(0))):
                context, next_ = chosen(context, next_)
                held.add(named(context) | next_.astype(np.uint64))
                contexts.add(context)
        keys, n = held.total()
        if not len(keys):
            return
        distinct = contexts.total()[0]
        names = named(distinct)
        order = np.argsort(names)
        context, next_ = distinct[order[np.searchsorted(names[order], keys & U(0xFFFFFFFFFFFFFF00))]], (keys & U(255)).astype(np.uint8)
        yield from in_parts(part_of(context, parts), FAR, context, n, next_)

    return docs.select("text").mapInArrow(run, "part int, level int, blob binary")


def named(context: np.ndarray) -> np.ndarray:
    """56 bits of a hash of each context, above a free byte."""
    return context * U(0x9E3779B97F4A7C15) & U(0xFFFFFFFFFFFFFF00)


def added_pairs(context: np.ndarray, next_: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, next), those of a context together, with their counts summed."""
    # by 56 bits of a hash of the context and the symbol: one sort, and equal pairs still meet
    order = np.argsort(named(context) | next_.astype(np.uint64))
    context, next_, n = context[order], next_[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (next_[1:] != next_[:-1])])) if len(context) else np.zeros(0, np.int64)
    return context[first], next_[first], np.add.reduceat(n, first) if len(first) else n[:0]


def far_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = [unsqueezed(b, np.uint64, np.int64, np.uint8) for b, k in zip(t["blob"].to_pylist(), t["level"].to_pylist()) if k == FAR]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    context, n, next_ = (np.concatenate(x) for x in zip(*got))
    return added_pairs(context, next_, n)


def score(docs: DataFrame, least: int = 500, divergence: float = 40.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of documents.

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0. Tokens are the words
    and one end; base_score is the unigram formula with 0.1 added to each count, over
    exact counts of all training words; score is the suffix tree's log10 probability of
    the text, lower-cased and with a space for each run of white space after a word, as
    white space is no part of the tokens. A null text is empty: one token, its end. Without training rows counts are zero and the
    formula still holds (0.1 over 0.1). Repeated rows count each time; other columns are
    not read; an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", crc_bucket("doc_id", 10) == 0)
    tree = fit(docs.where("not held_out"), least, divergence)
    buckets = exchange.sized(docs)
    parts = max(64, buckets)
    dealt = exchange.bucketed(docs, buckets, ["doc_id", "text"])

    def vocabulary(t: pa.Table):
        texts = as_bytes(t["text"])
        doc, h = all_words(texts, PIECE_BYTES)
        doc = np.concatenate([doc, np.arange(len(texts))])
        h = np.concatenate([h, np.full(len(texts), END)])
        keys, inverse = np.unique(h, return_inverse=True)
        train = ~np.array(t["held_out"].to_pylist(), bool)
        return doc, inverse, keys, np.bincount(inverse, train[doc], len(keys)).astype(np.uint32), texts

    def requests(t: pa.Table) -> pa.Table:
        texts = as_bytes(t["text"])
        doc, h = all_words(texts, PIECE_BYTES)
        train = ~np.array(t["held_out"].to_pylist(), bool)
        keys = sorted_set(np.append(h, END))
        learnt, times = np.unique(np.append(h[train[doc]], np.full(int(train.sum()), END)), return_counts=True)
        n = np.zeros(len(keys), np.uint32)
        n[np.searchsorted(keys, learnt)] = times
        entries = np.zeros(len(keys), ASKED)
        entries["key"], entries["n"] = keys, n
        return exchange.rows_table(exchange.packed(entries, exchange.part_of(keys, parts), exchange.bucket_of(t)))

    def answer(t: pa.Table) -> pa.Table:
        """Counts of the words that several buckets have; part -1 has this part's totals."""
        entries, bucket, index = exchange.unpacked(t, ASKED)
        keys, inverse, asked = np.unique(entries["key"], return_inverse=True, return_counts=True)
        total = np.bincount(inverse, entries["n"], len(keys)).astype(np.uint64)
        shared = asked[inverse] > 1
        told = np.zeros(int(shared.sum()), TOLD)
        told["at"], told["n"] = index[shared], total[inverse[shared]]
        out = exchange.replied(t["part"][0].as_py(), bucket[shared], told)
        return pa.concat_tables([out, exchange.rows_table([(-1, -1, int(total.sum()).to_bytes(8, "big") + int((total > 0).sum()).to_bytes(8, "big"))])])

    def finish(t: pa.Table, replies: pa.Table) -> pa.Table:
        doc, inverse, keys, n, texts = vocabulary(t)
        n = n.astype(float)
        part = exchange.part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        first = np.searchsorted(part[order], np.arange(parts))
        for p, blob in zip(replies["part"].to_pylist(), replies["blob"].to_pylist()):
            told = np.frombuffer(blob, TOLD)
            n[order[first[p] + told["at"]]] = told["n"]
        c = n[inverse]
        size = len(texts)
        columns = [np.bincount(doc, minlength=size), np.bincount(doc, c > 0, size).astype(np.int64), np.bincount(doc, np.log10(c + 0.1), size), tree.log10(texts)]
        return pa.table([t["doc_id"].combine_chunks(), t["held_out"].combine_chunks(), *(pa.array(x) for x in columns)], names=[f.split()[0] for f in SCORED.split(", ")])

    # a group's arrays beside the tree are large: fetching their pages anew for each costs more than it frees
    replies = exchange.ask(dealt, requests, answer, keep=True)
    scored = exchange.tell(dealt, replies.where("part >= 0"), finish, SCORED, keep=True)
    number = lambda at: F.coalesce(F.sum(F.conv(F.hex(F.substring("blob", at, 8)), 16, 10).cast("long")), F.lit(0)).cast("long")
    # one row of totals, beside every row
    totals = replies.where("part = -1").agg(number(1).alias("train_tokens"), number(9).alias("distinct"))
    base = F.col("log_sum") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.1 * (F.col("distinct") + 1))
    return scored.join(F.broadcast(totals)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")

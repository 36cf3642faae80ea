"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial hash of every prefix modulo two 31-bit
primes; two differences and two products then compare any spans, and bisection over the
span length finds the longest common extension of any two places. Long texts have their
arrays block by block, with the hash of the prefix before each block.

A fingerprint is text of four fields: the length, the hash of the whole text, hashes of
prefixes at STEPS multiples of a power of two, and the KEEP smallest mixed hashes of spans
of SPAN code points (a bottom-k sketch). Where both texts are at hand, likeness is the
share of common spans among the smallest, or the part of the longer text that the longest
common extensions from both ends cover, whichever is greater; from two fingerprints alone
the stored prefix hashes bound the common prefix from below. Equal texts give 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange
from .textops import mix, small_batches, sorted_set

P1, P2 = (1 << 31) - 1, (1 << 31) - 19
B1, B2 = 1_103_515_245, 1_664_525_017
SPAN, KEEP, STEPS = 8, 32, 16
BLOCK = 1 << 17
#: Text of a range of documents, and the ranges up to which they grow in number.
RANGE_BYTES, MOST_RANGES = 16 << 20, 4096
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_pow: dict[int, np.ndarray] = {}


def powers(base: int, p: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo p."""
    have = _pow.get(p, np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, have * pow(base, len(have), p) % p])
    _pow[p] = have
    return have[:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix hashes of one text; a span is a half-open pair of places."""

    def __init__(self, chars: np.ndarray, arrays: list | None = None):
        self.n = len(chars)
        self.arrays = arrays or []
        for base, p in ((B1, P1), (B2, P2)) if arrays is None else ():
            terms = (chars.astype(np.int64) + 1) * powers(base, p, self.n) % p
            self.arrays.append((np.concatenate([[0], np.cumsum(terms)]) % p, p, base))

    def spans(self, starts: np.ndarray, ends: np.ndarray, top: int | None = None) -> tuple[np.ndarray, ...]:
        """Two residues for each span, comparable between texts of places up to `top`."""
        top = self.n if top is None else top
        return tuple((sums[ends] - sums[starts]) % p * powers(base, p, top + 1)[top - starts] % p for sums, p, base in self.arrays)

    def equal(self, a: int, b: int, length: int, other: PrefixHash | None = None) -> bool:
        """Whether the spans of this length at a here and at b in other (or here) agree."""
        other = other or self
        top = max(self.n, other.n)
        one = self.spans(np.array([a]), np.array([a + length]), top)
        two = other.spans(np.array([b]), np.array([b + length]), top)
        return all(int(x[0]) == int(y[0]) for x, y in zip(one, two))

    def common(self, a: int, b: int, other: PrefixHash | None = None) -> int:
        """The longest common extension of places a here and b in other, by bisection."""
        other = other or self
        lo, hi = 0, min(self.n - a, other.n - b)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(a, b, mid, other) else (lo, mid - 1)
        return lo

    def common_prefix(self, other: PrefixHash) -> int:
        """common(0, 0, other): from one origin the prefix hashes compare as they are."""
        (x, *_), (y, *_) = self.arrays
        (u, *_), (v, *_) = other.arrays
        lo, hi = 0, min(self.n, other.n)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if x[mid] == u[mid] and y[mid] == v[mid] else (lo, mid - 1)
        return lo

    def common_suffix(self, other: PrefixHash) -> int:
        """The longest common extension of the two ends towards the starts: doubling, then bisection."""
        most = min(self.n, other.n)
        lo, hi = 0, 1
        while hi <= most and self.equal(self.n - hi, other.n - hi, hi, other):
            lo, hi = hi, hi * 2
        hi = min(hi - 1, most)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(self.n - mid, other.n - mid, mid, other) else (lo, mid - 1)
        return lo


class Prefixes:
    """Prefix hashes of a text of any length: those before each block, and the array of a block on demand."""

    def __init__(self, chars: np.ndarray, before: list[tuple[int, int]], first: list | None):
        """before: residues of the prefix at each multiple of BLOCK; first: the arrays of the only block, if it is the only one."""
        self.chars, self.before = chars, before
        self.only = PrefixHash(chars, first) if first else None

    def block(self, k: int, reverse: bool = False) -> PrefixHash:
        if self.only and not reverse:
            return self.only
        return PrefixHash(self.chars[len(self.chars) - (k + 1) * BLOCK if (k + 1) * BLOCK < len(self.chars) else 0 : len(self.chars) - k * BLOCK] if reverse else self.chars[k * BLOCK : (k + 1) * BLOCK])

    def common_prefix(self, other: Prefixes) -> int:
        lo, hi = 0, min(len(self.before), len(other.before)) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.before[mid] == other.before[mid] else (lo, mid - 1)
        return lo * BLOCK + self.block(lo).common_prefix(other.block(lo))

    def common_suffix(self, other: Prefixes) -> int:
        if not len(self.chars) or not len(other.chars) or self.chars[-1] != other.chars[-1]:
            return 0
        if self.only and other.only:
            return self.only.common_suffix(other.only)
        k = 0
        while k * BLOCK < min(len(self.chars), len(other.chars)):
            n = self.block(k, True).common_suffix(other.block(k, True))
            if n < BLOCK:
                return k * BLOCK + n
            k += 1
        return min(len(self.chars), len(other.chars))


def step_of(n: int) -> int:
    """The power of two whose multiples up to n are STEPS at most."""
    step = 1
    while n // step > STEPS:
        step *= 2
    return step


def fingerprint(chars: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(length, whole hash, prefix hashes, smallest span hashes)."""
    return fingerprint_and_prefixes(chars)[0]


def fingerprint_and_prefixes(chars: np.ndarray) -> tuple[tuple[int, int, np.ndarray, np.ndarray], Prefixes]:
    """The fingerprint, block by block, and the prefix hashes that it is made from."""
    n = len(chars)
    before, first = [(0, 0)], None
    step = step_of(n)
    marks = np.zeros(n // step, np.uint64)
    carry = [0, 0]
    least = np.zeros(0, np.uint64)
    width = min(SPAN, n)
    for at in range(0, n, BLOCK):
        block = chars[at : at + BLOCK + width - 1].astype(np.int64) + 1
        own = min(BLOCK, n - at)
        sums = []
        for k, (base, p) in enumerate(((B1, P1), (B2, P2))):
            terms = block * powers(base, p, len(block)) % p
            prefix = np.concatenate([[0], np.cumsum(terms)]) % p
            whole = (carry[k] + prefix[: own + 1] * pow(base, at, p)) % p
            carry[k] = int(whole[own])
            sums.append((prefix, whole, base, p))
        before.append((carry[0], carry[1]))
        if n <= BLOCK:
            first = [(whole, p, base) for _, whole, base, p in sums]
        inside = np.arange(-(-(at + 1) // step) * step, at + own + 1, step)
        marks[inside // step - 1] = mix(sums[0][1][inside - at].astype(np.uint64) << np.uint64(31) | sums[1][1][inside - at].astype(np.uint64))
        m = len(block) - width + 1
        if m > 0:
            both = []
            for prefix, _, base, p in sums:
                both.append(((prefix[width : width + m] - prefix[:m]) % p * powers(base, p, len(block) + 1)[len(block) - np.arange(m)] % p).astype(np.uint64))
                # each block has its own top power, which the factor below takes away
                both[-1] = both[-1] * np.uint64(pow(pow(base, len(block), p), -1, p)) % np.uint64(p)
            h = mix(both[0] << np.uint64(31) | both[1])
            cut = np.iinfo(np.uint64).max if m <= 8 * KEEP else int(4 * KEEP / m * float(np.iinfo(np.uint64).max))
            few = sorted_set(h[h <= np.uint64(cut)])
            if len(few) < KEEP and m > 8 * KEEP:
                few = sorted_set(h)
            least = sorted_set(np.concatenate([least, few[:KEEP]]))[:KEEP]
    whole = int(mix(np.array([carry[0] << 31 | carry[1]], np.uint64))[0]) if n else 0
    return (n, whole, marks >> np.uint64(40), sorted_set(least >> np.uint64(32))), Prefixes(chars, before[: max(1, -(-n // BLOCK))], first)


def as_text(f: tuple[int, int, np.ndarray, np.ndarray]) -> str:
    return f"{f[0]:x}:{f[1]:016x}:" + f[2].astype(">u4").tobytes().hex() + ":" + f[3].astype(">u4").tobytes().hex()


def from_text(s: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    n, whole, marks, least = s.split(":")
    return int(n, 16), int(whole, 16), np.frombuffer(bytes.fromhex(marks), ">u4").astype(np.uint64), np.frombuffer(bytes.fromhex(least), ">u4").astype(np.uint64)


def common_prefix(a: tuple, b: tuple) -> int:
    """A lower bound of the common prefix of two texts, by bisection over their stored prefix hashes."""
    one, two = step_of(a[0]), step_of(b[0])
    step = max(one, two)
    lo, hi = 0, min(a[0], b[0]) // step
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[2][mid * step // one - 1] == b[2][mid * step // two - 1] else (lo, mid - 1)
    return lo * step


def spans_shared(a: tuple, b: tuple) -> float:
    """The share of common spans among the smallest of two fingerprints."""
    union = sorted_set(np.concatenate([a[3], b[3]]))[:KEEP]
    return float((np.isin(union, a[3]) & np.isin(union, b[3])).mean())


def likeness(a: tuple, b: tuple) -> float:
    """0 to 1, from two fingerprints alone."""
    if a[:2] == b[:2]:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    return min(1.0, max(spans_shared(a, b), common_prefix(a, b) / max(a[0], b[0])))


def likeness_of(one: tuple[tuple, Prefixes], two: tuple[tuple, Prefixes]) -> float:
    """0 to 1, from two fingerprints and the prefix arrays that they were made from."""
    (a, x), (b, y) = one, two
    if a[:2] == b[:2]:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    prefix = x.common_prefix(y)
    ends = min(prefix + (x.common_suffix(y) if prefix < min(a[0], b[0]) else 0), a[0], b[0])
    return min(1.0, max(spans_shared(a, b), ends / max(a[0], b[0])))


def edited(text: str, after: str) -> str:
    """text with its last floor(n/2) code points replaced by as many first ones (or all) of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at most value (0 for null), in two steps of lookups."""
    if not cuts:
        return F.lit(0)
    wide = 64
    upto = lambda edges: F.size(F.filter(edges, lambda c: c <= value))
    coarse = upto(F.array(*map(F.lit, cuts[wide - 1 :: wide] or [float("inf")])))
    fine = F.slice(F.array(*map(F.lit, cuts)), coarse * wide + 1, wide)
    return F.when(value.isNull(), 0).otherwise(coarse * wide + upto(fine))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The digest of every row of documents: each text, its edited text and the text that follows.

    Rows follow each other by doc_id (null first), rows of one doc_id by text, and the
    first follows the last; a row alone follows itself. A null text is empty. Documents
    are cut into ranges of doc_id at approximate quantiles, of RANGE_BYTES of text each but
    no more than MOST_RANGES unless the shuffle has more partitions; the first row of each
    range also goes to the range before it, so a range is a task of its own, which streams
    its rows in order. Ranges are by doc_id alone, so rows of one doc_id stay together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = -(1 << 63)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(exchange.shuffle_partitions(docs), min(MOST_RANGES, -(-size // RANGE_BYTES)))
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    placed = docs.withColumn("place", F.coalesce("doc_id", F.lit(low))).withColumn("range", range_of(F.col("doc_id").cast("double"), cuts))
    heads = {r.range: r.first for r in placed.groupBy("range").agg(F.min("place").alias("first")).collect()}
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    used = sorted(heads)
    before = {k: used[i - 1] for i, k in enumerate(used)}
    first = F.get(F.array(*(F.lit(heads.get(k)).cast("long") for k in range(used[-1] + 1))), F.col("range"))
    previous = F.get(F.array(*(F.lit(before.get(k)).cast("int") for k in range(used[-1] + 1))), F.col("range"))
    # a row is in its own range, and, as the row after the last one, in the range before
    own, ahead = (F.struct(r.alias("range"), F.lit(after).alias("after")) for r, after in ((F.col("range"), 0), (previous, 1)))
    places = F.when(F.col("place") == first, F.array(own, ahead)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "place", "text", F.explode(places).alias("s")).select("doc_id", "place", "text", "s.range", "s.after")

    def run(batches):
        at, waiting, found = None, None, False
        out: list[tuple] = []

        def row(one, after):
            text = edited(one[1], after[1])
            f = fingerprint_and_prefixes(points(text)) if text != one[1] else one[2]
            return one[0], len(one[1]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), as_text(one[2][0]), as_text(f[0]), likeness_of(one[2], f), likeness_of(one[2], after[2])

        def batch():
            columns = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            for doc_id, text, range_, after in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("range").to_pylist(), b.column("after").to_pylist()):
                if range_ != at:
                    at, waiting, found = range_, None, False
                if found:
                    continue  # further rows of the next range's first doc_id
                one = doc_id, text, fingerprint_and_prefixes(points(text))
                if waiting is not None:
                    out.append(row(waiting, one))
                waiting, found = one, bool(after)
                if len(out) >= 500:
                    yield batch()
                    out = []
        yield batch()

    return dealt.repartitionById(used[-1] + 1, F.col("range")).sortWithinPartitions("range", "after", "place", "text").select("doc_id", "text", "range", "after").mapInArrow(run, SCHEMA)

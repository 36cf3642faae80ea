"""Line dedup as an exact set-similarity join.

A line is the set of its lower-cased words. A line goes if an earlier line (by doc_id,
then text, then line number), of the same document or another, has a Jaccard similarity
of at least `threshold`. Words are ordered by rarity, by exact counts over all documents;
similar sets share a word of their prefixes, so only prefix words are exchanged, and of
these only words that occur twice at all. Length and positional filters thin out the
pairs, and the full sets of what is left meet in the part of the shared word, where the
overlap is counted. Equal sets meet in the same way, by a hash of the set.

Copies are settled first: a bucket sends one line for each set, a part keeps the first of
each set, and pairs are met by distance in length order, so a line with a million copies
costs one entry a bucket. A line is marked once; pairs of marked lines are skipped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .textops import LOWER, U, as_bytes, mix, sorted_set, span_hashes, unused, word_spans

#: A word is known by its part and 32 bits of its hash here: words that share them only share a count.
COUNT = np.dtype([("key", "<u4"), ("n", "<u2")])
TOLD = np.dtype([("at", "<u4"), ("n", "<u2")])
#: Ties in doc_id go by a byte of a hash of the text. A set is known by sign, set and size together; sign has, for each of 64 bins, the parity of its words.
#: prev is the word before in the line's entries (0: none); two lines with one prev have met there.
ENTRY = np.dtype([("word", "<u4"), ("prev", "<u4"), ("sign", "<u8"), ("set", "<u4"), ("doc", "<i8"), ("tie", "u1"), ("index", "<u4"), ("size", "<u4"), ("place", "u1")])
#: The same of the lines that a part wants to know more of, with their buckets.
MET = np.dtype([*ENTRY.descr, ("bucket", "<u4")])
LINE = np.dtype("<u4")
ROWS = "part int, bucket int, kind int, blob binary"
#: Kinds of rows: lines to remove, prefix entries, lines whose parities or sets are wanted, these, and what a part keeps.
GONE, ENTRIES, WANT_PARITIES, WANT_SET, PARITIES, SETS, STATE = range(7)
#: Sets of more words differ in as many of 64 parities by chance as similar ones may; they are met by 512.
SHORT = 80
BUCKET_BYTES = 8 << 20
#: Bytes that are taken apart at a time: few enough that their arrays stay in a core's cache.
CHUNK = 1 << 17
#: Entries of a word from which its pairs are sought by classes.
HOT = 512


def rows(made) -> pa.Table:
    made = list(made)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["part", "bucket", "kind", "blob"])


#: Columns that rise along a blob, or mostly do, kept as differences.
ASCENDING = ("doc", "index", "key", "at")


def tie_of(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little")


def squeezed(entries: np.ndarray) -> bytes:
    """Entries by column and byte, compressed."""
    column = lambda c: np.diff(entries[c], prepend=entries[c].dtype.type(0)) if c in ASCENDING else np.ascontiguousarray(entries[c])
    planes = b"".join(column(c).view(np.uint8).reshape(len(entries), -1).T.tobytes() for c in entries.dtype.names)
    return len(entries).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = int.from_bytes(blob[:4], "little"), 0
    planes = np.frombuffer(pa.decompress(blob[4:], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros(n, dtype)
    for c in dtype.names:
        width = dtype[c].itemsize
        values = np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(dtype[c]).ravel()
        out[c] = np.cumsum(values, dtype=values.dtype) if c in ASCENDING else values
        at += n * width
    return out


class Lines:
    """The lines of a bucket's documents in their order: one index runs over all of them."""

    def __init__(self, t: pa.Table):
        texts = as_bytes(t["text"])
        ids = [-(1 << 63) if x is None else int(x) for x in t["doc_id"].to_pylist()]
        #: Row of the table for each document in order.
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], tie_of(texts[i]), texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        self.first = np.cumsum([0] + [x.count(b"\n") + 1 for x in self.texts])
        self.all = b"\n".join(self.texts)

    def words(self):
        """(line index, word hash) of all words, in order."""
        got, at, line = [], 0, 0
        while at < len(self.all):
            end = self.all.find(b"\n", at + CHUNK)
            end = len(self.all) if end < 0 else end
            buf = LOWER[np.frombuffer(b"\n" + self.all[at:end] + b"\n", np.uint8)]
            starts, ends = word_spans(buf)
            breaks = np.cumsum(buf == 10, dtype=np.int32)
            got.append(((line + breaks[starts] - 1).astype(np.int32), span_hashes(buf, starts, ends)))
            line += int(breaks[-1]) - 1
            at = end + 1
        if not got:
            return np.zeros(0, np.int32), np.zeros(0, np.uint64)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def doc_of(self, line: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, line, side="right") - 1

    def ties(self) -> np.ndarray:
        """Orders texts of one doc_id between buckets; those that share it follow their buckets."""
        return np.array([tie_of(x) >> 24 for x in self.texts], np.uint8)

    def kept(self, gone: np.ndarray) -> tuple[list[bytes], list[list[int]]]:
        """The texts without the lines of these indices, and their removed line numbers, by document in order."""
        gone = np.unique(gone)
        cut = np.searchsorted(gone, self.first)
        texts, numbers = [], []
        for i, x in enumerate(self.texts):
            out = (gone[cut[i] : cut[i + 1]] - self.first[i]).tolist()
            numbers.append(out)
            if out:
                dead = set(out)
                x = b"\n".join(line for k, line in enumerate(x.split(b"\n")) if k not in dead)
            texts.append(x)
        return texts, numbers


def order_of(e: np.ndarray, bucket: np.ndarray) -> tuple:
    """Keys for lexsort, the last the strongest, that put entries in document order."""
    return e["index"], bucket, e["tie"], e["doc"]


def first_of_each_set(e: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries of each word, (the first of each set, the later ones), as indices."""
    key = mix(e["sign"] ^ mix(e["set"].astype(np.uint64) << U(32) | e["word"]) ^ (e["size"].astype(np.uint64) << U(40)))
    order = np.argsort(key)
    new = np.ones(len(e) + 1, bool)
    new[1:-1] = key[order][1:] != key[order][:-1]
    alone = new[1:] & new[:-1]
    several = order[~alone]
    several = several[np.lexsort((*order_of(e[several], bucket[several]), key[several]))]
    first = np.ones(len(several), bool)
    first[1:] = key[several][1:] != key[several][:-1]
    return np.concatenate([order[alone], several[first]]), several[~first]


def near_pairs(e: np.ndarray, threshold: float, settled: tuple[np.ndarray, np.ndarray], rank: np.ndarray | None = None):
    """Yields (i, j, differing words allowed) arrays of pairs of one word that pass the length, positional and parity filters.

    The parities of two sets differ in no more bins than the sets differ in words. A pair
    passes at the first word that both prefixes have, if at any: the positional bound holds
    there, and the words before differ. Where they agree, the pair has met at that word.

    Of a word with many entries, i seeks a partner j, before it if there is a rank, and
    stops once the reader has marked it in settled[0], or [1] where one of the two is long.
    """
    order = np.argsort(e["word"].astype(np.uint64) << U(32) | e["size"])
    word = e["word"][order]
    cuts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1, [len(word)]]) if len(word) else np.zeros(1, np.int64)
    many = np.flatnonzero(np.diff(cuts) >= HOT)
    few = np.ones(len(order), bool)
    for g in many:
        few[cuts[g] : cuts[g + 1]] = False
        yield from hot_pairs(e, order[cuts[g] : cuts[g + 1]], threshold, settled, rank)
    order = order[few]
    word, prev, sign, size, place = e["word"][order], e["prev"][order], e["sign"][order], e["size"][order].astype(np.int64), e["place"][order]
    left = size - place
    # the longest partner that the positional bound leaves to each
    most = np.minimum(size / threshold, left * ((1 + threshold) / threshold) - size) + 1e-9
    active = np.flatnonzero(size * (1 / threshold) >= size + 1)
    d = 0
    while len(active):
        d += 1
        active = active[active + d < len(order)]
        other = active + d
        # longer sets follow shorter ones, so a pair too unlike in length ends the search for its first
        go = (word[active] == word[other]) & (size[other] <= most[active])
        active, other = active[go], other[go]
        both = size[active] + size[other]
        need = np.ceil(threshold / (1 + threshold) * both - 1e-9).astype(np.int64)
        spare = both - 2 * need
        ok = (left[other] >= need) & (np.bitwise_count(sign[active] ^ sign[other]) <= spare) & ((prev[active] != prev[other]) | (prev[active] == 0))
        if ok.any():
            yield order[active[ok]], order[other[ok]], spare[ok]


def hot_pairs(e: np.ndarray, mine: np.ndarray, threshold: float, settled: tuple[np.ndarray, np.ndarray], rank: np.ndarray | None):
    """near_pairs() of one word's entries, by classes of equal size and place.

    Two classes pass or fail the length and positional filters as a whole, so lines of one
    template with too many words of their own cost nothing. In a pair of classes every
    open entry tries the other's entries in document order: lines that are all alike find
    their first at once.
    """
    size, place = e["size"][mine].astype(np.int64), e["place"][mine].astype(np.int64)
    by = np.lexsort((rank[mine] if rank is not None else mine, place, size))
    mine, size, place = mine[by], size[by], place[by]
    first = np.flatnonzero(np.concatenate([[True], (size[1:] != size[:-1]) | (place[1:] != place[:-1])]))
    ends = np.append(first[1:], len(mine))
    kinds, left = size[first], (size - place)[first]
    for a in range(len(first)):
        both = kinds[a] + kinds
        need = np.ceil(threshold / (1 + threshold) * both - 1e-9).astype(np.int64)
        for b in np.flatnonzero((np.minimum(kinds, kinds[a]) >= threshold * np.maximum(kinds, kinds[a]) - 1e-9) & (np.minimum(left, left[a]) >= need)):
            spare = int(both[b] - 2 * need[b])
            done = settled[int(max(kinds[a], kinds[b]) > SHORT)]
            seekers = mine[first[a] : ends[a]]
            for partner in mine[first[b] : ends[b]]:
                seekers = seekers[~done[seekers]]
                if rank is not None:
                    # both classes are in document order: who does not follow this partner follows no later one
                    seekers = seekers[rank[seekers] > rank[partner]]
                if not len(seekers):
                    break
                ok = (np.bitwise_count(e["sign"][seekers] ^ e["sign"][partner]) <= spare) & ((e["prev"][seekers] != e["prev"][partner]) | (e["prev"][partner] == 0)) & (seekers != partner)
                if ok.any():
                    found = seekers[ok]
                    yield found, np.full(len(found), partner), np.full(len(found), spare)


def dedup(docs: DataFrame, threshold: float = 0.8, report: bool = False) -> DataFrame:
    """docs with the later similar lines taken out of text; with report, (doc_id, n_lines, n_removed, removed, kept_sha256).

    removed are line numbers from 0. A null text has one line without words and stays null;
    lines without words never match and stay; a document may end up empty, and stays.
    Repeated rows are documents of their own, in any order. Rows of one doc_id are in the
    order of a hash of their text (of their text within a bucket). Other columns, whatever
    their names, pass through. An empty table gives an empty table.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    if report:
        docs = docs.select("doc_id", "text")
    names = docs.columns
    # exchange.BUCKET holds the bucket; a column of that name steps aside
    (aside,) = unused(docs, "aside")
    if exchange.BUCKET.lower() in {c.lower() for c in names}:
        original = next(c for c in names if c.lower() == exchange.BUCKET.lower())
        return dedup(docs.withColumnRenamed(original, aside), threshold).withColumnRenamed(aside, original)
    buckets = exchange.sized(docs, of=BUCKET_BYTES)
    parts = max(64, buckets)
    dealt = exchange.bucketed(docs, buckets, ["doc_id", "text"])

    def ask_counts(t: pa.Table) -> pa.Table:
        _, h = Lines(t).words()
        h.sort()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        entries = np.zeros(len(first), COUNT)
        entries["key"], entries["n"] = h[first] & U(0xFFFFFFFF), np.minimum(np.diff(np.append(first, len(h))), 65535)
        order, part = exchange.by_part(h[first], parts)
        made = exchange.packed(entries[order], part, exchange.bucket_of(t))
        return exchange.rows_table((p, b, squeezed(np.frombuffer(blob, COUNT))) for p, b, blob in made)

    def tell_counts(t: pa.Table) -> pa.Table:
        blobs = [unsqueezed(b, COUNT) for b in t["blob"].to_pylist()]
        entries, index = np.concatenate(blobs), np.concatenate([np.arange(len(b)) for b in blobs])
        bucket = np.repeat(np.array(t["bucket"].to_pylist(), np.int64), [len(b) for b in blobs])
        keys, inverse, asked = np.unique(entries["key"], return_inverse=True, return_counts=True)
        total = np.bincount(inverse, entries["n"], len(keys))
        shared = asked[inverse] > 1
        told = np.zeros(int(shared.sum()), TOLD)
        told["at"], told["n"] = index[shared], np.minimum(total[inverse[shared]], 65535)
        replies = exchange.replied(t["part"][0].as_py(), bucket[shared], told)
        return exchange.rows_table((p, b, squeezed(np.frombuffer(blob, TOLD))) for p, b, blob in zip(*(replies[c].to_pylist() for c in ("part", "bucket", "blob"))))

    def offer(t: pa.Table, counts: pa.Table) -> pa.Table:
        """Prefix entries of the first line of each set; later lines of a set are gone already."""
        if not len(t):
            return rows([])
        lines, bucket = Lines(t), exchange.bucket_of(t)
        line, h = lines.words()
        keys, word, n = np.unique(h, return_inverse=True, return_counts=True)
        by_part, part = exchange.by_part(keys, parts)
        start = np.searchsorted(part, np.arange(parts))
        for p, blob in zip(counts["part"].to_pylist(), counts["blob"].to_pylist()):
            told = unsqueezed(blob, TOLD)
            n[by_part[start[p] + told["at"]]] = told["n"]
        rank = np.empty(len(keys), np.int64)
        # counts that are told end at 65535; of equal counts the smaller key, as keys ascend
        by_rarity = np.argsort(np.minimum(n, 65535).astype(np.uint16), kind="stable")
        rank[by_rarity] = np.arange(len(keys))
        # words of each line once, the rarest first
        ordered = sorted_set(line.astype(np.int64) << 32 | rank[word])
        line, word = ordered >> 32, by_rarity[ordered & 0xFFFFFFFF]
        if not len(line):
            return rows([])
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        size = np.diff(np.append(first, len(line)))
        set_ = mix(np.add.reduceat(mix(keys[word] ^ U(0x51ED270B7F4A7C15)), first) + size.astype(np.uint64))
        sign = np.bitwise_xor.reduceat(U(1) << (keys[word] & U(63)), first)
        _, kept = np.unique(set_, return_index=True)
        later = np.ones(len(first), bool)
        later[kept] = False
        owner = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(line)) - first[owner]
        prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
        use = np.flatnonzero((place < prefix[owner]) & (n[word] > 1) & ~later[owner])
        e = np.zeros(len(use), ENTRY)
        o = owner[use]
        at = line[first]
        doc = lines.doc_of(at)
        e["word"], e["sign"], e["set"], e["doc"], e["tie"] = keys[word[use]] & U(0xFFFFFFFF), sign[o], set_[o] >> U(32), lines.ids[doc][o], lines.ties()[doc][o]
        e["index"], e["size"], e["place"] = at[o], size[o], np.minimum(place[use], 255)
        before = np.zeros(len(use), np.uint32)
        before[1:] = np.where(o[1:] == o[:-1], np.maximum(e["word"][:-1], 1), 0)
        e["prev"] = before
        made = [(p, b, ENTRIES, squeezed(np.frombuffer(blob, ENTRY))) for p, b, blob in exchange.packed(e, exchange.part_of(keys[word[use]], parts), bucket)]
        return rows([*made, (bucket % parts, bucket, GONE, at[later].astype(LINE).tobytes())])

    def entries_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        mine = t.filter(pa.compute.equal(t["kind"], ENTRIES))
        blobs = [unsqueezed(b, ENTRY) for b in mine["blob"].to_pylist()]
        return np.concatenate(blobs) if blobs else np.zeros(0, ENTRY), np.repeat(np.array(mine["bucket"].to_pylist(), np.int64), [len(b) for b in blobs])

    def to_buckets(part: int, kind: int, bucket: np.ndarray, index: np.ndarray):
        both = sorted_set(bucket.astype(np.int64) << 32 | index)
        b = both >> 32
        for block in np.split(both, np.flatnonzero(np.diff(b)) + 1) if len(both) else ():
            yield part, int(block[0] >> 32), kind, (block & 0xFFFFFFFF).astype(LINE).tobytes()

    def meet(t: pa.Table) -> pa.Table:
        """Later lines of equal sets are gone; more is wanted of the lines of pairs that pass the filters."""
        part = t["part"][0].as_py()
        made = [(part, b, GONE, blob) for b, k, blob in zip(t["bucket"].to_pylist(), t["kind"].to_pylist(), t["blob"].to_pylist()) if k == GONE]
        e, bucket = entries_of(t)
        reps, later = first_of_each_set(e, bucket)
        later = later[e["prev"][later] == 0]
        made += to_buckets(part, GONE, bucket[later], e["index"][later])
        e, bucket = e[reps], bucket[reps]
        short, long = np.zeros(len(e), bool), np.zeros(len(e), bool)
        for i, j, _ in near_pairs(e, threshold, (short, long)):
            big = np.maximum(e["size"][i], e["size"][j]) > SHORT
            long[i[big]] = long[j[big]] = True
            short[i[~big]] = short[j[~big]] = True
        for kind, wanted in ((WANT_PARITIES, long), (WANT_SET, short)):
            made += to_buckets(part, kind, bucket[wanted], e["index"][wanted])
        if (wanted := short | long).any():
            kept = np.zeros(int(wanted.sum()), MET)
            for c in ENTRY.names:
                kept[c] = e[c][wanted]
            kept["bucket"] = bucket[wanted]
            made.append((part, part, STATE, squeezed(kept)))
        return rows(made)

    def state_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        blobs = [unsqueezed(b, MET) for b, k in zip(t["blob"].to_pylist(), t["kind"].to_pylist()) if k == STATE]
        e = np.concatenate(blobs) if blobs else np.zeros(0, MET)
        return e, e["bucket"].astype(np.int64)

    def send(t: pa.Table, asked: pa.Table, kind: int) -> pa.Table:
        """What the parts want to know of lines: 512 parities, or word sets as 32 bits of each word's hash.

        Two different words of a pair of lines agree in these once in four thousand million.
        """
        asked = asked.filter(pa.compute.equal(asked["kind"], kind))
        if not len(t) or not len(asked):
            return rows([])
        lines, bucket = Lines(t), exchange.bucket_of(t)
        every = lines.all.split(b"\n")
        wanted = [np.frombuffer(b, LINE) for b in asked["blob"].to_pylist()]
        union = sorted_set(np.concatenate(wanted))
        at, sets, parities = [0], [], np.zeros((len(union), 8), np.uint64)
        for lo in range(0, len(union), 2000):
            chunk = union[lo : lo + 2000].tolist()
            buf = LOWER[np.frombuffer(b"\n" + b"\n".join(every[i] for i in chunk) + b"\n", np.uint8)]
            starts, ends = word_spans(buf)
            owner = np.cumsum(buf == 10)[starts] - 1
            h = span_hashes(buf, starts, ends)
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
            owner, h = owner[new], h[new]
            if kind == WANT_PARITIES:
                np.bitwise_xor.at(parities, (lo + owner, (h >> U(32) & U(7)).astype(np.int64)), U(1) << (h >> U(35) & U(63)))
            else:
                sets.append((h & U(0xFFFFFFFF)).astype(np.uint32))
                at += (at[-1] + np.cumsum(np.bincount(owner, minlength=len(chunk)))).tolist()
        made = []
        if kind == WANT_PARITIES:
            for p, mine in zip(asked["part"].to_pylist(), wanted):
                made.append((p, bucket, PARITIES, np.array([len(mine)], LINE).tobytes() + mine.tobytes() + parities[np.searchsorted(union, mine)].tobytes()))
            return rows(made)
        sets, at = np.concatenate(sets), np.array(at)
        for p, mine in zip(asked["part"].to_pylist(), wanted):
            k = np.searchsorted(union, mine)
            size = at[k + 1] - at[k]
            flat = np.concatenate([sets[at[i] : at[i + 1]] for i in k]) if len(k) else sets[:0]
            made.append((p, bucket, SETS, np.array([len(mine)], LINE).tobytes() + mine.tobytes() + size.astype(LINE).tobytes() + flat.tobytes()))
        return rows(made)

    def narrow(t: pa.Table, sent: pa.Table) -> pa.Table:
        """Of the long lines, those of pairs whose 512 parities may belong to similar sets."""
        e, bucket = state_of(t)
        if not len(e) or not len(sent):
            return rows([])
        known, found = [], []
        for b, blob in zip(sent["bucket"].to_pylist(), sent["blob"].to_pylist()):
            n = int(np.frombuffer(blob, LINE, 1)[0])
            known.append(b << 32 | np.frombuffer(blob, LINE, n, 4).astype(np.int64))
            found.append(np.frombuffer(blob[4 + 4 * n :], np.uint64).reshape(n, 8))
        known, found = np.concatenate(known), np.concatenate(found)
        order = np.argsort(known)
        known, found = known[order], found[order]
        at = np.minimum(np.searchsorted(known, bucket << 32 | e["index"].astype(np.int64)), len(known) - 1)
        wanted = np.zeros(len(e), bool)
        for i, j, spare in near_pairs(e, threshold, (np.ones(len(e), bool), wanted)):
            big = np.maximum(e["size"][i], e["size"][j]) > SHORT
            i, j, spare = i[big], j[big], spare[big]
            ok = np.bitwise_count(found[at[i]] ^ found[at[j]]).sum(1) <= spare
            wanted[i[ok]] = wanted[j[ok]] = True
        return rows(to_buckets(t["part"][0].as_py(), WANT_SET, bucket[wanted], e["index"][wanted]))

    def verify(t: pa.Table, sent: pa.Table) -> pa.Table:
        """Lines with an earlier line of which enough words are shared are gone."""
        e, bucket = state_of(t)
        if not len(e) or not len(sent):
            return rows([])
        sets = {}
        for b, blob in zip(sent["bucket"].to_pylist(), sent["blob"].to_pylist()):
            n = int(np.frombuffer(blob, LINE, 1)[0])
            index, size = np.frombuffer(blob, LINE, n, 4), np.frombuffer(blob, LINE, n, 4 + 4 * n)
            flat = np.frombuffer(blob, "<u4", -1, 4 + 8 * n)
            for i, part_ in zip(index.tolist(), np.split(flat, np.cumsum(size)[:-1])):
                sets[b, i] = part_
        name = list(zip(bucket.tolist(), e["index"].tolist()))
        held = np.array([n in sets for n in name], bool)
        rank = np.empty(len(e), np.int64)
        rank[np.lexsort(order_of(e, bucket))] = np.arange(len(e))
        gone: set = set()
        made: dict = {}
        _, line = np.unique(bucket << 32 | e["index"].astype(np.int64), return_inverse=True)
        out, settled = np.zeros(int(line.max()) + 1, bool), np.zeros(len(e), bool)
        for i, j, _ in near_pairs(e, threshold, (settled, settled), rank):
            both_held = held[i] & held[j]
            i, j = i[both_held], j[both_held]
            later, early = np.where(rank[i] > rank[j], i, j).tolist(), np.where(rank[i] > rank[j], j, i).tolist()
            for a, b in zip(early, later):
                if name[b] in gone or name[a] == name[b]:
                    continue
                one, two = (made.get(name[x]) or made.setdefault(name[x], frozenset(sets[name[x]].tolist())) for x in (a, b))
                both = len(one & two)
                if both >= threshold * (len(one) + len(two) - both) - 1e-9:
                    gone.add(name[b])
                    out[line[b]] = True
            settled[:] = out[line]
        found = np.array(sorted(gone), np.int64).reshape(-1, 2)
        return rows(to_buckets(t["part"][0].as_py(), GONE, found[:, 0], found[:, 1]))

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):  # a part's rows lie under its number, which may be no bucket's
            return nothing if report else t.drop_columns([exchange.BUCKET])
        lines = Lines(t)
        gone = [np.frombuffer(b, LINE) for b, k in zip(told["blob"].to_pylist(), told["kind"].to_pylist()) if k == GONE]
        texts, numbers = lines.kept(np.concatenate(gone) if gone else np.zeros(0, LINE))
        t = t.drop_columns([exchange.BUCKET]).take(pa.array(lines.order))
        if report:
            n = [x.count(b"\n") + 1 for x in lines.texts]
            return pa.table([t["doc_id"].cast(pa.int64()).combine_chunks(), pa.array(n, pa.int32()), pa.array(list(map(len, numbers)), pa.int32()), pa.array(numbers, pa.list_(pa.int32())), pa.array([hashlib.sha256(x).hexdigest() for x in texts])], names=["doc_id", "n_lines", "n_removed", "removed", "kept_sha256"])
        null = t["text"].is_null().to_pylist()
        text = pa.array([None if z else x.decode("utf-8", "surrogatepass") for x, z in zip(texts, null)], pa.string())
        return t.set_column(names.index("text"), "text", text)

    nothing = pa.table({"doc_id": pa.array([], pa.int64()), "n_lines": pa.array([], pa.int32()), "n_removed": pa.array([], pa.int32()), "removed": pa.array([], pa.list_(pa.int32())), "kept_sha256": pa.array([], pa.string())})
    n = exchange.partitions(docs, buckets)
    counts = exchange.ask(dealt, ask_counts, tell_counts)
    met = exchange.once(exchange.tell(dealt, counts, offer, ROWS).groupBy("part").applyInArrow(exchange.one(meet), ROWS), n)
    # what readers leave out they leave out themselves: a filter would move below the exchange and split it
    parities = exchange.tell(dealt, met, lambda t, asked: send(t, asked, WANT_PARITIES), ROWS)
    narrowed = exchange.once(met.groupBy("part").cogroup(parities.groupBy("part")).applyInArrow(exchange.two(narrow), ROWS), n)
    sent = exchange.tell(dealt, met.union(narrowed), lambda t, asked: send(t, asked, WANT_SET), ROWS)
    verified = met.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(exchange.two(verify), ROWS)
    schema = "doc_id long, n_lines int, n_removed int, removed array<int>, kept_sha256 string" if report else docs.schema
    return exchange.tell(dealt, met.union(verified), finish, schema)


#: DuckDB's twin of the report at a threshold of 0.8, for documents with one row for each doc_id.
ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
w AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, n) AS rn, list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS words FROM l),
t AS (SELECT rn, len(words) AS size, unnest(words) AS word FROM w),
r AS (SELECT rn, size, word, row_number() OVER (PARTITION BY rn ORDER BY df, word) AS place FROM (SELECT *, count(*) OVER (PARTITION BY word) AS df FROM t)),
p AS (SELECT * FROM r WHERE place <= size - ceil(0.8 * size - 1e-9) + 1),
c AS (SELECT DISTINCT a.rn AS a, b.rn AS b FROM p a JOIN p b ON a.word = b.word AND a.rn < b.rn AND a.size >= 0.8 * b.size AND b.size >= 0.8 * a.size),
v AS (SELECT c.b, len(list_intersect(x.words, y.words)) AS n, len(x.words) + len(y.words) AS whole FROM c JOIN w x ON c.a = x.rn JOIN w y ON c.b = y.rn),
g AS (SELECT DISTINCT b AS rn FROM v WHERE n >= 0.8 * (whole - n) - 1e-9)
SELECT doc_id, count(*)::INT AS n_lines, count(g.rn)::INT AS n_removed, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (g.rn IS NOT NULL), '') AS removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (g.rn IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN g ON w.rn = g.rn GROUP BY doc_id
"""

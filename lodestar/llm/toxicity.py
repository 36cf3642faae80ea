"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are at most `per_class` labelled rows of each class, those with the smallest
hash of doc_id. Every term of an example is a dimension; its document frequency is counted
over all documents. A term's TF-IDF weight is scaled by how far its presence goes with
either label (chi-square x, scaled by (x / (x + HALF))^2), so words that tell nothing fade
without a cut. Examples with one and the same bag of terms are one index entry with its
labels counted, so ties cannot push each other out.

The index keeps postings by term, entries in blocks, and for each term the greatest weight
in each block. A query's terms bound what each block can reach; the blocks of the highest
bounds are scored first, and then only those whose bound still reaches the k nearest found,
so the neighbours are exact. Votes weigh by closeness and by the inverse of the class's
sampling rate, and a logistic curve fitted to leave-one-out votes calibrates them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import PUNCTUATED, Shipped, as_bytes, crc_bucket, small_batches, smallest, words

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, nearest array<long>, similarity array<double>"
#: The chi-square at which a term's weight is a quarter of its TF-IDF weight.
HALF = 15.0
#: Entries in a block, and the share of entries above which a term's postings are one dense row.
BLOCK, DENSE = 64, 1 / 32
#: Queries that are scored at once.
CHUNK = 256
#: Terms in one message of document frequencies.
STRIDE = 1 << 13


def bags(texts: list[bytes], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of all terms of the sorted vocabulary of hashes, by text and term."""
    keys = [np.zeros(0, np.int64)]
    for doc, h in words(texts, PUNCTUATED) if len(vocabulary) else ():
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = vocabulary[at] == h
        keys.append(doc[hit] * len(vocabulary) + at[hit])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), n.astype(np.float32)


def unit(row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """The weights of each row scaled to a norm of one."""
    norm = np.sqrt(np.bincount(row, weight.astype(float) ** 2, rows))
    return (weight / np.maximum(norm, 1e-12)[row]).astype(np.float32)


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The indices of all ranges [lo, hi), one after the other."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


class BlockMaxIndex:
    """Sparse unit vectors as postings by term, with each block's greatest weight for every term."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, terms: int):
        # entries lie by their heaviest term, so alike entries share blocks
        heaviest = np.full(rows, terms)
        order = np.lexsort((weight, row))
        heaviest[row[order]] = term[order]
        self.order = np.lexsort((np.arange(rows), heaviest))
        place = np.empty(rows, np.int64)
        place[self.order] = np.arange(rows)
        at = place[row]
        order = np.lexsort((at, term))
        self.at, self.weight, term = at[order].astype(np.int32), weight[order].astype(np.float32), term[order]
        self.first = np.searchsorted(term, np.arange(terms + 1))
        self.rows, self.blocks = rows, -(-rows // BLOCK)
        df = np.diff(self.first)
        #: Terms with most postings have a dense row: its number, or -1.
        self.dense = np.where(df > max(BLOCK, DENSE * rows), 0, -1)
        common = np.flatnonzero(self.dense == 0)
        self.dense[common] = np.arange(len(common))
        self.table = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        for i, t in enumerate(common):
            mine = slice(self.first[t], self.first[t + 1])
            self.table[i, self.at[mine]] = self.weight[mine]
        self.table_tops = self.table.reshape(len(common), self.blocks, BLOCK).max(2)
        # block maxima of the other terms: one entry for each term and block that has it
        block = self.at // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.top = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0, np.float32)
        self.top_block = block[new]
        self.top_first = np.searchsorted(term[new], np.arange(terms + 1))

    def all_nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices (-1: none) and cosines of the k nearest entries of each query, nearest first, ties by index; none at zero."""
        ids, sims = np.full((rows, k), -1, np.int64), np.zeros((rows, k))
        dense = self.dense[term]
        common = dense >= 0
        cut = np.searchsorted(row, np.arange(rows + 1))
        for lo in range(0, rows, CHUNK):
            hi = min(lo + CHUNK, rows)
            mine = slice(cut[lo], cut[hi])
            # what the terms with dense rows add, for the whole chunk at once
            q = np.zeros((hi - lo, len(self.table)), np.float32)
            use = common[mine]
            q[row[mine][use] - lo, dense[mine][use]] = weight[mine][use]
            base = q @ self.table
            for i in range(lo, hi):
                own = slice(cut[i], cut[i + 1])
                rare = ~common[own]
                found, s = self.nearest(base[i - lo], term[own][rare], weight[own][rare], k)
                ids[i, : len(found)], sims[i, : len(found)] = found, s
        return ids, sims

    def nearest(self, base: np.ndarray, terms: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest entries of one query, which has `base` in common with each entry by its dense terms."""
        lo, hi = self.top_first[terms], self.top_first[terms + 1]
        at = ranges(lo, hi)
        bound = np.bincount(self.top_block[at], self.top[at] * np.repeat(weight, hi - lo), self.blocks) + base.reshape(self.blocks, BLOCK).max(1) + 1e-5
        lo, hi = self.first[terms], self.first[terms + 1]
        at = ranges(lo, hi)
        entry, part = self.at[at], self.weight[at] * np.repeat(weight, hi - lo)
        by_bound = np.argsort(-bound, kind="stable")
        ids, sims, done = np.zeros(0, np.int64), np.zeros(0), 0
        ahead = -(-k // BLOCK) + 1
        while done < self.blocks:
            worst = sims[k - 1] if len(sims) >= k else 0.0
            chosen = by_bound[done : done + ahead]
            chosen = chosen[(bound[chosen] > 1.5e-5) & (bound[chosen] >= worst)]
            if not len(chosen):
                break
            slot = np.full(self.blocks, -1)
            slot[chosen] = np.arange(len(chosen))
            here = slot[entry // BLOCK]
            mine = here >= 0
            score = np.bincount(here[mine] * BLOCK + entry[mine] % BLOCK, part[mine], len(chosen) * BLOCK) + base.reshape(self.blocks, BLOCK)[chosen].ravel()
            hit = np.flatnonzero(score > max(1e-9, worst - 1e-9))
            if len(hit) > k:
                hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
            own = chosen[hit // BLOCK] * BLOCK + hit % BLOCK
            ids, sims = np.concatenate([ids, self.order[own]]), np.concatenate([sims, score[hit]])
            top = np.lexsort((ids, -sims))[:k]
            ids, sims = ids[top], sims[top]
            done, ahead = done + ahead, self.blocks
        return ids, sims


class ToxicityModel:
    """Neighbours' votes over a block-max index, with a calibration curve."""

    def __init__(self, vocabulary: np.ndarray, scale: np.ndarray, bag: tuple, toxic: np.ndarray, ids: np.ndarray, weight: np.ndarray, k: int):
        """bag: (row, term, count) of the examples; scale: each term's weight at one occurrence."""
        self.vocabulary, self.scale, self.k = vocabulary, scale, k
        row, term, count = bag
        cut = np.searchsorted(row, np.arange(len(toxic) + 1))
        kinds: dict[bytes, int] = {}
        self.group = np.array([kinds.setdefault(term[a:b].tobytes() + count[a:b].tobytes(), len(kinds)) for a, b in zip(cut[:-1], cut[1:])], np.int64)
        n = len(kinds)
        self.toxic = np.bincount(self.group, weight * toxic, n)
        self.total = np.bincount(self.group, weight, n)
        first = np.unique(self.group, return_index=True)[1]
        self.examples = ids[first]
        self.empty = kinds.get(b"", -1)
        self.prior = float((weight * toxic).sum() / weight.sum())
        self.smooth = float(weight.mean()) * 0.5
        use = np.isin(row, first)
        group = self.group[row[use]]
        self.index = BlockMaxIndex(group, term[use], unit(group, self.weights(term[use], count[use]), n), n, len(vocabulary))
        near, sims = self.neighbours(self.group_bags(term, count, cut[first], cut[first + 1]))
        own = near[self.group] == self.group[:, None]
        raw = self.votes(near[self.group], sims[self.group], own * weight[:, None], own * (weight * toxic)[:, None])
        self.slope, self.shift = self.calibrate(self.logit(raw), toxic, weight)

    def weights(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.log1p(count) * self.scale[term]

    @staticmethod
    def group_bags(term, count, lo, hi) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        at = ranges(lo, hi)
        return np.repeat(np.arange(len(lo)), hi - lo), term[at], count[at], len(lo)

    @staticmethod
    def logit(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    @staticmethod
    def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
        """Slope and shift of a weighed logistic fit (Newton's method, slightly damped)."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(weight * (y - p) * x).sum() - 1e-3 * (a - 1), (weight * (y - p)).sum()])
            s = weight * np.maximum(p * (1 - p), 1e-6)
            h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = max(0.05, a + step[0]), b + step[1]
        return float(a), float(b)

    def neighbours(self, bag: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
        """Entries (-1: none) nearest to each text of (row, term, count, rows); a text without a term has the entry without one."""
        row, term, count, rows = bag
        weight = unit(row, self.weights(term, count), rows)
        near, sims = self.index.all_nearest(row, term, weight, rows, self.k)
        if self.empty >= 0:
            bare = np.bincount(row, minlength=rows) == 0
            near[bare, 0], sims[bare, 0] = self.empty, 1
        return near, sims

    def votes(self, near: np.ndarray, sims: np.ndarray, less: np.ndarray | float = 0.0, less_toxic: np.ndarray | float = 0.0) -> np.ndarray:
        closeness = np.where(near >= 0, 1 / (1.02 - np.minimum(sims, 1)), 0) * sims
        total = np.where(near >= 0, self.total[near], 0) - less
        toxic = np.where(near >= 0, self.toxic[near], 0) - less_toxic
        return ((closeness * toxic).sum(1) + self.smooth * self.prior) / ((closeness * total).sum(1) + self.smooth)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores, and the ids and cosines of up to three nearest examples (-1: none)."""
        near, sims = self.neighbours((*bags(texts, self.vocabulary), len(texts)))
        p = 1 / (1 + np.exp(-(self.slope * self.logit(self.votes(near, sims)) + self.shift)))
        return p, np.where(near[:, :3] >= 0, self.examples[near[:, :3]], -1), sims[:, :3]


def association(term: np.ndarray, term_toxic: np.ndarray, toxic: np.ndarray, terms: int) -> np.ndarray:
    """The chi-square of each term's presence against the label."""
    df, a = np.bincount(term, minlength=terms), np.bincount(term, term_toxic, terms)
    n, t = len(toxic), toxic.sum()
    expected = df * t / n
    return (a - expected) ** 2 / np.maximum(expected * (1 - t / n) * (1 - df / n), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, per_class: int, k: int) -> ToxicityModel | None:
    """A model from labels (doc_id, toxic) of documents; None without labelled rows of both classes."""
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    present = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = smallest(present, "toxic", per_class)
    sizes = {r.toxic: r.n for r in present.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    small_batches(spark)

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column("text"))
            found: list[list] = [[] for _ in texts]
            for doc, h in words(texts, PUNCTUATED):
                for i in np.unique(doc):
                    found[i].append(h[doc == i])
            blobs = []
            for f in found:
                u, n = np.unique(np.concatenate(f) if f else np.zeros(0, np.uint64), return_counts=True)
                blobs.append(u.tobytes() + n.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(blobs, pa.binary())], ["doc_id", "toxic", "terms"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, toxic int, terms binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.terms))
    toxic = np.array([r.toxic for r in rows], float)
    size = [len(r.terms) // 12 for r in rows]
    hashes = np.concatenate([np.frombuffer(r.terms, np.uint64, n) for r, n in zip(rows, size)])
    tf = np.concatenate([np.frombuffer(r.terms, np.float32, n, 8 * n) for r, n in zip(rows, size)])
    row = np.repeat(np.arange(len(rows)), size)
    vocabulary, term = np.unique(hashes, return_inverse=True)
    df, n = document_frequencies(docs, vocabulary)
    chi = association(term, toxic[row], toxic, len(vocabulary))
    scale = (np.log((1 + n) / (1 + df)) + 1) * (chi / (chi + HALF)) ** 2 + 1e-6
    sampled = {c: max(1, int((toxic == c).sum())) for c in (0, 1)}
    weight = np.where(toxic == 1, sizes[1] / sampled[1], sizes[0] / sampled[0])
    return ToxicityModel(vocabulary, scale, (row, term, tf), toxic, np.array([r.doc_id for r in rows]), weight / weight.mean(), k)


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are.

    Each task counts all terms and sends its counts in packed strides, which add up on the
    executors: the driver gets one count for each term of the bounded sample.
    """
    shipped = Shipped(docs.sparkSession, vocabulary)
    strides = -(-len(vocabulary) // STRIDE)

    def run(batches):
        mine = shipped.value
        total, rows = np.zeros(strides * STRIDE, np.int64), 0
        for b in batches:
            texts = as_bytes(b.column(0))
            total += np.bincount(bags(texts, mine)[1], minlength=len(total))
            rows += len(texts)
        parts = [*range(strides), -1]
        blobs = [*(pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in total.reshape(strides, STRIDE)), pa.compress(np.full(STRIDE, rows).tobytes(), codec="zstd", asbytes=True)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.frombuffer(pa.decompress(blob, decompressed_size=8 * STRIDE, codec="zstd", asbytes=True), np.int64)
                sums[part] = sums.get(part, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "n"])

    counted = docs.select("text").mapInArrow(run, "part int, n binary").repartition(strides + 1, "part").mapInArrow(add, "part int, n binary")
    got = {r.part: np.frombuffer(r.n, np.int64) for r in counted.collect()}
    df = np.concatenate([got.get(i, np.zeros(STRIDE, np.int64)) for i in range(strides)]) if strides else np.zeros(0, np.int64)
    return df[: len(vocabulary)].astype(float), int(got[-1][0]) if -1 in got else 0


def score(docs: DataFrame, labels: DataFrame, per_class: int = 3000, k: int = 25) -> DataFrame:
    """(doc_id, held_out, score, predicted, nearest, similarity) of every row of documents.

    Learns from labels of documents whose crc32(doc_id as text) mod 5 is not 0; lang,
    source and doc_id are never inputs. A null text is empty; a text without any indexed
    term (empty ones too) scores as the labelled examples without one. Null labels and
    labels without a document are left out; a doc_id with both labels counts as toxic.
    Without labels of both classes every score is 0. Repeated rows stay, other columns are
    not read, and an empty table gives an empty table. nearest and similarity are the
    evidence: up to three examples.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", crc_bucket("doc_id", 5) == 0)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    shipped = Shipped(docs.sparkSession, fit(docs, labels.where(crc_bucket("doc_id", 5) != 0), per_class, k))
    small_batches(docs.sparkSession)

    def run(batches):
        model = shipped.value
        for b in batches:
            texts = as_bytes(b.column("text"))
            p, near, sims = model.score(texts) if model else (np.zeros(len(texts)), np.zeros((len(texts), 0), int), np.zeros((len(texts), 0)))
            nearest = [[int(i) for i in row if i >= 0] for row in near]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(nearest, pa.list_(pa.int64())), pa.array([[float(s) for s in row[: len(ids)]] for row, ids in zip(sims, nearest)], pa.list_(pa.float64()))], ["doc_id", "held_out", "score", "predicted", "nearest", "similarity"])

    return docs.mapInArrow(run, SCHEMA)

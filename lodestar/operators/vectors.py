"""Nearest vectors: inverted lists over trained centroids, product-quantised residuals, exact re-ranking.

A vector lies in the list of its nearest centroid, as one byte for each part of its
residual, beside the error that these bytes leave. A search scans the codes of the lists
nearest to a query by table look-ups, takes the best candidates of each query, and measures
these by the vectors themselves. An exact search goes on from there: with the distance of
the k-th neighbour found so far, only lists whose ball can reach below it are compared. It
does so where the vectors are: they are dealt once, queries go to each share of them, and
a share answers with a query's k nearest at most, so what is shuffled does not grow with
the pairs that are compared.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed. Lists are
split into shards of SHARD rows, so a list with a third of all vectors is many groups, and
queries go to the shards of the lists that they probe: no task holds more than a shard and
BLOCK queries at a time, and no query meets a list that it does not probe.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import stored

#: Vectors of a shard of a list, and queries that are scanned against it together.
SHARD, BLOCK = 1 << 16, 64
#: Vectors that centroids and codebooks are fitted on, at most, and lists, at most.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Share of a sampled vector's neighbours that the probed lists are to hold, and vectors on which that is measured.
RECALL, TRIALS = 0.97, 256
#: Bytes of a code: parts of a vector. Rounds of fitting.
PARTS, ROUNDS = 16, 10
#: Lists that an exact search probes for its first bound, and queries that meet a share of the vectors in one task, at most.
FIRST, QUERIES = 8, 1 << 18
#: Bounds give way by this share of the vectors' size, for what single precision loses.
SLACK = 1e-5
CODES = "list int, shard int, id long, code binary, error float"


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def lists_of(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32()), flat)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b, in double precision, as near rows cancel."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def centred(x: np.ndarray, k: int) -> np.ndarray:
    """k means of x by Lloyd's rounds, from rows spread evenly over x; a centroid that loses its rows moves to the farthest row."""
    k = min(k, len(x))
    means = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        d = squares(x, means)
        near = d.argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(means, dtype=np.float64)
        np.add.at(sums, near, x)
        means[count > 0] = (sums[count > 0] / count[count > 0, None]).astype(np.float32)
        lost = np.flatnonzero(count == 0)
        means[lost] = x[np.argsort(-d[np.arange(len(x)), near], kind="stable")[: len(lost)]]
    return means


@dataclasses.dataclass
class Quantiser:
    """Centroids (lists x dimensions), and for each part its codewords (parts x 256 at most x width); widths are padded with zeros.

    probes is how many lists hold the neighbours of sampled vectors, see enough().
    """

    centroids: np.ndarray
    books: np.ndarray
    probes: int = 1

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def parted(self, residual: np.ndarray) -> np.ndarray:
        """Residuals by part: rows x parts x width."""
        padded = np.zeros((len(residual), self.width), np.float32)
        padded[:, : residual.shape[1]] = residual
        return padded.reshape(len(residual), self.books.shape[0], -1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, error) of each row: error is the distance of the vector to what list and code say."""
        near = squares(x, self.centroids).argmin(1)
        parts = self.parted(x - self.centroids[near])
        code = np.stack([squares(parts[:, p], self.books[p]).argmin(1) for p in range(len(self.books))], axis=1)
        told = np.stack([self.books[p][code[:, p]] for p in range(len(self.books))], axis=1)
        return near, code.astype(np.uint8), np.sqrt(((parts - told) ** 2).sum((1, 2)))

    def tables(self, query: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of queries, seen from a centroid, to each codeword: queries x parts x codewords."""
        parts = self.parted(query - self.centroids[at])
        return np.stack([squares(parts[:, p], self.books[p]) for p in range(len(self.books))], axis=1)


def enough(x: np.ndarray, centroids: np.ndarray, k: int = 10) -> int:
    """The fewest nearest lists that hold RECALL of the k neighbours, among rows x, of TRIALS of these rows."""
    trials = x[np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(np.int64)]
    d = squares(trials, x)
    # the nearest is the row itself
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]
    if not near.size:
        return 1
    home = squares(x, centroids).argmin(1)
    place = np.argsort(np.argsort(squares(trials, centroids), axis=1, kind="stable"), axis=1)
    rank = np.sort(np.take_along_axis(place, home[near], axis=1), axis=None)
    return int(rank[int(np.ceil(RECALL * rank.size)) - 1]) + 1


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Quantiser:
    """A quantiser of (id, vector) rows from the `sample` rows, at most, with the smallest hashes of id."""
    n = vectors.count()
    lists = min(lists or max(1, round(n**0.5)), MOST_LISTS)
    h = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 40))
    thin = vectors.where(h < int(min(1.0, 2 * sample / max(1, n)) * (1 << 40)))
    x = matrix(thin.orderBy(h, "id").limit(sample).select("vector").toArrow().column(0).combine_chunks())
    if not len(x):
        return Quantiser(np.zeros((1, 1), np.float32), np.zeros((1, 1, 1), np.float32))
    centroids = centred(x, lists)
    parts = min(PARTS, x.shape[1])
    made = Quantiser(centroids, np.zeros((parts, 1, -(-x.shape[1] // parts)), np.float32))
    residual = made.parted(x - centroids[squares(x, centroids).argmin(1)])
    books = [centred(np.ascontiguousarray(residual[:, p]), 256) for p in range(parts)]
    return Quantiser(centroids, np.stack(books), enough(x, centroids))


@dataclasses.dataclass
class VectorIndex:
    """A quantiser, the codes (CODES) of all vectors, the vectors (id, vector), and of each list its radius and shards."""

    quantiser: Quantiser
    codes: DataFrame
    vectors: DataFrame
    radius: np.ndarray
    shards: np.ndarray

    @property
    def slack(self) -> float:
        return SLACK * (1 + float(np.sqrt((self.quantiser.centroids.astype(np.float64) ** 2).sum(1)).max() + self.radius.max()))

    def save(self, folder: str) -> None:
        """Codes sorted by list and vectors by id, so that a filter on them skips row groups; the quantiser as two small tables."""
        spark, q = self.codes.sparkSession, self.quantiser
        self.codes.repartition("list", "shard").sortWithinPartitions("list", "shard").write.mode("overwrite").parquet(f"{folder}/codes")
        self.vectors.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/vectors")
        rows = [(i, c.tolist(), float(r), int(s), q.probes) for i, (c, r, s) in enumerate(zip(q.centroids, self.radius, self.shards))]
        spark.createDataFrame(rows, "list int, centroid array<float>, radius float, shards int, probes int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/lists")
        words = [(p, c, w.tolist()) for p, book in enumerate(q.books) for c, w in enumerate(book)]
        spark.createDataFrame(words, "part int, code int, word array<float>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/books")


def load(spark: SparkSession, folder: str) -> VectorIndex:
    lists = spark.read.parquet(f"{folder}/lists").orderBy("list").toArrow()
    words = spark.read.parquet(f"{folder}/books").orderBy("part", "code").toArrow()
    parts = len(set(words.column("part").to_pylist()))
    books = matrix(words.column("word").combine_chunks())
    quantiser = Quantiser(matrix(lists.column("centroid").combine_chunks()), books.reshape(parts, -1, books.shape[1]), lists.column("probes")[0].as_py())
    return VectorIndex(quantiser, spark.read.parquet(f"{folder}/codes"), spark.read.parquet(f"{folder}/vectors"), lists.column("radius").to_numpy(), lists.column("shards").to_numpy())


def normalised(vectors: DataFrame, cosine: bool = False) -> DataFrame:
    """(id, vector) rows that can be indexed: no null among id, vector and its values, and as long as the longest; with cosine, of length 1 (zero stays)."""
    known = vectors.where("id is not null and vector is not null").where(~F.exists("vector", lambda v: v.isNull() | F.isnan(v))).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    most = known.agg(F.max(F.size("vector"))).first()[0] or 0
    known = known.where(F.size("vector") == most)
    if not cosine:
        return known
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    return known.withColumn("norm", norm).select("id", F.transform("vector", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(v).cast("float")).alias("vector"))


def build(vectors: DataFrame, lists: int | None = None, cosine: bool = False, sample: int = SAMPLE) -> VectorIndex:
    """An index of (id, vector) rows. Rows that normalised() leaves out are not in it; repeated ids are vectors of their own; no rows make an empty index."""
    spark = vectors.sparkSession
    vectors = stored(normalised(vectors, cosine))
    quantiser = fit(vectors, lists, sample)
    # plain arrays, so workers need not have this package
    shipped = spark.sparkContext.broadcast((quantiser.centroids, quantiser.books))

    def run(batches):
        q = Quantiser(*shipped.value)
        for b in batches:
            x = matrix(b.column("vector"))
            near, code, error = q.encode(x) if len(x) else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8), np.zeros(0))
            far = np.sqrt(((x - q.centroids[near]) ** 2).sum(1)) if len(x) else error
            columns = (pa.array(near.astype(np.int32)), b.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error.astype(np.float32)), pa.array(far.astype(np.float32)))
            yield pa.RecordBatch.from_arrays(list(columns), ["list", "id", "code", "error", "far"])

    coded = stored(vectors.mapInArrow(run, "list int, id long, code binary, error float, far float"))
    # a row for each list: MOST_LISTS at most
    found = coded.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()
    radius, shards = np.zeros(len(quantiser.centroids), np.float32), np.zeros(len(quantiser.centroids), np.int32)
    for r in found:
        radius[r.list], shards[r.list] = r.radius, -(-r.n // SHARD)
    of = F.get(F.array(*(F.lit(int(s)) for s in shards)), "list") if len(shards) <= 64 else None
    if of is None:
        table = F.broadcast(spark.createDataFrame([(i, int(s)) for i, s in enumerate(shards)], "list int, shards int"))
        coded, of = coded.join(table, "list"), F.col("shards")
    codes = coded.withColumn("shard", F.pmod(F.xxhash64("id"), of).cast("int")).select("list", "shard", "id", "code", "error")
    return VectorIndex(quantiser, codes, vectors, radius, shards)


def asked(index: VectorIndex, queries: DataFrame, pick) -> DataFrame:
    """(query, vector, reach, list, shard): each query once for every shard of the lists that pick(distances to centroids, reach) marks."""
    shipped = queries.sparkSession.sparkContext.broadcast((index.quantiser.centroids, index.shards))

    def run(batches):
        centroids, shards = shipped.value
        for b in batches:
            if not len(b):
                continue
            x, reach = matrix(b.column("vector")), b.column("reach").to_numpy()
            use = pick(np.sqrt(squares(x, centroids)), reach) & (shards > 0)
            row, at = np.nonzero(use)
            n = shards[at]
            row, at = np.repeat(row, n), np.repeat(at, n)
            shard = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(row)), b.column("vector").take(pa.array(row)), pa.array(reach[row]), pa.array(at.astype(np.int32)), pa.array(shard.astype(np.int32))], ["query", "vector", "reach", "list", "shard"])

    return queries.select("query", "vector", "reach").mapInArrow(run, "query long, vector array<float>, reach double, list int, shard int")


def scanned(index: VectorIndex, probes: DataFrame, best: int | None) -> DataFrame:
    """(query, id, near): of each shard the `best` codes of every query that probes it, or all whose distance less error is within the query's reach."""
    shipped = probes.sparkSession.sparkContext.broadcast((index.quantiser.centroids, index.quantiser.books))
    parts, slack = index.quantiser.books.shape[0], index.slack

    def run(t: pa.Table, q: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names=["query", "id", "near"])
        if not len(t) or not len(q):
            return none
        quantiser, at = Quantiser(*shipped.value), t["list"][0].as_py()
        code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(t), parts)
        ids, error, names = t["id"].to_numpy(), t["error"].to_numpy(), q["query"].to_numpy()
        x, reach = matrix(q["vector"].combine_chunks()), q["reach"].to_numpy()
        out = []
        for lo in range(0, len(x), BLOCK):
            tables = quantiser.tables(x[lo : lo + BLOCK], at)
            near = np.zeros((len(tables), len(t)), np.float32)
            for p in range(parts):
                near += tables[:, p, :][:, code[:, p]]
            np.sqrt(near, out=near)
            if best is None:
                row, col = np.nonzero(near - error <= reach[lo : lo + BLOCK, None] + slack)
            elif best < len(t):
                col = np.argpartition(near, best - 1, axis=1)[:, :best].ravel()
                row = np.repeat(np.arange(len(near)), best)
            else:
                row, col = (i.ravel() for i in np.indices(near.shape))
            out.append(pa.table([pa.array(names[lo + row]), pa.array(ids[col]), pa.array(near[row, col])], names=["query", "id", "near"]))
        return pa.concat_tables(out)

    return index.codes.groupBy("list", "shard").cogroup(probes.groupBy("list", "shard")).applyInArrow(run, "query long, id long, near float")


def measured(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, id, distance) of pairs (query, id), by the vectors themselves in double precision."""

    def run(batches):
        for b in batches:
            if len(b):
                d = matrix(b.column("q")).astype(np.float64) - matrix(b.column("vector"))
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("id"), pa.array(np.sqrt((d * d).sum(1)))], ["query", "id", "distance"])

    met = pairs.join(queries.select("query", F.col("vector").alias("q")), "query").join(vectors, "id")
    return met.select("query", "id", "q", "vector").mapInArrow(run, "query long, id long, distance double")


def compared(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, distance): of each share of the vectors the k nearest of every query (query, vector, reach) within its reach, ties by id.

    A share has SHARD vectors, about. In it, a list whose ball cannot reach a query is left out;
    distances come from products of matrices first, and those that may be among the k nearest
    are measured anew in double precision, so rounding decides nothing.
    """
    spark, slack = queries.sparkSession, index.slack
    shipped = spark.sparkContext.broadcast(index.quantiser.centroids)
    queries = stored(queries)
    shares, blocks = max(1, -(-index.vectors.count() // SHARD)), max(1, -(-queries.count() // QUERIES))
    # every vector once for each block of queries, every query once for each share of the vectors
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = index.vectors.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share"), every(blocks).alias("block"))
    sent = queries.select("query", "vector", "reach", every(shares).alias("share"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))

    def run(t: pa.Table, q: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query", "id", "distance"])]
        if not len(t) or not len(q):
            return out[0]
        centroids, x, ids = shipped.value, matrix(t["vector"].combine_chunks()), t["id"].to_numpy()
        step = range(0, len(x), 1024)
        home = np.concatenate([squares(x[lo : lo + 1024], centroids).argmin(1) for lo in step])
        order = np.argsort(home, kind="stable")
        x, ids, home = x[order], ids[order], home[order]
        radius = np.full(len(centroids), -np.inf)
        np.maximum.at(radius, home, np.concatenate([np.sqrt(((x[lo : lo + 1024].astype(np.float64) - centroids[home[lo : lo + 1024]]) ** 2).sum(1)) for lo in step]))
        asked, names, reach = matrix(q["vector"].combine_chunks()), q["query"].to_numpy(), q["reach"].to_numpy()
        # queries of one neighbourhood reach the same lists
        near = np.concatenate([squares(asked[lo : lo + 1024], centroids).argmin(1) for lo in range(0, len(asked), 1024)])
        turn = np.argsort(near, kind="stable")
        for lo in range(0, len(turn), BLOCK):
            rows = turn[lo : lo + BLOCK]
            lists = np.sqrt(squares(asked[rows], centroids)) - radius <= reach[rows, None] + slack
            used = np.flatnonzero(lists.any(0)[home])
            if not len(used):
                continue
            some, named = (x, ids) if len(used) == len(x) else (x[used], ids[used])
            d = squares(asked[rows], some)
            d[named[None, :] == names[rows, None]] = np.inf
            loose = 1e-12 * (float((asked[rows].astype(np.float64) ** 2).sum(1).max()) + float((some.astype(np.float64) ** 2).sum(1).max()))
            for i, row in enumerate(rows):
                at = np.flatnonzero(d[i] <= (reach[row] + slack) ** 2)
                at = at[d[i, at] < np.inf]
                if len(at) > k:
                    at = at[d[i, at] <= np.partition(d[i, at], k - 1)[k - 1] + loose]
                if len(at):
                    far = np.sqrt(((asked[row].astype(np.float64) - some[at]) ** 2).sum(1))
                    best = np.lexsort((named[at], far))[:k]
                    out.append(pa.table([pa.array(np.full(len(best), names[row])), pa.array(named[at][best]), pa.array(far[best])], names=["query", "id", "distance"]))
        return pa.concat_tables(out)

    return dealt.groupBy("share", "block").cogroup(sent.groupBy("share", "block")).applyInArrow(run, "query long, id long, distance double")


def ranked(distances: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ties by id, with their place from 1."""
    order = Window.partitionBy("query").orderBy("distance", "id")
    return distances.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "id", "place", "distance")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, candidates: int = 100, exact: bool = False) -> DataFrame:
    """(query, id, place, distance): the k vectors nearest to each of queries (query, vector), the one of the query's own id left out.

    The `probes` lists nearest to a query (as many as the index was found to need) are scanned and the `candidates` best codes
    measured. With exact, fewer lists are probed at first (FIRST unless told) and all that could be nearer than what
    this finds is compared too, so the answer is that of comparing with every vector. Equal distances rank by id. Queries
    must be as long as the indexed vectors, and unique by query; others are left out.
    """
    n, probes = index.quantiser.centroids.shape[1], probes or (min(FIRST, index.quantiser.probes) if exact else index.quantiser.probes)
    queries = queries.where((F.size("vector") == n) & F.col("query").isNotNull()).select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<float>").alias("vector"), F.lit(float("inf")).alias("reach"))

    def nearest(d: np.ndarray, reach: np.ndarray) -> np.ndarray:
        use = np.zeros(d.shape, bool)
        np.put_along_axis(use, np.argpartition(d, min(probes, d.shape[1]) - 1, axis=1)[:, :probes], True, axis=1)
        return use

    found = scanned(index, asked(index, queries, nearest), candidates + 1).where("query <> id")
    order = Window.partitionBy("query").orderBy("near", "id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= candidates).select("query", "id")
    best = ranked(measured(found, queries, index.vectors), k)
    if not exact:
        return best
    # the k-th distance so far, where k were found
    reach = best.groupBy("query").agg(F.max("distance").alias("far"), F.count("*").alias("n")).where(F.col("n") == k)
    wide = queries.drop("reach").join(reach, "query", "left").select("query", "vector", F.coalesce("far", F.lit(float("inf"))).alias("reach"))
    return ranked(compared(index, wide, k), k)

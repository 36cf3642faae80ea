"""Vectorised byte, word and line operations on batches of texts, and table helpers.

Words are maximal runs outside the bytes 0x20 and 0x09-0x0D. A word is known by a
64-bit polynomial hash of its bytes; two different words agree with probability
about 2**-64, so counts and set overlaps over hashes are taken as exact.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U = np.uint64
BASE = 0x9E3779B97F4A7C55
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space, and every ASCII byte that is neither letter nor digit.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 21
#: Groups whose counts are broadcast.
MOST_GROUPS = 100_000

_powers = np.ones(1, np.uint64)
_unpowers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    global _powers
    while len(_powers) < n:
        step = U(pow(BASE, len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers[:n]


def unpowers(n: int) -> np.ndarray:
    """The inverses of powers(n)."""
    global _unpowers
    down = pow(BASE, -1, 1 << 64)
    while len(_unpowers) < n:
        _unpowers = np.concatenate([_unpowers, _unpowers * U(pow(down, len(_unpowers), 1 << 64))])
    return _unpowers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder in use.

    Where neither is set, a temporary folder serves a local master; on a cluster no
    executor could read that, so it is an error there.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of DataFrames that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


class Shipped:
    """A broadcast value whose classes travel with it, so workers need not be able to import this package."""

    def __init__(self, spark: SparkSession, value):
        self.box = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if "held" not in self.__dict__:
            self.held = pickle.loads(self.box.value)  # noqa: S301  our own bytes
        return self.held

    def release(self) -> None:
        """Frees a worker's copies; the value can be had again."""
        self.__dict__.pop("held", None)
        self.box.__dict__.pop("_value", None)

    def __getstate__(self):
        return {"box": self.box}


def give_back() -> None:
    """Returns freed memory to the system; a reused worker otherwise keeps the most that any of its tasks took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def lean(run, *shipped: Shipped):
    """run, a function of batches, which lets go of the shipped values and gives memory back when it ends."""

    def lean_run(batches):
        try:
            yield from run(batches)
        finally:
            for s in shipped:
                s.release()
            give_back()

    return lean_run


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each after as many underscores as it takes for df to have no such column, case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        taken.add(f"_{name}".lower())
        out.append(f"_{name}")
    return out


def crc_bucket(column: str, n: int):
    """crc32(column as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def smallest(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows (group, doc_id): of each group the n with the smallest hashes of doc_id, each once.

    Groups are counted first, and only rows whose hash lies where about 4n of the group's
    do go on to be ranked, so a group with most rows sends no more than a small one. In a
    group that a few ids fill, fewer than n may be left.
    """
    ids = df.select(group, "doc_id", (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("at"))
    counts = checkpointed(ids.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("all")))
    if counts.count() <= MOST_GROUPS:  # else the engine joins as it sees fit
        counts = F.broadcast(counts)
    near = ids.join(counts, F.col(group) == F.col("g")).where(F.col("at") * F.col("all") <= 4 * n).select(group, "doc_id", "at").distinct()
    order = Window.partitionBy(group).orderBy("at", "doc_id")
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select(group, "doc_id")


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bounds the rows and the bytes of an Arrow batch, as texts can be long; lower settings stay. A longer row is a batch."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def pieces(texts: list[bytes], limit: int = CHUNK):
    """Chunks of (document index, bytes) of about limit bytes; long texts are cut after white space."""
    chunk, held = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > limit:
            end = at + limit
            while end < len(text) and not SPACE[text[end]]:
                end += 1
            end = min(end + 1, len(text))
            if chunk:
                yield chunk
                chunk, held = [], 0
            yield [(i, text[at:end])]
            at = end
        chunk.append((i, text[at:] if at else text))
        held += len(text) - at
        if held >= limit:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def laid_out(chunk: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces lower-cased in one buffer, each after a line feed; their document index and start."""
    buf = LOWER[np.frombuffer(b"\n" + b"\n".join(x for _, x in chunk) + b"\n", np.uint8)]
    starts = np.cumsum([1] + [len(x) + 1 for _, x in chunk])[:-1]
    return buf, np.array([i for i, _ in chunk], np.int64), starts


def word_spans(buf: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a buffer that begins and ends with white space."""
    edge = np.diff(space[buf].view(np.int8))
    return np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the buffer, by its own bytes only, from differences of prefix sums."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + U(1)) * powers(len(buf)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * unpowers(len(buf) + 1)[starts] + (ends - starts).astype(np.uint64) * U(0x632BE59BD9B4E019))


def sorted_set(x: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def words(texts: list[bytes], space: np.ndarray = SPACE, limit: int = CHUNK):
    """Yields (document index of each word, hash of each word) by chunk of about limit bytes, in order."""
    for chunk in pieces(texts, limit):
        buf, docs, at = laid_out(chunk)
        starts, ends = word_spans(buf, space)
        yield docs[np.searchsorted(at, starts, side="right") - 1], span_hashes(buf, starts, ends)


def all_words(texts: list[bytes], limit: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    got = list(words(texts, limit=limit))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])

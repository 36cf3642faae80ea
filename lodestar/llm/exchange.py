"""Questions from buckets of documents to parts of a key space, and the answers back.

Documents are dealt into hash buckets of bounded bytes. A bucket boils its texts down
to distinct 64-bit keys (counted locally, so a hot key costs one entry a bucket), packs
them by part of the key space, and each part answers its buckets. Packed NumPy blobs
keep this to a few large rows where one row for each key would cost a hundred times more.
Buckets are recomputed from the input if an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import give_back

BLOB = "part int, bucket int, blob binary"
SCHEMA = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
#: Bytes of text in a bucket, on average; a single longer text is a larger bucket.
BUCKET_BYTES = 6 << 20
#: Partitions of a shuffle.
MOST_PARTITIONS = 20_000
#: The column of a document's bucket; tables may have columns of any other name.
BUCKET = "__bucket"


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sized(docs: DataFrame, column: str = "text", of: int = BUCKET_BYTES) -> int:
    """Buckets of about `of` bytes of text each; of less, half a MB at least, if the shuffle has more partitions.

    A bucket's size does not grow with the corpus, so neither does what a task holds; the
    number of buckets does, and with it messages between buckets and parts become short.
    There are never more than keys.
    """
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(-(-total // of), min(shuffle_partitions(docs), -(-total // (1 << 19))), 1)


def bucketed(docs: DataFrame, buckets: int, key: list[str]) -> DataFrame:
    """docs with column BUCKET, dealt by the hash of the key columns."""
    dealt = docs.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    return dealt.repartition(partitions(docs, buckets), BUCKET)


def partitions(docs: DataFrame, buckets: int) -> int:
    """Of the shuffles between buckets and parts: few enough that their blocks, which are the square of it, can be kept track of."""
    return max(shuffle_partitions(docs), min(MOST_PARTITIONS, -(-buckets // 4)))


def once(replies: DataFrame, n: int) -> DataFrame:
    """replies behind an exchange by bucket, which several readers share instead of making them again."""
    return replies.repartition(n, "bucket")


def bucket_of(t: pa.Table) -> int:
    return t[BUCKET][0].as_py()


def packed(entries: np.ndarray, part: np.ndarray, bucket: int) -> Iterable[tuple[int, int, bytes]]:
    """(part, bucket, blob) rows of the entries, which keep their order within a part."""
    order = np.argsort(part, kind="stable")
    part, entries = part[order], entries[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for block, p in zip(np.split(entries, cuts), part[np.concatenate([[0], cuts])] if len(part) else ()):
        yield int(p), bucket, block.tobytes()


def rows_table(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())}, schema=SCHEMA)


def unpacked(t: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of the rows of t, with the bucket of each and its index within its blob."""
    blobs = [np.frombuffer(b, dtype) for b in t["blob"].to_pylist()]
    sizes = [len(b) for b in blobs]
    entries = np.concatenate(blobs) if blobs else np.zeros(0, dtype)
    index = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, np.int64)
    return entries, np.repeat(np.array(t["bucket"].to_pylist(), np.int64), sizes), index


def replied(part: int, buckets: np.ndarray, entries: np.ndarray) -> pa.Table:
    """Rows (part, bucket, blob) with the entries of each bucket."""
    order = np.argsort(buckets, kind="stable")
    buckets, entries = buckets[order], entries[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    blocks = np.split(entries, cuts) if len(entries) else []
    return rows_table((part, int(b), block.tobytes()) for b, block in zip(buckets[np.concatenate([[0], cuts])] if len(entries) else (), blocks))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def one(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f of a group, which gives back what memory it took."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        give_back()
        return out

    return run


def two(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """f of two groups, which gives back what memory it took."""

    def run(t: pa.Table, other: pa.Table) -> pa.Table:
        out = f(t, other)
        give_back()
        return out

    return run


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, part): the order of distinct keys by part and then their lower 32 bits, and the part of each key in it."""
    joint = part_of(keys, parts).astype(np.uint64) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)
    order = np.argsort(joint)
    return order, (joint[order] >> np.uint64(32)).astype(np.int64)


def ask(dealt: DataFrame, requests: Callable[[pa.Table], pa.Table], answer: Callable[[pa.Table], pa.Table], keep: bool = False) -> DataFrame:
    """Rows (part, bucket, blob) that answer what the buckets of `dealt` ask. With keep, workers keep a group's memory for the next one."""
    of = (lambda f: f) if keep else one
    return dealt.groupBy(BUCKET).applyInArrow(of(requests), BLOB).groupBy("part").applyInArrow(of(answer), BLOB)


def tell(dealt: DataFrame, replies: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str, keep: bool = False) -> DataFrame:
    """finish(documents of a bucket, replies to it) for every bucket; keep as for ask()."""
    return dealt.groupBy(BUCKET).cogroup(replies.groupBy("bucket")).applyInArrow(finish if keep else two(finish), schema)

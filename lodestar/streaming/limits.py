"""Token buckets of callers over a stream, with timers that refill them and let them go.

A key's bucket starts full. A call takes a token; without one it is turned away, or waits if
the queue has room. A timer at the next whole period fills the bucket and lets waiting calls
through, the oldest first; another, `idle` seconds after a key's last call, drops its state:
by then its bucket is full and nobody waits, which is what a new one would be.

Times are event times: timers fire as the watermark passes them, so a replay and a restart
give what the first run gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.govern import INGEST_LIMIT, QUERY_LIMIT, WINDOW_SECONDS, bucket_of

OUT = "call_id long, tool string, accepted boolean, retry_after_ms long, waited_ms long"
#: State is kept in this store, as timers and lists need it.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TokenBuckets(StatefulProcessor):
    """limits by the first part of the key; see limited()."""

    def __init__(self, limits: dict[str, int], seconds: float, queue: int, idle: float, anchor: float | None):
        self.limits, self.seconds, self.queue, self.idle, self.anchor = limits, seconds, queue, idle, anchor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Tokens left, the start of the period they belong to, and the last call's time, in seconds.
        self.bucket = handle.getValueState("bucket", "tokens int, since double, last double")
        self.waiting = handle.getListState("waiting", "call_id long, tool string, at double")

    def load(self, key: tuple, now: float) -> tuple[int, float, float]:
        if self.bucket.exists():
            return tuple(self.bucket.get())
        since = now if self.anchor is None else self.anchor + (now - self.anchor) // self.seconds * self.seconds
        return self.limits[key[0]], since, now

    def refilled(self, key: tuple, tokens: int, since: float, now: float) -> tuple[int, float]:
        periods = int((now - since) // self.seconds)
        return (self.limits[key[0]], since + periods * self.seconds) if periods > 0 else (tokens, since)

    def released(self, waiting: list, tokens: int, now: float) -> tuple[list, list, int]:
        """(rows of calls that get a token now, calls that go on waiting, tokens left)."""
        n = min(tokens, len(waiting))
        return [(c, tool, True, 0, round((now - at) * 1000)) for c, tool, at in waiting[:n]], waiting[n:], tokens - n

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # a frame at a time boils down to tuples; a key's calls of one batch are put in order
        calls = sorted((at.timestamp(), int(c), tool) for f in rows for c, tool, at in zip(f["call_id"], f["tool"], f["timestamp"]))
        waiting = [tuple(w) for w in self.waiting.get()]
        tokens, since, last = self.load(key, calls[0][0])
        out = []
        for now, call, tool in calls:
            while waiting and since + self.seconds <= now:
                # a period that ended between two calls
                tokens, since = self.limits[key[0]], since + self.seconds
                freed, waiting, tokens = self.released(waiting, tokens, since)
                out += freed
            tokens, since = self.refilled(key, tokens, since, now)
            last = max(last, now)
            if tokens > 0:
                tokens -= 1
                out.append((call, tool, True, 0, 0))
            elif len(waiting) < self.queue:
                waiting.append((call, tool, now))
            else:
                out.append((call, tool, False, max(1, int(-(-(since + self.seconds - now) * 1000 // 1))), 0))
        yield self.saved(tokens, since, last, waiting, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        out: list = []
        if self.bucket.exists():
            tokens, since, last = self.bucket.get()
            waiting = [tuple(w) for w in self.waiting.get()]
            tokens, since = self.refilled(key, tokens, since, now)
            out, waiting, tokens = self.released(waiting, tokens, now)
            if not waiting and now >= last + self.idle:
                self.bucket.clear()
                self.waiting.clear()
            else:
                yield self.saved(tokens, since, last, waiting, out)
                return
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def saved(self, tokens: int, since: float, last: float, waiting: list, out: list) -> pd.DataFrame:
        """Keeps the state and sets the timer: at the next period while calls wait, else when the key may be let go."""
        self.bucket.update((int(tokens), float(since), float(last)))
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        self.handle.registerTimer(int(-(-(since + self.seconds if waiting else last + self.idle) * 1000 // 1)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def limited(
    calls: DataFrame, limits: dict[str, int] | None = None, seconds: float = WINDOW_SECONDS, keys: tuple[str, ...] = ("caller",), queue: int = 0, idle: float | None = None, late: str = "1 minute", anchor: float | None = None
) -> DataFrame:
    """(call_id, tool, accepted, retry_after_ms, waited_ms) of a stream of calls (call_id, tool, timestamp, and the columns `keys`).

    Each kind of tool and value of the keys has a bucket of its own, so a busy stream is
    spread over callers. Periods count from a bucket's first call, or from `anchor` (seconds
    since 1970). With a queue a call without a token waits, and its row comes once it is
    let through. idle is at least a period. Rows without a timestamp, or behind the
    watermark, are left out.
    """
    spark = calls.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    limits = limits or {"query": QUERY_LIMIT, "ingestion": INGEST_LIMIT}
    idle = max(seconds, 2 * seconds if idle is None else idle)
    known = calls.where("timestamp is not null").withWatermark("timestamp", late).withColumn("bucket", bucket_of(F.col("tool")))
    grouped = known.select("bucket", *keys, "call_id", "tool", "timestamp").groupBy("bucket", *keys)
    return grouped.transformWithStateInPandas(statefulProcessor=TokenBuckets(limits, seconds, queue, idle, anchor), outputStructType=OUT, outputMode="append", timeMode="EventTime")

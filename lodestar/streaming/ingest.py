"""Incremental ingestion as a stream: every batch of changed files is merged into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..sources import parsers
from ..store import SnapshotMissing, SnapshotStore


def write_snapshots(files: DataFrame, store: SnapshotStore, project: str, checkpoint: str) -> StreamingQuery:
    """Parses each batch of a stream of (path, text) and saves a snapshot that replaces what the same files held.

    Snapshots are content-addressed, so a batch that is run again after a failure saves
    the same one.
    """
    def merge(batch: DataFrame, _: int) -> None:
        nodes, edges = parsers.graph(parsers.parse(batch.select("path", "text")))
        try:
            before, links = store.load(store.latest(project))
        except SnapshotMissing:
            store.save(nodes, edges, project)
            return
        again = batch.select(F.col("path").alias("file_path")).distinct()
        stale = before.where("span is not null").withColumn("file_path", F.col("span.file_path")).join(again, "file_path", "left_semi").select("id")
        kept = before.join(stale, "id", "left_anti").join(nodes.select("id"), "id", "left_anti")
        left = links.join(stale.withColumnRenamed("id", "from_id"), "from_id", "left_anti").select(*links.columns)
        store.save(kept.unionByName(nodes), ingest.enrich(left, edges), project)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Continuous ingest: micro-batches of scanned files go through the same diff as a one-shot update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import KEY, SnapshotStore, documents, merge_changes, new_content
from ..storage import cut


def upsert(store: SnapshotStore, batch: DataFrame) -> None:
    """Add or update the files of a batch; files it doesn't name stay.  Of repeated files the last one holds.

    Only rows that change are written, as a log that readers merge and that is folded into the table from sixteen batches on.
    Running a batch again changes nothing, so a restarted stream neither loses nor repeats a file.
    """
    now, base = F.current_timestamp(), store.version()
    newest = cut(batch.groupBy(*KEY).agg(F.max_by(F.struct("title", "hash", "doc"), F.struct("modified_at", "hash")).alias("f")).select(*KEY, "f.*"))
    fresh = newest.select(*KEY, F.col("title").alias("_title"), F.col("hash").alias("_hash"))
    stored, content = documents(store), store.read("content")
    if stored is None:
        stored = fresh.limit(0).select(*KEY, F.col("_title").alias("title"), F.col("_hash").alias("hash"), now.alias("created_at"), now.alias("modified_at"), F.lit(True).alias("active"))
    both = fresh.join(stored, KEY, "left").where(~(F.col("hash").eqNullSafe(F.col("_hash")) & F.col("active").eqNullSafe(True)))
    changes = both.select(*KEY, F.col("_title").alias("title"), F.col("_hash").alias("hash"), F.coalesce("created_at", now).alias("created_at"), now.alias("modified_at"), F.lit(True).alias("active"), F.lit(base + 1).cast("long").alias("seq"))
    if content is None:
        content = newest.limit(0).select("hash", "doc", now.alias("created_at"))
    store.commit(appended={"changes": changes, "content": new_content(content, newest, now)}, base=base)
    merge_changes(store)
    store.compact("content")


def ingest_stream(files: DataFrame, store: SnapshotStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``upsert`` on each micro-batch of ``collection, path, title, hash, doc, modified_at``."""
    writer = files.writeStream.foreachBatch(lambda batch, _: upsert(store, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

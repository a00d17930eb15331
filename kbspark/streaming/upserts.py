"""Document versions as a stream: each micro-batch replaces what it changes, and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.incremental import changes, latest
from ..sources.store import Store


def apply_batch(store: Store, batch: DataFrame) -> dict:
    """Puts the last version of each path of a batch (path, version, deleted and the store's other columns) in
    place; the store's key is ``path`` and its version ``version``. Versions that are not newer than the
    stored one change nothing, so a batch may come twice. A deletion is such a version: it stays as a
    row without content, so that an older version that comes late does not bring the document back. ``living``
    leaves these rows out. Only data files that hold paths of the batch are written again."""
    fresh = latest(batch)
    if "content" in fresh.columns:
        fresh = fresh.withColumn("content", F.when(~F.col("deleted"), F.col("content")))
    return store.upsert(fresh)


def living(rows: DataFrame) -> DataFrame:
    """The documents that are not deleted."""
    return rows.filter(~F.coalesce("deleted", F.lit(False)))


def maintain(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Runs ``apply_batch`` over everything that is there now, then stops."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by window and type, with a bound on how late an event may be."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    return changes(old, new).filter("status != 'same'")

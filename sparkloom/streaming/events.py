"""Streams: windowed counts, first occurrences, sessions, and keeping stores up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.changes import Memo, Store


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, keys, n): counts of windows; events that come later than late after the newest are dropped from a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(keys, session_start, session_end, n): runs of events with no longer gap."""
    return events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key's first event, with state only as long as late."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def into_store(stream: DataFrame, store: Store, keys: list[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """A query that merges each batch into a store by key; a batch that is run twice changes nothing more."""

    def merge(batch: DataFrame, _: int) -> None:
        store.upsert(prepare(batch) if prepare else batch, keys)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_updates(stream: DataFrame, memo: Memo, repository: str, changed: Callable[[DataFrame], None], checkpoint: str, order: str = "mtime"):
    """A query over (relative_path, content_hash, order, ...) rows that passes on what changed since the memo and then saves the hashes.

    Of several versions of a file in one batch the one of the highest order counts, of equal ones that of the larger hash.
    """
    from sparkloom.operators.changes import diff, latest

    def handle(batch: DataFrame, _: int) -> None:
        rows = latest(batch, ["relative_path"], order, "content_hash")
        new = diff(rows, memo.hashes(repository)).where("status IN ('added', 'modified')")
        changed(rows.join(new, "relative_path"))
        memo.save(repository, "file_hash", rows.select("relative_path", "content_hash"))

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

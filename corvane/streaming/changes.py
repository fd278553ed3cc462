"""A change feed that keeps a versioned table up to date, and windowed counts with a watermark (both are extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.sources.store import Store


def latest(changes: DataFrame, key: str, at: str) -> DataFrame:
    """The last change of each key."""
    return changes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("__n = 1").drop("__n")


def merge(rows: DataFrame, changes: DataFrame, key: str, status: str = "status") -> DataFrame:
    """rows after changes: deleted and changed keys go, new rows come."""
    kept = rows.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where(F.col(status) != "D").select(rows.columns))


def maintain(feed: DataFrame, store: Store, name: str, key: str, at: str, checkpoint: str) -> StreamingQuery:
    """Run the feed (columns of the table, status, time) into a table of the store, one version per batch.

    A batch that runs twice gives the same table, since the last change of a key replaces it.
    """

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.put(name, merge(store.get(name), latest(batch, key, at), key))

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of value by tumbling window and key; events later than the watermark are dropped."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))

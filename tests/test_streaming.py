from __future__ import annotations

from corvane.plans.registry import read
from corvane.sources.store import Store
from corvane.streaming import changes


def test_change_feed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.put("t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    feed = str(tmp_path / "feed")
    spark.createDataFrame([(1, "x", "M", 1), (1, "y", "M", 2), (2, None, "D", 1), (3, "n", "A", 1)], "k long, v string, status string, at long").write.parquet(feed)
    stream = spark.readStream.schema("k long, v string, status string, at long").parquet(feed)
    changes.maintain(stream, store, "t", "k", "at", str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in store.get("t").collect()} == {(1, "y"), (3, "n")}


def test_windows(spark, sf, tmp_path):
    events = read(spark, sf, "events")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    counts = changes.windowed_counts(stream, "ts", "event_type")
    counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()

"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from stavework.streaming import events


def test_windows_and_changes(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10", "a", "x", 1.0), (2, "2024-01-01 00:00:50", "a", "y", 3.0), (2, "2024-01-01 00:00:50", "a", "y", 3.0), (3, "2024-01-01 00:01:05", "b", "x", 5.0)]
    df = spark.createDataFrame(rows, "id int, at string, k string, s string, v double").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = events.read_files(spark, str(tmp_path / "in"), df.schema)
    q = events.write_once(events.deduplicate(stream, "id", "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    counts = events.window_counts(stream, ["k"], "at", "1 minute", "1 minute", "v")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n, r["mean"]) for r in spark.table("counts").collect()) == [("a", 3, 7 / 3), ("b", 1, 5.0)]
    q = events.changes(stream, "k", "s").writeStream.format("memory").queryName("changes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.before, r.after) for r in spark.table("changes").collect() if r.k == "b") == [("b", None, "x")]

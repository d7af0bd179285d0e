from datetime import datetime, timedelta

from millrace.streaming import counters


def test_stream_agrees_with_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(minutes=7 * k), f"k{k % 3}", float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, key string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, counters.windowed(df, "ts", "key", "value", "1 hour", "30 minutes").collect()))
    stream = counters.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "key", "value", "1 hour", "30 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("counted").collect())) == want


def test_late_events_are_dropped(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "ts timestamp, key string, value double"
    (tmp_path / "in").mkdir()
    folder = str(tmp_path / "in")
    stream = counters.windowed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "ts", "key", "value", "10 minutes", late="5 minutes")

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(60)

    batch([(t0, "a", 1.0)])
    batch([(t0 + timedelta(hours=1), "a", 1.0)])
    batch([(t0 + timedelta(minutes=1), "a", 1.0), (t0 + timedelta(hours=2), "a", 1.0)])
    got = {r.start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[t0] == 1

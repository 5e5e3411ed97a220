"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from tracewell.streaming import incremental


def test_windows_equal_the_batch(spark, tmp_path):
    rows = [(k, f"2024-01-{1 + k % 9:02} 10:00:00", k % 3, float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "value")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = incremental.account_windows(incremental.read_files(spark, f"{tmp_path}/in", df.schema))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted((r.window.start, r.user_id, r.n) for r in d.collect())
    assert key(spark.table("windows")) == key(incremental.account_windows(df))


def test_every_row_is_ingested_once(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "event_id")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    for _ in range(2):
        stream = incremental.read_files(spark, f"{tmp_path}/in", df.schema, per_trigger=1)
        incremental.ingest(stream, f"{tmp_path}/state", lambda b, k: b.write.mode("append").parquet(out)).awaitTermination(120)
    assert spark.read.parquet(out).count() == 100

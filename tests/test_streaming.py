from pyspark.sql import functions as F

from webloom.streaming import snapshots as S


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_and_sessions_equal_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = S.event_stream(spark, str(tmp_path / "events"))
    got = drain(S.windowed_counts(stream), "windows", "complete")
    want = batch.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("events"))
    assert got.select("start", "event_type", "events").exceptAll(want).isEmpty() and got.count() == want.count()
    assert drain(S.sessions(stream), "sessions").agg(F.sum("events").alias("n")).first().n <= batch.count()


def test_rank_changes_across_batches(spark, tmp_path):
    src = str(tmp_path / "ranks")
    frame = lambda rows: spark.createDataFrame(rows, "keyword string, position double, t string").select("keyword", "position", F.to_timestamp("t").alias("checked_at"))
    run = lambda: S.append_ranks(S.rank_changes(spark.readStream.schema(S.RANKS).parquet(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    frame([("a", 20.0, "2026-01-01 00:00:00"), ("a", 8.0, "2026-01-02 00:00:00")]).write.parquet(src)
    run()
    frame([("a", 9.0, "2026-01-03 00:00:00"), ("b", 1.0, "2026-01-03 00:00:00")]).write.mode("append").parquet(src)
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("keyword", "checked_at").collect()
    assert [(r.keyword, r.change) for r in rows] == [("a", None), ("a", 12.0), ("a", -1.0), ("b", None)]

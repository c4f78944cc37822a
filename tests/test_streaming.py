from pyspark.sql import functions as F

from tabulon.streaming import events


def source(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return events.read_stream(spark, folder, schema, "events.parquet")


def test_windows(spark, folder):
    got = events.drain(events.windowed(source(spark, folder), "ts", "event_type", "value", "1 hour"), "w1", "complete")
    batch = spark.read.parquet(f"{folder}/events.parquet")
    assert got.agg(F.sum("n")).first()[0] == batch.count()
    want = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("start"), "event_type").count()
    assert got.select("start", "event_type", F.col("n").alias("count")).exceptAll(want).count() == 0


def test_sessions_and_repeats(spark, folder):
    got = events.drain(events.sessions(source(spark, folder), "ts", "user_id", "30 minutes"), "s1", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{folder}/events.parquet").count()
    once = events.drain(events.without_repeats(source(spark, folder), "ts", ["event_id"]), "d1")
    assert once.count() == once.select("event_id").distinct().count()


def test_running_totals(spark, folder):
    got = {r.event_type: r.n for r in events.drain(events.running_totals(source(spark, folder), "event_type", "value"), "r1", "update").collect()}
    want = {r.event_type: r["count"] for r in spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()}
    assert got == want

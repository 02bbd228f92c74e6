"""Queries that run a stream over a table's files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..streaming import logs


def _place(spark: SparkSession) -> str:
    """A new folder where a cluster's executors can all write."""
    root = shared_folder(spark)
    return f"{root}/stream-{uuid.uuid4().hex}"


def stream_daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events by day and type, counted by a stream in complete mode."""
    place = _place(spark)
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    stream = events.withColumn("ts", F.col("ts").cast("timestamp"))
    logs.drain(logs.counts_by_window(stream, "ts", "1 day", ["event_type"], "1 day"), f"{place}/out", f"{place}/state", "complete")
    return spark.read.parquet(f"{place}/out").select(F.col("start").cast("date").alias("day"), "event_type", "n")


def stream_once_each(spark: SparkSession, sf: str) -> DataFrame:
    """Event ids, each once, read as a stream of two copies of the table."""
    place = _place(spark)
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    stream = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    logs.drain(logs.once_each(stream, ["event_id"], "ts", "60 days").select("event_id", "event_type"), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_latest_user(spark: SparkSession, sf: str) -> DataFrame:
    """Latest event of each user, kept by an upsert stream of several batches."""
    place = _place(spark)
    events = table(spark, sf, "events")
    events.repartition(3).write.parquet(f"{place}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    key = (["user_id"], "ts", "event_id")
    logs.upsert(stream, *key, f"{place}/store", f"{place}/state").awaitTermination()
    return logs.current_state(spark, f"{place}/store", *key).where("user_id IS NOT NULL").select("user_id", "event_id", "event_type", "revisions")


QUERIES = {f.__name__: f for f in (stream_daily_events, stream_once_each, stream_latest_user)}
ORACLES = {
    "stream_daily_events": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_once_each": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stream_latest_user": "SELECT user_id, max({'t': ts, 'e': event_id}).e AS event_id, max({'t': ts, 'e': event_id, 'y': event_type}).y AS event_type, count(*) AS revisions FROM events WHERE user_id IS NOT NULL GROUP BY 1",
}

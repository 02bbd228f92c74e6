"""Append-only logs as streams: current state, repeated records, counts by time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.sinks import current_records


def log_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json") -> DataFrame:
    """Records of the files of a folder as they arrive."""
    return spark.readStream.schema(schema).format(kind).load(path)


def upsert(stream: DataFrame, key: Sequence[str], time: str, sequence: str, store: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest record per key, and its number of revisions, in ``store``.

    Each batch is combined by key and written to a folder of its own number;
    what came before is neither read nor rewritten.  A replayed batch
    overwrites its folder, so a lost run changes nothing.  ``current_state``
    reads the store; ``compact`` makes one folder of many.
    """

    def keep(batch: DataFrame, number: int) -> None:
        current_records(batch, key, time, sequence).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(spark: SparkSession, store: str, key: Sequence[str], time: str, sequence: str) -> DataFrame:
    """Latest record per key over all batches, with its revisions counted through them; an unreadable batch is an error."""
    rows = spark.read.parquet(store).drop("batch")
    rest = [c for c in rows.columns if c not in (*key, time, sequence, "revisions")]
    last = rows.groupBy(*key).agg(F.max(F.struct(time, sequence, *rest)).alias("__r"), F.sum("revisions").alias("revisions"))
    return last.select(*key, "__r.*", "revisions")


def compact(spark: SparkSession, store: str, key: Sequence[str], time: str, sequence: str, into: str) -> None:
    """Write the state as the only batch of a new store."""
    current_state(spark, store, key, time, sequence).write.mode("overwrite").parquet(f"{into}/batch=0")


def once_each(stream: DataFrame, key: Sequence[str], time: str, lateness: str) -> DataFrame:
    """The first record of each key within the lateness bound; the state is dropped behind the watermark."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(key))


def counts_by_window(stream: DataFrame, time: str, width: str, by: Sequence[str], lateness: str) -> DataFrame:
    """Tumbling window counts with a watermark."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def drain(frame: DataFrame, path: str, checkpoint: str, mode: str = "append", after: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Run a stream over all files there are and write what it gives; in complete mode the last state."""

    def write(batch: DataFrame, number: int) -> None:
        rows = after(batch) if after else batch
        if mode == "complete":
            rows.write.mode("overwrite").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_budget(requests: DataFrame, key: str, day: str, order: Sequence[str], most: int) -> DataFrame:
    """Requests within each key's daily budget, first come first served."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key, day).orderBy(*order))
    return requests.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")

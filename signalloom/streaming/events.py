"""Windowed aggregates of an event stream (an extension; the batch engine needs none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_windows(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums a window and event type; on a stream, events later than ``late`` behind the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def read_events(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """The event files of a folder, or one file, as a stream."""
    stream = spark.readStream.schema(spark.read.parquet(folder).schema)
    # As a pattern, which may match a single file.
    pattern = f"{folder[:-1]}[{folder[-1]}]"
    return (stream.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else stream).parquet(pattern)


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Drain what there is into an in-memory table; for tests and small replays."""
    job = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return stream.sparkSession.table(name)


def drain(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what there is and stop; windows that a batch changes are written below ``folder``.

    A batch replaces its own files, so one that is run again after a failure
    leaves nothing twice, and a new call goes on from the checkpoint.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    job = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def latest(spark: SparkSession, folder: str, keys: list[str], values: list[str]) -> DataFrame:
    """What the last batch that changed it says of each key."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    last = F.max_by(F.struct(*values), F.col("batch").cast("long"))
    return rows.groupBy(*keys).agg(last.alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])

"""Event streams: windows, sessions, deduplication and running statistics, each with a batch form of the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with the schema that the folder has now; ts is in the session's time zone."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n, total) of time windows; as a stream rows later than `late` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions that end after a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once; a stream forgets ids after `late`."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def running_stats(events: DataFrame) -> DataFrame:
    """(user_id, n, mean, variance, least, most): mergeable statistics of each user, in complete or update mode."""
    return events.groupBy("user_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.min("value").alias("least"), F.max("value").alias("most"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that runs over all there is and ends; the checkpoint makes the output exactly-once."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)

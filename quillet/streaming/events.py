"""Event streams: state of each agent, tumbling, sliding and session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillet.sources import shared


def stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The files of that name in a folder, as a stream from the earliest on."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*").option("recursiveFileLookup", "true").parquet(folder)


def latest_state(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stateful aggregation over all that its source has now, and return each key's
    last state. Every micro-batch writes its changes to a folder of its own number, so a
    batch that is run again replaces what it wrote."""
    spark = counts.sparkSession
    out, mark = shared.folder(spark, "state"), shared.folder(spark, "progress")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch__", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    counts.writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    kept = [F.max_by(c, "batch__").alias(c) for c in counts.columns if c not in keys]
    return spark.read.schema(counts.schema.add("batch__", IntegerType())).option("recursiveFileLookup", "true").parquet(out).groupBy(*keys).agg(*kept)


def agent_state(events: DataFrame, agent: str = "user_id") -> DataFrame:
    """Events, time of the last, and its type, of each agent; ties go to the greater event_id."""
    last = F.max_by(F.struct("ts", "event_type", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy(agent).agg(F.count("*").alias("n"), last.alias("last"))


def windows(events: DataFrame, length: str, slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Events and the sum of value in each window of event time; later ones than ``late`` are left out.
    Windows start at whole lengths since 1970 in UTC, so ts is read in a UTC session."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(span.alias("span"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Sessions of each user: runs of events with no gap of that length."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("span")).agg(F.count("*").alias("n"))

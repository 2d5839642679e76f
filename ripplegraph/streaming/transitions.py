"""Layer transitions of triples that arrive as files, and event counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import triples
from ripplegraph.sources import readers


def stream_triples(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """New JSON files of triples with the time `at` when they were found in."""
    raw = spark.readStream.schema(readers.TRIPLE + ", at timestamp").option("maxFilesPerTrigger", files_per_trigger).json(path)
    return raw.select("*", F.lower(F.trim("start_layer")).alias("sl"), F.lower(F.trim("end_layer")).alias("el"))


def windowed_transitions(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """window_start, sl, el, n of distinct triples (paper, nodes, relation), late ones up to `late` counted."""
    once = stream.where(triples.is_layer(F.col("sl")) & triples.is_layer(F.col("el"))).withWatermark("at", late).dropDuplicatesWithinWatermark(["paper_id", "start_node", "relationship", "end_node"])
    return once.groupBy(F.window("at", width).alias("w"), "sl", "el").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "sl", "el", "n")


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, value of a stream (or table) of events."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def into_table(result: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is there now, appending finished windows to a Parquet table."""
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()

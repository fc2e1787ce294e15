"""Incremental evaluation of documents as they arrive.

The batch expressions run unchanged on a stream; only what needs state is here. The
results over a finished stream equal the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import evidence, language


def evaluated(documents: DataFrame) -> DataFrame:
    """Language and identifiers of each arriving document (doc_id, text): stateless."""
    found = {k: evidence.extracted(F.col("text"), k) for k in ("cas", "h_codes", "p_codes", "un")}
    return documents.select("doc_id", language.detect_language(F.col("text")).alias("language"), *(c.alias(k) for k, c in found.items()))


def without_reuploads(documents: DataFrame, time: str, within: str) -> DataFrame:
    """Documents whose content did not arrive already within the time; state is kept
    for that long only."""
    hashed = documents.withColumn("sha256", F.sha2("text", 256)).withWatermark(time, within)
    return hashed.dropDuplicatesWithinWatermark(["sha256"])


def event_counts(events: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Counts by type in tumbling windows; rows later than ``late`` are left out."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")


def appended(results: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each micro-batch as Parquet, once."""
    return results.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")

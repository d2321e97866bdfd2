"""Evidence that arrives: the row-local stages as a stream, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sensitivity
from ..functions.profile import characterize

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files in a folder, profiled and searched for sensitive matches; append mode."""
    files = spark.readStream.format("binaryFile").schema(_FILES).load(folder)
    rows = characterize(files.where("length > 0").withColumn("sha256", F.sha2("content", 256)), "content")
    rows = sensitivity.analyze(rows.withColumn("body", sensitivity.decoded(F.col("content"))), "body")
    return rows.select("path", "modificationTime", "length", "sha256", "entropy", "printable_ratio", "characterization", "sensitivity_level", "categories", "match_count")


def activity(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; works on streams (with a watermark) and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")

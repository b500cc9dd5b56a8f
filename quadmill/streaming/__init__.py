"""Streams of N-Triples and N-Quads lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reader import line_facts


def stream_lines(spark: SparkSession, path: str, format: str = "nt") -> DataFrame:
    """New files below a path as facts: doc_id, s, p, o, g, src_offset (null), parser, error, read_at."""
    text = spark.readStream.text(path)
    rows = text.select(F.col("_metadata.file_path").alias("doc_id"), F.lit(None).cast("long").alias("src_offset"), F.col("value").alias("line"))
    return line_facts(rows, format).withColumn("read_at", F.current_timestamp())


def deduplicated(facts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each quad once, as long as its copies come within the delay; older state is dropped."""
    keyed = facts.where("error IS NULL").withColumn("g_", F.coalesce("g", F.lit("")))
    return keyed.withWatermark("read_at", delay).dropDuplicatesWithinWatermark(["s", "p", "o", "g_"]).drop("g_")


def counts(facts: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Facts by predicate in tumbling windows of arrival."""
    return facts.where("error IS NULL").withWatermark("read_at", delay).groupBy(F.window("read_at", width), "p").count()

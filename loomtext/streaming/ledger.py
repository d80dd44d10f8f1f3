"""Ledger files as a stream (an extension): counts by window and step, with a watermark on the entries' time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON lines as they arrive: ts, step, raw. Malformed lines are skipped."""
    lines = spark.readStream.format("text").load(path)
    good = lines.filter(F.try_parse_json("value").isNotNull())
    return good.select(F.get_json_object("value", "$.ts").try_cast("timestamp").alias("ts"), F.get_json_object("value", "$.step").alias("step"), F.col("value").alias("raw"))


def step_windows(entries: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Entries by window and step; those later than the watermark are left out."""
    w = entries.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.coalesce("step", F.lit("?")).alias("step"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "step", "n")

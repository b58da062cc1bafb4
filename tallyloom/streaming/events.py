"""Streams: live event logs, windows over events, and the barrier that emits a group once it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.files import event_lines
from tallyloom.streaming.runs import log_lines


def log_stream(spark: SparkSession, path: str, secrets: list[str] = ()) -> DataFrame:
    """Events of growing logs of JSON lines, each with its place in the log; secrets are blotted out before anything is parsed."""
    lines = log_lines(spark, path)
    for secret in secrets:
        lines = lines.withColumn("line", F.replace("line", F.lit(secret), F.lit("***")))
    return event_lines(lines)


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))


def complete_groups(results: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of which every expected member has a result."""
    done = results.groupBy(*keys).agg(F.count_distinct("member").alias("seen"))
    return done.join(expected, keys).where("seen >= expected").select(*keys)


def new_work(inputs: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose fingerprint has no stored result."""
    return inputs.join(stored.select(*keys), keys, "left_anti")

"""Queries that run as streams over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.streaming import ingest


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value by type and day."""
    stream = ingest.read_arrivals(spark, f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.run_available(ingest.windowed_counts(stream, "ts", "event_type", "value")).withColumn("total", F.round("total", 6))


QUERIES = {"event_windows": event_windows}
SQL = {"event_windows": "select date_trunc('day', ts) as window_start, event_type, count(*) as rows, round(sum(value), 6) as total from events group by all"}

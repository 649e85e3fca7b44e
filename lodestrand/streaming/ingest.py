"""Streams of records: first deliveries, windowed counts, and runs over what has arrived so far."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import shared_folder


def read_arrivals(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as a stream, with the schema that they have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_deliveries(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each record once, as long as its copies arrive within the allowed lateness of each other; state beyond that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """by, window start, rows and sum of a value, in tumbling windows; rows later than allowed are left out of a running stream."""
    sums = stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))
    return sums.select(F.col("window.start").alias("window_start"), by, "rows", "total")


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, its progress kept in the shared folder, and give the result as a table.

    Complete results come from the last batch; append results are the union of all.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/lodestrand/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")

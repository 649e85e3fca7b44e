"""Row numbers over a whole table without a single task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, digest: Column, *order: str, name: str = "number", digits: int = 3) -> DataFrame:
    """Rows numbered from 1 in order of a hexadecimal digest, then `order`.

    Rows with the same first digits are numbered within their slice and shifted by the rows before it; there are
    16**digits slices, whose counts are broadcast.
    """
    sliced = df.withColumn("_d", digest).withColumn("_s", F.substring("_d", 1, digits))
    counts = sliced.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))  # at most 16**digits rows
    before = counts.select("_s", (F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_s").orderBy("_d", *order))
    return sliced.join(F.broadcast(before), "_s").withColumn(name, F.col("_b") + inside).drop("_s", "_b", "_d")

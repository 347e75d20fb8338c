"""Streaming sufficient statistics: micro-batches of images are added to a table of sums.

The reference data flow is bounded; this is an extension for images that keep arriving. The table is written as one
Parquet folder a version, each named by its batch, so that a batch that is run again after a failure
replaces its own output and is never added twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def batch_sums(df: DataFrame, class_no: str = "class_no", pixels: str = "pixels", weight: str = "weight") -> DataFrame:
    """(class_no, p, wx, w): weighted sums for each class and pixel."""
    long = df.select(class_no, weight, F.posexplode(pixels).alias("p", "v"))
    return long.groupBy(class_no, "p").agg(F.sum(F.col(weight) * F.col("v")).alias("wx"), F.sum(weight).alias("w"))


def class_averages(spark: SparkSession, path: str, alpha: float = 0.01) -> DataFrame:
    """(class_no, p, average) of all batches so far."""
    sums = spark.read.parquet(path)
    return sums.groupBy("class_no", "p").agg((F.sum("wx") / (F.sum("w") + alpha)).alias("average"))


def accumulate(stream: DataFrame, path: str, checkpoint: str, class_no: str = "class_no", pixels: str = "pixels", weight: str = "weight", **trigger) -> StreamingQuery:
    """Start adding the stream's images to the sums at path, a partition a batch; trigger: as for writeStream.trigger."""

    def add(batch: DataFrame, number: int) -> None:
        sums = batch_sums(batch, class_no, pixels, weight).withColumnRenamed(class_no, "class_no")
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows of each key in tumbling windows, with a watermark for late ones."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), key).agg(F.count("*").alias("n"))

"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.session import ship_package

#: Rows and bytes of an Arrow batch: bounds what a Python worker holds at once, however long texts are.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Characters of text that an operator takes from a batch at once.
SLICE_CHARS = 1 << 18


def prepare(spark: SparkSession) -> SparkSession:
    """Set the Arrow batch bounds and ship the package to the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)
    return spark


#: How to drop the models that this Python worker holds from task to task, by operator.
_MODELS: dict[str, Callable[[], None]] = {}


def holds(operator: str, drop: Callable[[], None]) -> None:
    """Tell how an operator's models are dropped when a reused worker goes on to another one."""
    _MODELS[operator] = drop


def begin(operator: str) -> None:
    """At the start of a task in a worker: drop the models of other operators."""
    for name, drop in _MODELS.items():
        if name != operator:
            drop()


def finish(*stores: dict) -> None:
    """At the end of a task in a worker: empty the stores and give free memory back, as idle workers stay alive."""
    for store in stores:
        store.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a libc that trims
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table; one in fewer partitions than there are cores, as of one small file, is dealt out evenly."""
    df = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


#: MB of input, as it is stored, that one task should take at most before rows are dealt anew, and that it then takes.
LARGEST_PART, DEALT_PART = 32, 16


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, its rows dealt by a hash of keys where one task would read much of its files.

    A row group is read by one task and held there, however small the splits of its file are; a file of one large
    row group would keep a single core busy and go on as one large file.
    """
    if not df.inputFiles():
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e6
    if size <= LARGEST_PART:
        return df
    # no column is read: the counts of rows are in the files' footers
    parts = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    if not parts.total or size * parts.most / parts.total <= LARGEST_PART:
        return df
    return df.repartition(math.ceil(size / DEALT_PART), *keys)


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Texts of a string array (null: empty) in lists of bounded size; a longer text comes alone."""
    some: list[str] = []
    size = 0
    for text in column.to_pylist():
        text = text or ""
        if some and size + len(text) > limit:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


#: Labelled rows that a model is fitted on at most, and characters of their texts in all (documented bounds of the fit
#: alone; all rows are scored).
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 16_000_000
#: Longer texts are not sampled, so that one of them does not use up the bound.
LONGEST_SAMPLED = 250_000
#: Partitions that a sample is dealt to.
SAMPLE_PARTS = 16


def trains() -> Column:
    """True for the documents that models may learn from: crc32(doc_id as text) mod 3 is not 1."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, labels) of at most `rows` rows of labels, the least by a hash of doc_id, outside the held-out fold.

    Of rows that share a doc_id, documents give their least text and labels their least values. In the order of
    the hash, texts of up to LONGEST_SAMPLED characters are taken while these are at most `chars` in all. The bound of rows makes the label
    side small enough to broadcast and the running sum over the sample one task of at most `rows` rows.
    """
    named = [c for c in labels.columns if c != "doc_id"]
    chosen = labels.where(F.col("doc_id").isNotNull() & trains()).groupBy("doc_id").agg(F.min(F.struct(*named)).alias("__of"))
    few = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    short = documents.where(F.coalesce(F.char_length("text"), F.lit(0)) <= LONGEST_SAMPLED)
    met = short.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__of").alias("__of"))
    upto = F.sum(F.coalesce(F.char_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("__upto", upto).where(F.col("__upto") <= chars).select("doc_id", "text", "__of.*").repartition(SAMPLE_PARTS, "doc_id")

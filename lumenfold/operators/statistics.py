"""Statistics over long tables: covariance, distances, extrema, step-up tests."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.em import matrix_of, squared_difference
from lumenfold.session import materialize, ship_package

#: Places of a side of a tile of products.
TILE = 512
#: References that one matrix product takes.
BLOCK = 4096


def covariance(rows: DataFrame, values: str = "pixels") -> DataFrame:
    """(i, j, cov) for i <= j of the population covariance of equally long arrays, of a few thousand places at most.

    Each task adds up the products of its batches in tiles of TILE places, written once a task; sums by tile
    are shuffled, not pairs of values. Longer arrays: principal_axes() takes projections.
    """
    ship_package(rows.sparkSession)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram: np.ndarray | None = None
        for batch in batches:
            if len(batch):
                x = matrix_of(batch.column(0))
                x = np.column_stack([x, np.ones(len(x))])
                gram = x.T @ x if gram is None else gram + x.T @ x
        if gram is None:
            return
        d = len(gram)
        for a in range(0, d, TILE):
            for b in range(a, d, TILE):
                i, j = np.meshgrid(np.arange(a, min(a + TILE, d)), np.arange(b, min(b + TILE, d)), indexing="ij")
                upper = i <= j
                last = (i == d - 1) | (j == d - 1)
                kind = np.where(last & (i == j), 2, np.where(last, 1, 0))[upper]
                yield pa.record_batch([pa.array(i[upper]), pa.array(j[upper]), pa.array(kind), pa.array(gram[i, j][upper])], ["i", "j", "kind", "x"])

    sums = rows.select(values).mapInArrow(products, "i bigint, j bigint, kind bigint, x double").groupBy("i", "j", "kind").agg(F.sum("x").alias("x"))
    sums = materialize(sums, "products")
    n = sums.where("kind = 2").select(F.col("x").alias("n"))
    means = sums.where("kind = 1").crossJoin(F.broadcast(n)).select(F.col("i").alias("at"), (F.col("x") / F.col("n")).alias("mean"))  # n is one row
    left, right = (means.select(F.col("at").alias(c), F.col("mean").alias(f"m{c}")) for c in ("i", "j"))
    met = sums.where("kind = 0").join(left, "i").join(right, "j").crossJoin(F.broadcast(n))
    return met.select("i", "j", (F.col("x") / F.col("n") - F.col("mi") * F.col("mj")).alias("cov"))


def columns(rows: DataFrame, values: str = "pixels") -> DataFrame:
    """(p, mean, std, least): population statistics of each place of equally long arrays."""
    long = rows.select(F.posexplode(values).alias("p", "v"))
    return long.groupBy("p").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"))


def distances(rows: DataFrame, references: DataFrame, key: str, other: str, values: str = "pixels") -> DataFrame:
    """(key, other, distance2) of rows from a stated set of references, which are taken in blocks of BLOCK, one matrix product a batch."""
    parts: list[DataFrame] = []
    names: list = []
    block: list[list[float]] = []

    def close() -> None:
        found = squared_difference(rows, (list(names), np.array(block, float)), key, values, other, references.schema[other].dataType)
        parts.append(found.select(key, other, (2 * F.col("diff2")).alias("distance2")))

    for r in references.select(other, values).toLocalIterator():
        names.append(r[0])
        block.append(r[1])
        if len(names) == BLOCK:
            close()
            names, block = [], []
    if names or not parts:
        close() if names else parts.append(rows.limit(0).select(key, F.lit(None).cast(references.schema[other].dataType).alias(other), F.lit(0.0).alias("distance2")))
    return functools.reduce(DataFrame.unionByName, parts)


def local_maxima(rows: DataFrame, by: str, order: str, value: str, reach: int = 1) -> DataFrame:
    """rows larger than all neighbours within `reach` places; beyond the ends nothing is compared."""
    near = Window.partitionBy(by).orderBy(order)
    ok = F.lit(True)
    for k in range(1, reach + 1):
        for neighbour in (F.lag(value, k).over(near), F.lead(value, k).over(near)):
            ok = ok & F.coalesce(F.col(value) > neighbour, F.lit(True))
    return rows.withColumn("__max", ok).where("__max").drop("__max")


def first_difference(rows: DataFrame, by: str, order: str, value: str, out: str = "difference") -> DataFrame:
    """rows with the next value less this one; the last of each group goes."""
    following = F.lead(value).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn(out, following - F.col(value)).where(F.col(out).isNotNull())


def step_up(rows: DataFrame, by: str, value: str, tie: str, level: float, total: Column | None = None) -> DataFrame:
    """(by, threshold, rejected): the largest k whose k-th smallest value is at most level * k / n.

    level is the decimal number that it is written as, and its product with k is exact. Null values come last and never pass.
    """
    rising = Window.partitionBy(by).orderBy(F.col(value).asc_nulls_last(), F.col(tie).asc_nulls_last())
    whole = Window.partitionBy(by)
    n = F.count("*").over(whole) if total is None else total
    placed = rows.withColumn("k", F.row_number().over(rising)).withColumn("n", n)
    passed = F.col(value) <= (F.lit(Decimal(str(level))) * F.col("k")).cast("double") / F.col("n")
    return placed.groupBy(by).agg(F.max(F.when(passed, F.col(value))).alias("threshold"), F.coalesce(F.max(F.when(passed, F.col("k"))), F.lit(0)).cast("long").alias("rejected"))


def quantile(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """(by, quantile): linear interpolation between order statistics."""
    return rows.groupBy(by).agg(F.percentile(value, F.lit(share)).alias("quantile"))

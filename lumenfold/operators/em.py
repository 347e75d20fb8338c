"""Expectation-maximisation building blocks; everything per image stays in one partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from lumenfold.session import ship_package


def reference_images(means: DataFrame, at: str = "p", value: str = "r", by: str = "class_no") -> tuple[list, np.ndarray]:
    """Class numbers and their images from a long table, whose size the model fixes."""
    rows = means.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(at, value))).alias("r")).orderBy(by).collect()
    return [r[by] for r in rows], np.array([[x[value] for x in r["r"]] for r in rows], float)


def matrix_of(batch: pa.Array) -> np.ndarray:
    """The rows of an array column of equally long arrays as a matrix."""
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(batch), -1).astype(float, copy=False)


def squared_difference(images: DataFrame, references: tuple[list, np.ndarray], image: str = "vec_id", pixels: str = "pixels", by: str = "class_no", kind: DataType | None = None) -> DataFrame:
    """(image, by, diff2): half the squared difference of each image from each reference; kind: the type of by.

    One matrix product a batch; the references, a model's, are broadcast as a matrix. Images must not be null.
    """
    names, matrix = references
    ship_package(images.sparkSession)
    shared = images.sparkSession.sparkContext.broadcast(matrix)

    @F.arrow_udf("array<double>")
    def halves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        r = shared.value
        own = (r * r).sum(1)
        for batch in batches:
            if len(batch):
                x = matrix_of(batch)
                d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ r.T + own, 0) / 2
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(r)), pa.array(d.ravel()))
            else:
                yield pa.array([], pa.list_(pa.float64()))

    # an inner explode would infer a filter on its array, and the product would run once more for it
    long = images.select(image, F.posexplode_outer(halves(pixels)).alias("__k", "diff2")).where("__k is not null")
    numbered = F.get(F.array(*[F.lit(n) for n in names]), F.col("__k"))
    numbered = numbered if kind is None else numbered.cast(kind)
    return long.select(image, numbered.alias(by), "diff2")


def posterior(samples: DataFrame, image: str = "vec_id", diff2: str = "diff2", prior: Column | None = None) -> DataFrame:
    """samples with min_diff2, w and p: weights exp(-(diff2 - least)) times the prior, and their shares.

    Exponents beyond 700 give 0.
    """
    whole = Window.partitionBy(image)
    least = samples.withColumn("min_diff2", F.min(diff2).over(whole))
    gap = F.col(diff2) - F.col("min_diff2")
    weight = F.when(gap > 700, F.lit(0.0)).otherwise(F.exp(-gap))
    weighted = least.withColumn("w", weight if prior is None else weight * prior)
    return weighted.withColumn("p", F.col("w") / F.sum("w").over(whole))


def best_class(samples: DataFrame, image: str = "vec_id", weight: str = "p", by: str = "class_no") -> DataFrame:
    """(image, by): the class of the largest weight; of equal ones the first."""
    return samples.groupBy(image).agg(F.max_by(by, F.struct(weight, -F.col(by))).alias(by))


def weighted_average(rows: DataFrame, keys: list[str], weight: Column, transfer: Column, value: Column, alpha: float = 0.01, beta: float = 1.0) -> DataFrame:
    """sum(beta p c x) / (sum(beta p c c) + alpha) for each of the keys; partial sums are made before the shuffle."""
    top = F.sum(weight * beta * transfer * value)
    bottom = F.sum(weight * beta * transfer * transfer) + alpha
    return rows.groupBy(*keys).agg((top / bottom).alias("average"))


def clamp_scales(groups: DataFrame, xa: str = "xa", aa: str = "aa", n: str = "n") -> DataFrame:
    """groups with scale: xa / aa within a fifth and five times the upper median, then with a mean of 1 over particles.

    One row a group: only groups meet in one task.
    """
    raw = groups.withColumn("scale", F.col(xa) / F.col(aa))
    median = raw.agg(F.sort_array(F.collect_list("scale")).alias("s")).select(F.expr("get(s, cast(size(s) div 2 as int))").alias("median"))
    held = raw.crossJoin(F.broadcast(median)).withColumn("scale", F.least(F.greatest(F.col("scale"), F.col("median") / 5), F.col("median") * 5))
    mean = held.agg((F.sum(F.col("scale") * F.col(n)) / F.sum(n)).alias("mean"))
    return held.crossJoin(F.broadcast(mean)).withColumn("scale", F.col("scale") / F.col("mean")).drop("median", "mean")


def row_shift(samples: DataFrame, image: str = "vec_id", diff2: str = "diff2") -> DataFrame:
    """(image, shift): the lesser of the middle of the exponents and the least of them plus 700."""
    return samples.groupBy(image).agg(F.least((F.max(diff2) + F.min(diff2)) / 2, F.min(diff2) + 700).alias("shift"))

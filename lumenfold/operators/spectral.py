"""Spectral operators on images: Arrow-batched numpy kernels for whole images, DataFrame sums for spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import ship_package

SPECTRUM = "array<struct<kx:int,ky:int,re:double,im:double>>"


def signed(i: np.ndarray, n: int) -> np.ndarray:
    """Frequencies of rows: 0 to n / 2, then negative ones."""
    return np.where(i <= n // 2, i, i - n)


def stacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Square images of an array column as (count, n, n) for rows of one size, with the rows' places; null rows are left out."""
    rows = [np.asarray(x.as_py(), float) for x in column if x.is_valid]
    places = np.flatnonzero(np.array([x.is_valid for x in column], bool))
    if not rows:
        return places, np.empty((0, 1, 1))
    n = int(round(len(rows[0]) ** 0.5))
    return places, np.stack(rows).reshape(len(rows), n, n)


def fourier(df: DataFrame, pixels: str = "pixels", out: str = "spectrum") -> DataFrame:
    """df with the half-complex Fourier transform (divided by the number of pixels) of each square image.

    The spectrum is an array of (kx, ky, re, im) with kx from 0 to n / 2 and signed ky.
    """
    ship_package(df.sparkSession)

    @F.arrow_udf(SPECTRUM)
    def transformed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            places, images = stacked(batch)
            result: list = [None] * len(batch)
            if len(images):
                n = images.shape[1]
                f = np.fft.rfft2(images) / (n * n)
                ky, kx = np.meshgrid(signed(np.arange(n), n), np.arange(n // 2 + 1), indexing="ij")
                for place, one in zip(places.tolist(), f):
                    flat = one.ravel()
                    result[place] = [
                        {"kx": a, "ky": b, "re": c, "im": d}
                        for a, b, c, d in zip(kx.ravel().tolist(), ky.ravel().tolist(), flat.real.tolist(), flat.imag.tolist())
                    ]
            yield pa.array(result, pa.list_(pa.struct([("kx", pa.int32()), ("ky", pa.int32()), ("re", pa.float64()), ("im", pa.float64())])))

    return df.withColumn(out, transformed(F.col(pixels)))


def long_spectrum(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """One row a Fourier pixel, with its shell; spectra stay beside their images until here, so nothing is shuffled."""
    other = [c for c in df.columns if c != spectrum]
    # an inner explode would infer a filter on its array, and the transform would run once more for it
    long = df.select(*other, F.explode_outer(spectrum).alias("__s")).select(*other, "__s.*").where("kx is not null")
    return long.withColumn("shell", F.round(F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky"))).cast("int"))


def once() -> Column:
    """True for one of the two Hermitian copies on the line kx = 0."""
    return ~((F.col("kx") == 0) & (F.col("ky") < 0))


def power_spectrum(long: DataFrame, *by: str, amplitude: bool = False) -> DataFrame:
    """Mean power (or amplitude) of each shell over the half plane."""
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return long.groupBy(*by, "shell").agg(F.avg(F.sqrt(power) if amplitude else power).alias("spectrum"))


def shell_correlation(both: DataFrame) -> DataFrame:
    """Fourier shell correlation of (re1, im1) with (re2, im2)."""
    dot = F.sum(F.expr("re1 * re2 + im1 * im2"))
    return both.groupBy("shell").agg((dot / F.sqrt(F.sum(F.expr("re1 * re1 + im1 * im1")) * F.sum(F.expr("re2 * re2 + im2 * im2")))).alias("fsc"))


def shifted(long: DataFrame, sx: float | Column, sy: float | Column, n: int) -> DataFrame:
    """The spectrum of the image moved by (sx, sy): a phase ramp, as an expression."""
    angle = (F.col("kx") * sx + F.col("ky") * sy) * (-2 * np.pi / n)
    c, s = F.cos(angle), F.sin(angle)
    return long.withColumns({"re": F.col("re") * c - F.col("im") * s, "im": F.col("re") * s + F.col("im") * c})


def cropped(long: DataFrame, n: int) -> DataFrame:
    """The spectrum of an image of side n: lower frequencies only."""
    return long.where((F.col("kx") <= n // 2) & F.col("ky").between(-(n // 2) + 1, n // 2))


def shell_order(long: DataFrame, *by: str, out: str = "place") -> DataFrame:
    """The Fourier pixels of each image numbered from 0 along rising shells, then rows and columns."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy("shell", "ky", "kx")
    return long.withColumn(out, (F.row_number().over(order) - 1).cast("long"))


def pool_transforms(df: DataFrame, dx: str, dy: str, size: int, pixels: str = "pixels", out: str = "spectrum") -> DataFrame:
    """df with the transform, cut to `size`, of each image after normalisation and a shift by whole pixels (columns dx, dy).

    One pass over the images: mean 0 and deviation 1, a circular shift, the transform divided by the pixels, low frequencies.
    """
    ship_package(df.sparkSession)

    @F.arrow_udf(SPECTRUM)
    def transformed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, by_x, by_y in batches:
            places, images = stacked(column)
            result: list = [None] * len(column)
            moves = list(zip(by_x.to_pylist(), by_y.to_pylist()))
            for place, image in zip(places.tolist(), images):
                n = len(image)
                sd = image.std()
                moved = np.roll((image - image.mean()) / sd if sd > 0 else image, (int(moves[place][1] or 0), int(moves[place][0] or 0)), (0, 1))
                f = np.fft.rfft2(moved) / (n * n)
                ky, kx = np.meshgrid(signed(np.arange(n), n), np.arange(n // 2 + 1), indexing="ij")
                kept = (kx <= size // 2) & (ky > -(size // 2)) & (ky <= size // 2)
                result[place] = [{"kx": a, "ky": b, "re": c.real, "im": c.imag} for a, b, c in zip(kx[kept].tolist(), ky[kept].tolist(), f[kept].tolist())]
            yield pa.array(result, pa.list_(pa.struct([("kx", pa.int32()), ("ky", pa.int32()), ("re", pa.float64()), ("im", pa.float64())])))

    return df.withColumn(out, transformed(pixels, dx, dy))


def shifted_with_noise(long: DataFrame, noise: DataFrame, sx: float | Column, sy: float | Column, n: int) -> DataFrame:
    """Shifted Fourier pixels with inverse = 1 / sigma2 of their shell, from a noise spectrum (shell, sigma2)."""
    return shifted(long, sx, sy, n).join(noise.select("shell", (1 / F.col("sigma2")).alias("inverse")), "shell")


def image_kernel(df: DataFrame, kernel, pixels: str = "pixels", out: str = "pixels") -> DataFrame:
    """df with kernel, a function from an (n, n) to an (m, m) array, applied to each image."""
    ship_package(df.sparkSession)

    @F.arrow_udf("array<double>")
    def applied(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            places, images = stacked(batch)
            result: list = [None] * len(batch)
            for place, image in zip(places.tolist(), images):
                result[place] = np.asarray(kernel(image)).ravel().tolist()
            yield pa.array(result, pa.list_(pa.float64()))

    return df.withColumn(out, applied(F.col(pixels)))

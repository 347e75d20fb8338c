"""Local resolution: a likelihood-ratio test of a local sinusoid against a constant, voxel by voxel.

Slabs of the volume with a halo go to tasks; each tests its own voxels at one resolution, by correlation with the few basis
functions of the test, so that no window is copied out and no form over all pairs of its cells is built. The step-up threshold over all
voxels of a step is found from a histogram of p-values, so that statistics are not collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.numerics import dilate, gaussian_filter, polynomial_fit, ridge_peaks, taxicab_distance, weighted_chi2_cdf
from lumenfold.session import ship_package

UNRESOLVED = 100.0
BINS = 2000


def steering() -> np.ndarray:
    """Sixteen unit vectors: six through the vertices of an icosahedron, ten through those of a dodecahedron."""
    g = (1 + math.sqrt(5)) / 2
    six = [(0, 1, g), (0, -1, g), (1, g, 0), (-1, g, 0), (g, 0, 1), (g, 0, -1)]
    ten = [(1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1), (0, 1 / g, g), (0, -1 / g, g), (1 / g, g, 0), (-1 / g, g, 0), (g, 0, 1 / g), (g, 0, -1 / g)]
    v = np.array([*six, *ten], float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def kernels(resolution: float, voxel: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights of a window's voxels, the test's basis functions (orthonormal under them, a constant first), and the reach.

    The statistic of a window is the sum of its squared products with all functions but the constant; what is left
    of its weighted square is the residual.
    """
    reach = math.ceil(resolution / 2 / voxel)
    a = 2 * math.pi / resolution * math.sqrt(2 / 5)
    z, y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1, -reach : reach + 1].astype(float) * voxel * a
    r2 = (x * x + y * y + z * z).ravel()
    inside = np.sqrt(r2) <= reach * voxel * a + 1e-9
    w = np.where(inside, np.exp(-r2), 0.0)
    root = np.sqrt(w)
    waves = []
    for k, (dx, dy, dz) in enumerate(steering()):
        t = (dx * x + dy * y + dz * z).ravel()
        waves.append(4 * t * t - 2 if k < 6 else t**3 - 2.254 * t)
    constant = root / np.linalg.norm(root)
    rest = root[:, None] * np.stack(waves, 1)
    rest -= np.outer(constant, constant @ rest)
    u, size, _ = np.linalg.svd(rest, full_matrices=False)
    basis = np.column_stack([constant, u[:, size > 1e-9 * size[0]]])
    return w, root[:, None] * basis, reach


def correlations(wide: np.ndarray, w: np.ndarray, basis: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistic and residual of every window that lies in the volume, by products in Fourier space: one function at a time."""
    size = (2 * reach + 1,) * 3
    inner = tuple(slice(0, n - 2 * reach) for n in wide.shape)

    def against(transform: np.ndarray, kernel: np.ndarray) -> np.ndarray:
        other = np.fft.rfftn(kernel.reshape(size), wide.shape, (0, 1, 2))
        return np.fft.irfftn(transform * other.conj(), wide.shape, (0, 1, 2))[inner]

    plain = np.fft.rfftn(wide)
    first = against(plain, basis[:, 0]) ** 2
    test = np.zeros_like(first)
    for k in range(1, basis.shape[1]):
        test += against(plain, basis[:, k]) ** 2
    return test, np.maximum(against(np.fft.rfftn(wide * wide), w) - first - test, 0.0)


def local_resolution(spark: SparkSession, volume: np.ndarray, mask: np.ndarray, voxel: float, start: float, stop: float, step: float, p_value: float = 0.05, slab: int = 4) -> np.ndarray:
    """Resolution of each masked voxel; 100 where none up to stop passes. Coarser steps test only what is left."""
    ship_package(spark)
    n = volume.shape[0]
    out = np.where(mask, UNRESOLVED, 0.0)
    left = mask.copy()
    resolution = start
    while resolution <= stop and left.any():
        weight, basis, reach = kernels(resolution, voxel)
        if 2 * reach + 1 > n:
            break
        wide = np.pad(volume, reach, mode="reflect")
        shared = spark.sparkContext.broadcast((wide, left, weight, basis))

        def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, todo, w, u = shared.value  # noqa: B023
            pad = (v.shape[0] - todo.shape[0]) // 2
            for batch in batches:
                for z0 in batch.column(0).to_pylist():
                    part = todo[z0 : z0 + slab]
                    at = np.flatnonzero(part.ravel())
                    lrs, noise = (x.ravel()[at] for x in correlations(v[z0 : z0 + len(part) + 2 * pad], w, u, pad))
                    yield pa.record_batch([pa.array(at + z0 * part[0].size), pa.array(lrs), pa.array(noise)], ["at", "lrs", "noise"])

        slabs = spark.range(0, n, slab).repartition(max(1, -(-n // slab)))
        found = slabs.mapInArrow(tested, "at bigint, lrs double, noise double").persist()
        sigma2 = found.agg(F.avg("noise")).first()[0] / (weight.sum() - (basis**2).sum())
        weights = np.linalg.eigvalsh(basis[:, 1:].T @ basis[:, 1:])
        weights = weights[weights > 1e-9 * weights.max()]
        top = float(found.agg(F.max("lrs")).first()[0]) / sigma2
        # counts of statistics by bin, from the largest down: the step-up threshold needs no sorted list
        width = max(top, 1e-12) / BINS
        counts = found.groupBy(F.least(F.floor(F.col("lrs") / sigma2 / width), F.lit(BINS - 1)).alias("bin")).count().orderBy(F.desc("bin")).collect()
        total, seen, limit = int(left.sum()), 0, math.inf
        for row in counts:
            seen += row["count"]
            p = 1 - weighted_chi2_cdf(row["bin"] * width, weights)
            if p <= p_value * seen / (total * math.log(max(total, 2))):
                limit = row["bin"] * width
            elif p > p_value:
                break
        hits = found.where(F.col("lrs") / sigma2 >= limit).select("at").toPandas()["at"].to_numpy(np.int64) if limit < math.inf else np.empty(0, np.int64)
        found.unpersist()
        shared.unpersist()
        out.reshape(-1)[hits] = resolution
        left.reshape(-1)[hits] = False
        if len(hits) < n and left.sum() < n * n:
            break
        resolution += step
    return out


def spherical_spectrum(volume: np.ndarray) -> np.ndarray:
    """Mean power by distance from the origin of Fourier space."""
    f = np.abs(np.fft.fftshift(np.fft.fftn(volume))) ** 2
    n = volume.shape[0]
    r = np.sqrt(sum((a - n // 2) ** 2 for a in np.mgrid[:n, :n, :n])).astype(int)
    r = np.minimum(r, n // 2)
    return np.bincount(r.ravel(), f.ravel()) / np.bincount(r.ravel())


def low_pass_factor(spectrum: np.ndarray) -> float:
    """Where a low-pass filter cut the spectrum, as a share of its length; 0 without one."""
    d = -np.diff(np.log(np.maximum(spectrum, 1e-300)))
    peaks = ridge_peaks(d, np.arange(1, 10))
    if not peaks:
        return 0.0
    last = peaks[-1]
    tail = np.asarray(spectrum[last + 2 :])
    return (last - 1) / len(spectrum) if len(tail) and abs(tail.mean()) < 1e-4 and tail.var() < 1e-4 else 0.0


def pre_whiten(volume: np.ndarray, mask: np.ndarray, degree: int = 4) -> np.ndarray:
    """The volume divided by a polynomial fit to the root of the spectrum of what lies outside the mask."""
    n = volume.shape[0]
    outside = ~dilate(mask, 1)
    edge = np.minimum(1.0, taxicab_distance(outside) / 2)
    background = spherical_spectrum(volume * gaussian_filter(edge, 1.0))
    k = np.arange(len(background)) / len(background)
    fit = polynomial_fit(k, np.log(np.maximum(background, 1e-12)), min(degree, len(k) - 1))
    r = np.sqrt(sum(f * f for f in np.meshgrid(*[np.fft.fftfreq(n) * n] * 3, indexing="ij"))) / len(background)
    return np.fft.ifftn(np.fft.fftn(volume) / np.exp(np.polyval(fit, np.minimum(r, 1)) / 2)).real

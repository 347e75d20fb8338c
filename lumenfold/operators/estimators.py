"""Composite estimators: 2D and 3D classification, latent maps, principal axes, reconstruction.

All follow one scheme: the model is small and broadcast, images stay where they are, each task reduces its images to
partial sufficient statistics, and a sum over their keys, whose number depends on the model alone, goes back to
the driver, where the next model is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import images as kernels
from lumenfold.session import ship_package


def statistics(df: DataFrame, columns: list[str], fold: Callable[[dict[str, np.ndarray], int], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of a vector of `size` numbers that fold gives for a batch of columns.

    Tasks add up their batches first; the sum over tasks is a shuffled aggregation by place, so that neither a
    task nor the driver holds the vectors of many tasks.
    """
    ship_package(df.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                values = {c: np.array(batch.column(c).to_pylist(), float) for c in columns}
                total += fold(values, len(batch))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["at", "x"])

    sums = df.select(*columns).mapInArrow(partial, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(size)
    out[sums["at"].to_numpy(np.int64)] = sums["x"].to_numpy(float)
    return out


def softmax(exponents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares by row and the log of their sums; exponents 700 below the largest give 0."""
    top = exponents.max(1, keepdims=True)
    w = np.where(exponents - top < -700, 0.0, np.exp(exponents - top))
    total = w.sum(1, keepdims=True)
    return w / total, (np.log(total) + top)[:, 0]


@dataclass
class Classes2D:
    """References, class shares, noise variance and the history of the log likelihood."""

    references: np.ndarray
    shares: np.ndarray
    sigma2: float
    history: list[float] = field(default_factory=list)


def poses(step: float, reach: float, shift: float) -> list[tuple[float, float, float]]:
    """(psi, dx, dy) of all in-plane samples."""
    n = int(np.ceil(360 / step))
    m = int(np.ceil(reach / shift)) if shift else 0
    disc = [(i * shift, j * shift) for i in range(-m, m + 1) for j in range(-m, m + 1) if (i * i + j * j) * shift * shift <= reach * reach]
    return [(k * 360 / n, dx, dy) for k in range(n) for dx, dy in disc or [(0.0, 0.0)]]


def posed(image: np.ndarray, pose: tuple[float, float, float]) -> np.ndarray:
    psi, dx, dy = pose
    return kernels.translate(kernels.rotate(image, psi) if psi else image, dx, dy)


def unposed(image: np.ndarray, pose: tuple[float, float, float]) -> np.ndarray:
    psi, dx, dy = pose
    moved = kernels.translate(image, -dx, -dy)
    return kernels.rotate(moved, -psi) if psi else moved


def classify_2d(
    images: DataFrame, classes: int, rounds: int, step: float = 360.0, reach: float = 0.0, shift: float = 1.0, prior: float = 1.0, seed: int = 33, pixels: str = "pixels", cc_first: bool = False
) -> Classes2D:
    """Maximum a posteriori classification of square images over in-plane rotations and shifts.

    prior is the weight, in images, of a zero reference in each class average. With cc_first the first round gives each
    image to its most correlated reference. An empty table is an error.
    """
    n = int(round(images.select(F.size(pixels)).first()[0] ** 0.5))
    d = n * n
    grid = poses(step, reach, shift)
    first = statistics(images, [pixels], lambda b, k: np.concatenate([b[pixels].sum(0), (b[pixels] ** 2).sum(0), [k]]), 2 * d + 1)
    count = first[-1]
    mean, variance = first[:d] / count, first[d : 2 * d] / count - (first[:d] / count) ** 2
    rng = np.random.default_rng(seed)
    model = Classes2D(mean + rng.normal(size=(classes, d)) * np.sqrt(variance.mean()) * 0.3, np.full(classes, 1 / classes), float(variance.mean()))
    for r in range(rounds):
        shared = images.sparkSession.sparkContext.broadcast((model.references, model.shares, model.sigma2, grid, cc_first and r == 0))

        def fold(batch: dict[str, np.ndarray], k: int) -> np.ndarray:
            refs, shares, sigma2, samples, cc = shared.value  # noqa: B023
            x = batch[pixels]
            each = np.stack([posed(ref.reshape(n, n), p).ravel() for ref in refs for p in samples])
            if cc:
                score = (x @ each.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(each, axis=1) + 1e-12)
                w = (score == score.max(1, keepdims=True)).astype(float)
                w /= w.sum(1, keepdims=True)
                like = score.max(1)
            else:
                d2 = (x * x).sum(1)[:, None] - 2 * x @ each.T + (each * each).sum(1)
                w, like = softmax(-d2 / (2 * sigma2) + np.log(np.repeat(shares, len(samples)) + 1e-300))
            d2 = (x * x).sum(1)[:, None] - 2 * x @ each.T + (each * each).sum(1)
            sums = w.T @ x  # one image for each class and pose
            back = np.zeros((len(refs), n * n))
            for i, pose in enumerate(samples):
                for c in range(len(refs)):
                    back[c] += unposed(sums[c * len(samples) + i].reshape(n, n), pose).ravel()
            mass = w.sum(0).reshape(len(refs), -1).sum(1)
            return np.concatenate([back.ravel(), mass, [(w * d2).sum(), like.sum()]])

        total = statistics(images, [pixels], fold, classes * d + classes + 2)
        mass = total[classes * d : classes * d + classes]
        model.references = total[: classes * d].reshape(classes, d) / (mass + prior)[:, None]
        model.history.append(float(total[-1] - count * d / 2 * np.log(2 * np.pi * model.sigma2)))
        model.shares, model.sigma2 = mass / count, max(total[-2] / (count * d), 1e-12)
        shared.unpersist()
    return model


@dataclass
class LatentMap:
    """Basis, weights, inverse variance and the images (Y) of the latent nodes."""

    basis: np.ndarray
    weights: np.ndarray
    beta: float
    nodes: np.ndarray
    history: list[float] = field(default_factory=list)


def axis_sizes(k: int | list[int], dimension: int) -> list[int]:
    """Points of each axis: one number for all, or one an axis."""
    sizes = [k] * dimension if isinstance(k, int) else list(k)
    if len(sizes) != dimension:
        raise ValueError(f"{len(sizes)} sizes for {dimension} axes")
    if min(sizes) < 3:
        raise ValueError("a latent grid needs three points at least")
    return sizes


def latent_basis(k: int | list[int], dimension: int = 1) -> np.ndarray:
    """Gaussians on int(0.8 k) centres an axis, and a constant; the first axis goes slowest."""

    def along(points: int) -> np.ndarray:
        m = int(0.8 * points)
        step = m / (m - 1) * (points - 1) / (m - 1)
        centers = m / (m - 1) + step * np.arange(m)
        return np.exp(-((np.arange(1, points + 1)[:, None] - centers) ** 2) / (2 * step * step))

    sizes = axis_sizes(k, dimension)
    phi = along(sizes[-1])
    for points in reversed(sizes[:-1]):
        axis = along(points)
        phi = np.einsum("im,jn->ijmn", axis, phi).reshape(len(axis) * len(phi), -1)
    return np.column_stack([phi, np.ones(len(phi))])


#: Pixels up to which a whole covariance matrix is summed.
EXACT_PIXELS = 1024


def _leading_axes(images: DataFrame, axes: int, d: int, pixels: str, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = statistics(images, [pixels], lambda b, k: np.append(b[pixels].sum(0), k), d + 1)
    count, mean = first[-1], first[:-1] / first[-1]
    wide = min(d, axes + 8)
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(d, wide)))[0]
    image = basis
    for _ in range(rounds):
        shared = images.sparkSession.sparkContext.broadcast((mean, basis))

        def fold(batch: dict[str, np.ndarray], k: int) -> np.ndarray:
            m, q = shared.value  # noqa: B023
            x = batch[pixels] - m
            return (x.T @ (x @ q)).ravel()

        image = statistics(images, [pixels], fold, d * wide).reshape(d, wide) / count
        shared.unpersist()
        values, turn = np.linalg.eigh(basis.T @ image)
        last, basis = basis, np.linalg.qr(image)[0]
    order = np.argsort(-values)[:axes]
    return mean, values[order], last @ turn[:, order]


def principal_axes(images: DataFrame, axes: int, pixels: str = "pixels") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, eigenvalues falling, eigenvectors) of the covariance of the images.

    Up to EXACT_PIXELS pixels, or for most of the axes, from the whole matrix; beyond, from projections on a few more
    axes than asked for (subspace iteration), so that sums have pixels times axes numbers.
    """
    d = int(images.select(F.size(pixels)).first()[0])
    if d > EXACT_PIXELS and 4 * axes < d:
        return _leading_axes(images, axes, d, pixels)
    total = statistics(images, [pixels], lambda b, k: np.concatenate([(b[pixels].T @ b[pixels]).ravel(), b[pixels].sum(0), [k]]), d * d + d + 1)
    count, mean = total[-1], total[d * d : d * d + d] / total[-1]
    values, vectors = np.linalg.eigh(total[: d * d].reshape(d, d) / count - np.outer(mean, mean))
    order = np.argsort(-values)[:axes]
    return mean, values[order], vectors[:, order]


def fit_latent_map(images: DataFrame, k: int | list[int], rounds: int, dimension: int = 1, alpha: float = 0.01, update_beta: bool = True, pixels: str = "pixels", ctf: str | None = None) -> LatentMap:
    """Generative topographic mapping: softmax over latent nodes, then a ridge solution for the weights.

    The ridge alpha / beta goes to all but the constant basis function. Starts from the principal axes. ctf: a column
    with the factor of each pixel, by which nodes are multiplied before they are compared with an image; each pixel
    then has a solution of its own.
    """
    phi = latent_basis(k, dimension)
    mean, values, vectors = principal_axes(images, dimension + 1, pixels)
    axes = np.stack(np.meshgrid(*[np.linspace(-1.7, 1.7, n) for n in axis_sizes(k, dimension)], indexing="ij"), -1).reshape(-1, dimension)
    start = mean + axes @ (vectors[:, :dimension] * np.sqrt(np.maximum(values[:dimension], 0))).T
    weights = np.linalg.lstsq(phi, start, rcond=None)[0]
    beta = 1 / max(float(values[dimension]), 1e-9)
    model = LatentMap(phi, weights, beta, phi @ weights)
    for _ in range(rounds):
        model = latent_step(images, model, alpha, update_beta, pixels, ctf)
    return model


def latent_step(images: DataFrame, model: LatentMap, alpha: float = 0.01, update_beta: bool = True, pixels: str = "pixels", ctf: str | None = None) -> LatentMap:
    """One round of fit_latent_map()."""
    phi = model.basis
    size, d = model.nodes.shape
    ridge = np.eye(phi.shape[1])
    ridge[-1, -1] = 0
    model = LatentMap(phi, model.weights, model.beta, model.nodes, list(model.history))
    shared = images.sparkSession.sparkContext.broadcast((model.nodes, model.beta))

    def fold(batch: dict[str, np.ndarray], n: int) -> np.ndarray:
        y, b = shared.value
        x = batch[pixels]
        c = batch[ctf] if ctf else None
        d2 = (x * x).sum(1)[:, None] - 2 * (x if c is None else c * x) @ y.T + ((y * y).sum(1) if c is None else (c * c) @ (y * y).T)
        r, like = softmax(-b / 2 * d2)
        mass = r.sum(0) if c is None else (r.T @ (c * c)).ravel()
        return np.concatenate([(r.T @ (x if c is None else c * x)).ravel(), mass, [(x * x).sum(), like.sum(), n]])

    wide = size * d if ctf else size
    total = statistics(images, [pixels, *([ctf] if ctf else [])], fold, size * d + wide + 3)
    b, g, (square, like, n) = total[: size * d].reshape(size, d), total[size * d : size * d + wide], total[-3:]
    if ctf:
        g = g.reshape(size, d)
        # a system for each pixel: basis functions weighted by what its nodes hold
        systems = np.einsum("km,kp,kl->pml", phi, g, phi) + alpha / model.beta * ridge
        model.weights = np.linalg.solve(systems, (phi.T @ b).T[..., None])[..., 0].T
        model.nodes = phi @ model.weights
        residual = square - 2 * (b * model.nodes).sum() + (g * model.nodes**2).sum()
    else:
        model.weights = np.linalg.solve(phi.T @ (g[:, None] * phi) + alpha / model.beta * ridge, phi.T @ b)
        model.nodes = phi @ model.weights
        residual = square - 2 * (b * model.nodes).sum() + (g * (model.nodes**2).sum(1)).sum()
    model.history.append(float(like + n * d / 2 * np.log(model.beta / (2 * np.pi))))
    model.beta = n * d / max(residual, 1e-12) if update_beta else 0.01
    shared.unpersist()
    return model


def assign_nodes(images: DataFrame, model: LatentMap, pixels: str = "pixels", out: str = "class_no") -> DataFrame:
    """images with the node, from 1, of the largest responsibility; the first of equal ones."""
    ship_package(images.sparkSession)
    shared = images.sparkSession.sparkContext.broadcast(model.nodes)

    @F.arrow_udf("bigint")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array(batch.to_pylist(), float).reshape(len(batch), -1)
            y = shared.value
            yield pa.array(((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)).argmin(1) + 1, pa.int64())

    return images.withColumn(out, nearest(F.col(pixels)))


def fine_classes(images: DataFrame, coarse: LatentMap, rounds: int, smallest: int = 20, pixels: str = "pixels") -> DataFrame:
    """images with fine_class: each coarse class of `smallest` images or more is mapped again, and classes are numbered on.

    One latent map a coarse class runs at a time; each is distributed.
    """
    from lumenfold.operators.particles import fine_class_plan

    named = assign_nodes(images, coarse, pixels)
    plan = fine_class_plan(named.groupBy("class_no").agg(F.count("*").alias("n"))).orderBy("class_no").collect()
    parts = []
    for row in plan:
        own = named.where(F.col("class_no") == row["class_no"])
        if row["n"] < smallest or row["fine"] < 3:
            parts.append(own.withColumn("fine_class", F.lit(row["offset"] + 1)))
        else:
            model = fit_latent_map(own, int(row["fine"]), rounds, pixels=pixels)
            parts.append(assign_nodes(own, model, pixels, "fine_class").withColumn("fine_class", F.col("fine_class") + row["offset"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reconstruct_volume(images: DataFrame, pad: int = 2, pixels: str = "pixels", angles: tuple[str, str, str] = ("rot", "tilt", "psi"), rounds: int = 0, ctf: str | None = None, symmetry: list[np.ndarray] | None = None, most: int | None = None) -> np.ndarray:
    """The volume whose projections in the given ZYZ angles the images are; the eight-corner scatter is summed by voxel.

    ctf: a column with the contrast transfer on the half plane, by which images are multiplied and weighed; symmetry:
    operations under which the transform is summed; most: the last shell that is kept.
    """
    n = int(round(images.select(F.size(pixels)).first()[0] ** 0.5))
    m = n * pad

    def fold(batch: dict[str, np.ndarray], k: int) -> np.ndarray:
        data, weight = np.zeros((m,) * 3, complex), np.zeros((m,) * 3)
        for i in range(k):
            matrix = euler(*(batch[a][i] for a in angles))
            kernels.scatter(data, weight, batch[pixels][i].reshape(n, n), matrix, pad, kernels.full_plane(batch[ctf][i], n, True) if ctf else None)
        return np.concatenate([data.real.ravel(), data.imag.ravel(), weight.ravel()])

    total = statistics(images, [pixels, *angles, *([ctf] if ctf else [])], fold, 3 * m**3).reshape(3, m, m, m)
    data, weight = total[0] + 1j * total[1], total[2]
    if symmetry and len(symmetry) > 1:
        data, weight = kernels.symmetrise(data, weight, symmetry)
    if most is not None:
        at = np.meshgrid(*[np.arange(m) - m // 2] * 3, indexing="ij")
        data = np.where(np.sqrt(sum(a * a for a in at)) <= most * pad, data, 0)
    return kernels.reconstruct(data, weight, n, pad, rounds)


def euler(rot: float, tilt: float, psi: float) -> np.ndarray:
    """ZYZ rotation matrix of angles in degrees."""
    ca, cb, cg = np.cos(np.radians([rot, tilt, psi]))
    sa, sb, sg = np.sin(np.radians([rot, tilt, psi]))
    return np.array([[cg * cb * ca - sg * sa, cg * cb * sa + sg * ca, -cg * sb], [-sg * cb * ca - cg * sa, -sg * cb * sa + cg * ca, sg * sb], [sb * ca, sb * sa, cb]])


#: Weights of classes, views and shifts held at a time in classify_3d.
WEIGHTS = 2_000_000


def classify_3d(images: DataFrame, volumes: np.ndarray, directions: np.ndarray, rounds: int, step: float = 90.0, pad: int = 2, pixels: str = "pixels", reach: float = 0.0, shift: float = 1.0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(volumes, class shares, log likelihoods): classification over directions (rot, tilt), in-plane angles and shifts.

    Projections of the current volumes are broadcast; each task moves its images back by every shift and scatters the
    weighted ones into partial transforms. Weights are held for a few images at a time.
    """
    n = volumes.shape[-1]
    k, m = len(volumes), n * pad
    views = [(rot, tilt, psi) for rot, tilt in directions for psi in np.arange(0, 360, step)]
    matrices = [euler(*v) for v in views]
    disc = [(dx, dy) for _, dx, dy in poses(360.0, reach, shift)]
    some = max(1, WEIGHTS // (k * len(views) * len(disc)))
    sigma2, shares, history = None, np.full(k, 1 / k), []
    for _ in range(rounds):
        each = np.stack([kernels.project(v, a, pad).ravel() for v in volumes for a in matrices])
        if sigma2 is None:
            total = statistics(images, [pixels], lambda b, c: np.array([(b[pixels] ** 2).sum(), b[pixels].size]), 2)
            sigma2 = total[0] / total[1]
        shared = images.sparkSession.sparkContext.broadcast((each, shares, sigma2))

        def fold(batch: dict[str, np.ndarray], count: int) -> np.ndarray:
            refs, pi, s2 = shared.value  # noqa: B023
            sums, mass, fit = np.zeros(refs.shape), np.zeros(len(refs)), np.zeros(2)
            square, prior = (refs * refs).sum(1), np.log(np.repeat(pi, len(matrices)) + 1e-300)
            for a in range(0, count, some):
                # images by shift: each moved back
                x = np.stack([[unposed(image.reshape(n, n), (0.0, *t)).ravel() if any(t) else image for t in disc] for image in batch[pixels][a : a + some]])
                d2 = (x * x).sum(2)[..., None] - 2 * x @ refs.T + square
                w, like = softmax((-d2 / (2 * s2) + prior).reshape(len(x), -1))
                w = w.reshape(d2.shape)
                sums += w.reshape(-1, len(refs)).T @ x.reshape(-1, n * n)
                mass += w.sum((0, 1))
                fit += (w * d2).sum(), like.sum()
            parts = []
            for c in range(k):
                data, weight = np.zeros((m,) * 3, complex), np.zeros((m,) * 3)
                for v, matrix in enumerate(matrices):
                    i = c * len(matrices) + v
                    if mass[i] > 1e-6:
                        kernels.scatter(data, weight, sums[i].reshape(n, n), matrix, pad, np.ones((n, n)))
                        # the weight of one image was added; the rest follows
                        if mass[i] != 1:
                            extra_data, extra = np.zeros((m,) * 3, complex), np.zeros((m,) * 3)
                            kernels.scatter(extra_data, extra, np.zeros((n, n)), matrix, pad)
                            weight += (mass[i] - 1) * extra
                parts += [data.real.ravel(), data.imag.ravel(), weight.ravel()]
            return np.concatenate([*parts, mass.reshape(k, -1).sum(1), fit, [batch[pixels].size]])

        total = statistics(images, [pixels], fold, 3 * k * m**3 + k + 3)
        grids = total[: 3 * k * m**3].reshape(k, 3, m, m, m)
        volumes = np.stack([kernels.reconstruct(g[0] + 1j * g[1], g[2], n, pad) for g in grids])
        mass = total[3 * k * m**3 : 3 * k * m**3 + k]
        shares, sigma2 = mass / mass.sum(), max(total[-3] / total[-1], 1e-12)
        history.append(float(total[-2]))
        shared.unpersist()
    return volumes, shares, history


def stalled(history: list[float], share: float = 0.03, rounds: int = 3) -> bool:
    """Whether the last rounds changed less than the share of their value."""
    last = history[-rounds - 1 :]
    return len(last) > rounds and all(abs(b - a) <= share * abs(a) for a, b in zip(last, last[1:]))

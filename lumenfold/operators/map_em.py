"""Maximum a posteriori classification of 2D images in Fourier space.

Images have a contrast transfer, a group with a noise spectrum by shell and a scale, and unknown classes, in-plane
angles and shifts. Each task turns its images into sums over classes and poses by a few matrix products; what goes
back to the driver is of the model's size. A first pass over coarse poses marks those that hold 0.999 of an image's
weight; a second looks at their finer children alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import images as kernels
from lumenfold.operators.estimators import poses, posed, softmax, statistics, unposed
from lumenfold.session import ship_package

#: Share of an image's weight that its significant coarse samples hold.
SIGNIFICANT = 0.999
#: Weights of images, classes and poses held at a time.
WEIGHTS = 4_000_000


@dataclass
class Plane:
    """The half plane of transforms of images of one side: shells, and what counts once."""

    side: int

    def __post_init__(self):
        n = self.side
        ky, kx = np.meshgrid(np.fft.fftfreq(n) * n, np.arange(n // 2 + 1), indexing="ij")
        ky = np.where(ky == -n / 2, n / 2, ky)
        shell = np.round(np.hypot(kx, ky)).astype(int)
        self.kx, self.ky = kx.ravel(), ky.ravel()
        self.shell = np.minimum(shell, n // 2).ravel()
        self.used = ((shell <= n // 2) & ~((kx == 0) & (ky < 0))).ravel()
        self.shells = n // 2 + 1

    def transform(self, images: np.ndarray) -> np.ndarray:
        """Transforms of (count, side * side) images, divided by their pixels, as rows."""
        n = self.side
        return np.fft.rfft2(images.reshape(-1, n, n)).reshape(len(images), -1) / (n * n)

    def image(self, plane: np.ndarray) -> np.ndarray:
        n = self.side
        return np.fft.irfft2(plane.reshape(n, n // 2 + 1), s=(n, n)) * n * n

    def turned(self, weight: np.ndarray, degrees: float) -> np.ndarray:
        """A real even weight on the half plane, turned with the image."""
        if not degrees:
            return weight
        n = self.side
        rows, columns = np.arange(n)[:, None], np.arange(n)[None]
        half = weight.reshape(n, n // 2 + 1)
        full = np.where(columns <= n // 2, half[rows, np.minimum(columns, n - columns)], half[(n - rows) % n, np.minimum(columns, n - columns)])
        back = np.fft.ifftshift(kernels.rotate(np.fft.fftshift(full), degrees))
        return back[:, : n // 2 + 1].ravel()


@dataclass
class MapModel:
    """Reference transforms, class shares, noise by group and shell, group scales and the variance of shifts."""

    side: int
    references: np.ndarray
    shares: np.ndarray
    sigma2: np.ndarray
    scales: np.ndarray
    offset2: float = 100.0
    history: list[float] = field(default_factory=list)
    pmax: list[float] = field(default_factory=list)

    @property
    def images(self) -> np.ndarray:
        plane = Plane(self.side)
        return np.stack([plane.image(r) for r in self.references])


@dataclass
class Sums:
    """What the images add up to: per class and Fourier pixel, per group and shell, and in all."""

    top: np.ndarray
    bottom: np.ndarray
    mass: np.ndarray
    residual: np.ndarray
    counts: np.ndarray
    xa: np.ndarray
    aa: np.ndarray
    offset: float
    log_likelihood: float
    pmax: float


def with_ctf(images: DataFrame, pixel: float, side: int, out: str = "ctf", part: str = "whole") -> DataFrame:
    """images with the contrast transfer of their optics columns on the half plane; part "sign": its sign alone, "size": its absolute value."""
    ship_package(images.sparkSession)

    @F.arrow_udf("array<double>")
    def transfer(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = zip(*(c.to_pylist() for c in columns))
            found = [kernels.ctf_image(side, pixel, u, v, a, kv, cs, q).ravel() for u, v, a, kv, cs, q in rows]
            kept = {"whole": lambda c: c, "sign": lambda c: np.where(c < 0, -1.0, 1.0), "size": np.abs}[part]
            yield pa.array([kept(c) for c in found], pa.list_(pa.float64()))

    return images.withColumn(out, transfer("DefocusU", "DefocusV", "DefocusAngle", "Voltage", "SphericalAberration", "AmplitudeContrast"))


def samples(plane: Plane, references: np.ndarray, grid: list[tuple[float, float, float]]) -> np.ndarray:
    """Transforms of every reference in every pose, class by class."""
    turned: dict[tuple[int, float], np.ndarray] = {}
    out = []
    for k, reference in enumerate(references):
        image = plane.image(reference)
        for psi, dx, dy in grid:
            if (k, psi) not in turned:
                turned[k, psi] = plane.transform(posed(image, (psi, 0.0, 0.0)).ravel()[None])[0]
            ramp = np.exp(-2j * np.pi * (plane.kx * dx + plane.ky * dy) / plane.side)
            out.append(turned[k, psi] * ramp)
    return np.array(out)


def children(grid: list[tuple[float, float, float]], step: float, shift: float, order: int) -> tuple[list[tuple[float, float, float]], np.ndarray]:
    """Each pose's finer poses, 2**order along every axis, and the pose that each comes from."""
    parts = 2**order
    part = (np.arange(parts) + 0.5) / parts - 0.5
    moves = [(a, b) for a in part * shift for b in part * shift] if any(dx or dy for _, dx, dy in grid) else [(0.0, 0.0)]
    turns = part * step if step < 360 else [0.0]
    fine = [(psi + t, dx + a, dy + b) for psi, dx, dy in grid for t in turns for a, b in moves]
    return fine, np.repeat(np.arange(len(grid)), len(turns) * len(moves))


def significant(w: np.ndarray, share: float = SIGNIFICANT) -> np.ndarray:
    """The samples of each row that hold the share of its weight, the largest first."""
    by = np.argsort(-w, axis=1, kind="stable")
    run = np.cumsum(np.take_along_axis(w, by, 1), axis=1)
    kept = np.concatenate([np.ones((len(w), 1), bool), run[:, :-1] < share], axis=1)
    out = np.zeros_like(kept)
    np.put_along_axis(out, by, kept, 1)
    return out


def exponents(x: np.ndarray, c: np.ndarray, wt: np.ndarray, each: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log weights of every sample for every image: the prior less half the weighted squared difference."""
    square = (wt * np.abs(x) ** 2).sum(1)[:, None]
    cross = ((wt * c * x) @ each.conj().T).real
    return prior - 0.5 * (square - 2 * cross + (wt * c * c) @ (np.abs(each) ** 2).T)


def expect(images: DataFrame, model: MapModel, grid: list[tuple[float, float, float]], step: float = 360.0, shift: float = 0.0, order: int = 0, pixels: str = "pixels", ctf: str | None = None, group: str | None = None) -> Sums:
    """One expectation step over all images: sums for the next model.

    ctf: a column with the contrast transfer on the half plane; group: one with the group from 0. order: how often the
    coarse poses are halved for the second pass; 0: no second pass.
    """
    plane = Plane(model.side)
    k, p, groups = len(model.references), plane.kx.size, len(model.sigma2)
    fine, parent = children(grid, step, shift, order) if order else (grid, np.arange(len(grid)))
    columns = [pixels, *([ctf] if ctf else []), *([group] if group else [])]
    shared = images.sparkSession.sparkContext.broadcast((model.references, model.shares, model.sigma2, model.scales, model.offset2))
    sizes = [k * p, k * p, k * p, k, groups * plane.shells, groups, groups, groups, 3]
    cuts = np.cumsum([0, *sizes])
    held: dict[str, np.ndarray] = {}

    def fold(batch: dict[str, np.ndarray], count: int) -> np.ndarray:
        references, shares, sigma2, scales, offset2 = shared.value
        if not held:  # once a task
            held["coarse"] = samples(plane, references, grid)
            held["fine"] = samples(plane, references, fine) if order else held["coarse"]
        moved = np.array([dx * dx + dy * dy for _, dx, dy in fine])
        first = np.array([dx * dx + dy * dy for _, dx, dy in grid])
        logs = np.log(shares + 1e-300)
        prior = lambda m: (logs[:, None] - m / (2 * offset2)).ravel()
        total = [np.zeros(n, complex if i == 0 else float) for i, n in enumerate([k * p, k * p, k, groups * plane.shells, groups, groups, groups, 3])]
        top, bottom = np.zeros((k * len(fine), p), complex), np.zeros((k * len(fine), p))
        some = max(1, WEIGHTS // (k * len(fine)))
        for a in range(0, count, some):
            x = plane.transform(batch[pixels][a : a + some])
            g = batch[group][a : a + some].astype(int) if group else np.zeros(len(x), int)
            c = (batch[ctf][a : a + some] if ctf else np.ones(x.shape)) * scales[g][:, None]
            wt = plane.used / sigma2[g][:, plane.shell]
            norm = -(plane.used * np.log(2 * np.pi * sigma2[g][:, plane.shell])).sum(1)
            log_w = exponents(x, c, wt, held["coarse"], prior(first))
            if order:
                w, _ = softmax(log_w)
                live = significant(w).reshape(len(x), k, len(grid))[:, :, parent].reshape(len(x), -1)
                at = np.flatnonzero(live.any(0))
                log_w = np.full(live.shape, -np.inf)
                log_w[:, at] = np.where(live[:, at], exponents(x, c, wt, held["fine"][at], prior(moved)[at]), -np.inf)
            w, like = softmax(log_w)
            each = held["fine"]
            top += w.T @ (wt * c * x)
            bottom += w.T @ (wt * c * c)
            total[2] += w.sum(0).reshape(k, -1).sum(1)
            mean, square = w @ each, w @ np.abs(each) ** 2
            cross, power = (x.conj() * c * mean).real, c * c * square
            rest = np.where(plane.used, np.abs(x) ** 2 - 2 * cross + power, 0.0)
            np.add.at(total[3].reshape(groups, -1), (g[:, None], plane.shell[None]), rest)
            np.add.at(total[4], g, 1)
            # without the present scale: how much of the model each group holds
            np.add.at(total[5], g, (wt * cross).sum(1) / scales[g])
            np.add.at(total[6], g, (wt * power).sum(1) / scales[g] ** 2)
            total[7] += [(w @ np.tile(moved, k)).sum(), (like + norm).sum(), w.max(1).sum()]
        for i in range(k):
            for j, pose in enumerate(fine):
                row = i * len(fine) + j
                if bottom[row].any():
                    ramp = np.exp(2j * np.pi * (plane.kx * pose[1] + plane.ky * pose[2]) / plane.side)
                    numer = top[row] * ramp
                    if pose[0]:
                        numer = plane.transform(unposed(plane.image(numer), (pose[0], 0.0, 0.0)).ravel()[None])[0]
                    total[0][i * p : (i + 1) * p] += numer
                    total[1][i * p : (i + 1) * p] += plane.turned(bottom[row], -pose[0])
        return np.concatenate([total[0].real, total[0].imag, *total[1:]])

    out = statistics(images, columns, fold, int(cuts[-1]))
    shared.unpersist()
    part = [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return Sums(
        (part[0] + 1j * part[1]).reshape(k, p), part[2].reshape(k, p), part[3], part[4].reshape(groups, -1), part[5], part[6], part[7], float(part[8][0]), float(part[8][1]), float(part[8][2])
    )


def maximise(model: MapModel, sums: Sums, tau2_fudge: float = 0.0, scale: bool = False, update_offset: bool = False, update_noise: bool = True) -> MapModel:
    """The next model. tau2_fudge above 0: references are held back by their own power spectrum times it."""
    plane = Plane(model.side)
    count = sums.counts.sum()
    weight = sums.bottom
    if tau2_fudge > 0:
        spectrum = np.stack([np.bincount(plane.shell, np.abs(r) ** 2 * plane.used, plane.shells) for r in model.references])
        tau2 = spectrum / np.maximum(np.bincount(plane.shell, plane.used, plane.shells), 1) / 2
        weight = weight + 1 / np.maximum(tau2_fudge * tau2[:, plane.shell], 1e-300)
    references = np.where(weight > 1e-12, sums.top / np.maximum(weight, 1e-12), 0)
    n_pixels = np.bincount(plane.shell, plane.used, plane.shells)
    sigma2 = model.sigma2
    if update_noise:
        fitted = sums.residual / (2 * np.maximum(sums.counts[:, None] * n_pixels, 1))
        sigma2 = np.where(sums.counts[:, None] > 0, np.maximum(fitted, 1e-12), model.sigma2)
    scales = model.scales
    if scale:
        raw = np.where(sums.aa > 0, sums.xa / np.maximum(sums.aa, 1e-300), 1.0)
        middle = np.sort(raw)[len(raw) // 2]
        raw = np.clip(raw, middle / 5, middle * 5)
        scales = raw / ((raw * sums.counts).sum() / count)
    offset2 = max(sums.offset / (2 * count), 1e-3) if update_offset else model.offset2
    return MapModel(model.side, references, sums.mass / count, sigma2, scales, offset2, [*model.history, sums.log_likelihood], [*model.pmax, sums.pmax / count])


def start(images: DataFrame, classes: int, groups: int = 1, seed: int = 33, pixels: str = "pixels", group: str | None = None) -> MapModel:
    """A first model: the mean image with drawn noise for each class, and each group's noise spectrum about its mean image."""
    side = int(round(images.select(F.size(pixels)).first()[0] ** 0.5))
    plane = Plane(side)
    p, s = plane.kx.size, plane.shells

    def fold(batch: dict[str, np.ndarray], count: int) -> np.ndarray:
        x = plane.transform(batch[pixels])
        g = batch[group].astype(int) if group else np.zeros(count, int)
        power, mean, n = np.zeros((groups, s)), np.zeros((groups, p), complex), np.zeros(groups)
        np.add.at(power, (g[:, None], plane.shell[None]), np.abs(x) ** 2 * plane.used)
        np.add.at(mean, g, x)
        np.add.at(n, g, 1)
        return np.concatenate([power.ravel(), mean.real.ravel(), mean.imag.ravel(), n])

    out = statistics(images, [pixels, *([group] if group else [])], fold, groups * (s + 2 * p + 1))
    power, real, imaginary = out[: groups * s].reshape(groups, s), out[groups * s : groups * (s + p)], out[groups * (s + p) : groups * (s + 2 * p)]
    n = np.maximum(out[-groups:], 1)
    mean = (real + 1j * imaginary).reshape(groups, p) / n[:, None]
    own = np.stack([np.bincount(plane.shell, np.abs(m) ** 2 * plane.used, s) for m in mean])
    sigma2 = np.maximum((power / n[:, None] - own) / (2 * np.maximum(np.bincount(plane.shell, plane.used, s), 1)), 1e-12)
    rng = np.random.default_rng(seed)
    average = (mean * n[:, None]).sum(0) / n.sum()
    noise = np.sqrt(np.mean(sigma2, 0))[plane.shell]
    drawn = plane.transform(rng.normal(size=(classes, side * side))) * side
    return MapModel(side, average + drawn * noise * 0.5, np.full(classes, 1 / classes), sigma2, np.ones(groups))


def classify(images: DataFrame, classes: int, rounds: int, step: float = 360.0, reach: float = 0.0, shift: float = 1.0, order: int = 0, tau2_fudge: float = 0.0, seed: int = 33, pixels: str = "pixels", ctf: str | None = None, group: str | None = None, scale: bool = False) -> MapModel:
    """Classes of images by expectation maximisation over in-plane angles and shifts. An empty table is an error."""
    groups = int(images.agg(F.max(group)).first()[0]) + 1 if group else 1
    model = start(images, classes, groups, seed, pixels, group)
    grid = poses(step, reach, shift)
    for _ in range(rounds):
        sums = expect(images, model, grid, 360 / np.ceil(360 / step), shift if reach else 0.0, order, pixels, ctf, group)
        model = maximise(model, sums, tau2_fudge, scale, update_offset=reach > 0)
    return model


FOUND = "struct<class_no:int,pmax:double,log_likelihood:double,significant:int,psi:double,dx:double,dy:double>"


def assign(images: DataFrame, model: MapModel, grid: list[tuple[float, float, float]], pixels: str = "pixels", ctf: str | None = None, group: str | None = None, out: str = "found") -> DataFrame:
    """images with the struct out: the best class (from 1) and pose, its share of the weight, the log likelihood and the significant samples."""
    ship_package(images.sparkSession)
    plane = Plane(model.side)
    shared = images.sparkSession.sparkContext.broadcast((model.references, model.shares, model.sigma2, model.scales, model.offset2))

    @F.arrow_udf(FOUND)
    def best(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        references, shares, sigma2, scales, offset2 = shared.value
        each = samples(plane, references, grid)
        moved = np.array([dx * dx + dy * dy for _, dx, dy in grid])
        prior = (np.log(shares + 1e-300)[:, None] - moved / (2 * offset2)).ravel()
        some = max(1, WEIGHTS // len(each))
        for columns in batches:
            values = dict(zip(names, columns))
            rows: list[tuple] = []
            for a in range(0, len(columns[0]), some):
                x = plane.transform(np.array(values[pixels][a : a + some].to_pylist(), float))
                g = np.array(values[group][a : a + some].to_pylist(), int) if group else np.zeros(len(x), int)
                c = (np.array(values[ctf][a : a + some].to_pylist(), float) if ctf else np.ones(x.shape)) * scales[g][:, None]
                w, like = softmax(exponents(x, c, plane.used / sigma2[g][:, plane.shell], each, prior))
                norm = -(plane.used * np.log(2 * np.pi * sigma2[g][:, plane.shell])).sum(1)
                by_class = w.reshape(len(x), len(references), -1)
                k, j = by_class.sum(2).argmax(1), w.argmax(1) % len(grid)
                rows += zip((k + 1).tolist(), w.max(1).tolist(), (like + norm).tolist(), significant(w).sum(1).tolist(), *np.array(grid)[j].T.tolist())
            fields = ["class_no", "pmax", "log_likelihood", "significant", "psi", "dx", "dy"]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], fields)

    names = [pixels, *([ctf] if ctf else []), *([group] if group else [])]
    return images.withColumn(out, best(*names))


def class_averages(images: DataFrame, classes: int, class_no: str, weight: str, alpha: float = 0.01, beta: float = 1.0, pixels: str = "pixels", ctf: str | None = None) -> np.ndarray:
    """Averages of the classes 1 to `classes`: sum(beta w c X) / (sum(beta w c c) + alpha) on the half plane, as images."""
    side = int(round(images.select(F.size(pixels)).first()[0] ** 0.5))
    plane = Plane(side)
    p = plane.kx.size

    def fold(batch: dict[str, np.ndarray], count: int) -> np.ndarray:
        x = plane.transform(batch[pixels])
        c = batch[ctf] if ctf else np.ones(x.shape)
        k = batch[class_no].astype(int)
        w = np.where((k >= 1) & (k <= classes), batch[weight] * beta, 0.0)[:, None]
        top, bottom = np.zeros((classes + 1, p), complex), np.zeros((classes + 1, p))
        at = np.where(w[:, 0] != 0, k, 0)
        np.add.at(top, at, w * c * x)
        np.add.at(bottom, at, w * c * c)
        return np.concatenate([top.real.ravel(), top.imag.ravel(), bottom.ravel()])

    total = statistics(images, [pixels, class_no, weight, *([ctf] if ctf else [])], fold, 3 * (classes + 1) * p).reshape(3, classes + 1, p)[:, 1:]
    return np.stack([plane.image(a) for a in (total[0] + 1j * total[1]) / (total[2] + alpha)])


def scatter_plane(data: np.ndarray, weight: np.ndarray, numer: np.ndarray, denom: np.ndarray, matrix: np.ndarray, pad: int) -> None:
    """Add a centred plane and its weights to a padded transform, shared among eight corners."""
    n, m = numer.shape[0], data.shape[0]
    ky, kx = np.mgrid[:n, :n] - n // 2
    keep = np.hypot(kx, ky) < n // 2
    at = (pad * (kx[..., None] * matrix[0] + ky[..., None] * matrix[1]) + m // 2)[keep]
    value, w = numer[keep], denom[keep]
    base = np.floor(at).astype(int)
    part = at - base
    for corner in np.ndindex(2, 2, 2):
        share = np.prod(np.where(corner, part, 1 - part), axis=1)
        x, y, z = (base + corner).T
        ok = ((base + corner >= 0) & (base + corner < m)).all(1)
        np.add.at(data, (z[ok], y[ok], x[ok]), (share * value)[ok])
        np.add.at(weight, (z[ok], y[ok], x[ok]), (share * w)[ok])


@dataclass
class Volumes:
    """Class volumes, shares, noise by group and shell, and the history of the log likelihood."""

    volumes: np.ndarray
    shares: np.ndarray
    sigma2: np.ndarray
    history: list[float] = field(default_factory=list)


def classify_volumes(images: DataFrame, model: Volumes, directions: np.ndarray, rounds: int, step: float, reach: float = 0.0, shift: float = 1.0, pad: int = 2, tau2_fudge: float = 0.0, symmetry: list[np.ndarray] | None = None, cc_first: bool = False, pixels: str = "pixels", ctf: str | None = None, group: str | None = None) -> Volumes:
    """Classification of images over directions (rot, tilt), in-plane angles and shifts, with transfer functions and noise by shell.

    Each task weighs its images against the projections of the present volumes, a few images at a time, and adds up
    planes by class and view; these, not images, are scattered into the padded transforms. tau2_fudge above 0: the
    volumes' own spectra times it hold the divisions back; symmetry: operations under which the transforms are
    summed; cc_first: the first round gives each image to its most correlated view.
    """
    from lumenfold.operators.estimators import euler

    n, k = model.volumes.shape[-1], len(model.volumes)
    m, plane = n * pad, Plane(n)
    p, groups = plane.kx.size, len(model.sigma2)
    matrices = [euler(rot, tilt, psi) for rot, tilt in directions for psi in np.arange(0, 360, step)]
    moves = [(dx, dy) for _, dx, dy in poses(360.0, reach, shift)]
    ramps = np.exp(-2j * np.pi * (np.outer([dx for dx, _ in moves], plane.kx) + np.outer([dy for _, dy in moves], plane.ky)) / n)
    # volumes turn about their middle
    centred = np.exp(2j * np.pi * (n // 2) * (plane.kx + plane.ky) / n)
    columns = [pixels, *([ctf] if ctf else []), *([group] if group else [])]
    views = len(matrices)
    some = max(1, WEIGHTS // (k * views * len(moves)))
    sizes = [k * m**3, k * m**3, k * m**3, k, groups * plane.shells, groups, 1]
    cuts = np.cumsum([0, *sizes])
    n_pixels = np.bincount(plane.shell, plane.used, plane.shells)
    for r in range(rounds):
        each = plane.transform(np.stack([kernels.project(v, a, pad).ravel() for v in model.volumes for a in matrices]))
        shared = images.sparkSession.sparkContext.broadcast((each, model.shares, model.sigma2, cc_first and r == 0))
        memo: dict[str, np.ndarray] = {}

        def fold(batch: dict[str, np.ndarray], count: int) -> np.ndarray:
            refs, shares, sigma2, cc = shared.value  # noqa: B023
            if not memo:  # once a task  # noqa: B023
                memo["all"] = (refs[:, None] * ramps).reshape(-1, p)  # noqa: B023
            every = memo["all"]  # noqa: B023
            prior = np.repeat(np.log(shares + 1e-300), views * len(moves))
            top, bottom = np.zeros((k * views, p), complex), np.zeros((k * views, p))
            residual, counts, mass, like = np.zeros((groups, plane.shells)), np.zeros(groups), np.zeros(k), 0.0
            for a in range(0, count, some):
                x = plane.transform(batch[pixels][a : a + some])
                g = batch[group][a : a + some].astype(int) if group else np.zeros(len(x), int)
                c = batch[ctf][a : a + some] if ctf else np.ones(x.shape)
                wt = plane.used / sigma2[g][:, plane.shell]
                if cc:
                    used = plane.used.astype(float)
                    cross = ((used * c * x) @ every.conj().T).real
                    score = cross / np.sqrt(np.maximum((used * c * c) @ (np.abs(every) ** 2).T, 1e-300))
                    w = np.zeros_like(score)
                    w[np.arange(len(x)), score.argmax(1)] = 1.0
                else:
                    w, own = softmax(exponents(x, c, wt, every, prior))
                    like += float((own - (plane.used * np.log(2 * np.pi * sigma2[g][:, plane.shell])).sum(1)).sum())
                by_move = w.reshape(len(x), k * views, len(moves))
                for t in range(len(moves)):
                    top += ramps[t].conj() * (by_move[:, :, t].T @ (wt * c * x))
                bottom += by_move.sum(2).T @ (wt * c * c)
                mean, square = w @ every, w @ np.abs(every) ** 2
                rest = np.where(plane.used, np.abs(x) ** 2 - 2 * (x.conj() * c * mean).real + c * c * square, 0.0)
                np.add.at(residual, (g[:, None], plane.shell[None]), rest)
                np.add.at(counts, g, 1)
                mass += by_move.sum((0, 2)).reshape(k, views).sum(1)
            grids = np.zeros((3, k, m, m, m))
            for i in range(k):
                data, weight = np.zeros((m,) * 3, complex), np.zeros((m,) * 3)
                for v, matrix in enumerate(matrices):
                    row = i * views + v
                    if bottom[row].any():
                        # a plane's lone half of the line kx = 0 is given back by its mirror image
                        numer = np.where(plane.used, top[row] * centred, 0)
                        scatter_plane(data, weight, mirrored(kernels.full_plane(numer, n, False), False), mirrored(kernels.full_plane(bottom[row], n, True), True), matrix, pad)
                grids[0, i], grids[1, i], grids[2, i] = data.real, data.imag, weight
            return np.concatenate([grids.ravel(), mass, residual.ravel(), counts, [like]])

        out = statistics(images, columns, fold, int(cuts[-1]))
        shared.unpersist()
        part = [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        real, imaginary, weights = (x.reshape(k, m, m, m) for x in part[:3])
        volumes = []
        for i in range(k):
            data, weight = real[i] + 1j * imaginary[i], weights[i]
            if symmetry and len(symmetry) > 1:
                data, weight = kernels.symmetrise(data, weight, symmetry)
            if tau2_fudge > 0:
                weight = weight + _held_back(model.volumes[i], pad, tau2_fudge)
            scale = max(float(weight.max()), 1e-300)
            value = np.where(weight > 1e-6 * scale, data / np.maximum(weight, 1e-6 * scale), 0)
            volumes.append(kernels.reconstruct(value * n * n, np.ones_like(weight), n, pad))
        counts = part[5]
        sigma2 = np.where(counts[:, None] > 0, np.maximum(part[4].reshape(groups, -1) / (2 * np.maximum(counts[:, None] * n_pixels, 1)), 1e-12), model.sigma2)
        model = Volumes(np.stack(volumes), part[3] / counts.sum(), sigma2, [*model.history, float(part[6][0])])
    return model


def mirrored(plane: np.ndarray, even: bool) -> np.ndarray:
    """A centred plane where what is missing (0) is taken from the point through the centre."""
    other = plane[::-1, ::-1] if len(plane) % 2 else np.roll(plane[::-1, ::-1], 1, (0, 1))
    return np.where(plane == 0, other if even else other.conj(), plane)


def _held_back(volume: np.ndarray, pad: int, fudge: float) -> np.ndarray:
    """1 / (fudge tau2) of each shell of a padded transform, from the power of the present volume's projections."""
    n = volume.shape[0]
    power = np.abs(np.fft.fftshift(np.fft.fftn(volume))) ** 2 / n**4
    z, y, x = np.mgrid[:n, :n, :n] - n // 2
    shell = np.minimum(np.round(np.sqrt(z * z + y * y + x * x)).astype(int), n // 2)
    tau2 = np.bincount(shell.ravel(), power.ravel()) / np.bincount(shell.ravel()) / 2
    m = n * pad
    z, y, x = np.mgrid[:m, :m, :m] - m // 2
    at = np.minimum(np.round(np.sqrt(z * z + y * y + x * x) / pad).astype(int), n // 2)
    return 1 / np.maximum(fudge * tau2[at], 1e-12)

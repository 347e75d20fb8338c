"""Numerics that Spark has no function for, in numpy and the standard library; SciPy is not needed."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(np.asarray(x) / math.sqrt(2)))


def erf_column(x: Column) -> Column:
    """erf as an Arrow-batched column."""
    @F.arrow_udf("double")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array([None if v is None else math.erf(v) for v in batch.to_pylist()], pa.float64())

    return of(x)


def bessel_i(order: int, x: np.ndarray, terms: int = 60) -> np.ndarray:
    """Modified Bessel function of the first kind of integer order, by its series."""
    half = np.asarray(x, float) / 2
    term = half**order / math.factorial(order)
    total = term.copy()
    for k in range(1, terms):
        term = term * half * half / (k * (k + order))
        total = total + term
    return total


def bessel_i_half(n: int, x: np.ndarray) -> np.ndarray:
    """Modified Bessel function of order n + 1/2, n up to 3, in closed form."""
    x = np.asarray(x, float)
    a = np.sqrt(2 / (np.pi * np.maximum(x, 1e-300)))
    s, c = np.sinh(x), np.cosh(x)
    forms = {
        0: lambda: s,
        1: lambda: c - s / x,
        2: lambda: s - 3 * c / x + 3 * s / x**2,
        3: lambda: c - 6 * s / x + 15 * c / x**2 - 15 * s / x**3,
    }
    return a * forms[n]()


def bessel_j(order: float, x: np.ndarray, steps: int = 4000) -> np.ndarray:
    """Bessel function of the first kind: order 0 or 1 by Bessel's integral, 3/2 and 7/2 in closed form."""
    x = np.asarray(x, float)
    if order in (0, 1):
        t = (np.arange(steps) + 0.5) * np.pi / steps
        return np.cos(order * t - x[..., None] * np.sin(t)).mean(-1)
    a, s, c = np.sqrt(2 / (np.pi * x)), np.sin(x), np.cos(x)
    if order == 1.5:
        return a * (s / x - c)
    if order == 3.5:
        return a * ((15 / x**3 - 6 / x) * s - (15 / x**2 - 1) * c)
    raise ValueError(f"no form for order {order}")


def kaiser_blob(r: np.ndarray, radius: float = 1.9, alpha: float = 15.0, order: int = 0) -> np.ndarray:
    """Generalised Kaiser-Bessel window, 1 at the centre."""
    r = np.asarray(r, float)
    root = np.sqrt(np.maximum(0, 1 - (r / radius) ** 2))
    value = root**order * bessel_i(order, alpha * root) / bessel_i(order, np.array(alpha))
    return np.where(r <= radius, value, 0.0)


def kaiser_blob_transform(w: np.ndarray, radius: float = 1.9, alpha: float = 15.0) -> np.ndarray:
    """The Fourier transform of the 3D window of order 0 at the frequencies w, in closed form."""
    scaled = (2 * np.pi * radius * np.asarray(w, float)) ** 2 - alpha * alpha
    root = np.sqrt(np.maximum(np.abs(scaled), 1e-12))
    value = np.where(scaled < 0, bessel_i_half(1, np.minimum(root, 700)), bessel_j(1.5, root)) / root**1.5
    return (2 * np.pi) ** 1.5 * radius**3 / bessel_i(0, np.array(alpha)) * value


def minimise(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-8, rounds: int = 200) -> tuple[float, float]:
    """(x, f(x)) at a minimum between a and b: golden sections with parabolic steps."""
    golden = (3 - math.sqrt(5)) / 2
    x = w = v = a + golden * (b - a)
    fx = fw = fv = f(x)
    step = last = 0.0
    for _ in range(rounds):
        middle, near = (a + b) / 2, tolerance * abs(x) + 1e-12
        if abs(x - middle) <= 2 * near - (b - a) / 2:
            break
        parabola = False
        if abs(last) > near:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p = (x - v) * q - (x - w) * r
            q = 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(q * last / 2) and q * (a - x) < p < q * (b - x):
                last, step, parabola = step, p / q, True
        if not parabola:
            last = (b if x < middle else a) - x
            step = golden * last
        u = x + (step if abs(step) >= near else math.copysign(near, step))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


def polynomial_fit(x: np.ndarray, y: np.ndarray, degree: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Coefficients, highest power first, of the weighted least-squares polynomial."""
    w = np.ones(len(x)) if weights is None else weights
    return np.linalg.lstsq(np.vander(x, degree + 1) * w[:, None], y * w, rcond=None)[0]


def weighted_chi2_cdf(x: float, weights: np.ndarray, samples: int = 4096) -> float:
    """P(sum of weights times squared normals <= x).

    Weights of like size: a mixture of chi-square distributions of rising order, all scaled by the least weight, with
    non-negative shares. Others: numerical inversion of the characteristic function.
    """
    weights = np.asarray(weights, float)
    if x <= 0:
        return 0.0
    least = float(weights.min())
    if weights.max() <= 50 * least:
        n, y = len(weights), x / least
        decay = 1 - least / weights
        shares, powers, part = [float(np.prod(np.sqrt(least / weights)))], [], np.ones(n)
        at = math.erf(math.sqrt(y / 2)) if n % 2 else -math.expm1(-y / 2)
        for order in range(2 - n % 2, n, 2):
            at -= math.exp(order / 2 * math.log(y / 2) - y / 2 - math.lgamma(order / 2 + 1))
        total, held = shares[0] * at, shares[0]
        for k in range(1, 5000):
            if held > 1 - 1e-12:
                break
            part = part * decay
            powers.append(part.sum())
            shares.append(float(np.dot(powers[::-1], shares)) / (2 * k))
            order = n + 2 * k - 2
            at -= math.exp(order / 2 * math.log(y / 2) - y / 2 - math.lgamma(order / 2 + 1))
            total, held = total + shares[-1] * at, held + shares[-1]
        return float(min(max(total, 0.0), 1.0))
    scale = float(np.sqrt((weights**2).sum()))
    limit, u = 60 / scale, None
    u = (np.arange(samples * 8) + 0.5) * limit / (samples * 8)
    theta = 0.5 * np.arctan(np.outer(u, weights) * 2).sum(1) - u * x
    rho = np.prod((1 + (2 * np.outer(u, weights)) ** 2) ** 0.25, axis=1)
    return float(np.clip(0.5 - (np.sin(theta) / (u * rho)).sum() * (limit / (samples * 8)) / np.pi, 0, 1))


def gaussian_filter(a: np.ndarray, sigma: float, reach: float = 4.0) -> np.ndarray:
    """Gaussian smoothing on every axis, edges mirrored."""
    r = int(reach * sigma + 0.5)
    kernel = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in range(a.ndim):
        a = correlate(a, kernel, axis)
    return a


def correlate(a: np.ndarray, kernel: np.ndarray, axis: int = -1) -> np.ndarray:
    """One-dimensional correlation with mirrored edges."""
    r = len(kernel) // 2
    wide = np.pad(a, [(r, r) if k == axis % a.ndim else (0, 0) for k in range(a.ndim)], mode="symmetric")
    n = a.shape[axis]
    return sum(w * np.take(wide, np.arange(k, k + n), axis) for k, w in enumerate(kernel))


def frequency_filter(volume: np.ndarray, cutoff: float) -> np.ndarray:
    """Gaussian low pass of a cube in Fourier space; cutoff in cycles a pixel."""
    k2 = sum(f * f for f in np.meshgrid(*[np.fft.fftfreq(n) for n in volume.shape], indexing="ij"))
    return np.fft.ifftn(np.fft.fftn(volume) * np.exp(-k2 / (2 * cutoff * cutoff))).real


def taxicab_distance(mask: np.ndarray) -> np.ndarray:
    """Steps along the axes from each true cell to the nearest false one."""
    far = int(sum(mask.shape)) + 1
    d = np.where(mask, far, 0)
    for axis in range(mask.ndim):
        d = np.moveaxis(d, axis, 0)
        for i in range(1, len(d)):
            d[i] = np.minimum(d[i], d[i - 1] + 1)
        for i in range(len(d) - 2, -1, -1):
            d[i] = np.minimum(d[i], d[i + 1] + 1)
        d = np.moveaxis(d, 0, axis)
    return d


def dilate(mask: np.ndarray, rounds: int = 1) -> np.ndarray:
    """Cells within `rounds` steps along the axes of a true one."""
    return taxicab_distance(~mask) <= rounds


def zoom(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Linear resampling that maps corners to corners."""
    for axis, n in enumerate(shape):
        m = a.shape[axis]
        at = np.linspace(0, m - 1, n)
        low = np.minimum(np.floor(at).astype(int), max(m - 2, 0))
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
        a = np.take(a, low, axis) * (1 - part) + np.take(a, np.minimum(low + 1, m - 1), axis) * part
    return a


def convolve(a: np.ndarray, b: np.ndarray, same: bool = False) -> np.ndarray:
    """The full convolution of two series, or its middle part as long as the first."""
    full = np.convolve(a, b)
    start = (len(b) - 1) // 2
    return full[start : start + len(a)] if same else full


def converged(history: list[float], precision: float) -> bool:
    """Whether the last three values differ by less than the precision, relative to the earlier ones; equal ones tell nothing."""
    if len(history) < 3 or history[-1] == history[-2]:
        return False
    a, b, c = history[-3:]
    return abs(a - b) < precision * abs(a) and abs(c - b) < precision * abs(b)


def bracket(f: Callable[[float], float], a: float, b: float, grow: float = 1.618, rounds: int = 100) -> tuple[float, float]:
    """Ends of an interval that holds a minimum, by growing steps downhill from a and b."""
    fa, fb = f(a), f(b)
    if fb > fa:
        a, b, fa, fb = b, a, fb, fa
    for _ in range(rounds):
        c = b + grow * (b - a)
        fc = f(c)
        if fc >= fb:
            return (a, c) if a < c else (c, a)
        a, b, fb = b, c, fc
    raise ValueError("no minimum was enclosed")


def grid_peak(f: Callable[[tuple[int, ...]], float], bounds: list[tuple[int, int]], parts: int = 8) -> tuple[tuple[int, ...], float]:
    """The best point of an integer grid [low, high) found by halving steps.

    Each round tries all points of its step; where the best stands out by half a standard deviation, the next looks
    about it alone, else everywhere.
    """
    steps = [max(1, (high - low) // parts) for low, high in bounds]
    box = list(bounds)
    best, value = tuple(low for low, _ in bounds), -math.inf
    while True:
        axes = [np.arange(low, high, step) for (low, high), step in zip(box, steps)]
        points = [tuple(int(v) for v in p) for p in np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, len(bounds))]
        found = np.array([f(p) for p in points])
        if found.max() > value:
            value, best = float(found.max()), points[int(found.argmax())]
        if all(s == 1 for s in steps):
            return best, value
        if value - found.mean() > 0.5 * found.std():
            box = [(max(low, b - s), min(high, b + s + 1)) for (low, high), b, s in zip(bounds, best, steps)]
        steps = [max(1, s // 2) for s in steps]


def clear_peaks(y: np.ndarray, least_height: float = 0.0, least_gap: int = 1) -> list[int]:
    """Places of local maxima at least so high, the highest first to claim its surroundings of least_gap places."""
    y = np.asarray(y, float)
    inner = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1
    kept: list[int] = []
    for i in sorted(inner[y[inner] >= least_height].tolist(), key=lambda i: (-y[i], i)):
        if all(abs(i - k) >= least_gap for k in kept):
            kept.append(i)
    return sorted(kept)


def ricker(points: int, width: float) -> np.ndarray:
    t = np.arange(points) - (points - 1) / 2
    q = (t / width) ** 2
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - q) * np.exp(-q / 2)


def wavelet_transform(y: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Ricker wavelet transform, one row a width."""
    out = np.empty((len(widths), len(y)))
    for row, w in zip(out, widths):
        kernel = ricker(min(10 * int(w), len(y)), w)
        full = np.convolve(y, kernel)
        start = (len(full) - len(y)) // 2
        row[:] = full[start : start + len(y)]
    return out


def ridge_peaks(y: np.ndarray, widths: np.ndarray, least_snr: float = 2.0, gap: int = 2) -> list[int]:
    """Peaks that persist over widths: ridge lines of local maxima, kept by length and signal to noise."""
    rows = wavelet_transform(y, widths)
    maxima = np.zeros_like(rows, bool)
    maxima[:, 1:-1] = (rows[:, 1:-1] > rows[:, :-2]) & (rows[:, 1:-1] > rows[:, 2:])
    lines: list[dict] = []
    for k in range(len(widths) - 1, -1, -1):
        free = {int(i) for i in np.flatnonzero(maxima[k])}
        for line in lines:
            near = [i for i in free if abs(i - line["at"]) <= max(1, widths[k] // 4)]
            if near and line["gaps"] <= gap:
                line["at"] = min(near, key=lambda i: abs(i - line["at"]))
                line["rows"].append((k, line["at"]))
                line["gaps"] = 0
                free.discard(line["at"])
            else:
                line["gaps"] += 1
        lines += [{"at": i, "rows": [(k, i)], "gaps": 0} for i in sorted(free)]
    noise = max(np.quantile(np.abs(rows[0]), 0.1), 1e-12)
    kept = [line for line in lines if len(line["rows"]) >= math.ceil(len(widths) / 4) and abs(rows[line["rows"][-1]]) / noise >= least_snr]
    return sorted({line["rows"][-1][1] for line in kept})


def align_with_z(axis: np.ndarray) -> np.ndarray:
    """A rotation that takes the axis to z."""
    a = np.asarray(axis, float) / np.linalg.norm(axis)
    side = np.hypot(a[1], a[2])
    if side < 1e-9:
        return np.array([[0, 0, -np.sign(a[0])], [0, 1, 0], [np.sign(a[0]), 0, 0]])
    return np.array([[side, -a[0] * a[1] / side, -a[0] * a[2] / side], [0, a[2] / side, -a[1] / side], a])

"""Optics, geometry, masks and windows as Column expressions, so that they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wavelength(kilovolts: Column | float) -> Column:
    """Electron wavelength in Angstrom."""
    v = (F.lit(kilovolts) if not isinstance(kilovolts, Column) else kilovolts) * 1000
    return F.lit(12.2643247) / F.sqrt(v * (1 + v * 0.978466e-6))


def local_defocus(x: Column, y: Column, defocus_u: Column, defocus_v: Column, angle: Column) -> Column:
    """Defocus in the direction of (x, y); 0 at the origin."""
    average, deviation = -(defocus_u + defocus_v) / 2, -(defocus_u - defocus_v) / 2
    local = average + deviation * F.cos(2 * (F.atan2(y, x) - F.radians(angle)))
    return F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(local)


def ctf(
    x: Column, y: Column, defocus_u: Column, defocus_v: Column, angle: Column, kilovolts: float = 300.0, cs: float = 2.7, q0: float = 0.1,
    bfactor: float = 0.0, absolute: bool = False, flip_only: bool = False, first_peak: bool = False, damping: bool = True,
) -> Column:
    """Contrast transfer at the spatial frequency (x, y).

    first_peak: 1 up to the first peak; damping by the B factor; then the absolute value or, else, the sign.
    """
    lam = wavelength(kilovolts)
    u2 = x * x + y * y
    k2 = cs * 1e7 * math.pi / 2
    argument = math.pi * lam * local_defocus(x, y, defocus_u, defocus_v, angle) * u2 + k2 * F.pow(lam, 3) * u2 * u2
    value = -(math.sqrt(1 - q0 * q0) * F.sin(argument) - q0 * F.cos(argument))
    if first_peak:
        value = F.when(F.abs(argument) < math.pi / 2, F.lit(1.0)).otherwise(value)
    if damping and bfactor:
        value = value * F.exp(u2 * (-bfactor / 4))
    if absolute:
        return F.abs(value)
    return F.when(value < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) if flip_only else value


def gaussian(x: Column, mean: float, sigma: float) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))


def offset_pdf(dx: Column, dy: Column, sigma2: Column) -> Column:
    """Density of an offset; with hardly any spread, 1 at none and 0 elsewhere."""
    r2 = dx * dx + dy * dy
    return F.when(sigma2 < 1e-4, F.when(r2 > 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.exp(-r2 / (2 * sigma2)) / (2 * math.pi * sigma2))


def euler_matrix(rot: Column, tilt: Column, psi: Column) -> list[Column]:
    """Nine entries, row by row, of the ZYZ rotation; angles in degrees."""
    ca, cb, cg = (F.cos(F.radians(a)) for a in (rot, tilt, psi))
    sa, sb, sg = (F.sin(F.radians(a)) for a in (rot, tilt, psi))
    cc, cs, sc, ss = cb * ca, cb * sa, sb * ca, sb * sa
    return [cg * cc - sg * sa, cg * cs + sg * ca, -(cg * sb), -(sg * cc) - cg * sa, -(sg * cs) + cg * ca, sg * sb, sc, ss, cb]


def euler_angles(m: list[Column]) -> tuple[Column, Column, Column]:
    """(rot, tilt, psi) in degrees of a ZYZ rotation; at the poles rot is 0."""
    s = F.sqrt(m[2] * m[2] + m[5] * m[5])
    pole = s < 1e-9
    rot = F.when(pole, F.lit(0.0)).otherwise(F.degrees(F.atan2(m[7], m[6])))
    tilt = F.when(pole, F.when(m[8] > 0, F.lit(0.0)).otherwise(F.lit(180.0))).otherwise(F.degrees(F.atan2(s, m[8])))
    psi = F.when(pole, F.when(m[8] > 0, F.degrees(F.atan2(-m[3], m[0]))).otherwise(F.degrees(F.atan2(m[3], -m[0])))).otherwise(F.degrees(F.atan2(m[5], -m[2])))
    return rot, tilt, psi


def direction(rot: Column, tilt: Column) -> list[Column]:
    r, t = F.radians(rot), F.radians(tilt)
    return [F.cos(r) * F.sin(t), F.sin(r) * F.sin(t), F.cos(t)]


def direction_angles(v: list[Column]) -> tuple[Column, Column]:
    """(rot, tilt) in degrees of a vector of length 1."""
    return F.degrees(F.atan2(v[1], v[0])), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v[2]))))


def axis_distance(a: list[Column], b: list[Column]) -> Column:
    """Mean angle, in degrees, between the like axes of two rotations."""
    total = F.lit(0.0)
    for i in range(3):
        dot = sum((a[3 * i + j] * b[3 * i + j] for j in range(1, 3)), a[3 * i] * b[3 * i])
        total = total + F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    return total / 3


def wrap(x: Column, low: float, high: float) -> Column:
    """x moved by whole periods into [low, high)."""
    return x - F.floor((x - low) / (high - low)) * (high - low)


def sign(x: Column) -> Column:
    """-1 below zero, otherwise 1."""
    return F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))


def resolution_of_shell(shell: Column, pixel: float, side: int) -> Column:
    return F.when(shell > 0, pixel * side / shell).otherwise(F.lit(999.0))


def shell_of_resolution(resolution: Column, pixel: float, side: int) -> Column:
    return F.round(pixel * side / resolution).cast("int")


def cosine_mask(r: Column, radius: float, width: float) -> Column:
    """1 within the radius, 0 beyond radius + width, a raised cosine between."""
    soft = 0.5 + 0.5 * F.cos((r - radius) / width * math.pi)
    return F.when(r < radius, F.lit(1.0)).when(r > radius + width, F.lit(0.0)).otherwise(soft)


def sinc(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(x * math.pi) / (x * math.pi))


def hamming(i: Column, n: int) -> Column:
    return 0.54 - 0.46 * F.cos(2 * math.pi * i / (n - 1))


def ricker(t: Column, width: float) -> Column:
    """Second derivative of a Gaussian, of unit energy."""
    q = t * t / (width * width)
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - q) * F.exp(-q / 2)


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that the seed and the key fix: 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 13), 16, 10)
    return bits.cast("double") / float(1 << 52)


def normal(key: Column, seed: int) -> Column:
    """A standard normal number that the seed and the key fix, from two uniform ones."""
    first = F.greatest(uniform(key, seed), F.lit(2.0**-52))
    return F.sqrt(-2 * F.log(first)) * F.cos(2 * F.pi() * uniform(key, seed + 1))


def perturbed(angle: Column, step: float, draw: Column, order: int = 0) -> Column:
    """An accumulated random perturbation, wrapped into half a step on both sides; draw is between -1 and 1."""
    width = step / 2**order
    return wrap(angle + draw * (width / 2), -width / 2, width / 2)


def half_away(x: Column) -> Column:
    """Rounding half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)

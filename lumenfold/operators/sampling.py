"""Grids and table generators: translations, angles, directions, latent grids and bases."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.operators import healpix


def translations(spark: SparkSession, reach: float, step: float) -> DataFrame:
    """(x, y): multiples of step within the disc of radius reach."""
    n = math.ceil(reach / step)
    axis = f"sequence(-{n}, {n})"
    grid = spark.sql(f"select explode({axis}) as i").select("i", F.explode(F.expr(axis)).alias("j"))
    return grid.select((F.col("i") * float(step)).alias("x"), (F.col("j") * float(step)).alias("y")).where(F.expr(f"x * x + y * y <= {reach * reach}"))


def psi_angles(spark: SparkSession, step: float) -> DataFrame:
    """(i, psi): equal steps of a full turn, at least as fine as asked for."""
    n = math.ceil(360 / step)
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") * (360.0 / n)).alias("psi"))


def oversampled(grid: DataFrame, columns: dict[str, float], order: int) -> DataFrame:
    """Each point of the grid with its 2**order children on every axis; columns: axis to step."""
    parts = 2**order
    out = grid
    for name, step in columns.items():
        child = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        out = out.withColumn("__k", child).withColumn(f"over_{name}", F.col(name) - step / 2 + (F.col("__k") + 0.5) * (step / parts)).drop("__k")
    return out


def sampling_counts(step: float, reach: float, offset_step: float, healpix_order: int, order: int) -> dict[str, int]:
    """How many directions, in-plane angles, translations and points a sampling has."""
    n = math.ceil(reach / offset_step)
    shifts = sum(1 for i in range(-n, n + 1) for j in range(-n, n + 1) if (i * i + j * j) * offset_step**2 <= reach * reach)
    directions = 12 * 4**healpix_order
    return {"directions": directions, "psi": math.ceil(360 / step), "translations": shifts, "points": directions * math.ceil(360 / step) * shifts * 8**order * 4**order}


def asymmetric_unit(grid: DataFrame, group: str, n: int = 1) -> DataFrame:
    """Directions of one unit of a point group; rot is taken in (-180, 180]."""
    rot = "(rot - ceil((rot - 180) / 360) * 360)"
    tests = {
        "C": f"abs({rot}) <= {180 / n}", "CI": "tilt <= 90", "CS": "tilt <= 90", "CV": f"{rot} between 0 and {180 / n}",
        "CH": f"abs({rot}) <= {180 / n} and tilt <= 90", "S": f"abs({rot}) <= {360 / n} and tilt <= 90",
        "D": f"{rot} between {90 - 180 / n} and {90 + 180 / n} and tilt <= 90", "DV": f"{rot} between 90 and {90 + 180 / n} and tilt <= 90",
        "DH": f"{rot} between 90 and {90 + 180 / n} and tilt <= 90",
    }
    if group not in tests:
        raise ValueError(f"unknown point group {group}")
    return grid.where(tests[group])


def thinned_seams(unit: DataFrame, operations: list[np.ndarray], order: int, tolerance: float = 1e-4) -> DataFrame:
    """Directions of a unit (pixel, rot, tilt) without those that an operation takes, within the tolerance in degrees, to one of a lesser pixel.

    Such equivalents lie on the seams of a unit. Each direction is turned by each of the few operations, and meets the
    direction of the cell that it falls into, or of one beside it, by a join on cells.
    """
    parts = F.array(*[F.array(*[F.lit(float(v)) for v in r.ravel()]) for r in operations])
    r, t = F.radians("rot"), F.radians("tilt")
    v = unit.select("pixel", F.explode(parts).alias("o"), (F.cos(r) * F.sin(t)).alias("vx"), (F.sin(r) * F.sin(t)).alias("vy"), F.cos(t).alias("vz"))
    row = lambda k: F.get("o", F.lit(3 * k)) * F.col("vx") + F.get("o", F.lit(3 * k + 1)) * F.col("vy") + F.get("o", F.lit(3 * k + 2)) * F.col("vz")
    turned = v.select("pixel", row(0).alias("tx"), row(1).alias("ty"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), row(2))).alias("tz"))
    turned = turned.withColumns({"to_rot": F.degrees(F.atan2("ty", "tx")), "to_tilt": F.degrees(F.acos("tz"))})
    grid = unit.select(F.col("pixel"), F.col("rot").alias("at_rot"), F.col("tilt").alias("at_tilt"))
    met = healpix.near(grid, turned.withColumnRenamed("pixel", "own"), 29.0 / 2**order, order, "to_rot", "to_tilt").where("pixel < own")
    a, b = F.radians("at_rot"), F.radians("at_tilt")
    apart = F.sqrt(F.pow(F.cos(a) * F.sin(b) - F.col("tx"), 2) + F.pow(F.sin(a) * F.sin(b) - F.col("ty"), 2) + F.pow(F.cos(b) - F.col("tz"), 2))
    gone = met.where(F.degrees(apart) <= tolerance).select(F.col("own").alias("pixel")).distinct()
    return unit.join(gone, "pixel", "left_anti")


def closure(generators: list[np.ndarray], most: int = 240) -> list[np.ndarray]:
    """All products of rotation matrices, the identity first."""
    found = [np.eye(3)]
    k = 0
    while k < len(found):
        for g in generators:
            new = g @ found[k]
            if not any(np.allclose(new, f, atol=1e-6) for f in found):
                found.append(new)
                if len(found) > most:
                    raise ValueError("the generators give no small group")
        k += 1
    return found


def axis_rotation(axis: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation about an axis."""
    x, y, z = np.asarray(axis, float) / np.linalg.norm(axis)
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + s * k + (1 - c) * (k @ k)


def mirror(normal: np.ndarray) -> np.ndarray:
    """Reflection in the plane through the origin with the given normal."""
    n = np.asarray(normal, float) / np.linalg.norm(normal)
    return np.eye(3) - 2 * np.outer(n, n)


def point_group(name: str) -> list[np.ndarray]:
    """Operations of a point group, the identity first: CI, CS, C<n>, C<n>V, C<n>H, S<2n>, D<n>, D<n>V (staggered planes), D<n>H, T, TD, TH, O, OH, I, IH.

    Rotations alone for C<n>, D<n>, T, O and I; the others hold reflections or the inversion as well.
    """
    found = re.fullmatch(r"(CI|CS|[CDS]\d+|[TOI])([VHD]?)", name.strip().upper())
    if not found:
        raise ValueError(f"unknown point group {name}")
    kind, more = found[1], found[2]
    z, x = np.array([0, 0, 1.0]), np.array([1.0, 0, 0])
    golden = (1 + 5**0.5) / 2
    n = int(kind[1:]) if kind[1:].isdigit() else 1
    turn = axis_rotation(z, 360 / n) if n else None
    if turn is None or (kind[0] == "S" and (n % 2 or more)) or (kind in ("CI", "CS") and more):
        raise ValueError(f"unknown point group {name}")
    three = axis_rotation(np.ones(3), 120)
    generators = {
        "CI": [-np.eye(3)], "CS": [mirror(z)], "C": [turn], "S": [turn @ mirror(z)], "D": [turn, axis_rotation(x, 180)],
        "T": [three, axis_rotation(z, 180)], "O": [three, axis_rotation(z, 90)], "I": [three, axis_rotation(np.array([0, 1, golden]), 72)],
    }[kind if kind in ("CI", "CS") else kind[0]]
    half = np.radians(90 / n)
    extra = {
        "CV": [mirror(np.array([0, 1.0, 0]))], "CH": [mirror(z)], "DH": [mirror(z)], "DV": [mirror(np.array([-np.sin(half), np.cos(half), 0]))],
        "TD": [mirror(np.array([1.0, -1, 0]))], "TH": [-np.eye(3)], "OH": [-np.eye(3)], "IH": [-np.eye(3)], "C": [], "S": [], "D": [], "T": [], "O": [], "I": [],
    }
    if kind[0] + more not in extra:
        raise ValueError(f"unknown point group {name}")
    return closure(generators + extra[kind[0] + more])


def latent_grid(spark: SparkSession, k: int, dimension: int) -> DataFrame:
    """(node, x1 .. xd): the points 1 to k on every axis."""
    names = [f"x{i + 1}" for i in range(dimension)]
    out = spark.range(k**dimension).select(F.col("id").alias("node"))
    for i, name in enumerate(names):
        out = out.withColumn(name, (F.expr(f"node div {k**i}") % k + 1).cast("double"))
    return out


def basis_1d(grid: DataFrame, k: int, x: str = "x1") -> DataFrame:
    """(node, m, phi): Gaussians on int(0.8 k) even centres as wide as their distance, then a constant; k >= 3."""
    if k < 3:
        raise ValueError("a latent grid needs three points at least")
    m = int(0.8 * k)
    width = (k * m / (m - 1) - m / (m - 1)) / (m - 1)
    center = F.lit(m / (m - 1)) + F.col("m") * width
    rows = grid.select("node", x, F.explode(F.sequence(F.lit(0), F.lit(m))).alias("m"))
    phi = F.when(F.col("m") == m, F.lit(1.0)).otherwise(F.exp(-(F.col(x) - center) * (F.col(x) - center) / (2 * width * width)))
    return rows.select("node", F.col("m").cast("long").alias("m"), phi.alias("phi"))


def perturbed(angle: float, step: float, draw: float, order: int = 0) -> float:
    """An accumulated random perturbation, wrapped into half a step on both sides; draw is between -1 and 1."""
    width = step / 2**order
    moved = angle + draw * width / 2
    return float((moved + width / 2) % width - width / 2)


def near_prior(priors: DataFrame, order: int, sigma: float, reach: float = 3.0) -> DataFrame:
    """(id, pixel, weight): directions of the order within reach * sigma of each prior, or the nearest one, with Gaussian shares.

    priors have id, prior_rot and prior_tilt; each meets the directions of the cells around its own only.
    """
    grid = healpix.directions(priors.sparkSession, order)
    met = healpix.near(grid, priors, reach * sigma, order, "prior_rot", "prior_tilt")
    dot = F.expr("cos(radians(tilt)) * cos(radians(prior_tilt)) + sin(radians(tilt)) * sin(radians(prior_tilt)) * cos(radians(rot - prior_rot))")
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    nearest = Window.partitionBy("id").orderBy("angle", "pixel")
    placed = met.select("id", "pixel", angle.alias("angle")).withColumn("k", F.row_number().over(nearest))
    kept = placed.where((F.col("angle") <= reach * sigma) | (F.col("k") == 1))
    weight = F.exp(-F.col("angle") * F.col("angle") / (2 * sigma * sigma))
    total = F.sum(weight).over(Window.partitionBy("id"))
    return kept.select("id", "pixel", F.when(total > 0, weight / total).otherwise(F.lit(1.0)).alias("weight"))


def half_space_unit(grid: DataFrame, planes: list[np.ndarray]) -> DataFrame:
    """Directions on the inner side of all planes, given by their normals: units of tetrahedral and like groups."""
    r, t = F.radians("rot"), F.radians("tilt")
    v = [F.cos(r) * F.sin(t), F.sin(r) * F.sin(t), F.cos(t)]
    out = grid
    for n in planes:
        out = out.where(v[0] * float(n[0]) + v[1] * float(n[1]) + v[2] * float(n[2]) >= -1e-9)
    return out


def unit_planes(axes: list[np.ndarray]) -> list[np.ndarray]:
    """Normals of the planes through neighbouring axes of a unit."""
    k = len(axes)
    return [np.cross(axes[i], axes[(i + 1) % k]) for i in range(k)]

"""The equal-area, iso-latitude pixelisation of the sphere in twelve base faces, from its plane projection.

In the plane of the projection, with a quarter of pi as the unit, faces are squares that stand on a corner. Along
axes turned by 45 degrees, p = (t + w) / 2 and q = (w - t) / 2 for longitude t and height w, they are unit cells
with whole numbers P and Q: P + Q is 1 for the faces about the north pole, 0 for those of the equator and -1 for
those about the south pole, and P counts them eastwards. A pixel is a cell (x, y) of the face's grid; nested numbers
interleave the bits of x and y, ring numbers go around the parallels from the north.

Functions on tables plan as projections; those on arrays serve estimators, which hold a whole grid.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = math.pi / 4


def spread_bits(x: Column, order: int) -> Column:
    """The bits of x at even places."""
    out = F.lit(0).cast("long")
    for bit in range(order):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, bit).bitwiseAND(F.lit(1)).cast("long"), 2 * bit))
    return out


def gather_bits(x: Column, order: int) -> Column:
    """The bits of x at even places, side by side."""
    out = F.lit(0).cast("long")
    for bit in range(order):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, 2 * bit).bitwiseAND(F.lit(1)).cast("long"), bit))
    return out


def nest_of(face: Column, x: Column, y: Column, order: int) -> Column:
    return face.cast("long") * (4**order) + spread_bits(x.cast("long"), order) + 2 * spread_bits(y.cast("long"), order)


def with_cells(df: DataFrame, pixel: str, order: int) -> DataFrame:
    """df with __face, __x and __y of a nested pixel."""
    inside = df.withColumns({"__face": F.floor(F.col(pixel) / (4**order)), "__inside": F.col(pixel) % (4**order)})
    return inside.withColumns({"__x": gather_bits(F.col("__inside"), order), "__y": gather_bits(F.shiftright("__inside", 1), order)}).drop("__inside")


def with_pixel(df: DataFrame, rot: str, tilt: str, order: int, out: str = "pixel") -> DataFrame:
    """df with the nested number of the pixel that holds each direction, in degrees; a border belongs to the pixel north or east of it, a null has -1.

    Each step is a projection of its own: as one expression, what later steps take several times would be repeated.
    """
    side = 2**order
    c = F.col
    polar = F.abs("__z") > 2 / 3
    flat = df.withColumns({"__z": F.cos(F.radians(c(tilt))), "__turn": c(rot) / 45 - 8 * F.floor(c(rot) / 360)})
    flat = flat.withColumns({"__s": F.sqrt(F.greatest(F.lit(0.0), 3 * (1 - F.abs("__z")))), "__m": F.least(2 * F.floor(c("__turn") / 2) + 1, F.lit(7))})
    flat = flat.withColumns({"__t": F.when(polar, c("__m") + (c("__turn") - c("__m")) * c("__s")).otherwise(c("__turn")), "__w": F.when(polar, F.signum("__z") * (2 - c("__s"))).otherwise(1.5 * c("__z"))})
    flat = flat.withColumns({"__p": (c("__t") + c("__w")) / 2 + 0.5, "__q": (c("__w") - c("__t")) / 2 + 0.5})
    flat = flat.withColumns({"__high": F.floor("__p"), "__low": F.floor("__q")})
    # on an edge at a pole, or at the pole, the point belongs to a face that ends there; rounding may call for it too
    flat = flat.withColumns({"__beyond": c("__high") + c("__low"), "__first": c("__p") - c("__high") <= c("__q") - c("__low")})
    beyond, first = c("__beyond"), c("__first")
    flat = flat.withColumns({
        "__cp": c("__high") + F.when(beyond >= 3, -1).when(first & (beyond == 2), -1).when(~first & (beyond == -2), 1).otherwise(0),
        "__cq": c("__low") + F.when(beyond >= 3, -1).when(~first & (beyond == 2), -1).when(first & (beyond == -2), 1).otherwise(0),
    })
    belt = c("__cp") + c("__cq")
    index = lambda u: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(u * side)))
    flat = flat.withColumns({
        "__face": F.pmod(F.when(belt == 1, c("__cp") - 1).otherwise(c("__cp")), F.lit(4)) + 4 * (1 - belt),
        "__x": index(c("__p") - c("__cp")), "__y": index(c("__q") - c("__cq")),
    })
    made = "__z __turn __s __m __t __w __p __q __high __low __beyond __first __cp __cq __face __x __y".split()
    # never null: a join on a key that may be null pushes a test of it down through all the projections, which multiplies them
    return flat.withColumn(out, F.coalesce(nest_of(c("__face"), c("__x"), c("__y"), order), F.lit(-1).cast("long"))).drop(*made)


def with_plane(df: DataFrame, pixel: str, order: int) -> DataFrame:
    """df with __t and __w, longitude and height of a pixel's centre in the plane."""
    side = 2**order
    cells = with_cells(df, pixel, order).withColumn("__belt", 1 - F.floor(F.col("__face") / 4))
    cells = cells.withColumn("__east", F.col("__face") % 4 + F.when(F.col("__belt") == 1, 1).otherwise(0))
    p = F.col("__east") + (F.col("__x") + 0.5) / side - 0.5
    q = F.col("__belt") - F.col("__east") + (F.col("__y") + 0.5) / side - 0.5
    cells = cells.withColumns({"__p": p, "__q": q})
    return cells.withColumns({"__t": F.col("__p") - F.col("__q"), "__w": F.col("__p") + F.col("__q")}).drop("__face", "__x", "__y", "__belt", "__east", "__p", "__q")


def with_centre(df: DataFrame, pixel: str, order: int, rot: str = "rot", tilt: str = "tilt") -> DataFrame:
    """df with the direction of each nested pixel's centre, in degrees; rot is in [0, 360)."""
    t, w = F.col("__t"), F.col("__w")
    polar = F.abs(w) > 1
    flat = with_plane(df, pixel, order).withColumns({"__s": 2 - F.abs(w), "__m": 2 * F.floor(t / 2) + 1})
    flat = flat.withColumn("__turn", F.when(polar, F.col("__m") + (t - F.col("__m")) / F.col("__s")).otherwise(t))
    z = F.when(polar, F.signum(w) * (1 - F.col("__s") * F.col("__s") / 3)).otherwise(w / 1.5)
    return flat.withColumns({rot: 45 * (F.col("__turn") - 8 * F.floor(F.col("__turn") / 8)), tilt: F.degrees(F.acos(z))}).drop("__t", "__w", "__s", "__m", "__turn")


def with_ring(df: DataFrame, pixel: str, order: int, out: str = "ring_pixel") -> DataFrame:
    """df with the ring number of each nested pixel: whole parallels before its own, then its place eastwards."""
    side = 2**order
    t, ring, south = F.col("__t"), F.col("__ring"), F.col("__south")
    flat = with_plane(df, pixel, order).withColumn("__ring", F.round((2 - F.col("__w")) * side).cast("long"))  # 1 at the north
    flat = flat.withColumns({"__south": 4 * side - ring, "__quarter": F.floor(t / 2)})
    flat = flat.withColumn("__cap", F.least(ring, south, F.lit(side)))
    before = F.when(ring <= side, 2 * ring * (ring - 1)).when(ring <= 3 * side, F.lit(2 * side * (side - 1)) + 4 * side * (ring - side)).otherwise(12 * side * side - 2 * south * (south + 1))
    # centres are one step apart; those of polar rings stand in the middle of their share of the quarter
    in_cap = F.round((t - 2 * F.col("__quarter") - 1) * side / 2 + (F.col("__cap") - 1) / 2).cast("long") + F.col("__quarter") * F.col("__cap")
    place = F.when(F.col("__cap") < side, in_cap).otherwise(F.floor(t * side / 2 + 1e-6).cast("long"))
    flat = flat.withColumns({"__before": before, "__place": place})
    return flat.withColumn(out, F.col("__before") + F.pmod("__place", 4 * F.col("__cap"))).drop("__t", "__w", "__ring", "__south", "__quarter", "__cap", "__before", "__place")


def directions(spark: SparkSession, order: int) -> DataFrame:
    """(pixel, rot, tilt) of every pixel in nested order, made by the executors."""
    return with_centre(spark.range(12 * 4**order).withColumnRenamed("id", "pixel"), "pixel", order)


def faces_of(pixels: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    face, inside = np.divmod(np.asarray(pixels, np.int64), 4**order)
    bits = np.arange(order)
    gather = lambda v: ((v[..., None] >> (2 * bits) & 1) << bits).sum(-1)
    return face, gather(inside), gather(inside >> 1)


def pixels_at(face: np.ndarray, x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    bits = np.arange(order)
    spread = lambda v: ((v[..., None] >> bits & 1) << (2 * bits)).sum(-1)
    return face * 4**order + spread(x) + 2 * spread(y)


def centres(order: int) -> np.ndarray:
    """(rot, tilt) in degrees of all pixels in nested order, as an array."""
    side = 2**order
    face, x, y = faces_of(np.arange(12 * side * side), order)
    belt = 1 - face // 4
    east = face % 4 + (belt == 1)
    p, q = east + (x + 0.5) / side - 0.5, belt - east + (y + 0.5) / side - 0.5
    t, w = p - q, p + q
    narrow = 2 - np.abs(w)
    polar = np.abs(w) > 1
    middle = 2 * np.floor(t / 2) + 1
    turn = np.where(polar, middle + (t - middle) / narrow, t) % 8
    z = np.where(polar, np.sign(w) * (1 - narrow**2 / 3), w / 1.5)
    return np.stack([45 * turn, np.degrees(np.arccos(z))], 1)


#: Steps to the eight neighbours of a cell, from the south-west clockwise.
STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def neighbours(order: int) -> np.ndarray:
    """The eight neighbours of every pixel in nested order, from the south-west clockwise; -1 where three faces meet.

    Between faces of different belts, cells go on in the plane; about a pole, a face is turned by a right angle
    against the next one, so that the edges that meet at the pole's corner lie on each other.
    """
    side = 2**order
    face, x, y = faces_of(np.arange(12 * side * side), order)
    out = np.empty((len(face), 8), np.int64)
    for k, (dx, dy) in enumerate(STEPS):
        u, v = x + dx, y + dy
        a, b = np.floor_divide(u, side), np.floor_divide(v, side)
        belt, east = 1 - face // 4, face % 4
        to_p, to_q = east + (belt == 1) + a, belt - east - (belt == 1) + b
        over = to_p + to_q
        u, v = u - a * side, v - b * side
        last = side - 1
        # beyond a pole's edges: the next face eastwards or westwards, or across the pole
        pole = np.abs(over) > 1
        north = over > 1
        across = pole & (a != 0) & (b != 0)
        turn = np.where(across, 2, np.where(north, a - b, b * -1 + a))
        new_u = np.where(across, np.where(north, last, 0), np.where(north, np.where(a != 0, v, last - v), np.where(a != 0, v, last - v)))
        new_v = np.where(across, np.where(north, last, 0), np.where(north, np.where(a != 0, last - u, u), np.where(a != 0, last - u, u)))
        to_face = np.where(pole, (east + turn) % 4 + 4 * (1 - belt), np.where(over == 1, (to_p - 1) % 4, to_p % 4) + 4 * (1 - np.clip(over, -1, 1)))
        found = pixels_at(to_face, np.where(pole, new_u, u), np.where(pole, new_v, v), order)
        # a corner step that stays in the plane of two belts at once leads to a gap where only three faces meet
        corner = (a != 0) & (b != 0)
        gap = corner & (a == -b) & (belt != 0) | corner & (a == b) & (belt == 0)
        out[:, k] = np.where(gap, -1, found)
    return out


def near(grid: DataFrame, points: DataFrame, reach: float, order: int, rot: str = "rot", tilt: str = "tilt") -> DataFrame:
    """points joined with the directions of grid (pixel and further columns, of the given order) that lie in the neighbourhood of their cell.

    Cells are pixels of an order whose neighbours reach at least `reach` degrees beyond a cell, so that every
    direction within reach is among them, and so is the nearest. The join is on cells: no pair of far ones is made.
    """
    spark = points.sparkSession
    coarse = 0
    while coarse < min(order, 8) and 29.0 / 2 ** (coarse + 1) >= reach:
        coarse += 1
    if coarse == 0 and reach > 29.0:
        cells = points.withColumn("__cell", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<long>")))
    else:
        table = neighbours(coarse)
        rows = [(i, sorted({i, *(int(n) for n in near if n >= 0)})) for i, near in enumerate(table)]
        around = spark.createDataFrame(rows, "__home long, __cells array<long>")
        placed = with_pixel(points, rot, tilt, coarse, "__home")
        cells = placed.join(around, "__home").withColumn("__cell", F.explode("__cells")).drop("__home", "__cells")
    return cells.join(grid.withColumn("__cell", F.shiftright("pixel", 2 * (order - coarse))), "__cell").drop("__cell")

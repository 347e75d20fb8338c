"""Queries on image kernels, numerics and grids, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import images as kernels
from lumenfold.functions import numerics, physics
from lumenfold.operators import healpix, local_resolution, sampling, spectral
from lumenfold.plans.format_queries import VOLUME, long_volume, volume_of
from lumenfold.plans.image_queries import DFT, PX, rounded
from lumenfold.plans.math_queries import RINGS
from lumenfold.plans.registry import register
from lumenfold.session import ship_package
from lumenfold.sources.tables import SIDE, images, table


def through(spark: SparkSession, sf_dir: str, kernel, name: str = "v", places: int = 6) -> DataFrame:
    """(vec_id, p, value) of a kernel on every image."""
    found = spectral.image_kernel(images(spark, sf_dir), kernel).select("vec_id", F.posexplode_outer("pixels").alias("p", name)).where("p is not null")
    return rounded(found.withColumn("p", F.col("p").cast("long")), name, places=places)


@register("center_roll", f"WITH {PX} SELECT vec_id, ((y + 4) % 8) * 8 + (x + 4) % 8 AS p, round(v, 6) + 0.0 AS v FROM px")
def center_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, kernels.center)


@register("translate_bilinear", f"""WITH {PX}, s AS (SELECT * FROM (VALUES (1, 1, 0.375), (1, 2, 0.125), (0, 1, 0.375), (0, 2, 0.125)) AS t(dy, dx, w))
SELECT vec_id, ((y + dy) % 8) * 8 + (x + dx) % 8 AS p, round(sum(w * v), 6) + 0.0 AS v FROM px, s GROUP BY ALL""")
def translate_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, lambda image: kernels.translate(image, 1.25, 0.5))


@register("rotate_quarter", f"""WITH {PX}, q AS (SELECT vec_id, y, x, v FROM px), g AS (SELECT vec_id, p, y AS yo, x AS xo FROM px)
SELECT g.vec_id, g.p, round(coalesce(q.v, 0), 6) + 0.0 AS v FROM g LEFT JOIN q ON q.vec_id = g.vec_id AND q.y = 8 - g.xo AND q.x = g.yo""")
def rotate_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, lambda image: kernels.rotate(image, 90))


@register("solvent_flatten", f"""WITH {PX} SELECT vec_id, p, round(v * CASE WHEN r < 2 THEN 1 WHEN r > 3.5 THEN 0 ELSE 0.5 + 0.5 * cos((r - 2) / 1.5 * pi()) END, 6) + 0.0 AS v FROM (SELECT *, sqrt((x - 4) * (x - 4) + (y - 4) * (y - 4)) AS r FROM px)""")
def solvent_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, lambda image: kernels.solvent_flatten(image, 2.0, 1.5))


@register("low_pass_image", f"""WITH {DFT}, m AS (SELECT label, kx, ky, avg(re) AS re, avg(im) AS im FROM ft GROUP BY ALL),
f AS (SELECT *, (CASE WHEN k < 2 THEN 1 WHEN k > 3 THEN 0 ELSE 0.5 + 0.5 * cos((k - 2) * pi()) END) * CASE WHEN kx IN (0, 4) THEN 1 ELSE 2 END AS w FROM (SELECT *, sqrt(kx * kx + ky * ky) AS k FROM m))
SELECT label, i AS p, round(sum(w * (re * cos(2 * pi() * (kx * (i % 8) + ky * (i // 8)) / 8) - im * sin(2 * pi() * (kx * (i % 8) + ky * (i // 8)) / 8))), 6) + 0.0 AS v FROM f, (SELECT unnest(range(64)) AS i) GROUP BY ALL""")
def low_pass_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class means without their high frequencies."""
    from lumenfold.plans.image_queries import pixels

    means = pixels(spark, sf_dir).groupBy("label", "p").agg(F.avg("v").alias("v")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("a"))
    found = spectral.image_kernel(means.select("label", F.transform("a", lambda s: s["v"]).alias("pixels")), lambda image: kernels.low_pass(image, 2.5, 1.0))
    return rounded(found.select("label", F.posexplode("pixels").alias("p", "v")).withColumn("p", F.col("p").cast("long")), "v")


@register("window_center", f"WITH {PX} SELECT vec_id, (y - 2) * 4 + x - 2 AS p, round(v, 6) + 0.0 AS v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5")
def window_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, lambda image: kernels.window(image, 4))


@register("taxicab_distance", f"""WITH {PX} SELECT a.vec_id, a.p, CASE WHEN a.v > 0 THEN coalesce(min(abs(a.x - b.x) + abs(a.y - b.y)), 17) ELSE 0 END::DOUBLE AS v
FROM px a LEFT JOIN px b ON a.vec_id = b.vec_id AND b.v <= 0 GROUP BY a.vec_id, a.p, a.v""")
def taxicab_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, lambda image: numerics.taxicab_distance(image > 0).astype(float))


@register("dilated_mask", f"""WITH {PX} SELECT a.vec_id, a.p, max(CASE WHEN b.v > 0.15 THEN 1 ELSE 0 END)::DOUBLE AS v FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY a.vec_id, a.p""")
def dilated_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, lambda image: numerics.dilate(image > 0.15).astype(float))


GAUSS = "g AS (SELECT k, exp(-k * k / 2.0) / (SELECT sum(exp(-j * j / 2.0)) FROM (SELECT unnest(range(-4, 5)) AS j)) AS w FROM (SELECT unnest(range(-4, 5)) AS k))"


@register("gaussian_smooth", f"""WITH {PX}, {GAUSS}, o AS (SELECT unnest(range(8)) AS o), m AS (SELECT o, CASE WHEN o + k < 0 THEN -1 - o - k WHEN o + k > 7 THEN 15 - o - k ELSE o + k END AS i, sum(w) AS w FROM o, g GROUP BY ALL),
rows_done AS (SELECT vec_id, m.o AS y, x, sum(w * v) AS v FROM px JOIN m ON m.i = y GROUP BY ALL)
SELECT vec_id, y * 8 + m.o AS p, round(sum(w * v), 6) + 0.0 AS v FROM rows_done JOIN m ON m.i = x GROUP BY ALL""")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, lambda image: numerics.gaussian_filter(image, 1.0))


@register("wavelet_row", f"""WITH {PX}, k AS (SELECT m, 2 / (sqrt(6.0) * power(pi(), 0.25)) * (1 - q) * exp(-q / 2) AS w FROM (SELECT m, power((m - 9.5) / 2, 2) AS q FROM (SELECT unnest(range(20)) AS m)))
SELECT vec_id, i AS p, round(sum(v * w), 6) + 0.0 AS v FROM px, (SELECT unnest(range(64)) AS i) JOIN k ON k.m = i + 9 - p GROUP BY ALL""")
def wavelet_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, lambda image: numerics.wavelet_transform(image.ravel(), np.array([2])))


@register("convolved_rows", f"""WITH {PX}, k AS (SELECT * FROM (VALUES (0, 1.0), (1, -2.0), (2, 0.5)) AS t(m, w))
SELECT vec_id, i AS p, round(sum(v * w), 6) + 0.0 AS v FROM px, (SELECT unnest(range(64)) AS i) JOIN k ON k.m = i + 1 - p GROUP BY ALL""")
def convolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, sf_dir, lambda image: numerics.convolve(image.ravel(), np.array([1.0, -2.0, 0.5]), same=True))


@register("project_axis", f"WITH {VOLUME} SELECT 0::BIGINT AS z, y, x, round(sum(v), 6) + 0.0 AS v FROM vol GROUP BY ALL")
def project_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_volume(spark, kernels.project(volume_of(spark, sf_dir), np.eye(3))[None])


@register("power_spectrum_3d", f"""WITH {VOLUME}, k AS (SELECT i // 64 AS kz, (i // 8) % 8 AS ky, i % 8 AS kx FROM (SELECT unnest(range(512)) AS i)),
f AS (SELECT kz, ky, kx, sum(v * cos(2 * pi() * (kz * z + ky * y + kx * x) / 8)) AS re, sum(v * sin(2 * pi() * (kz * z + ky * y + kx * x) / 8)) AS im FROM vol, k GROUP BY ALL),
s AS (SELECT least(4, floor(sqrt(power(least(kz, 8 - kz), 2) + power(least(ky, 8 - ky), 2) + power(least(kx, 8 - kx), 2)))) AS r, re * re + im * im AS e FROM f)
SELECT r::BIGINT AS shell, round(avg(e), 5) + 0.0 AS power FROM s GROUP BY 1""")
def power_spectrum_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = local_resolution.spherical_spectrum(volume_of(spark, sf_dir))
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "shell long, power double"), "power", places=5)


@register("shell_order", f"WITH {DFT} SELECT vec_id, kx, ky, row_number() OVER (PARTITION BY vec_id ORDER BY shell, ky, kx) - 1 AS place FROM ft")
def shell_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = spectral.long_spectrum(spectral.fourier(images(spark, sf_dir)).drop("pixels"))
    return rounded(spectral.shell_order(long, "vec_id").select("vec_id", "kx", "ky", "place"))


@register("pool_transforms", f"""WITH {PX}, n AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd FROM px GROUP BY 1), z AS (SELECT vec_id, (x + vec_id % 3) % 8 AS x, (y + 8 - vec_id % 2) % 8 AS y, (v - m) / sd AS v FROM px JOIN n USING (vec_id)),
k AS (SELECT kx, ky FROM (SELECT unnest(range(3)) AS kx), (SELECT unnest(range(-1, 3)) AS ky))
SELECT vec_id, kx, ky, round(sum(v * cos(2 * pi() * (kx * x + ky * y) / 8)) / 64, 6) + 0.0 AS re, round(-sum(v * sin(2 * pi() * (kx * x + ky * y) / 8)) / 64, 6) + 0.0 AS im FROM z, k GROUP BY ALL""")
def pool_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = images(spark, sf_dir).withColumns({"dx": F.col("vec_id") % 3, "dy": -(F.col("vec_id") % 2)})
    long = spectral.long_spectrum(spectral.pool_transforms(moved, "dx", "dy", 4).drop("pixels"))
    return rounded(long.select("vec_id", "kx", "ky", "re", "im"), "re", "im")


@register("shifted_with_noise", f"""WITH {DFT}, s AS (SELECT shell, avg(re * re + im * im) / 2 AS s2 FROM ft GROUP BY 1), a AS (SELECT *, -2 * pi() * (kx * 1.0 + ky * 0.25) / 8 AS a FROM ft)
SELECT vec_id, kx, ky, round(1000 * (re * cos(a) - im * sin(a)), 5) + 0.0 AS re, round(1000 * (re * sin(a) + im * cos(a)), 5) + 0.0 AS im, round(1 / s2, 3) AS inverse FROM a JOIN s USING (shell)""")
def shifted_with_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = spectral.long_spectrum(spectral.fourier(images(spark, sf_dir)).drop("pixels"))
    noise = long.groupBy("shell").agg((F.avg(F.expr("re * re + im * im")) / 2).alias("sigma2"))
    found = spectral.shifted_with_noise(long, noise, 1.0, 0.25, SIDE)
    scaled = found.select("vec_id", "kx", "ky", (F.col("re") * 1000).alias("re"), (F.col("im") * 1000).alias("im"), F.round("inverse", 3).alias("inverse"))
    return rounded(scaled, "re", "im", places=5)


@register("line_fit_by_user", """WITH e AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events) SELECT user_id, round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 6) + 0.0 AS intercept FROM e GROUP BY 1 HAVING count(*) > 2""")
def line_fit_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A least-squares line for each user's series; a series is one group's rows."""
    ship_package(spark)

    def fitted(keys: tuple, rows: pa.Table) -> pa.Table:
        y = rows.sort_by("event_id").column("value").to_numpy()
        slope, intercept = numerics.polynomial_fit(np.arange(1.0, len(y) + 1), y, 1)
        return pa.table({"user_id": [keys[0].as_py()], "slope": [float(slope)], "intercept": [float(intercept)], "n": [len(y)]})

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    found = rows.groupBy("user_id").applyInArrow(fitted, "user_id long, slope double, intercept double, n long").where("n > 2").drop("n")
    return rounded(found, "slope", "intercept")


@register("erf_values", """SELECT i, round(2 / sqrt(pi()) * list_sum([power(-1, k) * power(x, 2 * k + 1) / (factorial(k::INTEGER) * (2 * k + 1.0)) FOR k IN range(28)]), 8) + 0.0 AS erf FROM (SELECT i, (i - 20) / 10.0::DOUBLE AS x FROM (SELECT unnest(range(41)) AS i))""")
def erf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.range(41).select(F.col("id").alias("i"), numerics.erf_column((F.col("id") - 20) / 10.0).alias("erf")), "erf", places=8)


@register("chi2_mixtures", """SELECT i, round(1 - exp(-x / 2), 5) AS two, round(1 - exp(-x / 6) * (1 + x / 6), 5) AS four_of_three FROM (SELECT i, i / 2.0::DOUBLE AS x FROM (SELECT unnest(range(1, 21)) AS i))""")
def chi2_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of weighted sums that have a closed form: two weights of 1, four of 3."""
    rows = [(i, numerics.weighted_chi2_cdf(i / 2, np.ones(2)), numerics.weighted_chi2_cdf(i / 2, np.full(4, 3.0))) for i in range(1, 21)]
    return rounded(spark.createDataFrame(rows, "i long, two double, four_of_three double"), "two", "four_of_three", places=5)


@register("bessel_values", """SELECT i, round(list_sum([power(x / 2, 2 * k) / power(factorial(k::INTEGER), 2) FOR k IN range(20)]), 6) AS i0, round(list_sum([power(x / 2, 2 * k + 2) / (factorial(k::INTEGER) * factorial((k + 2)::INTEGER)) FOR k IN range(20)]), 6) AS i2,
round(list_sum([power(-1, k) * power(x / 2, 2 * k) / power(factorial(k::INTEGER), 2) FOR k IN range(20)]), 6) + 0.0 AS j0, round(sqrt(2 / (pi() * x)) * (sin(x) / x - cos(x)), 6) + 0.0 AS j1_5, round(sqrt(2 / (pi() * x)) * (exp(x) - exp(-x)) / 2, 6) AS i0_5
FROM (SELECT i, i / 4.0::DOUBLE AS x FROM (SELECT unnest(range(1, 17)) AS i))""")
def bessel_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = np.arange(1, 17) / 4
    columns = [numerics.bessel_i(0, x), numerics.bessel_i(2, x), numerics.bessel_j(0, x), numerics.bessel_j(1.5, x), numerics.bessel_i_half(0, x)]
    rows = [(i + 1, *(float(c[i]) for c in columns)) for i in range(16)]
    return rounded(spark.createDataFrame(rows, "i long, i0 double, i2 double, j0 double, j1_5 double, i0_5 double"), "i0", "i2", "j0", "j1_5", "i0_5")


@register("blob_transform", """SELECT i, round(4 * pi() * sum(r * r * b * CASE WHEN w = 0 THEN 1 ELSE sin(2 * pi() * w * r) / (2 * pi() * w * r) END) * 1.9 / 4000, 5) + 0.0 AS value
FROM (SELECT i, i / 10.0::DOUBLE AS w FROM (SELECT unnest(range(12)) AS i)), (SELECT r, list_sum([power(7.5 * sqrt(1 - r * r / 3.61), 2 * k) / power(factorial(k::INTEGER), 2) FOR k IN range(20)]) / list_sum([power(7.5, 2 * k) / power(factorial(k::INTEGER), 2) FOR k IN range(20)]) AS b
  FROM (SELECT (k + 0.5) * 1.9 / 4000 AS r FROM (SELECT unnest(range(4000)) AS k))) GROUP BY i""")
def blob_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Fourier transform of the blob, whose closed form is compared with an integral over its radius."""
    w = np.arange(12) / 10
    found = numerics.kaiser_blob_transform(w, 1.9, 15.0)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "i long, value double"), "value", places=5)


@register("affine_geometry", f"""WITH {PX}, g AS (SELECT vec_id, p, y AS yo, x AS xo FROM px) SELECT g.vec_id, g.p, round(coalesce(q.v, 0), 6) + 0.0 AS v FROM g LEFT JOIN px q ON q.vec_id = g.vec_id AND q.x = 8 - g.xo + 1 AND q.y = g.yo - 2""")
def affine_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images mirrored in x and moved by (1, 2): out(A u + t) = in(u), from the middle."""
    return through(spark, sf_dir, lambda image: kernels.apply_geometry(image, np.array([[-1.0, 0.0], [0.0, 1.0]]), (1.0, 2.0)))


@register("minimum_of_curves", """SELECT s_suppkey, round((s_suppkey % 64) / 8.0, 4)::DOUBLE AS x FROM supplier""")
def minimum_of_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a quartic about each supplier's number is least: bracketed from 0, then minimised."""
    ship_package(spark)

    @F.arrow_udf("double")
    def least(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for a in batch.to_pylist():
                f = lambda x: (x - a) ** 2 + 0.1 * (x - a) ** 4  # noqa: E731, B023
                out.append(numerics.minimise(f, *numerics.bracket(f, 0.0, 0.5))[0])
            yield pa.array(out, pa.float64())

    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey", least((F.col("s_suppkey") % 64) / 8.0).alias("x")), "x", places=4)


@register("beta_convergence", """SELECT * FROM (VALUES (1, false), (2, true), (3, false), (4, false)) AS t(i, done)""")
def beta_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [[5.0, 4.0, 3.0], [1.0, 1.0001, 1.00011], [1.0, 2.0, 2.0], [1.0, 1.0001]]
    return spark.createDataFrame([(i + 1, numerics.converged(c, 1e-3)) for i, c in enumerate(cases)], "i int, done boolean")


@register("grid_peak_search", """SELECT n_nationkey::BIGINT AS n, (n_nationkey * 3 + 5)::BIGINT AS x, (60 - n_nationkey * 2)::BIGINT AS y FROM nation""")
def grid_peak_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())
    found = [(k, *numerics.grid_peak(lambda c, k=k: -abs(c[0] - (3 * k + 5)) - abs(c[1] - (60 - 2 * k)), [(0, 100), (0, 64)])[0]) for k in keys]
    return spark.createDataFrame(found, "n long, x long, y long")


@register("clear_peaks", """WITH d AS (SELECT user_id, event_id, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) AS peaks FROM d WHERE value > b AND value >= a AND value >= 300 GROUP BY 1""")
def clear_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)

    def counted(keys: tuple, rows: pa.Table) -> pa.Table:
        y = rows.sort_by("event_id").column("value").to_numpy()
        return pa.table({"user_id": [keys[0].as_py()], "peaks": [len(numerics.clear_peaks(y, 300.0))]})

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return rows.groupBy("user_id").applyInArrow(counted, "user_id long, peaks long").where("peaks > 0")


@register("turned_axes", """SELECT p_partkey, round(cos(a), 6) + 0.0 AS x, round(sin(a), 6) + 0.0 AS y FROM (SELECT p_partkey, radians(p_partkey % 360) AS a FROM part)""")
def turned_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The x axis turned about z, for every part."""
    ship_package(spark)

    @F.arrow_udf("struct<x:double,y:double>")
    def turned(batch: pa.Array) -> pa.Array:
        ends = [sampling.axis_rotation(np.array([0, 0, 2.0]), d) @ np.array([1.0, 0, 0]) for d in batch.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([float(e[0]) for e in ends]), pa.array([float(e[1]) for e in ends])], ["x", "y"])

    found = table(spark, sf_dir, "part").select("p_partkey", turned((F.col("p_partkey") % 360).cast("double")).alias("e"))
    return rounded(found.select("p_partkey", "e.x", "e.y").withColumnsRenamed({"x": "ex", "y": "ey"}), "ex", "ey").withColumnsRenamed({"ex": "x", "ey": "y"})


@register("aligned_axes", """SELECT p_partkey, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 1.0::DOUBLE AS w FROM part""")
def aligned_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions made from parts, each taken to z by its rotation."""
    ship_package(spark)

    @F.arrow_udf("array<double>")
    def aligned(batch: pa.Array) -> pa.Array:
        axes = [np.array([k % 7 - 3.0, k % 5 - 1.0, k % 11 + 0.5]) for k in batch.to_pylist()]
        return pa.array([(numerics.align_with_z(a) @ (a / np.linalg.norm(a))).tolist() for a in axes], pa.list_(pa.float64()))

    found = table(spark, sf_dir, "part").select("p_partkey", aligned("p_partkey").alias("e"))
    return rounded(found.select("p_partkey", F.get("e", F.lit(0)).alias("u"), F.get("e", F.lit(1)).alias("v"), F.get("e", F.lit(2)).alias("w")), "u", "v", "w")


@register("group_orders", """SELECT * FROM (VALUES ('C1', 1), ('C7', 7), ('D3', 6), ('T', 12), ('O', 24), ('I', 60), ('CI', 2), ('CS', 2), ('C4V', 8), ('C3H', 6), ('S4', 4), ('D3V', 12), ('D2H', 8), ('TD', 24), ('TH', 24), ('OH', 48), ('IH', 120)) AS t(name, operations)""")
def group_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "C1 C7 D3 T O I CI CS C4V C3H S4 D3V D2H TD TH OH IH".split()
    return spark.createDataFrame([(g, len(sampling.point_group(g))) for g in names], "name string, operations int")


@register("steering_directions", """SELECT 16::BIGINT AS n, 16.0::DOUBLE AS squares""")
def steering_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = local_resolution.steering()
    return spark.createDataFrame([(len(v), round(float((v**2).sum()), 6))], "n long, squares double")


@register("perturbed_angles", """SELECT s_suppkey, round(a + 2.5 - floor((a + 2.5) / 5) * 5 - 2.5, 6) + 0.0 AS angle FROM (SELECT s_suppkey, s_acctbal + (s_suppkey % 21 - 10) / 10.0::DOUBLE * 2.5 AS a FROM supplier)""")
def perturbed_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = (F.col("s_suppkey") % 21 - 10) / 10.0
    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey", physics.perturbed(F.col("s_acctbal"), 10.0, draw, 1).alias("angle")), "angle")


@register("oversampled_psi", """SELECT i, round(i * 36.0 - 18 + (a + 0.5) * 9, 6)::DOUBLE AS over_psi FROM (SELECT unnest(range(10)) AS i), (SELECT unnest(range(4)) AS a)""")
def oversampled_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.oversampled(sampling.psi_angles(spark, 36.0), {"psi": 36.0}, 2).select("i", "over_psi"), "over_psi")


@register("unit_of_symmetry", f"""WITH {RINGS} SELECT count(*) FILTER (WHERE abs(r) <= 36) AS c5, count(*) FILTER (WHERE abs(r) <= 36 AND z >= -1e-12) AS c5h FROM (SELECT z, rot - ceil((rot - 180) / 360) * 360 AS r FROM centres)""")
def unit_of_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = healpix.directions(spark, 3).withColumn("tilt", F.round("tilt", 9))
    counts = [F.lit(g).alias("g") for g in ("C", "CH")]
    one, both = (sampling.asymmetric_unit(grid, g, 5).agg(F.count("*").alias("n")).withColumn("g", c) for g, c in zip(("C", "CH"), counts))
    return one.unionByName(both).agg(F.max(F.when(F.col("g") == "C", F.col("n"))).alias("c5"), F.max(F.when(F.col("g") == "CH", F.col("n"))).alias("c5h"))


@register("directions_near_prior", f"""WITH {RINGS}, p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 360)::DOUBLE AS prot, (s_suppkey * 13 % 171 + 4.5)::DOUBLE AS ptilt FROM supplier),
d AS (SELECT id, degrees(acos(greatest(-1, least(1, z * cos(radians(ptilt)) + sqrt(greatest(0, 1 - z * z)) * sin(radians(ptilt)) * cos(radians(rot - prot)))))) AS a FROM p, centres),
k AS (SELECT id, a, exp(-a * a / 32) AS w FROM d WHERE a <= 12)
SELECT id, count(*) AS near, round(max(w) / sum(w), 5) AS largest FROM k GROUP BY 1""")
def directions_near_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    priors = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey * 37 % 360 as double) as prior_rot", "cast(s_suppkey * 13 % 171 + 4.5 as double) as prior_tilt")
    return sampling.near_prior(priors, 3, 4.0).groupBy("id").agg(F.count("*").alias("near"), F.round(F.max("weight"), 5).alias("largest"))


@register("grid_numerics", """SELECT i, i // 12 AS z, (i // 4) % 3 AS y, i % 4 AS x, round(-1 + i * 2.0 / 23, 6)::DOUBLE AS place, (i // 6) * (i % 6) AS product FROM (SELECT unnest(range(24)) AS i)""")
def grid_numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a grid from flat numbers, evenly spaced values and an outer product, as expressions on a sequence."""
    i = F.col("id")
    found = spark.range(24).select(i.alias("i"), F.floor(i / 12).alias("z"), (F.floor(i / 4) % 3).alias("y"), (i % 4).alias("x"), (i * (2.0 / 23) - 1).alias("place"), (F.floor(i / 6) * (i % 6)).alias("product"))
    return rounded(found, "place")


@register("dot_and_norm", f"""WITH {PX}, r AS (SELECT p, v AS r FROM px WHERE vec_id = (SELECT min(vec_id) FROM px)) SELECT vec_id, round(sum(v * r), 6) + 0.0 AS dot, round(sqrt(sum((v - r) * (v - r))), 6) AS distance, round(sum(CASE WHEN x = y THEN v ELSE 0 END), 6) + 0.0 AS trace FROM px JOIN r USING (p) GROUP BY 1""")
def dot_and_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with the first image, distances from it and traces, on arrays."""
    rows = images(spark, sf_dir)
    first = rows.agg(F.min_by("pixels", "vec_id").alias("r"))  # one row
    met = rows.crossJoin(F.broadcast(first))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    found = met.select(
        "vec_id",
        total(F.zip_with("pixels", "r", lambda a, b: a * b)).alias("dot"),
        F.sqrt(total(F.zip_with("pixels", "r", lambda a, b: (a - b) * (a - b)))).alias("distance"),
        total(F.transform(F.sequence(F.lit(0), F.lit(63), F.lit(9)), lambda i: F.get("pixels", i))).alias("trace"),
    )
    return rounded(found, "dot", "distance", "trace")


@register("noise_masked")
def noise_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose surroundings are noise that their number fixes; the drawn numbers have no SQL."""
    ship_package(spark)

    @F.arrow_udf("array<double>")
    def masked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pixels, ids in batches:
            rows = zip(pixels.to_pylist(), ids.to_pylist())
            yield pa.array([kernels.noise_mask(np.reshape(x, (8, 8)), 2.0, 1.0, np.full(5, 1e-4), 33 + i).ravel().tolist() for x, i in rows], pa.list_(pa.float64()))

    return images(spark, sf_dir).select("vec_id", masked("pixels", "vec_id").alias("pixels"))


@register("local_resolution")
def local_resolution_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution of each voxel of a small cube: iterated tests without SQL; the test against whole windows is in the tests."""
    volume = volume_of(spark, sf_dir)
    found = local_resolution.local_resolution(spark, volume, np.ones(volume.shape, bool), 1.0, 2.5, 3.5, 1.0)
    return long_volume(spark, found)


@register("pre_whitened")
def pre_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small cube divided by its fitted background spectrum, and whether a low-pass filter shows."""
    volume = volume_of(spark, sf_dir)
    mask = kernels.solvent_flatten(np.ones(volume.shape), 2.0, 0.0) > 0.5
    factor = local_resolution.low_pass_factor(local_resolution.spherical_spectrum(volume))
    return long_volume(spark, local_resolution.pre_whiten(volume, mask)).withColumn("low_pass", F.lit(float(factor)))

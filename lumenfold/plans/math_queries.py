"""Queries on scalar functions, grids, statistics and GTM steps, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import physics
from lumenfold.operators import em, healpix, sampling, statistics
from lumenfold.plans.image_queries import PX, REF, diffs, rounded
from lumenfold.plans.registry import register
from lumenfold.sources.tables import images, pixels, table

ANGLES = "SELECT DISTINCT CAST(l_partkey % 360 - 180 AS DOUBLE) AS rot, CAST(l_suppkey % 171 + 5 AS DOUBLE) AS tilt, CAST(l_linenumber * 40 AS DOUBLE) AS psi FROM lineitem"


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.selectExpr("cast(l_partkey % 360 - 180 as double) as rot", "cast(l_suppkey % 171 + 5 as double) as tilt", "cast(l_linenumber * 40 as double) as psi").distinct()


def euler() -> list[Column]:
    return [F.col("rot"), F.col("tilt"), F.col("psi")]


@register("euler_matrix", f"""WITH a AS ({ANGLES}), t AS (SELECT rot, tilt, psi, cos(radians(rot)) AS ca, sin(radians(rot)) AS sa, cos(radians(tilt)) AS cb, sin(radians(tilt)) AS sb, cos(radians(psi)) AS cg, sin(radians(psi)) AS sg FROM a)
SELECT rot, tilt, psi, round(cg * cb * ca - sg * sa, 6) + 0.0 AS m11, round(-sg * cb * sa + cg * ca, 6) + 0.0 AS m22, round(sb * ca, 6) + 0.0 AS m31, round(-cg * sb, 6) + 0.0 AS m13, round(cb, 6) + 0.0 AS m33 FROM t""")
def euler_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = physics.euler_matrix(*euler())
    found = angles(spark, sf_dir).select("rot", "tilt", "psi", m[0].alias("m11"), m[4].alias("m22"), m[6].alias("m31"), m[2].alias("m13"), m[8].alias("m33"))
    return rounded(found, "m11", "m22", "m31", "m13", "m33")


@register("euler_roundtrip", f"""SELECT rot, tilt, psi, round(sin(radians(rot)), 5) + 0.0 AS rot_back, tilt AS tilt_back, round(cos(radians(psi)), 5) + 0.0 AS psi_back FROM ({ANGLES})""")
def euler_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rot, tilt, psi = physics.euler_angles(physics.euler_matrix(*euler()))
    found = angles(spark, sf_dir).select("rot", "tilt", "psi", F.sin(F.radians(rot)).alias("rot_back"), tilt.alias("tilt_back"), F.cos(F.radians(psi)).alias("psi_back"))
    return rounded(found, "rot_back", "tilt_back", "psi_back", places=5)


@register("direction_vector", f"""SELECT rot, tilt, psi, round(cos(radians(rot)) * sin(radians(tilt)), 6) + 0.0 AS dx, round(sin(radians(rot)) * sin(radians(tilt)), 6) + 0.0 AS dy, round(cos(radians(tilt)), 6) + 0.0 AS dz FROM ({ANGLES})""")
def direction_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = physics.direction(F.col("rot"), F.col("tilt"))
    return rounded(angles(spark, sf_dir).select("rot", "tilt", "psi", v[0].alias("dx"), v[1].alias("dy"), v[2].alias("dz")), "dx", "dy", "dz")


@register("angular_distance", f"""WITH a AS ({ANGLES}), t AS (SELECT rot, tilt, psi, cos(radians(rot)) AS ca, sin(radians(rot)) AS sa, cos(radians(tilt)) AS cb, sin(radians(tilt)) AS sb, cos(radians(psi)) AS cg, sin(radians(psi)) AS sg FROM a)
SELECT rot, tilt, psi, round((degrees(acos(greatest(-1, least(1, cg * cb * ca - sg * sa)))) + degrees(acos(greatest(-1, least(1, -sg * cb * sa + cg * ca)))) + degrees(acos(greatest(-1, least(1, cb))))) / 3, 5) AS distance FROM t""")
def angular_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = physics.euler_matrix(*euler())
    none = [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]
    return rounded(angles(spark, sf_dir).select("rot", "tilt", "psi", physics.axis_distance(here, none).alias("distance")), "distance", places=5)


@register("angular_distance_2d", """SELECT DISTINCT l_partkey % 720 AS psi, CAST(least((l_partkey % 720 + 40) % 360, 360 - (l_partkey % 720 + 40) % 360) AS DOUBLE) AS distance FROM lineitem""")
def angular_distance_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = physics.wrap((F.col("psi") + 40).cast("double"), 0.0, 360.0)
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 720).alias("psi")).distinct()
    return rows.select("psi", F.least(gap, 360 - gap).alias("distance"))


@register("real_wrap", """SELECT s_suppkey, round(s_acctbal - floor((s_acctbal + 180) / 360) * 360, 6) AS wrapped FROM supplier""")
def real_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey", physics.wrap(F.col("s_acctbal"), -180.0, 180.0).alias("wrapped")), "wrapped")


@register("sign_function", """SELECT s_suppkey, CASE WHEN s_acctbal - 5000 < 0 THEN -1 ELSE 1 END AS sgn FROM supplier""")
def sign_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", physics.sign(F.col("s_acctbal") - 5000).alias("sgn"))


@register("resolution_shell", """SELECT i AS shell, round(CASE WHEN i > 0 THEN 4.0 * 160 / i ELSE 999 END, 6) AS resolution FROM (SELECT unnest(range(40)) AS i)""")
def resolution_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.range(40).select(F.col("id").alias("shell"), physics.resolution_of_shell(F.col("id"), 4.0, 160).alias("resolution")), "resolution")


@register("image_sizes", """SELECT i AS maxres, least(160, 2 * (i + 10)) AS current_size, least(160, 2 * CAST(ceil(4.0 * 160 / (10.0 / 360 * pi() * 300 / 1.5)) AS BIGINT), 2 * (i + 10)) AS coarse_size FROM (SELECT unnest(range(0, 100, 5)) AS i)""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = F.least(F.lit(160), 2 * (F.col("id") + 10)).cast("long")
    coarse = F.lit(2) * F.ceil(F.lit(4.0 * 160) / (F.lit(10.0 / 360 * 300 / 1.5) * F.pi()))
    return spark.range(0, 100, 5).select(F.col("id").alias("maxres"), current.alias("current_size"), F.least(F.lit(160), coarse, current).cast("long").alias("coarse_size"))


@register("gaussian_pdf", """SELECT i, round(exp(-(i - 10.0) * (i - 10) / 18) / (3 * sqrt(2 * pi())) * 1000, 6) AS pdf FROM (SELECT unnest(range(20)) AS i)""")
def gaussian_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.range(20).select(F.col("id").alias("i"), (physics.gaussian(F.col("id"), 10.0, 3.0) * 1000).alias("pdf")), "pdf")


@register("offset_pdf", """SELECT s_suppkey, round(1000 * CASE WHEN s2 < 1e-4 THEN CASE WHEN x * x + 1 > 0 THEN 0 ELSE 1 END ELSE exp(-(x * x + 1) / (2 * s2)) / (2 * pi() * s2) END, 6) + 0.0 AS pdf
FROM (SELECT s_suppkey, s_acctbal / 5000 - 1 AS x, (s_suppkey % 5) * 0.5 AS s2 FROM supplier)""")
def offset_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, s2 = F.col("s_acctbal") / 5000 - 1, (F.col("s_suppkey") % 5) * 0.5
    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey", (1000 * physics.offset_pdf(x, F.lit(1.0), s2)).alias("pdf")), "pdf")


@register("sinc_correction", """SELECT i, round(CASE WHEN i = 0 THEN 1 ELSE power(sin(pi() * i / 16) / (pi() * i / 16), 2) END, 6) + 0.0 AS w FROM (SELECT unnest(range(16)) AS i)""")
def sinc_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.range(16).select(F.col("id").alias("i"), F.pow(physics.sinc(F.col("id") / 16), 2).alias("w")), "w")


@register("hamming_window", """SELECT i, j, k, round(a * a * b * c, 6) AS w FROM (SELECT i, j, k, 0.54 - 0.46 * cos(2 * pi() * i / 5) AS a, 0.54 - 0.46 * cos(2 * pi() * j / 5) AS b, 0.54 - 0.46 * cos(2 * pi() * k / 5) AS c
FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(6)) AS j), (SELECT unnest(range(6)) AS k))""")
def hamming_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = spark.range(216).selectExpr("id div 36 as i", "(id div 6) % 6 as j", "id % 6 as k")
    h = lambda c: physics.hamming(F.col(c), 6)
    return rounded(cube.select("i", "j", "k", (h("i") * h("i") * h("j") * h("k")).alias("w")), "w")


@register("ricker_wavelet", """SELECT i, round(2 / (sqrt(9.0) * power(pi(), 0.25)) * (1 - t * t / 9) * exp(-t * t / 18), 6) + 0.0 AS w FROM (SELECT i, i - 10.0 AS t FROM (SELECT unnest(range(21)) AS i))""")
def ricker_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.range(21).select(F.col("id").alias("i"), physics.ricker(F.col("id") - 10.0, 3.0).alias("w")), "w")


@register("half_away_rounding", """SELECT i, CAST(sign(i) * floor(abs(i) / 2.0 + 0.5) AS BIGINT) AS half FROM (SELECT unnest(range(-9, 10)) AS i)""")
def half_away_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(-9, 10).select(F.col("id").alias("i"), physics.half_away(F.col("id") / 2).cast("long").alias("half"))


@register("translation_disc", """SELECT i * 2.0::DOUBLE AS x, j * 2.0::DOUBLE AS y FROM (SELECT unnest(range(-5, 6)) AS i), (SELECT unnest(range(-5, 6)) AS j) WHERE 4 * (i * i + j * j) <= 100""")
def translation_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.translations(spark, 10, 2)


@register("psi_grid", """SELECT i, round(i * 360.0 / 52, 6) AS psi FROM (SELECT unnest(range(52)) AS i)""")
def psi_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.psi_angles(spark, 7.0), "psi")


@register("oversampled_translations", """SELECT i * 2.0::DOUBLE AS x, j * 2.0::DOUBLE AS y, i * 2.0 - 1 + (a + 0.5) AS over_x, j * 2.0 - 1 + (b + 0.5) AS over_y FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j), (SELECT unnest(range(2)) AS a), (SELECT unnest(range(2)) AS b) WHERE 4 * (i * i + j * j) <= 16""")
def oversampled_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = sampling.oversampled(sampling.translations(spark, 4, 2), {"x": 2.0, "y": 2.0}, 1)
    return fine.select("x", "y", "over_x", "over_y")


@register("sampling_counts", """SELECT 192::BIGINT AS directions, 36::BIGINT AS psi, (SELECT count(*) FROM (SELECT unnest(range(-5, 6)) AS i), (SELECT unnest(range(-5, 6)) AS j) WHERE 4 * (i * i + j * j) <= 100) AS translations""")
def sampling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sampling.sampling_counts(10, 10, 2, 2, 0)
    return spark.range(1).select(*(F.lit(counts[k]).cast("long").alias(k) for k in ("directions", "psi", "translations")))


RINGS = """ring AS (SELECT i, least(i, 32 - i, 8) AS c, i < 8 OR i > 24 AS polar FROM (SELECT unnest(range(1, 32)) AS i)),
cells AS (SELECT i, c, polar, unnest(range(4 * c)) AS j FROM ring),
centres AS (SELECT (row_number() OVER (ORDER BY i, j) - 1)::BIGINT AS ring_pixel, CASE WHEN i < 8 THEN 1 - i * i / 192.0 WHEN i > 24 THEN (32 - i) * (32 - i) / 192.0 - 1 ELSE 4 / 3.0 - i / 12.0 END AS z,
  90.0 / c * (j + CASE WHEN polar OR (i - 8) % 2 = 0 THEN 0.5 ELSE 0 END) AS rot FROM cells)"""


@register("healpix_centres", f"""WITH {RINGS} SELECT ring_pixel, round(z, 6) + 0.0 AS z, round(rot, 6) AS rot FROM centres""")
def healpix_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of all 768 pixels of order 3, made in nested order and renumbered along the rings."""
    found = healpix.with_ring(healpix.directions(spark, 3), "pixel", 3)
    return rounded(found.select("ring_pixel", F.cos(F.radians("tilt")).alias("z"), "rot"), "z", "rot")


CELLS = """dirs AS (SELECT DISTINCT l_partkey % 360 + 0.3 AS rot, l_suppkey % 171 + 5.2 AS tilt FROM lineitem),
flat AS (SELECT rot, tilt, cos(radians(tilt)) AS z, rot / 45 AS turn FROM dirs),
plane AS (SELECT rot, tilt, CASE WHEN abs(z) > 2 / 3.0 THEN m + (turn - m) * s ELSE turn END AS t, CASE WHEN abs(z) > 2 / 3.0 THEN sign(z) * (2 - s) ELSE 1.5 * z END AS w
  FROM (SELECT *, sqrt(3 * (1 - abs(z))) AS s, 2 * floor(turn / 2) + 1 AS m FROM flat)),
faces AS (SELECT f, CASE WHEN f // 4 = 1 THEN 2 * (f % 4) ELSE 2 * (f % 4) + 1 END AS tc, 1 - f // 4 AS wc FROM (SELECT unnest(range(12)) AS f)),
inside AS (SELECT rot, tilt, f, (dt + w - wc) / 2 + 0.5 AS u, (w - wc - dt) / 2 + 0.5 AS v FROM (SELECT *, (t - tc + 12) - 8 * floor((t - tc + 12) / 8) - 4 AS dt FROM plane, faces)),
cell AS (SELECT rot, tilt, f, CAST(floor(u * 16) AS BIGINT) AS x, CAST(floor(v * 16) AS BIGINT) AS y FROM inside WHERE u >= 0 AND u < 1 AND v >= 0 AND v < 1)"""


@register("healpix_pixel_of_direction", f"""WITH {CELLS} SELECT rot::DOUBLE AS rot, tilt::DOUBLE AS tilt, f * 256 + list_sum([(x >> b & 1) * power(4, b) + (y >> b & 1) * 2 * power(4, b) FOR b IN [0, 1, 2, 3]])::BIGINT AS pixel FROM cell""")
def healpix_pixel_of_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested pixel of order 4 that holds each direction."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey % 360 + 0.3 as double) as rot", "cast(l_suppkey % 171 + 5.2 as double) as tilt").distinct()
    return healpix.with_pixel(rows, "rot", "tilt", 4)


@register("healpix_moments", """SELECT 192::BIGINT AS n, 0.0::DOUBLE AS mean_z, round(1 / 3.0, 2)::DOUBLE AS mean_z2""")
def healpix_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.cos(F.radians("tilt"))
    return healpix.directions(spark, 2).agg(F.count("*").alias("n"), (F.round(F.avg(z), 6) + F.lit(0.0)).alias("mean_z"), F.round(F.avg(z * z), 2).alias("mean_z2"))


@register("gtm_grid_2d", """SELECT i + 5 * j AS node, (i + 1)::DOUBLE AS x1, (j + 1)::DOUBLE AS x2 FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j)""")
def gtm_grid_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.latent_grid(spark, 5, 2)


@register("gtm_basis_1d", """WITH c AS (SELECT 10 AS k, 8 AS m), w AS (SELECT (k * m / (m - 1.0) - m / (m - 1.0)) / (m - 1.0) AS w, m / (m - 1.0) AS c0 FROM c)
SELECT n AS node, m, round(CASE WHEN m = 8 THEN 1 ELSE exp(-power(n + 1 - (c0 + m * w), 2) / (2 * w * w)) END, 6) AS phi FROM (SELECT unnest(range(10)) AS n), (SELECT unnest(range(9)) AS m), w""")
def gtm_basis_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.basis_1d(sampling.latent_grid(spark, 10, 1), 10), "phi")


@register("gtm_delta", f"WITH {REF} SELECT class_no AS node, vec_id, round(2 * diff2 / 64, 6) AS delta FROM d")
def gtm_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diffs(spark, sf_dir).select(F.col("class_no").alias("node"), "vec_id", (F.col("diff2") / 32).alias("delta")), "delta")


@register("gtm_row_shift", f"WITH {REF} SELECT vec_id, round(least((max(diff2) + min(diff2)) / 2, min(diff2) + 700), 6) AS shift FROM d GROUP BY 1")
def gtm_row_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(em.row_shift(diffs(spark, sf_dir)), "shift")


@register("gtm_beta", f"""WITH {REF} SELECT round((SELECT count(DISTINCT vec_id) FROM post) * 64.0 / sum(p * 2 * diff2 / 64), 4) AS beta FROM post""")
def gtm_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = em.posterior(diffs(spark, sf_dir))
    return post.agg(F.round(F.sum("p") * 64.0 / F.sum(F.col("p") * F.col("diff2") / 32), 4).alias("beta"))


@register("gtm_alpha", f"""WITH {PX}, w AS (SELECT label, p, avg(v) AS w FROM px GROUP BY ALL) SELECT round(count(*) / sum(w * w), 4) AS alpha FROM w""")
def gtm_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = pixels(spark, sf_dir).groupBy("label", "p").agg(F.avg("v").alias("w"))
    return weights.agg(F.round(F.count("*") / F.sum(F.col("w") * F.col("w")), 4).alias("alpha"))


@register("covariance", f"""WITH {PX} SELECT a.p AS i, b.p AS j, round(1000 * (avg(a.v * b.v) - avg(a.v) * avg(b.v)), 6) + 0.0 AS cov FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.p <= b.p GROUP BY ALL""")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.covariance(images(spark, sf_dir))
    return rounded(found.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.col("cov") * 1000).alias("cov")), "cov")


@register("column_stats", f"""WITH {PX} SELECT p, round(1000 * avg(v), 5) + 0.0 AS mean, round(1000 * stddev_pop(v), 5) AS std, round(1000 * min(v), 5) AS least FROM px GROUP BY 1""")
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.columns(images(spark, sf_dir))
    scaled = found.select(F.col("p").cast("long").alias("p"), *((F.col(c) * 1000).alias(c) for c in ("mean", "std", "least")))
    return rounded(scaled, "mean", "std", "least", places=5)


@register("pairwise_distance", """SELECT a.vec_id, b.vec_id AS ref_id, round(sum(power(a.v::DOUBLE - b.v, 2)), 6) AS distance2 FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS p FROM embeddings) a
JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS p FROM embeddings WHERE vec_id < 16) b ON a.p = b.p GROUP BY ALL""")
def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).select("vec_id", "pixels")
    found = statistics.distances(rows, rows.where("vec_id < 16").withColumnRenamed("vec_id", "ref_id"), "vec_id", "ref_id")
    return rounded(found, "distance2")


@register("local_maxima", """WITH d AS (SELECT user_id, event_id, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id FROM d WHERE coalesce(value > b, true) AND coalesce(value > a, true)""")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.local_maxima(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id")


@register("first_difference", """SELECT * FROM (SELECT user_id, event_id, round(lead(value) OVER (PARTITION BY user_id ORDER BY event_id) - value, 6) + 0.0 AS difference FROM events) WHERE difference IS NOT NULL""")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.first_difference(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "difference"), "difference")


@register("fdr_step_up", """WITH p AS (SELECT user_id, event_id, value / 500 * (event_id % 7) / 6 AS p FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM p)
SELECT user_id, round(max(p) FILTER (WHERE p <= 0.2 * k / n), 6) AS threshold, coalesce(max(k) FILTER (WHERE p <= 0.2 * k / n), 0) AS rejected FROM k GROUP BY 1""")
def fdr_step_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "value / 500 * (event_id % 7) / 6 as p")
    return rounded(statistics.step_up(rows, "user_id", "p", "event_id", 0.2), "threshold")


@register("quantile_linear", """SELECT user_id, round(quantile_cont(value, 0.1), 6) AS quantile FROM events GROUP BY 1""")
def quantile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.quantile(table(spark, sf_dir, "events"), "user_id", "value", 0.1), "quantile")


@register("resolution_histogram", """SELECT CAST(floor(value / 50) AS BIGINT) AS step, count(*) AS resolved FROM events GROUP BY 1""")
def resolution_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("value") / 50).alias("step")).agg(F.count("*").alias("resolved"))


@register("masked_mean_resolution", """SELECT round(avg(value) FILTER (WHERE event_type = 'click' AND value < 100), 6) AS mean FROM events""")
def masked_mean_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.round(F.avg(F.when((F.col("event_type") == "click") & (F.col("value") < 100), F.col("value"))), 6).alias("mean"))


@register("nearest_prior_directions", f"""WITH a AS (SELECT DISTINCT rot, tilt FROM ({ANGLES}) WHERE tilt < 60), g AS (SELECT (i * 30 - 180)::DOUBLE AS grot, (j * 20 + 5)::DOUBLE AS gtilt FROM (SELECT unnest(range(12)) AS i), (SELECT unnest(range(9)) AS j)),
d AS (SELECT rot, tilt, grot, gtilt, degrees(acos(greatest(-1, least(1, cos(radians(tilt)) * cos(radians(gtilt)) + sin(radians(tilt)) * sin(radians(gtilt)) * cos(radians(rot - grot)))))) AS a FROM a, g)
SELECT rot, tilt, count(*) FILTER (WHERE a <= 30) AS near, round(min(a), 4) AS least FROM d GROUP BY ALL""")
def nearest_prior_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = angles(spark, sf_dir).where("tilt < 60").select("rot", "tilt").distinct()
    # a fixed grid of 108 directions: an expression on the row, no join
    dots = F.expr(
        "transform(sequence(0, 107), i -> cos(radians(tilt)) * cos(radians(i % 9 * 20 + 5))"
        " + sin(radians(tilt)) * sin(radians(i % 9 * 20 + 5)) * cos(radians(rot - (i div 9 * 30 - 180))))"
    )
    angle = lambda dot: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    met = rows.select("rot", "tilt", F.transform(dots, angle).alias("a"))
    return met.select("rot", "tilt", F.size(F.filter("a", lambda a: a <= 30)).cast("long").alias("near"), F.round(F.array_min("a"), 4).alias("least"))


@register("symmetric_distance", f"""WITH a AS (SELECT DISTINCT psi + rot AS psi FROM ({ANGLES})), s AS (SELECT unnest(range(4)) * 90 AS turn)
SELECT psi, min(least((psi + turn) - floor((psi + turn) / 360) * 360, 360 - ((psi + turn) - floor((psi + turn) / 360) * 360))) AS distance FROM a, s GROUP BY 1""")
def symmetric_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = angles(spark, sf_dir).select((F.col("psi") + F.col("rot")).alias("psi")).distinct()
    # the operations of a group are few: their minimum is an expression on the row
    each = [physics.wrap(F.col("psi") + turn, 0.0, 360.0) for turn in (0, 90, 180, 270)]
    return rows.select("psi", F.least(*[F.least(g, 360 - g) for g in each]).alias("distance"))


@register("random_groups", """WITH m AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey * 7919 % 1009, s_suppkey) AS k, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, CAST(ceil(k / (n / 10.0)) AS BIGINT) AS group_no FROM m""")
def random_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.operators.particles import with_global_index

    drawn = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("s_suppkey * 7919 % 1009").alias("draw"))
    placed, total = with_global_index(drawn, ["draw", "s_suppkey"])
    return placed.select("s_suppkey", F.ceil((F.col("ord") + 1) / F.lit(total / 10.0)).alias("group_no"))


@register("data_vs_prior_gate", """SELECT event_type, CASE WHEN avg(value) / 60 > 3 THEN 'S' WHEN avg(value) / 60 > 1 THEN 'N' ELSE 'O' END AS flag FROM events GROUP BY 1""")
def data_vs_prior_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.avg("value") / 60
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.when(ratio > 3, "S").when(ratio > 1, "N").otherwise("O").alias("flag"))


@register("resolution_range", """SELECT event_id, CAST(floor(value / 50) AS BIGINT) AS ires FROM events WHERE floor(value / 50) > 0 AND floor(value / 50) < 8""")
def resolution_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") / 50).alias("ires")).where("ires > 0 and ires < 8")


@register("downsampled_average", f"""WITH {PX} SELECT label, CAST(round(y / 2.0) AS BIGINT) AS y, CAST(round(x / 2.0) AS BIGINT) AS x, round(sum(v * (1 + p % 3)) / sum(1 + p % 3), 6) + 0.0 AS v FROM px GROUP BY ALL""")
def downsampled_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = pixels(spark, sf_dir).select("label", physics.half_away(F.col("y") / 2).cast("long").alias("y"), physics.half_away(F.col("x") / 2).cast("long").alias("x"), "v", F.expr("1 + p % 3").alias("w"))
    return rounded(small.groupBy("label", "y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v")), "v")


@register("direction_of_vector", f"""SELECT rot, tilt, psi, round(tilt, 4) AS tilt_back, round(cos(radians(rot)), 5) + 0.0 AS rot_back FROM ({ANGLES})""")
def direction_of_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rot, tilt = physics.direction_angles(physics.direction(F.col("rot"), F.col("tilt")))
    found = angles(spark, sf_dir).select("rot", "tilt", "psi", F.round(tilt, 4).alias("tilt_back"), F.cos(F.radians(rot)).alias("rot_back"))
    return rounded(found, "rot_back", places=5)


@register("column_minimum_mean", """SELECT round(min(value), 6) AS least, round(avg(value), 6) AS mean FROM events""")
def column_minimum_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.round(F.min("value"), 6).alias("least"), F.round(F.avg("value"), 6).alias("mean"))


@register("array_reductions", f"""WITH {PX} SELECT vec_id, round(min(v), 6) AS least, round(max(v), 6) AS most, round(sum(v), 5) + 0.0 AS total, round(sqrt(sum(v * v)), 6) AS norm, arg_max(p, v) AS place, bool_or(v > 0.3) AS any_high, count(*) FILTER (WHERE v > 0) AS positive FROM px GROUP BY 1""")
def array_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("pixels")
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    found = images(spark, sf_dir).select(
        "vec_id", F.round(F.array_min(a), 6).alias("least"), F.round(F.array_max(a), 6).alias("most"), (F.round(total, 5) + F.lit(0.0)).alias("total"),
        F.round(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), (F.array_position(a, F.array_max(a)) - 1).alias("place"),
        F.exists(a, lambda x: x > 0.3).alias("any_high"), F.size(F.filter(a, lambda x: x > 0)).cast("long").alias("positive"),
    )
    return found

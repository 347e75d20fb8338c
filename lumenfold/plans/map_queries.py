"""One step of the estimators as queries, with the same sums in SQL; the estimators call the same code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import estimators, map_em
from lumenfold.plans.image_queries import DFT, PX, rounded
from lumenfold.plans.registry import register
from lumenfold.sources.tables import SIDE, images, pixels

STEP = f"""{DFT}, used AS (SELECT vec_id, label, kx, ky, shell, re, im, vec_id % 3 AS g, (0.75 + 0.25 * cos((kx * kx + ky * ky) * (1 + vec_id % 4) / 8.0)) * (0.8 + 0.1 * (vec_id % 3)) AS c FROM ft WHERE shell <= 4 AND NOT (kx = 0 AND ky < 0)),
s2 AS (SELECT g, shell, avg(re * re + im * im) / 2 AS s2 FROM used GROUP BY ALL),
ref AS (SELECT label AS k, kx, ky, avg(re) AS ar, avg(im) AS ai FROM used WHERE vec_id % 2 = 0 GROUP BY ALL),
d AS (SELECT vec_id, k, sum(((re - c * ar) * (re - c * ar) + (im - c * ai) * (im - c * ai)) / (2 * s2)) AS d2 FROM used JOIN s2 USING (g, shell) JOIN ref USING (kx, ky) GROUP BY ALL),
e AS (SELECT *, exp(min(d2) OVER (PARTITION BY vec_id) - d2) AS e FROM d),
w AS (SELECT vec_id, k, d2, e, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM e)"""


def step_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a group and the contrast transfer of each Fourier pixel."""
    n = SIDE
    kx = f"(i % {n // 2 + 1})"
    ky = f"if(i div {n // 2 + 1} > {n // 2}, i div {n // 2 + 1} - {n}, i div {n // 2 + 1})"
    transfer = F.expr(f"transform(sequence(0, {n * (n // 2 + 1) - 1}), i -> 0.75d + 0.25d * cos(({kx} * {kx} + ({ky}) * ({ky})) * (1 + vec_id % 4) / 8d))")
    return images(spark, sf_dir).withColumns({"g": F.col("vec_id") % 3, "ctf": transfer})


def step_model(spark: SparkSession, sf_dir: str) -> map_em.MapModel:
    """Class means of the even half, each group's mean power and fixed scales."""
    plane = map_em.Plane(SIDE)
    means = pixels(spark, sf_dir).where("vec_id % 2 = 0").groupBy("label", "p").agg(F.avg("v").alias("v")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("a")).orderBy("label").collect()
    references = plane.transform(np.array([[x["v"] for x in r["a"]] for r in means]))
    power = estimators.statistics(images(spark, sf_dir).withColumn("g", F.col("vec_id") % 3), ["pixels", "g"], lambda b, k: _power(plane, b), 3 * plane.shells + 3)
    counts = np.bincount(plane.shell, plane.used, plane.shells)
    sigma2 = power[: 3 * plane.shells].reshape(3, -1) / (2 * power[-3:, None] * counts)
    return map_em.MapModel(SIDE, references, np.full(len(references), 1 / len(references)), sigma2, np.array([0.8, 0.9, 1.0]), 1e30)


def _power(plane: map_em.Plane, batch: dict[str, np.ndarray]) -> np.ndarray:
    x, g = plane.transform(batch["pixels"]), batch["g"].astype(int)
    total, n = np.zeros((3, plane.shells)), np.zeros(3)
    np.add.at(total, (g[:, None], plane.shell[None]), np.abs(x) ** 2 * plane.used)
    np.add.at(n, g, 1)
    return np.append(total.ravel(), n)


def step(spark: SparkSession, sf_dir: str) -> tuple[map_em.MapModel, map_em.Sums]:
    model = step_model(spark, sf_dir)
    sums = map_em.expect(step_images(spark, sf_dir), model, [(0.0, 0.0, 0.0)], ctf="ctf", group="g")
    return map_em.maximise(model, sums, scale=True), sums


@register("map2d_step_references", f"""WITH {STEP} SELECT k AS class_no, kx, ky, round(1000 * sum(w * c * re / s2) / sum(w * c * c / s2), 5) + 0.0 AS re, round(1000 * sum(w * c * im / s2) / sum(w * c * c / s2), 5) + 0.0 AS im
FROM used JOIN s2 USING (g, shell) JOIN w USING (vec_id) GROUP BY ALL""")
def map2d_step_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class references after one round with transfer functions, groups and noise by shell."""
    model, _ = step(spark, sf_dir)
    plane = map_em.Plane(SIDE)
    rows = [(k, int(plane.kx[i]), int(plane.ky[i]), 1000 * float(r[i].real), 1000 * float(r[i].imag)) for k, r in enumerate(model.references) for i in np.flatnonzero(plane.used)]
    return rounded(spark.createDataFrame(rows, "class_no int, kx long, ky long, re double, im double"), "re", "im", places=5)


@register("map2d_step_noise", f"""WITH {STEP} SELECT g, shell, round(1e6 * sum(w * ((re - c * ar) * (re - c * ar) + (im - c * ai) * (im - c * ai))) / (2 * count(DISTINCT vec_id) * count(DISTINCT kx * 100 + ky)), 4) AS sigma2
FROM used JOIN ref USING (kx, ky) JOIN w ON w.vec_id = used.vec_id AND w.k = ref.k GROUP BY ALL""".replace("count(DISTINCT vec_id)", "count(DISTINCT used.vec_id)"))
def map2d_step_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise spectra by group after one round."""
    model, _ = step(spark, sf_dir)
    rows = [(g, s, 1e6 * float(v)) for g, one in enumerate(model.sigma2) for s, v in enumerate(one)]
    return rounded(spark.createDataFrame(rows, "g long, shell int, sigma2 double"), "sigma2", places=4)


@register("map2d_step_shares", f"""WITH {STEP}, l AS (SELECT vec_id, ln(sum(e)) - min(d2) - ln(10.0) AS l, max(w) AS pm FROM w GROUP BY 1), n AS (SELECT sum(-ln(2 * pi() * s2)) AS n FROM used JOIN s2 USING (g, shell))
SELECT k AS class_no, round(sum(w) / (SELECT count(*) FROM l), 6) AS share, round((SELECT sum(l) FROM l) + (SELECT n FROM n), 3) AS log_likelihood, round((SELECT avg(pm) FROM l), 6) AS mean_pmax FROM w GROUP BY 1""")
def map2d_step_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, sums = step(spark, sf_dir)
    rows = [(k, round(float(s), 6), round(sums.log_likelihood, 3), round(float(model.pmax[-1]), 6)) for k, s in enumerate(model.shares)]
    return spark.createDataFrame(rows, "class_no int, share double, log_likelihood double, mean_pmax double")


@register("map2d_step_scales", f"""WITH {STEP}, x AS (SELECT g, sum(w * c0 * (re * ar + im * ai) / s2) / sum(w * c0 * c0 * (ar * ar + ai * ai) / s2) AS s, count(DISTINCT vec_id) AS n
  FROM (SELECT used.*, c / (0.8 + 0.1 * g) AS c0, ar, ai, k AS rk FROM used JOIN ref USING (kx, ky)) u JOIN s2 USING (g, shell) JOIN w ON w.vec_id = u.vec_id AND w.k = u.rk GROUP BY g),
m AS (SELECT s AS m FROM x ORDER BY s LIMIT 1 OFFSET 1), c AS (SELECT g, n, least(greatest(s, m / 5), m * 5) AS s FROM x, m) SELECT g, round(s * (SELECT sum(n) FROM c) / (SELECT sum(s * n) FROM c), 5) AS scale FROM c""".replace("count(DISTINCT vec_id)", "count(DISTINCT u.vec_id)"))
def map2d_step_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group scales after one round, held within a fifth and five times their median."""
    model, _ = step(spark, sf_dir)
    return spark.createDataFrame([(g, round(float(s), 5)) for g, s in enumerate(model.scales)], "g long, scale double")


@register("cc_first_iteration", f"""WITH {PX}, ref AS (SELECT label AS k, p, avg(v) AS r FROM px WHERE vec_id % 2 = 0 GROUP BY ALL), s AS (SELECT vec_id, k, sum(v * r) / sqrt(sum(v * v) * sum(r * r)) AS cc FROM px JOIN ref USING (p) GROUP BY ALL)
SELECT vec_id, arg_max(k, cc) AS class_no, round(max(cc), 6) + 0.0 AS cc FROM s GROUP BY 1""")
def cc_first_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most correlated class mean of each image: one matrix product gives the products, norms are the arrays' own."""
    from lumenfold.operators import em
    from lumenfold.plans.image_queries import references

    names, matrix = em.reference_images(references(spark, sf_dir))
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    rows = images(spark, sf_dir)
    norm = F.sqrt(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x * x))
    # of vectors of length 1, half the squared distance is 1 less the correlation
    scaled = rows.select("vec_id", F.transform("pixels", lambda x: x / norm).alias("pixels"))
    found = em.squared_difference(scaled, (names, unit)).withColumn("cc", 1 - F.col("diff2"))
    best = found.groupBy("vec_id").agg(F.max_by("class_no", "cc").alias("class_no"), F.max("cc").alias("cc"))
    return rounded(best, "cc")


GTM = f"""{PX}, x AS (SELECT vec_id, p, v, 0.75 + 0.25 * cos(p * 0.3 + vec_id % 5) AS c FROM px), node AS (SELECT i AS k, (i + 1) / 4.0::DOUBLE AS f FROM (SELECT unnest(range(4)) AS i)),
y AS (SELECT k, p, 0.2 * f * cos(p::DOUBLE) + 0.1 * sin(p::DOUBLE) AS y FROM node, (SELECT unnest(range(64)) AS p)),
d AS (SELECT vec_id, k, sum((v - c * y) * (v - c * y)) AS d2 FROM x JOIN y USING (p) GROUP BY ALL), e AS (SELECT *, exp(10 * (min(d2) OVER (PARTITION BY vec_id) - d2)) AS e FROM d), r AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) AS r FROM e),
s AS (SELECT p, sum(r * c * c * f * f) + 0.01 / 20 AS a11, sum(r * c * c * f) AS a12, sum(r * c * c) AS a22, sum(r * c * v * f) AS b1, sum(r * c * v) AS b2 FROM x JOIN r USING (vec_id) JOIN node USING (k) GROUP BY 1),
w AS (SELECT p, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM s)"""


def gtm_step(spark: SparkSession, sf_dir: str) -> estimators.LatentMap:
    """One round over four nodes and two basis functions, with a factor for every pixel."""
    basis = np.column_stack([np.arange(1, 5) / 4, np.ones(4)])
    p = np.arange(64.0)
    weights = np.stack([0.2 * np.cos(p), 0.1 * np.sin(p)])
    start = estimators.LatentMap(basis, weights, 20.0, basis @ weights)
    rows = images(spark, sf_dir).withColumn("c", F.expr("transform(sequence(0, 63), p -> 0.75d + 0.25d * cos(p * 0.3d + vec_id % 5))"))
    return estimators.latent_step(rows, start, 0.01, ctf="c")


@register("gtm_step_weights", f"WITH {GTM} SELECT p::INTEGER AS p, round(w1, 6) + 0.0 AS w1, round(w2, 6) + 0.0 AS w2 FROM w")
def gtm_step_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the latent map after one round: a system of its own for every pixel."""
    model = gtm_step(spark, sf_dir)
    return rounded(spark.createDataFrame([(i, float(model.weights[0, i]), float(model.weights[1, i])) for i in range(64)], "p int, w1 double, w2 double"), "w1", "w2")


@register("gtm_step_beta", f"""WITH {GTM}, q AS (SELECT sum(r * (v - c * (w1 * f + w2)) * (v - c * (w1 * f + w2))) AS s FROM x JOIN r USING (vec_id) JOIN node USING (k) JOIN w USING (p)),
l AS (SELECT vec_id, ln(sum(e)) - 10 * min(d2) AS l FROM e GROUP BY 1) SELECT round(count(*) * 64 / (SELECT s FROM q), 4) AS beta, round(sum(l) + count(*) * 32 * ln(20 / (2 * pi())), 3) AS log_likelihood FROM l""")
def gtm_step_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = gtm_step(spark, sf_dir)
    return spark.createDataFrame([(round(float(model.beta), 4), round(float(model.history[-1]), 3))], "beta double, log_likelihood double")


@register("map3d_classes")
def map3d_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of two volumes after two rounds over directions and in-plane angles, with transfer functions, groups and symmetry."""
    from lumenfold.operators import healpix, sampling
    from lumenfold.plans.format_queries import volume_of

    first = volume_of(spark, sf_dir)
    rows = step_images(spark, sf_dir)
    noise = map_em.start(rows, 1, 3, group="g").sigma2
    model = map_em.Volumes(np.stack([first, first[::-1]]), np.full(2, 0.5), noise)
    model = map_em.classify_volumes(rows, model, healpix.centres(0), 2, 90.0, tau2_fudge=4.0, symmetry=sampling.point_group("C2"), cc_first=True, ctf="ctf", group="g")
    return spark.createDataFrame([(k + 1, float(s), float(model.history[-1])) for k, s in enumerate(model.shares)], "class_no long, share double, log_likelihood double")


@register("map2d_full")
def map2d_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of four classes after four rounds with angles, a finer second pass, transfer functions, groups and priors."""
    model = map_em.classify(step_images(spark, sf_dir), 4, 4, step=90.0, order=1, tau2_fudge=2.0, ctf="ctf", group="g", scale=True)
    return spark.createDataFrame([(k + 1, float(s), float(model.history[-1])) for k, s in enumerate(model.shares)], "class_no long, share double, log_likelihood double")

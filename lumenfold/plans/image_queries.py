"""Queries on images, spectra and estimators, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import images as kernels
from lumenfold.functions import physics
from lumenfold.operators import em, spectral
from lumenfold.plans.registry import register
from lumenfold.sources.tables import SIDE, images, optics, pixels, table

PX = """px AS (SELECT vec_id, label, i AS p, i // 8 AS y, i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) AS v
  FROM embeddings, (SELECT unnest(range(64)) AS i))"""
KGRID = """kgrid AS (SELECT kx, CASE WHEN a <= 4 THEN a ELSE a - 8 END AS ky FROM (SELECT unnest(range(5)) AS kx), (SELECT unnest(range(8)) AS a)),
shells AS (SELECT kx, ky, CAST(round(sqrt(kx * kx + ky * ky)) AS INTEGER) AS shell FROM kgrid)"""
DFT = f"""{PX}, {KGRID}, ft AS (SELECT vec_id, label, kx, ky, shell, sum(v * cos(2 * pi() * (kx * x + ky * y) / 8)) / 64 AS re, -sum(v * sin(2 * pi() * (kx * x + ky * y) / 8)) / 64 AS im
  FROM px, shells GROUP BY ALL)"""


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.long_spectrum(spectral.fourier(images(spark, sf_dir)).drop("pixels"))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    exact = {c: F.round(c, places) + F.lit(0.0) for c in columns}
    return df.withColumns(exact | {c: F.col(c).cast("long") for c in ("kx", "ky", "z", "y", "x") if c in df.columns and df.schema[c].dataType.simpleString() == "int"})


CTF_OF = "(0.5 + 0.5 * cos(x + y))"


@register("class_average_weighted", f"""WITH {PX} SELECT label AS class_no, p, round(sum(w * c * v) / (sum(w * c * c) + 0.01), 6) + 0.0 AS average
FROM (SELECT label, p, v, {CTF_OF} AS c, 1 - (vec_id % 10) / 20.0 AS w FROM px) GROUP BY ALL""")
def class_average_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir).withColumnRenamed("label", "class_no")
    found = em.weighted_average(rows, ["class_no", "p"], F.expr("1 - (vec_id % 10) / 20d"), F.expr(CTF_OF), F.col("v"))
    return rounded(found.withColumn("p", F.col("p").cast("long")), "average")


@register("class_average_threshold", f"""WITH {PX} SELECT label AS class_no, p, round(sum(w * v) / (sum(w) + 0.01), 6) + 0.0 AS average
FROM (SELECT *, 1 - (vec_id % 10) / 20.0 AS w FROM px) WHERE w > 0.7 GROUP BY ALL""")
def class_average_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir).withColumnRenamed("label", "class_no").withColumn("w", F.expr("1 - (vec_id % 10) / 20d")).where("w > 0.7")
    found = em.weighted_average(rows, ["class_no", "p"], F.col("w"), F.lit(1.0), F.col("v"))
    return rounded(found.withColumn("p", F.col("p").cast("long")), "average")


REF = f"""{PX}, ref AS (SELECT label AS class_no, p, avg(v) AS r FROM px WHERE vec_id % 2 = 0 GROUP BY ALL),
d AS (SELECT vec_id, class_no, sum((v - r) * (v - r)) * 0.5 * 64 AS diff2 FROM px JOIN ref USING (p) GROUP BY ALL),
s AS (SELECT *, min(diff2) OVER (PARTITION BY vec_id) AS min_diff2 FROM d),
w AS (SELECT *, CASE WHEN diff2 - min_diff2 > 700 THEN 0 ELSE exp(-(diff2 - min_diff2)) END AS w FROM s),
post AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class means of the even half."""
    even = pixels(spark, sf_dir).where("vec_id % 2 = 0")
    return even.groupBy(F.col("label").alias("class_no"), "p").agg(F.avg("v").alias("r"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image to reference differences at a noise variance of 1 / 64."""
    found = em.squared_difference(images(spark, sf_dir), em.reference_images(references(spark, sf_dir)))
    return found.withColumn("diff2", F.col("diff2") * 64)


def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return em.posterior(diffs(spark, sf_dir))


@register("map_diff2", f"WITH {REF} SELECT vec_id, class_no, round(diff2, 6) AS diff2 FROM d")
def map_diff2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diffs(spark, sf_dir), "diff2")


@register("map_min_diff2", f"WITH {REF} SELECT vec_id, round(min(diff2), 6) AS min_diff2 FROM d GROUP BY 1")
def map_min_diff2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diffs(spark, sf_dir).groupBy("vec_id").agg(F.min("diff2").alias("min_diff2")), "min_diff2")


@register("map_weights", f"WITH {REF} SELECT vec_id, class_no, round(w, 6) AS w FROM post")
def map_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(posteriors(spark, sf_dir).select("vec_id", "class_no", "w"), "w")


@register("softmax_responsibility", f"WITH {REF} SELECT vec_id, class_no, round(p, 6) AS p FROM post")
def softmax_responsibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(posteriors(spark, sf_dir).select("vec_id", "class_no", "p"), "p")


@register("argmax_class", f"""WITH {REF} SELECT vec_id, class_no FROM (SELECT vec_id, class_no, row_number() OVER (PARTITION BY vec_id ORDER BY diff2, class_no) AS k FROM d) WHERE k = 1""")
def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return em.best_class(diffs(spark, sf_dir).withColumn("p", -F.col("diff2")))


@register("class_average_maxprob", f"""WITH {REF}, best AS (SELECT vec_id, arg_min(class_no, diff2) AS class_no FROM d GROUP BY 1)
SELECT class_no, p, round(sum(v) / (count(*) + 0.01), 6) + 0.0 AS average FROM px JOIN best USING (vec_id) GROUP BY ALL""")
def class_average_maxprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = em.best_class(diffs(spark, sf_dir).withColumn("p", -F.col("diff2")))
    rows = pixels(spark, sf_dir).select("vec_id", "p", "v").join(best, "vec_id")
    return rounded(em.weighted_average(rows, ["class_no", "p"], F.lit(1.0), F.lit(1.0), F.col("v")).withColumn("p", F.col("p").cast("long")), "average")


@register("map_pdf_class", f"WITH {REF} SELECT class_no, round(sum(p) / (SELECT count(DISTINCT vec_id) FROM post), 6) AS pdf FROM post GROUP BY 1")
def map_pdf_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = posteriors(spark, sf_dir).groupBy("class_no").agg(F.sum("p").alias("s"))
    # one row a class; all weights sum to the number of images
    return rounded(sums.withColumn("pdf", F.col("s") / F.sum("s").over(Window.partitionBy())).select("class_no", "pdf"), "pdf")


@register("map_loglik", f"""WITH {REF} SELECT round(sum(l), 4) AS loglik, round(avg(pm), 6) AS mean_pmax FROM (SELECT vec_id, ln(sum(w)) - min(min_diff2) AS l, max(p) AS pm FROM post GROUP BY 1)""")
def map_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = posteriors(spark, sf_dir).groupBy("vec_id").agg((F.log(F.sum("w")) - F.min("min_diff2")).alias("l"), F.max("p").alias("pm"))
    return each.agg(F.round(F.sum("l"), 4).alias("loglik"), F.round(F.avg("pm"), 6).alias("mean_pmax"))


@register("map_pmax", f"WITH {REF} SELECT vec_id, round(max(p), 6) AS pmax FROM post GROUP BY 1")
def map_pmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(posteriors(spark, sf_dir).groupBy("vec_id").agg(F.max("p").alias("pmax")), "pmax")


@register("map_significant", f"""WITH {REF}, r AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, class_no ROWS UNBOUNDED PRECEDING) AS run FROM post),
t AS (SELECT vec_id, coalesce(max(p) FILTER (WHERE run > 0.999), min(p)) AS threshold FROM r GROUP BY 1)
SELECT vec_id, count(*) FILTER (WHERE p >= threshold) AS nr_significant FROM r JOIN t USING (vec_id) GROUP BY 1""")
def map_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.operators.particles import mass_threshold

    marked = mass_threshold(posteriors(spark, sf_dir).select("vec_id", "class_no", "p"), "vec_id", "p", "class_no", 0.999)
    return marked.groupBy("vec_id").agg(F.count(F.when(F.col("p") >= F.col("threshold"), 1)).alias("nr_significant"))


OFFSETS = "(l_quantity / 10 - 2.5)"


@register("map_mean_offset", f"""SELECT l_linenumber AS class_no, round(sum(w * o) / sum(w), 6) AS mean_offset FROM (SELECT l_linenumber, 1 - l_discount AS w, {OFFSETS} AS o FROM lineitem) GROUP BY 1""")
def map_mean_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as class_no", "1 - l_discount as w", f"{OFFSETS} as o")
    total = F.sum("w")
    return rows.groupBy("class_no").agg(F.round(F.when(total > 0, F.sum(F.col("w") * F.col("o")) / total).otherwise(0.0), 6).alias("mean_offset"))


@register("map_sigma2_offset", f"""WITH r AS (SELECT l_linenumber AS k, 1 - l_discount AS w, {OFFSETS} AS o FROM lineitem), m AS (SELECT k, sum(w * o) / sum(w) AS mu FROM r GROUP BY 1)
SELECT round(sum(w * (o - mu) * (o - mu)) / (2 * sum(w)), 6) AS sigma2_offset FROM r JOIN m USING (k)""")
def map_sigma2_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as k", "1 - l_discount as w", f"{OFFSETS} as o")
    # sums of squares about the class means, from one pass of moments
    moments = rows.groupBy("k").agg(F.sum("w").alias("w"), F.sum(F.expr("w * o")).alias("wo"), F.sum(F.expr("w * o * o")).alias("woo"))
    return moments.agg(F.round(F.sum(F.expr("woo - wo * wo / w")) / (2 * F.sum("w")), 6).alias("sigma2_offset"))


@register("norm_correction", f"""WITH {PX} SELECT label, round(avg(n), 6) AS mean_norm FROM (SELECT vec_id, label, sqrt(2 * sum(v * v)) AS n FROM px GROUP BY ALL) GROUP BY 1""")
def norm_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the pixels of an image are one array, so the inner sum needs no shuffle
    norm = F.sqrt(2 * F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x * x))
    return rounded(images(spark, sf_dir).groupBy("label").agg(F.avg(norm).alias("mean_norm")), "mean_norm")


@register("scale_correction_median_clamp", """WITH g AS (SELECT l_suppkey AS g, sum(l_quantity * l_extendedprice) AS xa, sum(l_extendedprice * l_extendedprice) / 1000 AS aa, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT g, n, xa / aa AS s FROM g), m AS (SELECT s AS med FROM (SELECT s, row_number() OVER (ORDER BY s) AS k FROM s) WHERE k = (SELECT count(*) // 2 + 1 FROM s)),
c AS (SELECT g, n, least(greatest(s, med / 5), med * 5) AS s FROM s, m) SELECT g, round(s / (SELECT sum(s * n) / sum(n) FROM c), 6) AS scale FROM c""")
def scale_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    groups = rows.groupBy(F.col("l_suppkey").alias("g")).agg(
        F.sum(F.expr("l_quantity * l_extendedprice")).alias("xa"), (F.sum(F.expr("l_extendedprice * l_extendedprice")) / 1000).alias("aa"), F.count("*").alias("n")
    )
    return rounded(em.clamp_scales(groups).select("g", "scale"), "scale")


@register("radial_power_spectrum", f"WITH {DFT} SELECT label, shell, round(avg(re * re + im * im) * 1000, 6) AS power FROM ft GROUP BY ALL")
def radial_power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.power_spectrum(transforms(spark, sf_dir), "label")
    return found.select("label", "shell", F.round(F.col("spectrum") * 1000, 6).alias("power"))


@register("amplitude_spectrum", f"WITH {DFT} SELECT vec_id, shell, round(avg(sqrt(re * re + im * im)) * 1000, 5) AS amplitude FROM ft GROUP BY ALL")
def amplitude_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = spectral.long_spectrum(spectral.fourier(images(spark, sf_dir)).drop("pixels"))
    found = spectral.power_spectrum(some, "vec_id", amplitude=True)
    return found.select("vec_id", "shell", F.round(F.col("spectrum") * 1000, 5).alias("amplitude"))


@register("npix_per_shell", f"WITH {KGRID} SELECT shell, count(*) AS n FROM shells WHERE NOT (kx = 0 AND ky < 0) GROUP BY 1")
def npix_per_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    kx = spark.range(SIDE // 2 + 1).select(F.col("id").cast("int").alias("kx"))
    grid = kx.select("kx", F.explode(F.expr(f"transform(sequence(0, {SIDE - 1}), a -> if(a <= {SIDE // 2}, a, a - {SIDE}))")).alias("ky"))
    shell = F.round(F.sqrt(F.expr("cast(kx * kx + ky * ky as double)"))).cast("int")
    return grid.where(spectral.once()).groupBy(shell.alias("shell")).agg(F.count("*").alias("n"))


@register("noise_spectrum_init", f"""WITH {DFT}, a AS (SELECT shell, avg(re * re + im * im) / 2 AS p FROM ft GROUP BY 1), m AS (SELECT kx, ky, shell, avg(re) AS re, avg(im) AS im FROM ft GROUP BY ALL),
b AS (SELECT shell, avg(re * re + im * im) / 2 AS p FROM m GROUP BY 1) SELECT shell, round((a.p - b.p) * 1000, 6) AS noise FROM a JOIN b USING (shell)""")
def noise_spectrum_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = transforms(spark, sf_dir)
    # one pass: sums for each Fourier pixel hold both the mean power and the power of the mean
    each = ft.groupBy("kx", "ky", "shell").agg(F.avg(F.expr("re * re + im * im")).alias("p"), F.avg("re").alias("re"), F.avg("im").alias("im"))
    return each.groupBy("shell").agg(F.round(F.avg(F.expr("p - re * re - im * im")) / 2 * 1000, 6).alias("noise"))


@register("map_sigma2_noise", f"""WITH {DFT}, m AS (SELECT label, kx, ky, avg(re) AS mre, avg(im) AS mim FROM ft GROUP BY ALL)
SELECT label, shell, round(sum((re - mre) * (re - mre) + (im - mim) * (im - mim)) / (2 * count(DISTINCT vec_id) * count(DISTINCT kx * 100 + ky)) * 1000, 6) AS sigma2
FROM ft JOIN m USING (label, kx, ky) WHERE NOT (kx = 0 AND ky < 0) GROUP BY ALL""")
def map_sigma2_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = transforms(spark, sf_dir).where(spectral.once())
    moments = ft.groupBy("label", "shell", "kx", "ky").agg(
        F.sum(F.expr("re * re + im * im")).alias("s"), F.sum("re").alias("re"), F.sum("im").alias("im"), F.count("*").alias("n")
    )
    found = moments.groupBy("label", "shell").agg(F.sum(F.expr("s - (re * re + im * im) / n")).alias("s"), F.max("n").alias("n"), F.count("*").alias("npix"))
    return found.select("label", "shell", F.round(F.col("s") / (2 * F.col("n") * F.col("npix")) * 1000, 6).alias("sigma2"))


HALVES = f"""{DFT}, h AS (SELECT vec_id % 2 AS h, kx, ky, shell, avg(re) AS re, avg(im) AS im FROM ft GROUP BY ALL),
b AS (SELECT a.shell, a.kx, a.ky, a.re AS re1, a.im AS im1, c.re AS re2, c.im AS im2 FROM h a JOIN h c ON a.kx = c.kx AND a.ky = c.ky AND a.h = 0 AND c.h = 1)"""


def half_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean transforms of the even and the odd images side by side, from one pass."""
    ft = transforms(spark, sf_dir)
    even = F.col("vec_id") % 2 == 0
    part = lambda c, e: F.avg(F.when(even if e else ~even, F.col(c)))
    return ft.groupBy("shell", "kx", "ky").agg(part("re", True).alias("re1"), part("im", True).alias("im1"), part("re", False).alias("re2"), part("im", False).alias("im2"))


@register("fsc_halves", f"WITH {HALVES} SELECT shell, round(sum(re1 * re2 + im1 * im2) / sqrt(sum(re1 * re1 + im1 * im1) * sum(re2 * re2 + im2 * im2)), 6) AS fsc FROM b GROUP BY 1")
def fsc_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.shell_correlation(half_maps(spark, sf_dir)), "fsc")


@register("current_resolution", f"""WITH {HALVES}, f AS (SELECT shell, sum(re1 * re2 + im1 * im2) / sqrt(sum(re1 * re1 + im1 * im1) * sum(re2 * re2 + im2 * im2)) AS fsc FROM b GROUP BY 1)
SELECT CAST(coalesce(min(shell) FILTER (WHERE fsc < 0.143 AND shell > 0) - 1, max(shell)) AS INTEGER) AS shell FROM f""")
def current_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spectral.shell_correlation(half_maps(spark, sf_dir))
    first = F.min(F.when((F.col("fsc") < 0.143) & (F.col("shell") > 0), F.col("shell")))
    return f.agg(F.coalesce(first - 1, F.max("shell")).cast("int").alias("shell"))


@register("join_half_maps", f"WITH {HALVES} SELECT kx, ky, round(1000 * CASE WHEN shell <= 2 THEN (re1 + re2) / 2 ELSE re1 END, 5) + 0.0 AS re1, round(1000 * CASE WHEN shell <= 2 THEN (re1 + re2) / 2 ELSE re2 END, 5) + 0.0 AS re2 FROM b")
def join_half_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.expr("(re1 + re2) / 2")
    low = F.col("shell") <= 2
    joined = half_maps(spark, sf_dir).select("kx", "ky", (1000 * F.when(low, mean).otherwise(F.col("re1"))).alias("re1"), (1000 * F.when(low, mean).otherwise(F.col("re2"))).alias("re2"))
    return rounded(joined, "re1", "re2", places=5)


@register("fourier_shift", f"""WITH {DFT} SELECT vec_id, kx, ky, round(1000 * (re * cos(a) - im * sin(a)), 5) + 0.0 AS re, round(1000 * (re * sin(a) + im * cos(a)), 5) + 0.0 AS im
FROM (SELECT *, -2 * pi() * (kx * 0.5 + ky * 1.5) / 8 AS a FROM ft)""")
def fourier_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = spectral.long_spectrum(spectral.fourier(images(spark, sf_dir)).drop("pixels"))
    moved = spectral.shifted(some, 0.5, 1.5, SIDE).select("vec_id", "kx", "ky", (F.col("re") * 1000).alias("re"), (F.col("im") * 1000).alias("im"))
    return rounded(moved, "re", "im", places=5)


@register("fourier_crop", f"WITH {DFT} SELECT vec_id, count(*) AS n, round(sum(re * re + im * im) * 1000, 6) AS energy FROM ft WHERE kx <= 2 AND ky BETWEEN -1 AND 2 GROUP BY 1")
def fourier_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spectral.cropped(transforms(spark, sf_dir), 4)
    return kept.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("re * re + im * im")) * 1000, 6).alias("energy"))


@register("spherical_average_3d", f"""WITH {PX}, z AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z FROM embeddings),
vol AS (SELECT px.label, z.z, y, x, v FROM px JOIN z ON px.vec_id = z.vec_id WHERE z.z < 8)
SELECT label, least(CAST(floor(sqrt((z - 4) * (z - 4) + (y - 4) * (y - 4) + (x - 4) * (x - 4))) AS INTEGER), 3) AS bin, count(*) AS n, round(avg(v), 6) + 0.0 AS mean FROM vol GROUP BY ALL""")
def spherical_average_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(volumes(spark, sf_dir).groupBy("label", F.expr("least(cast(floor(sqrt((z - 4) * (z - 4) + (y - 4) * (y - 4) + (x - 4) * (x - 4))) as int), 3)").alias("bin"))
                   .agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean")


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes of the first eight images of each label: label, z, y, x, v."""
    firsts = Window.partitionBy("label").orderBy("vec_id")
    slabs = images(spark, sf_dir).withColumn("z", F.row_number().over(firsts) - 1).where("z < 8")
    long = slabs.select("label", "z", F.posexplode("pixels").alias("p", "v"))
    return long.selectExpr("label", "z", f"p div {SIDE} as y", f"p % {SIDE} as x", "v")


VOL = f"""{PX}, z AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z FROM embeddings),
vol AS (SELECT px.label, z.z, y, x, v FROM px JOIN z ON px.vec_id = z.vec_id WHERE z.z < 8)"""


@register("volume_compare", f"""WITH {VOL} SELECT count(*) AS voxels, count(*) FILTER (WHERE a.v <> b.v) AS unlike, round(sqrt(avg((a.v - b.v) * (a.v - b.v))), 6) AS rms FROM vol a JOIN vol b ON a.z = b.z AND a.y = b.y AND a.x = b.x AND a.label = 1 AND b.label = 2""")
def volume_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = volumes(spark, sf_dir)
    both = vol.where("label = 1").join(vol.where("label = 2").withColumnRenamed("v", "u"), ["z", "y", "x"])
    return both.agg(F.count("*").alias("voxels"), F.count(F.expr("if(v <> u, 1, null)")).alias("unlike"), F.round(F.sqrt(F.avg(F.expr("(v - u) * (v - u)"))), 6).alias("rms"))


@register("half_sum_difference", f"""WITH {VOL} SELECT a.z, a.y, a.x, round((a.v + b.v) / 2, 6) + 0.0 AS half_sum, round((a.v - b.v) / 2, 6) + 0.0 AS half_difference FROM vol a JOIN vol b ON a.z = b.z AND a.y = b.y AND a.x = b.x AND a.label = 3 AND b.label = 4""")
def half_sum_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = volumes(spark, sf_dir)
    both = vol.where("label = 3").join(vol.where("label = 4").select("z", "y", "x", F.col("v").alias("u")), ["z", "y", "x"])
    return rounded(both.select("z", "y", "x", F.expr("(v + u) / 2").alias("half_sum"), F.expr("(v - u) / 2").alias("half_difference")), "half_sum", "half_difference")


@register("local_variance", f"""WITH {VOL}, o AS (SELECT unnest(range(-1, 2)) AS o) SELECT a.z, a.y, a.x, count(*) AS n, round(avg(b.v * b.v) - avg(b.v) * avg(b.v), 6) + 0.0 AS variance
FROM vol a JOIN vol b ON a.label = 1 AND b.label = 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL""")
def local_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = volumes(spark, sf_dir).where("label = 1")
    near = "explode(flatten(transform(sequence(-1, 1), i -> flatten(transform(sequence(-1, 1), j -> transform(sequence(-1, 1), k -> struct(z + i as z, y + j as y, x + k as x)))))))"
    # each voxel is sent to its neighbours, so windows are an equi-aggregation and need no range join
    sent = vol.select("v", F.expr(near).alias("to")).where(f"to.z between 0 and {SIDE - 1} and to.y between 0 and {SIDE - 1} and to.x between 0 and {SIDE - 1}")
    found = sent.groupBy("to.z", "to.y", "to.x").agg(F.count("*").alias("n"), (F.avg(F.expr("v * v")) - F.avg("v") * F.avg("v")).alias("variance"))
    return rounded(found, "variance")


@register("normalisation_check", f"""WITH {PX}, s AS (SELECT vec_id, avg(v * 8) AS m, sqrt(avg(v * v * 64) - avg(v * 8) * avg(v * 8)) AS sd FROM px WHERE (x - 4) * (x - 4) + (y - 4) * (y - 4) > 9 GROUP BY 1)
SELECT vec_id, abs(m / sd) <= 0.5 AND sd BETWEEN 0.5 AND 2 AS valid FROM s""")
def normalisation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = pixels(spark, sf_dir).where("(x - 4) * (x - 4) + (y - 4) * (y - 4) > 9")
    stats = ring.groupBy("vec_id").agg(F.avg(F.expr("v * 8")).alias("m"), F.sqrt(F.avg(F.expr("v * v * 64")) - F.pow(F.avg(F.expr("v * 8")), 2)).alias("sd"))
    return stats.select("vec_id", F.expr("abs(m / sd) <= 0.5 and sd between 0.5 and 2").alias("valid"))


@register("basic_stats", f"WITH {PX} SELECT label, round(avg(v), 6) + 0.0 AS mean, round(sqrt(avg(v * v) - avg(v) * avg(v)), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most FROM px GROUP BY 1")
def basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixels(spark, sf_dir).groupBy("label").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))
    return rounded(found, "mean", "std", "least", "most")


@register("zscore_image", f"""WITH {PX}, s AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd FROM px GROUP BY 1) SELECT vec_id, p, round(CASE WHEN sd > 0 THEN (v - m) / sd ELSE v END, 5) + 0.0 AS z FROM px JOIN s USING (vec_id)""")
def zscore_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = images(spark, sf_dir)
    n = F.size("pixels")
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x * x) / n
    stats = some.withColumns({"m": mean, "sd": F.sqrt(square - mean * mean)})
    z = stats.select("vec_id", F.posexplode(F.transform("pixels", lambda x: F.when(F.col("sd") > 0, (x - F.col("m")) / F.col("sd")).otherwise(x))).alias("p", "z"))
    return rounded(z.withColumn("p", F.col("p").cast("long")), "z", places=5)


@register("soft_mask", f"""WITH {PX}, w AS (SELECT *, CASE WHEN r < 2 THEN 1.0 WHEN r > 4 THEN 0.0 ELSE 0.5 + 0.5 * cos((r - 2) / 2 * pi()) END AS w FROM (SELECT *, sqrt((x - 4) * (x - 4) + (y - 4) * (y - 4)) AS r FROM px)),
b AS (SELECT vec_id, sum((1 - w) * v) / sum(1 - w) AS b FROM w GROUP BY 1) SELECT vec_id, p, round(w * v + (1 - w) * b, 6) + 0.0 AS v FROM w JOIN b USING (vec_id)""")
def soft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = spectral.image_kernel(images(spark, sf_dir), lambda image: kernels.soft_mask(image, 2.0, 2.0))
    return rounded(masked.select("vec_id", F.posexplode("pixels").alias("p", "v")).withColumn("p", F.col("p").cast("long")), "v")


@register("lowpass_weights", """SELECT i AS shell, round(CASE WHEN i < 3 THEN 1.0 WHEN i > 8 THEN 0.0 ELSE 0.5 + 0.5 * cos((i - 3) / 5.0 * pi()) END, 6) AS weight FROM (SELECT unnest(range(12)) AS i)""")
def lowpass_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(12).select(F.col("id").alias("shell"), F.round(physics.cosine_mask(F.col("id"), 3.0, 5.0), 6).alias("weight"))


@register("gauss_circle", """SELECT y, x, round(exp(-((x - 8) * (x - 8) + (y - 8) * (y - 8)) / 32.0), 6) AS v FROM (SELECT unnest(range(16)) AS y), (SELECT unnest(range(16)) AS x)""")
def gauss_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(256).selectExpr("id div 16 as y", "id % 16 as x")
    return grid.select("y", "x", F.round(F.exp(F.expr("-((x - 8) * (x - 8) + (y - 8) * (y - 8)) / 32d")), 6).alias("v"))


@register("backproject_scatter", f"""WITH {PX}, r AS (SELECT label, v, 4 + (x - 4) * cos(a) - (y - 4) * sin(a) AS qx, 4 + (x - 4) * sin(a) + (y - 4) * cos(a) AS qy FROM (SELECT *, radians(vec_id % 90) AS a FROM px)),
c AS (SELECT label, v, CAST(floor(qx) AS INTEGER) + dx AS gx, CAST(floor(qy) AS INTEGER) + dy AS gy,
  (CASE WHEN dx = 0 THEN 1 - (qx - floor(qx)) ELSE qx - floor(qx) END) * (CASE WHEN dy = 0 THEN 1 - (qy - floor(qy)) ELSE qy - floor(qy) END) AS w
  FROM r, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy))
SELECT label, gx, gy, round(sum(w * v), 5) + 0.0 AS value, round(sum(w), 5) + 0.0 AS weight FROM c WHERE gx BETWEEN 0 AND 7 AND gy BETWEEN 0 AND 7 GROUP BY ALL""")
def backproject_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = pixels(spark, sf_dir).selectExpr("label", "v", "x - 4 as x", "y - 4 as y", "radians(cast(vec_id % 90 as double)) as a").selectExpr(
        "label", "v", "4 + x * cos(a) - y * sin(a) as qx", "4 + x * sin(a) + y * cos(a) as qy"
    )
    corner = "explode(array(struct(0 as dx, 0 as dy), struct(0 as dx, 1 as dy), struct(1 as dx, 0 as dy), struct(1 as dx, 1 as dy)))"
    parts = turned.select("*", F.expr(corner).alias("c")).selectExpr(
        "label", "v", "cast(floor(qx) as int) + c.dx as gx", "cast(floor(qy) as int) + c.dy as gy",
        "if(c.dx = 0, 1 - (qx - floor(qx)), qx - floor(qx)) * if(c.dy = 0, 1 - (qy - floor(qy)), qy - floor(qy)) as w",
    )
    inside = parts.where("gx between 0 and 7 and gy between 0 and 7")
    return rounded(inside.groupBy("label", "gx", "gy").agg(F.sum(F.expr("w * v")).alias("value"), F.sum("w").alias("weight")), "value", "weight", places=5)


CTF_SQL = """lam AS (SELECT 12.2643247 / sqrt(300000 * (1 + 300000 * 0.978466e-6)) AS lam), o AS (SELECT p_partkey, 10000 + 100 * p_size AS du, 10000 + p_retailprice AS dv, p_partkey % 180 AS az FROM part),
k AS (SELECT p_partkey, du, dv, az, unnest([0.0, 0.01, 0.02, 0.05]) AS x, 0.015 AS y FROM o),
a AS (SELECT p_partkey, x, pi() * lam * (-(du + dv) / 2 - (du - dv) / 2 * cos(2 * (atan2(y, x) - radians(az)))) * (x * x + y * y) + pi() / 2 * 2.7e7 * lam * lam * lam * (x * x + y * y) * (x * x + y * y) AS arg, x * x + y * y AS u2 FROM k, lam),
c AS (SELECT p_partkey, x, arg, u2, -(sqrt(0.99) * sin(arg) - 0.1 * cos(arg)) AS c FROM a)"""


def ctf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optics(spark, sf_dir).withColumn("x", F.explode(F.array(*map(F.lit, [0.0, 0.01, 0.02, 0.05])))).withColumn("y", F.lit(0.015))


def ctf_of(**options) -> F.Column:
    return physics.ctf(F.col("x"), F.col("y"), F.col("defocus_u"), F.col("defocus_v"), F.col("angle"), **options)


@register("ctf_value", f"WITH {CTF_SQL} SELECT p_partkey, x::DOUBLE AS x, round(c, 6) + 0.0 AS ctf FROM c")
def ctf_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ctf_rows(spark, sf_dir).select("p_partkey", "x", ctf_of().alias("ctf")), "ctf")


@register("ctf_flip", f"WITH {CTF_SQL} SELECT p_partkey, x::DOUBLE AS x, CASE WHEN c < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS ctf FROM c")
def ctf_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctf_rows(spark, sf_dir).select("p_partkey", "x", ctf_of(flip_only=True).alias("ctf"))


@register("ctf_first_peak", f"WITH {CTF_SQL} SELECT p_partkey, x::DOUBLE AS x, round(abs(CASE WHEN abs(arg) < pi() / 2 THEN 1.0 ELSE c END * exp(-50 * u2 / 4)), 6) AS ctf FROM c")
def ctf_first_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ctf_rows(spark, sf_dir).select("p_partkey", "x", ctf_of(first_peak=True, bfactor=50.0, absolute=True).alias("ctf")), "ctf")


@register("electron_wavelength", "SELECT kv, round(12.2643247 / sqrt(kv * 1000 * (1 + kv * 1000 * 0.978466e-6)) * 1000, 6) AS milli_angstrom FROM (SELECT unnest([100, 200, 300])::BIGINT AS kv)")
def electron_wavelength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 4).select((F.col("id") * 100).alias("kv")).select("kv", F.round(physics.wavelength(F.col("kv")) * 1000, 6).alias("milli_angstrom"))


@register("ctf_grid", f"""WITH {KGRID}, lam AS (SELECT 12.2643247 / sqrt(300000 * (1 + 300000 * 0.978466e-6)) AS lam),
a AS (SELECT p_partkey, kx, ky, kx / 32.0 AS x, ky / 32.0 AS y, 10000 + 100 * p_size AS du, 10000 + p_retailprice AS dv, p_partkey % 180 AS az FROM part, kgrid WHERE p_partkey <= 50),
b AS (SELECT p_partkey, kx, ky, pi() * lam * (CASE WHEN kx = 0 AND ky = 0 THEN 0 ELSE -(du + dv) / 2 - (du - dv) / 2 * cos(2 * (atan2(y, x) - radians(az))) END) * (x * x + y * y) + pi() / 2 * 2.7e7 * lam * lam * lam * (x * x + y * y) * (x * x + y * y) AS arg FROM a, lam)
SELECT p_partkey, kx, ky, round(-(sqrt(0.99) * sin(arg) - 0.1 * cos(arg)), 5) + 0.0 AS ctf FROM b""")
def ctf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda a: F.transform(F.sequence(F.lit(-3), F.lit(4)), lambda b: F.struct(a.alias("kx"), b.alias("ky"))))))
    rows = optics(spark, sf_dir).where("p_partkey <= 50").select("*", grid.alias("k")).select("*", "k.kx", "k.ky")
    at = rows.withColumns({"x": F.col("kx") / 32, "y": F.col("ky") / 32, "kx": F.col("kx").cast("long"), "ky": F.col("ky").cast("long")})
    return rounded(at.select("p_partkey", "kx", "ky", ctf_of().alias("ctf")), "ctf", places=5)



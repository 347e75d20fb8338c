"""Queries that write formats and read them back, and on the fields of particle tables, with their DuckDB counterparts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import physics, strings
from lumenfold.operators import particles as ops
from lumenfold.plans.image_queries import PX, rounded
from lumenfold.plans.registry import register
from lumenfold.session import shared_path
from lumenfold.sources import pictures, reports, stacks, star, state
from lumenfold.sources.tables import ORDER, images, particles, table

PLACED = f"""{PX}, placed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings)"""


def long_stack(stack: DataFrame) -> DataFrame:
    long = stack.select("index", F.posexplode("pixels").alias("p", "v"))
    return rounded(long.select(F.col("index"), F.col("p").cast("long").alias("p"), F.col("v").cast("double").alias("v")), "v")


def written_stack(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_path(spark, 'stack')}/images.mrcs"
    stacks.write_stack(images(spark, sf_dir), path, "vec_id")
    return path


@register("mrc_stack_round_trip", f"""WITH {PLACED} SELECT k::BIGINT AS "index", p, round(v, 6) + 0.0 AS v FROM px JOIN placed USING (vec_id)""")
def mrc_stack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_stack(stacks.read_stacks(spark, [written_stack(spark, sf_dir)], slice_images=64))


@register("mrc_header_fields", """SELECT 8::BIGINT AS nx, 8::BIGINT AS ny, count(*)::BIGINT AS nz, 2::BIGINT AS mode FROM embeddings""")
def mrc_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    with stacks.opened(written_stack(spark, sf_dir)) as f:
        h = stacks.mrc_header(f.read(stacks.HEADER))
    return spark.createDataFrame([tuple(int(h[k]) for k in ("nx", "ny", "nz", "mode"))], "nx long, ny long, nz long, mode long")


@register("spider_round_trip", f"""WITH {PLACED} SELECT k::BIGINT AS "index", p, round(v, 6) + 0.0 AS v FROM px JOIN placed USING (vec_id)""")
def spider_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = written_stack(spark, sf_dir)
    folder = shared_path(spark, "converted")
    stacks.convert(source, f"{folder}/images.dat")
    stacks.convert(f"{folder}/images.dat", f"{folder}/back.mrcs")
    return long_stack(stacks.read_stacks(spark, [f"{folder}/back.mrcs"]))


@register("particle_image_join", f"""WITH {PLACED}, n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT k, sum(v) AS total FROM px JOIN placed USING (vec_id) GROUP BY 1)
SELECT p_partkey, round(total, 5) + 0.0 AS total FROM part, n JOIN s ON s.k = p_partkey % n.n + 1""")
def particle_image_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_stack(spark, sf_dir)
    stack = stacks.read_stacks(spark, [path]).withColumn("name", F.lit("images.mrcs"))
    n = table(spark, sf_dir, "embeddings").count()
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lpad((F.col("p_partkey") % n + 1).cast("string"), 7, "0"), F.lit("@images.mrcs")).alias("ImageName"))
    met = stacks.join_images(named, stack.withColumn("pixels", F.col("pixels").cast("array<double>")))
    return rounded(met.select("p_partkey", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("total")), "total", places=5)


VOLUME = f"""{PX}, first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS z FROM embeddings WHERE label = 0 QUALIFY z < 8),
vol AS (SELECT z, y, x, v FROM px JOIN first USING (vec_id))"""


def volume_of(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The first eight images of label 0 as the sections of a cube; a fixed size."""
    rows = images(spark, sf_dir).where("label = 0").orderBy("vec_id").limit(8).collect()
    return np.array([r["pixels"] for r in rows], float).reshape(-1, 8, 8)


def long_volume(spark: SparkSession, volume: np.ndarray, places: int = 6) -> DataFrame:
    rows = [(*map(int, at), float(volume[at])) for at in np.ndindex(volume.shape)]
    return rounded(spark.createDataFrame(rows, "z long, y long, x long, v double"), "v", places=places)


@register("mrc_volume_round_trip", f"WITH {VOLUME} SELECT z, y, x, round(v, 6) + 0.0 AS v FROM vol")
def mrc_volume_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_path(spark, 'volume')}/a.mrc"
    stacks.write_mrc(path, volume_of(spark, sf_dir), 1.5)
    return long_volume(spark, stacks.read_mrc(path))


@register("symmetry_file", """SELECT round(cos(a), 6) + 0.0 AS m11, round(-sin(a), 6) + 0.0 AS m12, round(sin(a), 6) + 0.0 AS m21, 1.0::DOUBLE * s AS m33
FROM (SELECT radians(unnest(range(4)) * 90) AS a), (SELECT unnest([1, -1]) AS s)""")
def symmetry_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.parse_symmetry("rot_axis 4 0 0 1 ; four turns\n# and\nmirror_plane 0 0 1\n")
    rows = [(float(m[0, 0]), float(m[0, 1]), float(m[1, 0]), float(m[2, 2])) for m in found]
    return rounded(spark.createDataFrame(rows, "m11 double, m12 double, m21 double, m33 double"), "m11", "m12", "m21", "m33")


@register("fine_search_list", """SELECT s_suppkey::INTEGER AS class_no, (s_nationkey + 1)::INTEGER AS fine FROM supplier""")
def fine_search_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "list")
    line = F.concat(F.col("s_suppkey").cast("string"), F.lit(" , "), (F.col("s_nationkey") + 1).cast("string"))
    note = spark.createDataFrame([("# 1,2 is a note",), ("no pair",)], "value string")
    table(spark, sf_dir, "supplier").select(line.alias("value")).unionAll(note).write.text(path)
    return star.read_class_list(spark, path)


@register("class_count_file", """SELECT l_linenumber || ' ' || count(*) AS value FROM lineitem GROUP BY l_linenumber""")
def class_count_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "counts")
    star.write_class_counts(particles(spark, sf_dir), path)
    return spark.read.text(path)


@register("orientation_plot", """WITH c AS (SELECT l_linenumber * 40 + 1.0 AS rot, 20.0 * l_linenumber + 7 AS tilt, count(*) AS n FROM lineitem GROUP BY l_linenumber),
s AS (SELECT avg(n) AS m, stddev_pop(n) AS sd, max(n) AS top FROM c),
r AS (SELECT cos(radians(rot)) * sin(radians(tilt)) AS ux, sin(radians(rot)) * sin(radians(tilt)) AS uy, cos(radians(tilt)) AS uz, 100 * (1 + 0.3 * n / top) AS l,
  greatest(0, least(1, 0.5 + CASE WHEN sd > 0 THEN (n - m) / sd ELSE 0 END / 6)) AS z FROM c, s)
SELECT printf('.color %.3f 0.000 %.3f', z, 1 - z) || chr(10) || printf('.cylinder %.3f %.3f %.3f %.3f %.3f %.3f 1.0', ux * 100, uy * 100, uz * 100, ux * l, uy * l, uz * l) AS line FROM r""")
def orientation_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = particles(spark, sf_dir).groupBy("class_no").agg(F.count("*").alias("n"))
    return reports.orientation_lines(counts.selectExpr("class_no * 40 + 1d as rot", "20d * class_no + 7 as tilt", "n"))


@register("viewer_script_lines", """SELECT unnest(['open #0 a.mrc', 'open #1 r.mrc', 'volume #1 hide', 'scolor #0 volume #1 cmap 3.00,blue:6.00,white:9.00,red', 'colorkey 0.05,0.05 0.3,0.08']) AS line""")
def viewer_script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(line,) for line in reports.viewer_script("a.mrc", "r.mrc", 3, 9).split("\n")], "line string")


@register("state_round_trip", """SELECT 2::BIGINT AS iteration, l_linenumber - 1 AS at, count(*)::DOUBLE AS x FROM lineitem GROUP BY l_linenumber""")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "state")
    counts = ops.class_counts(particles(spark, sf_dir)).orderBy("class_no").collect()
    for i in (1, 2, 2):
        reports.save_state(spark, path, i, {"mass": np.array([r["n"] for r in counts]) * i / 2}, {"sigma2": 0.5})
    last, arrays, _ = reports.load_state(spark, path)
    return spark.createDataFrame([(int(last), k, float(x)) for k, x in enumerate(arrays["mass"])], "iteration long, at int, x double")


@register("model_round_trip", """SELECT l_returnflag || l_linestatus AS "GroupName", count(*) AS size, round(avg(l_discount) * 10, 6) AS scale, round(0.2 + row_number() OVER (ORDER BY l_returnflag || l_linestatus), 6)::DOUBLE AS sigma2_of_shell_2, 5::BIGINT AS classes
FROM lineitem GROUP BY l_returnflag || l_linestatus""")
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "model")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("g")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("d")).orderBy("g").collect()
    sigma2 = np.arange(1, len(rows) + 1)[:, None] + np.arange(5) / 10
    state.write_model_state(spark, path, 8, np.full(5, 0.2), sigma2, [r["g"] for r in rows], [r["n"] for r in rows], np.array([r["d"] * 10 for r in rows]), PixelSize=1.5)
    found = state.read_model_state(spark, path)
    back = [(g, int(n), float(s), float(x[2]), int(found["general"]["NrClasses"])) for g, n, s, x in zip(found["group_names"], found["group_sizes"], found["scales"], found["sigma2"])]
    return rounded(spark.createDataFrame(back, "GroupName string, size long, scale double, sigma2_of_shell_2 double, classes long"), "scale", "sigma2_of_shell_2")


@register("sampling_round_trip", """SELECT s_suppkey::DOUBLE AS "AngleRot", (s_suppkey % 180)::DOUBLE AS "AngleTilt", 'D2' AS symmetry, 7.5::DOUBLE AS psi_step, 3::BIGINT AS healpix_order FROM supplier""")
def sampling_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "sampling")
    keys = [r[0] for r in table(spark, sf_dir, "supplier").select("s_suppkey").collect()]
    state.write_sampling(spark, path, np.array([(k, k % 180) for k in keys], float), SymmetryGroup="D2", PsiStep=7.5, HealpixOrder=3, Is3DSampling=1)
    values, directions = state.read_sampling(spark, path)
    return directions.select("*", F.lit(values["SymmetryGroup"]).alias("symmetry"), F.lit(values["PsiStep"]).alias("psi_step"), F.lit(values["HealpixOrder"]).cast("long").alias("healpix_order"))


@register("optimiser_round_trip", """SELECT 'run' AS root, 'run_it004_model.star' AS model, 'run_it004_sampling.star' AS sampling, 4::BIGINT AS iteration, 25::BIGINT AS iterations, 0.999::DOUBLE AS fraction, -1.0::DOUBLE AS join_until""")
def optimiser_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "optimiser")
    state.write_optimiser(spark, path, "run", 4, NumberOfIterations=25)
    o = state.read_optimiser(spark, path)
    row = (o["OutputRootName"], o["ModelStarFile"], o["OrientSamplingStarFile"], o["CurrentIteration"], o["NumberOfIterations"], o["AdaptiveOversampleFraction"], o["JoinHalvesUntilThisResolution"])
    return spark.createDataFrame([row], "root string, model string, sampling string, iteration long, iterations long, fraction double, join_until double")


GREY = f"""{PX}, shown AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 31 AS k FROM embeddings QUALIFY k BETWEEN 0 AND 29), r AS (SELECT vec_id, min(v) AS low, max(v) AS high FROM px GROUP BY 1),
g AS (SELECT k, y, x, floor((v - low) / (high - low) * 255 + 0.5)::BIGINT AS g FROM px JOIN shown USING (vec_id) JOIN r USING (vec_id))"""


@register("picture_of_images", f"WITH {GREY} SELECT (k // 6) * 8 + y AS y, (k % 6) * 8 + x AS x, g AS grey FROM g")
def picture_of_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of thirty images as one picture, written and read back."""
    path = f"{shared_path(spark, 'picture')}/page.bmp"
    pictures.write_bmp(path, pictures.montage(pictures.page_of_images(images(spark, sf_dir), "vec_id", 1, 30), 6))
    back = pictures.read_bmp(path)
    return spark.createDataFrame([(y, x, int(back[y, x])) for y, x in np.ndindex(back.shape)], "y long, x long, grey long")


@register("pages_of_images", f"WITH {GREY} SELECT k AS page, y, x, g AS grey FROM g")
def pages_of_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images as pages of one file."""
    path = f"{shared_path(spark, 'picture')}/pages.tif"
    pictures.write_tiff(path, [pictures.grey(i) for i in pictures.page_of_images(images(spark, sf_dir), "vec_id", 1, 30)])
    return spark.createDataFrame([(k, y, x, int(p[y, x])) for k, p in enumerate(pictures.read_tiff(path)) for y, x in np.ndindex(p.shape)], "page long, y long, x long, grey long")


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as particles, with some of the known columns."""
    return star.with_defaults(
        table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("inner_id"), F.concat(F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit("@a.mrcs")).alias("ImageName"),
            (F.col("o_custkey") % 50).cast("double").alias("OriginX"), (F.col("o_custkey") % 360).cast("double").alias("AnglePsi"), F.col("o_totalprice").alias("DefocusU"),
        )
    )


@register("default_columns", """SELECT o_orderkey AS inner_id, 999.0::DOUBLE AS "AngleRotPrior", 1.0::DOUBLE AS "NormCorrection", 1 AS "GroupNumber", '' AS "MicrographName", round(o_totalprice, 6) AS "DefocusU" FROM orders""")
def default_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stars(spark, sf_dir).select("inner_id", "AngleRotPrior", "NormCorrection", "GroupNumber", "MicrographName", "DefocusU"), "DefocusU")


@register("label_present", """SELECT * FROM (VALUES ('OriginX', true), ('Own', true), ('Other', false)) AS t(label, present)""")
def label_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = stars(spark, sf_dir).withColumn("extra", F.create_map(F.lit("Own"), F.lit("1")))
    return spark.createDataFrame([(n, star.has_label(known, n)) for n in ("OriginX", "Own", "Other")], "label string, present boolean")


@register("label_tokens", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'Size' || p_size END AS label FROM part""")
def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.expr("case p_partkey % 3 when 0 then concat('_rln', p_size) when 1 then concat(' rlnSize', p_size) else concat('loop_', p_size) end")
    return table(spark, sf_dir, "part").select("p_partkey", star.label_of(token).alias("label"))


@register("reset_pose", """SELECT o_orderkey AS inner_id, 0.0::DOUBLE AS "OriginX", 0.0::DOUBLE AS "OriginY", 0.0::DOUBLE AS "AnglePsi", round(o_totalprice, 6) AS "DefocusU" FROM orders""")
def reset_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(star.reset_pose(stars(spark, sf_dir)).select("inner_id", "OriginX", "OriginY", "AnglePsi", "DefocusU"), "DefocusU")


@register("metadata_gather", """SELECT o_orderkey AS inner_id, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 7)::DOUBLE ELSE (o_custkey % 360)::DOUBLE END AS "AnglePsi", CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 5)::INTEGER ELSE 0 END AS "ClassNumber",
CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS "MaxValueProbDistribution", CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END AS "NrOfSignificantSamples" FROM orders""")
def metadata_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an iteration found for half of the particles goes into the table; the others keep theirs."""
    half = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    values = {"AnglePsi": "cast(o_custkey % 7 as double)", "ClassNumber": "cast(o_custkey % 5 as int)", "MaxValueProbDistribution": "0.5d", "NrOfSignificantSamples": "3"}
    found = half.select(F.col("o_orderkey").alias("inner_id"), *[F.expr(values.get(c, "0")).alias(c) for c in star.FOUND])
    return star.with_found(stars(spark, sf_dir), found).select("inner_id", *values)


@register("shuffled_rows", """SELECT event_id, row_number() OVER (ORDER BY md5('7:' || event_id), event_id) - 1 AS place FROM events""")
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.shuffled(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 7)


KEYS = ", ".join(ORDER)


@register("sorted_by_micrograph", f"""SELECT {KEYS}, row_number() OVER (ORDER BY l_suppkey, {KEYS}) - 1 AS place FROM lineitem""")
def sorted_by_micrograph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_global_index(particles(spark, sf_dir).select("micrograph", *ORDER), ["micrograph", *ORDER], "place")[0].drop("micrograph")


@register("images_by_key", """SELECT label, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY label""")
def images_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images dealt by their class, so that those of one class are read together; the aggregation needs no shuffle of its own."""
    dealt = images(spark, sf_dir).repartition("label")
    return dealt.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@register("random_draws", """WITH u AS (SELECT event_id, CAST('0x' || substr(md5('3:' || event_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS a, CAST('0x' || substr(md5('4:' || event_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS b FROM events)
SELECT event_id, round(a, 9) AS uniform, round(sqrt(-2 * ln(greatest(a, power(2.0, -52)))) * cos(2 * pi() * b), 6) + 0.0 AS normal FROM u""")
def random_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = table(spark, sf_dir, "events").select("event_id", F.round(physics.uniform(F.col("event_id"), 3), 9).alias("uniform"), physics.normal(F.col("event_id"), 3).alias("normal"))
    return rounded(drawn, "normal")


@register("simulated_images", f"""WITH {PX}, ref AS (SELECT label, p, avg(v) AS r FROM px GROUP BY ALL), i AS (SELECT event_id, event_id % 10 AS label, p, r, event_id * 64 + p AS k FROM events JOIN ref ON ref.label = event_id % 10 WHERE event_type = 'click'),
u AS (SELECT *, CAST('0x' || substr(md5('5:' || k), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS a, CAST('0x' || substr(md5('6:' || k), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS b FROM i)
SELECT event_id, round(sum(r + 0.1 * sqrt(-2 * ln(greatest(a, power(2.0, -52)))) * cos(2 * pi() * b)), 5) + 0.0 AS total FROM u GROUP BY 1""")
def simulated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each click: a class mean with noise that its number fixes; the sum of its pixels."""
    from lumenfold.plans.image_queries import pixels

    means = pixels(spark, sf_dir).groupBy("label", "p").agg(F.avg("v").alias("r"))
    made = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", (F.col("event_id") % 10).cast("int").alias("label")).join(means, "label")
    noisy = made.withColumn("v", F.col("r") + 0.1 * physics.normal(F.expr("event_id * 64 + p"), 5))
    return rounded(noisy.groupBy("event_id").agg(F.sum("v").alias("total")), "total", places=5)


@register("int_list_split", """SELECT p_partkey, p_size || '|' || p_partkey || '|0' AS numbers FROM part""")
def int_list_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_size").cast("string"), F.lit(", "), F.col("p_partkey").cast("string"), F.lit(",x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(strings.int_list(text).cast("array<string>"), "|").alias("numbers"))


@register("option_keys", """SELECT p_partkey, '-k' || p_size AS key FROM part""")
def option_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('  ', repeat('-', cast(1 + p_partkey % 2 as int)), 'k', p_size, ' ')")
    return table(spark, sf_dir, "part").select("p_partkey", strings.option_key(text).alias("key"))

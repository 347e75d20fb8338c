"""Queries on estimators, formats and streams. Those that iterate have no SQL counterpart."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import estimators
from lumenfold.plans.image_queries import PX, rounded
from lumenfold.plans.registry import register
from lumenfold.session import shared_path
from lumenfold.sources import star
from lumenfold.sources.tables import ORDER, SIDE, images, table
from lumenfold.streaming import accumulate


@register("star_round_trip", """SELECT printf('%07d@class%d.mrcs', l_partkey, l_linenumber) AS "ImageName", 'mic_' || l_suppkey AS "MicrographName", l_linenumber AS "ClassNumber", round(10000 + l_quantity, 6) AS "DefocusU", count(*) AS n
FROM lineitem GROUP BY ALL""")
def star_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.expr("concat(lpad(cast(l_partkey as string), 7, '0'), '@class', l_linenumber, '.mrcs')").alias("ImageName"),
        F.expr("concat('mic_', l_suppkey)").alias("MicrographName"), F.col("l_linenumber").cast("int").alias("ClassNumber"), (F.col("l_quantity") + 10000).alias("DefocusU"),
        F.xxhash64(*ORDER).alias("inner_id"),
    )
    path = shared_path(spark, "star")
    star.write_star(rows, path, ["ImageName", "MicrographName", "ClassNumber", "DefocusU"])
    back = star.read_star(spark, path)
    return back.groupBy("ImageName", "MicrographName", "ClassNumber", F.round("DefocusU", 6).alias("DefocusU")).agg(F.count("*").alias("n"))


@register("streaming_class_average", f"""WITH {PX} SELECT label AS class_no, p, round(sum(v) / (count(*) + 0.01), 6) + 0.0 AS average FROM px GROUP BY ALL""")
def streaming_class_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = table(spark, sf_dir, "embeddings").schema
    # the source wants a folder: the table's file, or the files of its folder, are found by a pattern
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/embeddings.parque[t]")
    rows = stream.select("label", F.col("embedding").cast("array<double>").alias("pixels"), F.lit(1.0).alias("weight"))
    path = shared_path(spark, "sums")
    accumulate.accumulate(rows, path, shared_path(spark, "stream"), class_no="label").awaitTermination()
    found = accumulate.class_averages(spark, path)
    return rounded(found.withColumn("p", F.col("p").cast("long")), "average")


@register("pca_total_variance", f"""WITH {PX} SELECT round(sum(v), 6) AS total FROM (SELECT var_pop(v) AS v FROM px GROUP BY p)""")
def pca_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, values, _ = estimators.principal_axes(images(spark, sf_dir), SIDE * SIDE)
    return spark.createDataFrame([(round(float(values.sum()), 6),)], "total double")


@register("map2d_classes")
def map2d_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of five classes after eight rounds of classification with in-plane rotations."""
    model = estimators.classify_2d(images(spark, sf_dir), 5, 8, step=90.0)
    return spark.createDataFrame([(k + 1, float(s), float(model.sigma2)) for k, s in enumerate(model.shares)], "class_no long, share double, sigma2 double")


@register("gtm_assignment")
def gtm_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latent node of every image after ten rounds."""
    rows = images(spark, sf_dir)
    return estimators.assign_nodes(rows, estimators.fit_latent_map(rows, 8, 10)).select("vec_id", "class_no")


@register("gtm_fine_classes")
def gtm_fine_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes mapped again class by class."""
    rows = images(spark, sf_dir)
    return estimators.fine_classes(rows, estimators.fit_latent_map(rows, 4, 5), 3).select("vec_id", "class_no", "fine_class")


@register("deep_2d")
def deep_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification first, then a latent map of every class; one of fewer than 20 images is one node."""
    rows = images(spark, sf_dir)
    model = estimators.classify_2d(rows, 3, 4)
    as_map = estimators.LatentMap(np.eye(3), model.references, 1 / model.sigma2, model.references)
    named = estimators.assign_nodes(rows, as_map)
    parts = []
    for row in named.groupBy("class_no").agg(F.count("*").alias("n")).orderBy("class_no").collect():
        own = named.where(F.col("class_no") == row["class_no"])
        if row["n"] < 20:
            parts.append(own.withColumn("node", F.lit(1).cast("long")))
        else:
            parts.append(estimators.assign_nodes(own, estimators.fit_latent_map(own, 5, 5), out="node"))
    return functools.reduce(DataFrame.unionByName, parts).select("vec_id", "class_no", "node")


@register("reconstruction")
def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume from all images, with angles taken from their ids."""
    posed = images(spark, sf_dir).selectExpr("pixels", "cast(vec_id * 37 % 360 as double) as rot", "cast(vec_id * 17 % 180 as double) as tilt", "cast(vec_id * 7 % 360 as double) as psi")
    volume = estimators.reconstruct_volume(posed)
    return spark.createDataFrame([(z, y, x, float(volume[z, y, x])) for z, y, x in np.ndindex(volume.shape)], "z int, y int, x int, v double")

"""Stand-in views over the benchmark tables: particles, pixels, Fourier grid and optics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the square images in `embeddings`.
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a particle: micrograph, group, class, Pmax and pose from lineitem."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_suppkey as micrograph", "concat(l_returnflag, l_linestatus) as group_name", "l_linenumber as class_no",
        "1 - l_discount as pmax", "l_tax",
    )


#: Total order of particles.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and pixels (array of double)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("pixels"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: vec_id, label, p, y, x, v."""
    long = images(spark, sf_dir).select("vec_id", "label", F.posexplode("pixels").alias("p", "v"))
    return long.selectExpr("vec_id", "label", "p", f"p div {SIDE} as y", f"p % {SIDE} as x", "v")


def optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defocus and astigmatism of each part; voltage, aberration and contrast are constants."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "10000d + 100 * p_size as defocus_u", "10000d + p_retailprice as defocus_v", "cast(p_partkey % 180 as double) as angle"
    )

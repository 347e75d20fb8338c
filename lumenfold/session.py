"""Session helpers: configuration, shared scratch folder and package shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "lumenfold", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the library's defaults; on a cluster pass your own session instead."""
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("MASTER") and "spark.master" not in conf:
        builder = builder.master(f"local[{cores}]")
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_lumenfold_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lumenfold-"), "lumenfold_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("lumenfold", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._lumenfold_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one where that is unset and so is the master."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        context = spark.sparkContext
        conf = getattr(context, "_lumenfold_scratch", None)
        if conf is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            conf = context._lumenfold_scratch = tempfile.mkdtemp(prefix="lumenfold-shared-")
            context.setCheckpointDir(conf)
    return conf.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, which clear_scratch() removes."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    if not hasattr(context, "_lumenfold_paths"):
        context._lumenfold_paths = set()
    context._lumenfold_paths.add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenfold_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for these tables; no plan that reads them may run any more."""
    for df in tables:
        if path := getattr(df, "_lumenfold_path", None):
            _delete(df.sparkSession, path)
            getattr(df.sparkSession.sparkContext, "_lumenfold_paths", set()).discard(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all shared tables of this session, once their results have been read."""
    paths = getattr(spark.sparkContext, "_lumenfold_paths", set())
    while paths:
        _delete(spark, paths.pop())

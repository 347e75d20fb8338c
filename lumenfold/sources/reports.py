"""Symmetry definitions, orientation plots, viewer scripts and run state."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.sampling import axis_rotation, closure, point_group


def parse_symmetry(text: str) -> list[np.ndarray]:
    """All operations of a symmetry definition; without one, the text is a group's name.

    Lines: rot_axis FOLD X Y Z, mirror_plane X Y Z, inversion. Comments begin with ; or #.
    """
    generators = []
    for line in text.splitlines():
        words = line.split(";")[0].split("#")[0].split()
        if not words:
            continue
        if words[0] == "rot_axis":
            generators.append(axis_rotation(np.array(words[2:5], float), 360 / float(words[1])))
        elif words[0] == "mirror_plane":
            n = np.array(words[1:4], float)
            n /= np.linalg.norm(n)
            generators.append(np.eye(3) - 2 * np.outer(n, n))
        elif words[0] == "inversion":
            generators.append(-np.eye(3))
        elif len(text.split()) == 1:
            return point_group(words[0])
        else:
            raise ValueError(f"not a symmetry line: {line}")
    return closure(generators)


def orientation_lines(counts: DataFrame, radius: float = 100.0, rot: str = "rot", tilt: str = "tilt", n: str = "n") -> DataFrame:
    """(line): a cylinder for each direction, longer and redder the more particles it has."""
    stats = counts.agg(F.avg(n).alias("m"), F.stddev_pop(n).alias("s"), F.max(n).alias("top"))
    rows = counts.crossJoin(F.broadcast(stats))  # one row
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.when(F.col("s") > 0, (F.col(n) - F.col("m")) / F.col("s")).otherwise(0.0) / 6))
    r, t = F.radians(rot), F.radians(tilt)
    unit = [F.cos(r) * F.sin(t), F.sin(r) * F.sin(t), F.cos(t)]
    length = F.lit(radius) * (1 + 0.3 * F.col(n) / F.col("top"))
    color = F.format_string(".color %.3f 0.000 %.3f", score, 1 - score)
    bar = F.format_string(".cylinder %.3f %.3f %.3f %.3f %.3f %.3f 1.0", *[u * radius for u in unit], *[u * length for u in unit])
    return rows.select(F.concat_ws("\n", color, bar).alias("line"))


def viewer_script(volume: str, resolution: str, low: float, high: float) -> str:
    """Commands that open a volume and colour it by its resolution."""
    middle = (low + high) / 2
    return "\n".join(
        [f"open #0 {volume}", f"open #1 {resolution}", "volume #1 hide", f"scolor #0 volume #1 cmap {low:.2f},blue:{middle:.2f},white:{high:.2f},red", "colorkey 0.05,0.05 0.3,0.08"]
    )


def save_state(spark: SparkSession, path: str, iteration: int, arrays: dict[str, np.ndarray], values: dict[str, object] | None = None) -> None:
    """One Parquet folder an iteration with the arrays of a run; writing an iteration again replaces it."""
    rows = [(k, [int(n) for n in a.shape], [float(x) for x in a.ravel()], "") for k, a in arrays.items()]
    rows.append(("", [], [], json.dumps(values or {})))
    spark.createDataFrame(rows, "name string, shape array<int>, x array<double>, json string").write.mode("overwrite").parquet(f"{path}/iteration={iteration}")


def load_state(spark: SparkSession, path: str) -> tuple[int, dict[str, np.ndarray], dict[str, object]]:
    """The last saved iteration."""
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("iteration")).first()[0]
    arrays, values = {}, {}
    for r in stored.where(F.col("iteration") == last).collect():
        if r["name"]:
            arrays[r["name"]] = np.array(r["x"]).reshape(r["shape"])
        else:
            values = json.loads(r["json"])
    return last, arrays, values

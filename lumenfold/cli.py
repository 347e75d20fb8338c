"""Command line: python -m lumenfold.cli COMMAND -option value ...

Option rules: names may have one or two dashes; an option without value is "1"; a value that is a known option name begins
the next option; unknown options are named and skipped; -options FILE reads more of them.
"""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import images as kernels
from lumenfold.functions.numerics import zoom
from lumenfold.functions.strings import name_stack
from lumenfold.operators import estimators, map_em, particles, spectral
from lumenfold.operators.local_resolution import local_resolution
from lumenfold.session import get_spark
from lumenfold.sources import stacks, star

# The commands' options and their defaults; None: required.
_EM = {"pool": "50", "random_seed": "33", "ctf": "0", "only_flip_phases": "0", "ctf_phase_flipped": "0", "norm": "0", "zero_mask": "0"}
COMMANDS: dict[str, dict[str, str | None]] = {
    "map2d": {"i": None, "o": None, "K": None, "iter": None, "angpix": None, "tau2_fudge": None, "oversampling": None, "particle_diameter": "-1", "offset_step": "2", "offset_range": "10", "psi_step": "10"} | _EM,
    "map3d": {"i": None, "o": None, "ref": None, "K": None, "iter": None, "angpix": None, "healpix_order": None, "sym": "C1", "offset_step": "2", "offset_range": "10", "firstiter_cc": "0", "tau2_fudge": "4"} | _EM,
    "sml": {"i": None, "o": None, "K": None, "iter": None, "angpix": None, "dimension": "1", "pca": "0", "alpha": "0.01", "updatebeta": "1", "precision": "10e-12", "weightedsum": "1", "search": "NULL"},
    "deep2d": {"i": None, "o": None, "map2d_K": None, "sml_K": None, "map2d_iter": None, "sml_iter": None, "angpix": None, "tau2_fudge": None, "dimension": "1", "offset_step": "2", "offset_range": "10", "psi_step": "10"} | _EM,
    "reconstruct": {"i": None, "o": None, "angpix": None, "iter": "10", "refdim": "3", "sym": "c1", "ctf": "0", "maxres": "-1", "pad": "2"},
    "res": {"i": None, "o": None, "vxSize": "0", "pValue": "0.05", "minRes": "0", "maxRes": "5", "stepRes": "1"},
    "zoom": {"i": None, "n": None, "o": None},
    "compare": {"i1": None, "i2": None},
    "desc": {"i": None},
    "classaverage": {"i": None, "o": None, "K": None, "angpix": None, "averageBeta": "1", "averageAlpha": "0.01", "ctf": "0"},
    "convert": {"i": None, "o": None},
    "select": {"i": None, "o": None, "class": "1"},
    "adjust": {"i": None, "o": None},
    "applyfilter": {"i": None, "o": None, "filter": None},
    "clean": {"i": None, "o": None},
}


#: Options that are known but not built, by command, with the one value that they may have.
FIXED: dict[str, dict[str, str]] = {
    "map3d": {"norm": "0"},
    "sml": {"pca": "0", "precision": "10e-12", "weightedsum": "1"},
    "reconstruct": {"refdim": "3"},
}


class OptionError(ValueError):
    """Options that can't be used."""


def refuse_unbuilt(command: str, o: dict[str, str]) -> None:
    """An error where an option has a value that the command would not follow."""

    def same(a: str, b: str) -> bool:
        try:
            return float(a) == float(b)
        except ValueError:
            return a.lower() == b.lower()

    wrong = [f"-{k} {o[k]} (only {v})" for k, v in FIXED.get(command, {}).items() if not same(o[k], v)]
    if "," in (o.get("K") or "") and not (command == "sml" and len(o["K"].split(",")) == int(o["dimension"])):
        wrong.append(f"-K {o['K']} (one number, or in sml one for each dimension)")
    if wrong:
        raise OptionError(f"{command} can't use {', '.join(wrong)}")


def parse(arguments: list[str]) -> tuple[str, dict[str, str]]:
    """The command and its options with defaults filled in."""
    if not arguments or arguments[0].lstrip("-") not in COMMANDS:
        raise OptionError(f"commands: {', '.join(COMMANDS)}")
    command = arguments[0].lstrip("-")
    known = COMMANDS[command] | {"options": ""}
    found: dict[str, str] = {}
    rest = list(arguments[1:])
    while rest:
        name = rest.pop(0).strip().lstrip("-")
        if name not in known:
            print(f"unknown option {name}", file=sys.stderr)
            if rest and not rest[0].startswith("-"):
                rest.pop(0)
            continue
        is_option = bool(rest) and rest[0].startswith("-") and rest[0].lstrip("-") in known
        found[name] = rest.pop(0) if rest and not is_option else "1"
        if name == "options":
            with open(found.pop(name)) as f:
                rest = f.read().split() + rest
    values = {k: found.get(k, d) for k, d in known.items() if k != "options"}
    if missing := [k for k, v in values.items() if v is None]:
        raise OptionError(f"{command} needs -{', -'.join(missing)}")
    return command, values  # type: ignore[return-value]


@dataclass
class Inputs:
    """A particle table and its images."""

    table: DataFrame
    rows: DataFrame
    read: list[str]


def read_inputs(spark: SparkSession, path: str) -> Inputs:
    """Particles of a STAR file joined with the stacks that their names give, beside it if relative."""
    found = star.read_star(spark, path)
    table = star.with_defaults(found)
    folder = os.path.dirname(os.path.abspath(path))
    names = [r[0] for r in table.select(name_stack(F.col("ImageName"))).distinct().collect()]
    places = {n: n if os.path.isabs(n) else os.path.join(folder, n) for n in names}
    stack = stacks.read_stacks(spark, sorted(places.values()))
    back = spark.createDataFrame([(v, k) for k, v in places.items()], "name string, short string")
    stack = stack.join(F.broadcast(back), "name").drop("name").withColumnRenamed("short", "name").withColumn("pixels", F.col("pixels").cast("array<double>"))
    return Inputs(table, stacks.join_images(table, stack), [c for c in found.columns if c in star.LABELS])


def save_table(df: DataFrame, path: str, read: list[str] | None = None) -> None:
    """One STAR file at path, in any store that Spark writes to; the columns that were read are among its own."""
    folder = f"{path}.parts"
    star.write_star(df, folder, read=read)
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(make(path), False)
    files.rename(make(f"{folder}/part-00000.txt"), make(path))
    files.delete(make(folder), True)


def save_references(path: str, references: np.ndarray) -> None:
    n = int(round(references.shape[1] ** 0.5))
    stacks.write_mrc(path, references.reshape(-1, n, n).astype(np.float32))


def run(arguments: list[str], spark: SparkSession | None = None) -> None:
    """Run one command."""
    command, o = parse(arguments)
    refuse_unbuilt(command, o)
    if command in ("convert", "zoom", "compare", "desc"):
        return _files(command, o)
    spark = spark or get_spark()
    if command == "res":
        volume = stacks.read_mrc(o["i"]).astype(float)
        mask = np.abs(volume) > 2 * volume.std()
        voxel = float(o["vxSize"]) or 1.0
        found = local_resolution(spark, volume, mask, voxel, float(o["minRes"]) or 2.5 * voxel, float(o["maxRes"]) * voxel, float(o["stepRes"]), float(o["pValue"]))
        return stacks.write_mrc(o["o"], found.astype(np.float32), voxel)
    if command == "clean":
        table = star.read_star(spark, o["i"])
        labels = particles.relabel_classes(table.select(F.col("ClassNumber").alias("class_no"))).drop("n")
        named = table.join(labels, table["ClassNumber"] == labels["class_no"])
        placed, _ = particles.with_global_index(named, ["new_class", "inner_id"], "__place")
        order = placed.withColumns({"inner_id": F.col("__place"), "ClassNumber": F.col("new_class").cast("int")})
        return save_table(order.drop("class_no", "new_class", "__place"), o["o"], [c for c in table.columns if c in star.LABELS])
    both = read_inputs(spark, o["i"])
    rows = both.rows
    if command == "select":
        chosen = F.col("ClassNumber") == int(o["class"])
        return _save_stack(rows.where(chosen), both.table.where(chosen), o["o"], both.read)
    if command == "classaverage":
        transfer = "ctf" if o["ctf"] != "0" else None
        given = map_em.with_ctf(rows, float(o["angpix"]), _side(rows)) if transfer else rows
        average = map_em.class_averages(given, int(o["K"]), "ClassNumber", "MaxValueProbDistribution", float(o["averageAlpha"]), float(o["averageBeta"]), ctf=transfer)
        return save_references(o["o"], average.reshape(len(average), -1))
    if command in ("adjust", "applyfilter"):
        if command == "adjust":
            changed = _posed(rows)
            table = star.reset_pose(both.table)
        else:
            radius = float(o["filter"])
            changed, table = spectral.image_kernel(rows, lambda image: kernels.low_pass(image, radius)), both.table
        return _save_stack(changed, table, o["o"], both.read)
    if command == "map2d" and _whole_model(o):
        return _map2d(both, o)
    if command == "map2d":
        model = estimators.classify_2d(rows, int(o["K"]), int(o["iter"]), float(o["psi_step"]), float(o["offset_range"]), float(o["offset_step"]), float(o["tau2_fudge"]), int(o["random_seed"]))
        save_references(f"{o['o']}.mrcs", model.references)
        as_map = estimators.LatentMap(np.eye(len(model.references)), model.references, 1 / model.sigma2, model.references)
        return save_table(_with_class(rows, as_map), f"{o['o']}.star", both.read)
    if command == "sml":
        if o["search"] != "NULL":
            return save_table(_fine_search(rows, star.read_class_list(spark, o["search"]), int(o["iter"]), float(o["alpha"]), o["updatebeta"] != "0"), f"{o['o']}_fine.star", both.read)
        sizes = [int(k) for k in o["K"].split(",")]
        latent = estimators.fit_latent_map(rows, sizes if len(sizes) > 1 else sizes[0], int(o["iter"]), int(o["dimension"]), float(o["alpha"]), o["updatebeta"] != "0")
        save_references(f"{o['o']}.mrcs", latent.nodes)
        return save_table(_with_class(rows, latent), f"{o['o']}.star", both.read)
    if command == "deep2d":
        first = f"{o['o']}_map2d"
        run(["map2d", "-i", o["i"], "-o", first, "-K", o["map2d_K"], "-iter", o["map2d_iter"], "-angpix", o["angpix"], "-tau2_fudge", o["tau2_fudge"], "-oversampling", "0", "-psi_step", o["psi_step"], "-offset_range", o["offset_range"], "-offset_step", o["offset_step"], "-random_seed", o["random_seed"], *[x for k in ("ctf", "only_flip_phases", "ctf_phase_flipped", "norm", "zero_mask") for x in (f"-{k}", o[k])]], spark)
        for row in star.read_star(spark, f"{first}.star").groupBy("ClassNumber").count().where("count >= 20").orderBy("ClassNumber").collect():
            own = rows.drop("ClassNumber").join(star.read_star(spark, f"{first}.star").select("ImageName", "ClassNumber"), "ImageName").where(F.col("ClassNumber") == row["ClassNumber"])
            latent = estimators.fit_latent_map(own, int(o["sml_K"]), int(o["sml_iter"]), int(o["dimension"]))
            save_references(f"{o['o']}_class{row['ClassNumber']}.mrcs", latent.nodes)
        return None
    if command == "reconstruct":
        from lumenfold.operators.sampling import point_group

        side, pixel = _side(rows), float(o["angpix"])
        transfer = "ctf" if o["ctf"] != "0" else None
        given = map_em.with_ctf(_shifted(rows), pixel, side) if transfer else _shifted(rows)
        most = int(round(pixel * side / float(o["maxres"]))) if float(o["maxres"]) > 0 else None
        named = ("AngleRot", "AngleTilt", "AnglePsi")
        volume = estimators.reconstruct_volume(given, int(o["pad"]), angles=named, rounds=int(o["iter"]), ctf=transfer, symmetry=point_group(o["sym"]), most=most)
        return stacks.write_mrc(o["o"], volume.astype(np.float32), float(o["angpix"]))
    if command == "map3d":
        from lumenfold.operators.healpix import centres
        from lumenfold.operators.sampling import point_group

        start = stacks.read_mrc(o["ref"]).astype(float)
        rng = np.random.default_rng(int(o["random_seed"]))
        k, order, side, pixel = int(o["K"]), int(o["healpix_order"]), _side(rows), float(o["angpix"])
        volumes = np.stack([start * (1 + 0.05 * rng.normal(size=start.shape)) for _ in range(k)])
        if not _whole_model(o):
            volumes, _, _ = estimators.classify_3d(rows, volumes, centres(order), int(o["iter"]), 60.0 / 2**order, reach=float(o["offset_range"]), shift=float(o["offset_step"]))
            return _save_volumes(volumes, o["o"], pixel)
        given, transfer = _prepared(star.grouped(rows), o, side, pixel, side / 2)
        noise = map_em.start(given, 1, int(given.agg(F.max("__group")).first()[0]) + 1, group="__group").sigma2
        model = map_em.classify_volumes(
            given, map_em.Volumes(volumes, np.full(k, 1 / k), noise), centres(order), int(o["iter"]), 60.0 / 2**order, float(o["offset_range"]), float(o["offset_step"]),
            tau2_fudge=float(o["tau2_fudge"]), symmetry=point_group(o["sym"]), cc_first=o["firstiter_cc"] != "0", ctf=transfer, group="__group",
        )
        return _save_volumes(model.volumes, o["o"], pixel)
    return None


def _save_volumes(volumes: np.ndarray, base: str, pixel: float) -> None:
    for k, volume in enumerate(volumes):
        stacks.write_mrc(f"{base}_class{k + 1:03d}.mrc", volume.astype(np.float32), pixel)


def _side(rows: DataFrame) -> int:
    return int(round(rows.select(F.size("pixels")).first()[0] ** 0.5))


def _whole_model(o: dict[str, str]) -> bool:
    """Whether the options ask for transfer functions, group scales, masks, a second pass, symmetry or a first round by correlation."""
    known = ("ctf", "only_flip_phases", "ctf_phase_flipped", "norm", "zero_mask", "oversampling", "firstiter_cc")
    return any(o.get(k, "0") != "0" for k in known) or float(o.get("particle_diameter", -1)) > 0 or o.get("sym", "C1").upper() != "C1"


def _prepared(rows: DataFrame, o: dict[str, str], side: int, pixel: float, radius: float | None) -> tuple[DataFrame, str | None]:
    """Images with __group from 0, masked and with their transfer functions if the options ask for them, and the latter's column."""
    part = "sign" if o["only_flip_phases"] != "0" else "size" if o["ctf_phase_flipped"] != "0" else "whole"
    given = rows.withColumn("__group", F.col("GroupNumber") - 1)
    if o["zero_mask"] != "0" or (radius is not None and radius < side / 2):
        mask, reach = kernels.solvent_flatten if o["zero_mask"] != "0" else kernels.soft_mask, side / 2 if radius is None else radius
        given = spectral.image_kernel(given, lambda image: mask(image, reach - 5.0 if side > 16 else reach, 5.0))
    if o["ctf"] == "0":
        return given, None
    return map_em.with_ctf(given, pixel, side, part=part), "ctf"


def _map2d(both: Inputs, o: dict[str, str]) -> None:
    """map2d with noise by group and shell, and what the options ask for."""
    rows = both.rows
    side, pixel = _side(rows), float(o["angpix"])
    given, transfer = _prepared(star.grouped(rows), o, side, pixel, float(o["particle_diameter"]) / 2 / pixel if float(o["particle_diameter"]) > 0 else None)
    step, reach, shift, order = float(o["psi_step"]), float(o["offset_range"]), float(o["offset_step"]), int(o["oversampling"])
    model = map_em.classify(given, int(o["K"]), int(o["iter"]), step, reach, shift, order, float(o["tau2_fudge"]), int(o["random_seed"]), ctf=transfer, group="__group", scale=o["norm"] != "0")
    save_references(f"{o['o']}.mrcs", model.images.reshape(len(model.references), -1))
    grid = estimators.poses(step, reach, shift)
    fine = map_em.children(grid, 360 / np.ceil(360 / step), shift if reach else 0.0, order)[0] if order else grid
    found = map_em.assign(given, model, fine, ctf=transfer, group="__group")
    named = {"ClassNumber": "found.class_no", "MaxValueProbDistribution": "found.pmax", "LogLikeliContribution": "found.log_likelihood", "NrOfSignificantSamples": "found.significant", "AnglePsi": "found.psi", "OriginX": "-found.dx", "OriginY": "-found.dy"}
    save_table(found.withColumns({k: F.expr(v) for k, v in named.items()}).drop("found", "pixels", "n", "ctf", "__group"), f"{o['o']}.star", both.read)


def _fine_search(rows: DataFrame, plan: DataFrame, rounds: int, alpha: float, update_beta: bool) -> DataFrame:
    """Images of the listed classes mapped again, class by class, with classes numbered on."""
    parts, offset = [], 0
    for row in plan.orderBy("class_no").collect():
        own = rows.where(F.col("ClassNumber") == row["class_no"]).drop("ClassNumber")
        latent = estimators.fit_latent_map(own, int(row["fine"]), rounds, 1, alpha, update_beta)
        parts.append(estimators.assign_nodes(own, latent, out="ClassNumber").withColumn("ClassNumber", (F.col("ClassNumber") + offset).cast("int")))
        offset += int(row["fine"])
    return functools.reduce(DataFrame.unionByName, parts).drop("pixels", "n")


def _files(command: str, o: dict[str, str]) -> None:
    if command == "convert":
        stacks.convert(o["i"], o["o"])
    elif command == "zoom":
        n = int(o["n"])
        stacks.write_mrc(o["o"], zoom(stacks.read_mrc(o["i"]), (n, n, n)).astype(np.float32))
    elif command == "compare":
        a, b = stacks.read_mrc(o["i1"]), stacks.read_mrc(o["i2"])
        print(f"{int((a != b).sum())} of {a.size} voxels differ")
    else:
        a = stacks.read_mrc(o["i"])
        print(f"shape {a.shape} mean {a.mean():.6g} std {a.std():.6g} min {a.min():.6g} max {a.max():.6g} NaN {int(np.isnan(a).sum())}")


def _with_class(rows: DataFrame, model: estimators.LatentMap) -> DataFrame:
    named = estimators.assign_nodes(rows.drop("ClassNumber"), model, out="ClassNumber").withColumn("ClassNumber", F.col("ClassNumber").cast("int"))
    return named.drop("pixels", "n")


def _kernel_rows(rows: DataFrame, kernel, *columns: str) -> DataFrame:
    """rows with kernel(image, *values of columns) as pixels."""

    @F.arrow_udf("array<double>")
    def applied(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for pixels, *values in batches:
            out = []
            for image, *own in zip(pixels.to_pylist(), *(v.to_pylist() for v in values)):
                n = int(round(len(image) ** 0.5))
                out.append(kernel(np.array(image).reshape(n, n), *own).ravel().tolist())
            yield pa.array(out, pa.list_(pa.float64()))

    return rows.withColumn("pixels", applied("pixels", *columns))


def _shifted(rows: DataFrame) -> DataFrame:
    return _kernel_rows(rows, lambda image, dx, dy: kernels.translate(image, dx, dy), "OriginX", "OriginY")


def _posed(rows: DataFrame) -> DataFrame:
    return _kernel_rows(rows, lambda image, dx, dy, psi: kernels.rotate(kernels.translate(image, dx, dy), -psi), "OriginX", "OriginY", "AnglePsi")


def _save_stack(rows: DataFrame, table: DataFrame, path: str, read: list[str]) -> None:
    """The images in table order as path.mrcs and the renamed table as path.star; places need no window over all rows."""
    base = path[:-5] if path.endswith((".star", ".mrcs")) else path
    stacks.write_stack(rows, f"{base}.mrcs", "inner_id")
    placed, _ = particles.with_global_index(table, ["inner_id"], "__place")
    name = F.concat(F.lpad((F.col("__place") + 1).cast("string"), 7, "0"), F.lit(f"@{os.path.basename(base)}.mrcs"))
    save_table(placed.withColumn("ImageName", name).drop("__place"), f"{base}.star", read)


if __name__ == "__main__":
    try:
        run(sys.argv[1:])
    except OptionError as e:
        sys.exit(str(e))

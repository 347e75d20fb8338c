"""The state of a run as STAR files: model, sampling and optimiser, by field."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lumenfold.sources.star import read_model, write_model

# The keys of the general blocks, in order, with their defaults (None: the caller's).
MODEL_GENERAL: dict[str, object] = {
    "ReferenceDimensionality": 2, "OriginalImageSize": None, "CurrentResolution": 0.0, "CurrentImageSize": None, "PaddingFactor": 2,
    "FourierSpaceInterpolator": 1, "MinRadiusNnInterpolation": 10, "PixelSize": 1.0, "NrClasses": None, "NrGroups": None, "Tau2FudgeFactor": 4,
    "NormCorrectionAverage": 1.0, "SigmaOffsets": 10.0, "OrientationalPriorMode": 0, "SigmaPriorRotAngle": 0, "SigmaPriorTiltAngle": 0,
    "SigmaPriorPsiAngle": 0, "LogLikelihood": 0.0, "AveragePmax": 0.0,
}
SAMPLING_GENERAL: dict[str, object] = {
    "Is3DSampling": 0, "Is3DTranslationalSampling": 0, "HealpixOrder": 0, "SymmetryGroup": "C1", "TiltAngleLimit": -91, "PsiStep": 10.0,
    "OffsetRange": 10.0, "OffsetStep": 2.0, "SamplingPerturbInstance": 0.0, "SamplingPerturbFactor": 0.5,
}
OPTIMISER_GENERAL: dict[str, object] = {
    "OutputRootName": None, "ModelStarFile": None, "ExperimentalDataStarFile": None, "OrientSamplingStarFile": None, "CurrentIteration": 0,
    "NumberOfIterations": None, "DoSplitRandomHalves": 0, "JoinHalvesUntilThisResolution": -1.0, "AdaptiveOversampleOrder": 0,
    "AdaptiveOversampleFraction": 0.999, "RandomSeed": 33, "ParticleDiameter": 999, "WidthMaskEdge": 5, "DoZeroMask": 0, "DoSolventFlattening": 0,
}


def _general(keys: dict[str, object], values: dict[str, object], what: str) -> dict[str, object]:
    """The keys in their order with the values given, else their defaults."""
    if unknown := set(values) - set(keys):
        raise ValueError(f"no {what} field: {', '.join(sorted(unknown))}")
    found = keys | values
    if missing := [k for k, v in found.items() if v is None]:
        raise ValueError(f"{what} needs {', '.join(missing)}")
    return found


def _typed(keys: dict[str, object], row: dict[str, str]) -> dict[str, object]:
    """Values of the types of their defaults; a key without default is an integer if it reads as one."""

    def value(k: str) -> object:
        text, default = row[k], keys[k]
        if isinstance(default, str):
            return text
        try:
            number = float(text)
        except ValueError:
            return text
        return number if isinstance(default, float) or not number.is_integer() else int(number)

    return {k: value(k) for k in keys if k in row}


def write_sampling(spark: SparkSession, path: str, directions: np.ndarray, **values: object) -> None:
    """The sampling's keys and its directions (rot, tilt)."""
    rows = [{"AngleRot": float(r), "AngleTilt": float(t)} for r, t in directions]
    write_model(spark, {"data_sampling_general": [_general(SAMPLING_GENERAL, values, "sampling")], "data_sampling_directions": rows}, path)


def read_sampling(spark: SparkSession, path: str) -> tuple[dict[str, object], DataFrame]:
    """The sampling's values, and (AngleRot, AngleTilt) of its directions."""
    blocks = read_model(spark, path)
    general = blocks["data_sampling_general"].first().asDict()
    directions = blocks.get("data_sampling_directions")
    if directions is None:
        directions = spark.createDataFrame([], "AngleRot string, AngleTilt string")
    return _typed(SAMPLING_GENERAL, general), directions.selectExpr("cast(AngleRot as double) as AngleRot", "cast(AngleTilt as double) as AngleTilt")


def write_optimiser(spark: SparkSession, path: str, root: str, iteration: int, **values: object) -> None:
    """The optimiser's keys; the files beside it are named by the root and the iteration."""
    base = f"{root}_it{iteration:03d}"
    names = {"OutputRootName": root, "ModelStarFile": f"{base}_model.star", "ExperimentalDataStarFile": f"{base}_data.star", "OrientSamplingStarFile": f"{base}_sampling.star", "CurrentIteration": iteration}
    write_model(spark, {"data_optimiser_general": [_general(OPTIMISER_GENERAL, names | values, "optimiser")]}, path)


def read_optimiser(spark: SparkSession, path: str) -> dict[str, object]:
    return _typed(OPTIMISER_GENERAL, read_model(spark, path)["data_optimiser_general"].first().asDict())


def write_model_state(spark: SparkSession, path: str, side: int, shares: np.ndarray, sigma2: np.ndarray, group_names: list[str], group_sizes: list[int], scales: np.ndarray, spectra: dict[str, np.ndarray] | None = None, directions: np.ndarray | None = None, root: str = "run", **values: object) -> None:
    """A model's general keys, classes, groups, noise spectra by group and, by class, spectra and direction shares.

    spectra: SsnrMap, GoldStandardFsc, ReferenceSigma2 and ReferenceTau2, (classes, shells) each; those missing are 0.
    """
    k, shells = len(shares), side // 2 + 1
    general = _general(MODEL_GENERAL, {"OriginalImageSize": side, "CurrentImageSize": side, "NrClasses": k, "NrGroups": len(group_names)} | values, "model")
    length = float(general["PixelSize"]) * side  # type: ignore[arg-type]
    blocks: dict[str, list[dict[str, object]]] = {"data_model_general": [general]}
    blocks["data_model_classes"] = [{"ReferenceImage": f"{root}_class{c + 1:03d}.mrc", "ClassDistribution": float(p), "AccuracyRotations": 999.0, "AccuracyTranslations": 999.0} for c, p in enumerate(shares)]
    names = ("SsnrMap", "GoldStandardFsc", "ReferenceSigma2", "ReferenceTau2")
    for c in range(k):
        of = {n: (spectra or {}).get(n, np.zeros((k, shells)))[c] for n in names}
        blocks[f"data_model_class_{c + 1}"] = [
            {"SpectralIndex": s, "Resolution": s / length, "AngstromResolution": length / s if s else 999.0, **{n: float(of[n][s]) for n in names}, "SpectralOrientabilityContribution": float(s == 0)} for s in range(shells)
        ]
    blocks["data_model_groups"] = [{"GroupNumber": g + 1, "GroupName": n, "GroupNrParticles": int(m), "GroupScaleCorrection": float(x)} for g, (n, m, x) in enumerate(zip(group_names, group_sizes, scales))]
    for g in range(len(group_names)):
        blocks[f"data_model_group_{g + 1}"] = [{"SpectralIndex": s, "Resolution": s / length, "Sigma2Noise": float(sigma2[g][s])} for s in range(shells)]
    if directions is not None:
        for c in range(k):
            blocks[f"data_model_pdf_orient_class_{c + 1}"] = [{"OrientationDistribution": float(p)} for p in directions[c]]
    write_model(spark, blocks, path)


def read_model_state(spark: SparkSession, path: str) -> dict[str, object]:
    """general (values by key), shares, group_names, group_sizes, scales, sigma2 (groups, shells) and spectra by name."""
    blocks = read_model(spark, path)
    rows = lambda name: [r.asDict() for r in blocks[name].collect()]  # noqa: E731  blocks are of the model's size
    general = _typed(MODEL_GENERAL, rows("data_model_general")[0])
    classes, groups = rows("data_model_classes"), rows("data_model_groups")
    names = ("SsnrMap", "GoldStandardFsc", "ReferenceSigma2", "ReferenceTau2")
    by_class = [rows(f"data_model_class_{c + 1}") for c in range(len(classes))]
    return {
        "general": general,
        "shares": np.array([float(r["ClassDistribution"]) for r in classes]),
        "group_names": [r["GroupName"] for r in groups],
        "group_sizes": [int(r["GroupNrParticles"]) for r in groups],
        "scales": np.array([float(r["GroupScaleCorrection"]) for r in groups]),
        "sigma2": np.array([[float(r["Sigma2Noise"]) for r in rows(f"data_model_group_{g + 1}")] for g in range(len(groups))]),
        "spectra": {n: np.array([[float(r[n]) for r in one] for one in by_class]) for n in names},
    }

"""Numerics against closed forms, and local resolution on a small volume."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import numerics
from lumenfold.operators import local_resolution


def test_special_functions(spark):
    assert numerics.bessel_i(0, np.array([1.0]))[0] == pytest.approx(1.2660658778)
    assert numerics.bessel_i_half(0, np.array([1.0]))[0] == pytest.approx(math.sqrt(2 / math.pi) * math.sinh(1))
    assert numerics.bessel_j(0, np.array([2.0]))[0] == pytest.approx(0.2238907791, abs=1e-9)
    assert numerics.bessel_j(1.5, np.array([2.0]))[0] == pytest.approx(0.4912937787, abs=1e-8)
    assert numerics.kaiser_blob(np.array([0.0, 1.9, 3.0])).tolist() == pytest.approx([1, 1 / numerics.bessel_i(0, np.array(15.0)), 0])
    assert numerics.normal_cdf(np.array([1.96]))[0] == pytest.approx(0.9750021, abs=1e-6)
    assert spark.range(1).select(numerics.erf_column(F.lit(0.5))).first()[0] == pytest.approx(math.erf(0.5))


def test_minimum_fit_and_chi2():
    x, fx = numerics.minimise(lambda t: (t - 1.3) ** 2 + 2, -4, 9)
    assert (x, fx) == (pytest.approx(1.3, abs=1e-5), pytest.approx(2))
    t = np.linspace(0, 1, 20)
    assert numerics.polynomial_fit(t, 3 * t * t - t + 2, 2) == pytest.approx([3, -1, 2])
    assert numerics.weighted_chi2_cdf(3.841459, np.array([1.0, 1e-6])) == pytest.approx(0.95, abs=0.01)
    assert numerics.weighted_chi2_cdf(2 * math.log(2), np.ones(2)) == pytest.approx(0.5, abs=1e-3)


def test_filters_and_distances():
    a = np.zeros((9, 9))
    a[4, 4] = 1
    assert numerics.gaussian_filter(a, 1.0).sum() == pytest.approx(1)
    mask = np.ones((5, 5), bool)
    mask[2, 2] = False
    assert numerics.taxicab_distance(mask)[0, 0] == 4
    assert numerics.dilate(~mask, 1).sum() == 5
    assert numerics.zoom(np.arange(5.0), (9,)).tolist() == pytest.approx(np.arange(0, 4.5, 0.5).tolist())
    assert numerics.frequency_filter(np.ones((4, 4, 4)), 0.1) == pytest.approx(np.ones((4, 4, 4)))
    t = np.arange(100)
    y = np.exp(-((t - 30) ** 2) / 20) + np.exp(-((t - 70) ** 2) / 20) + np.random.default_rng(0).normal(0, 1e-3, 100)
    found = numerics.ridge_peaks(y, np.arange(1, 10))
    assert any(abs(p - 30) <= 2 for p in found) and any(abs(p - 70) <= 2 for p in found)
    m = numerics.align_with_z(np.array([1.0, 2.0, -0.5]))
    assert m @ np.array([1.0, 2.0, -0.5]) == pytest.approx([0, 0, math.sqrt(5.25)]) and m @ m.T == pytest.approx(np.eye(3))


def test_local_resolution_is_finer_where_there_is_detail(spark):
    rng = np.random.default_rng(3)
    n = 16
    z, y, x = np.mgrid[:n, :n, :n]
    volume = rng.normal(0, 0.3, (n, n, n))
    volume[:, :, : n // 2] += 2 * np.sin(2 * np.pi * (x + z) / 6)[:, :, : n // 2]
    got = local_resolution.local_resolution(spark, volume, np.ones((n, n, n), bool), 1.0, 3.0, 5.0, 1.0)
    assert (got[:, :, 2:6] < 100).mean() > 0.8 and (got[:, :, 11:14] < 100).mean() < 0.3
    white = local_resolution.pre_whiten(volume, np.zeros((n, n, n), bool))
    assert white.shape == volume.shape and np.isfinite(white).all()
    assert local_resolution.low_pass_factor(local_resolution.spherical_spectrum(volume)) == 0

"""The longitude factor against a search in numpy."""

from __future__ import annotations

import math

import numpy as np

from tributary.functions import geo
from tributary.operators import calibration, spatial


def pairs_around(n: int, seed: int = 1) -> np.ndarray:
    """Columns lat_a, lon_a, lat_b, lon_b, distance on the sphere, around the middle of Czechia."""
    rng = np.random.default_rng(seed)
    p = np.stack([49.74 + rng.normal(size=n), 15.33 + 2 * rng.normal(size=n), 49.74 + rng.normal(size=n), 15.33 + 2 * rng.normal(size=n)], axis=1)
    return np.column_stack([p, spatial.circle(p[:, 0], p[:, 1], p[:, 2], p[:, 3])])


def frame(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) if r is not None else None for r in rows], "lat_a double, lon_a double, lat_b double, lon_b double, distance double")


def error(p: np.ndarray, factor: float) -> float:
    return np.abs(np.hypot((p[:, 0] - p[:, 2]) * geo.KM_LATITUDE, (p[:, 1] - p[:, 3]) * factor) - p[:, 4]).sum() / p[:, 4].sum()


def test_within_a_metre_of_a_full_search(spark):
    p = pairs_around(2000)
    factor, least = calibration.longitude_factor(frame(spark, p))
    tried = np.arange(factor - 0.5, factor + 0.5, 0.0005)
    best = tried[np.argmin([error(p, f) for f in tried])]
    assert abs(factor - best) < 0.001
    assert least == min(least, error(p, 0.99 * factor), error(p, 1.01 * factor)) and math.isclose(least, error(p, factor), rel_tol=1e-9)
    assert abs(factor - geo.KM_LONGITUDE) < 1


def test_all_errors_in_one_pass(spark):
    p, factors = pairs_around(300, 2), np.array([50.0, 71.941, 90.0])
    odd = spark.createDataFrame([(None, 1.0, 2.0, 3.0, 4.0), (1.0, 1.0, 2.0, 3.0, float("nan"))], frame(spark, p).schema)
    found = calibration.errors(frame(spark, p).unionByName(odd).repartition(5), factors)
    assert np.allclose(found, [error(p, f) for f in factors])


def test_no_pairs(spark):
    assert all(map(math.isnan, calibration.longitude_factor(frame(spark, pairs_around(2)).limit(0))))

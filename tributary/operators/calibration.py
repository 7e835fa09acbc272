"""Calibration of the planar approximation: the kilometres to a degree of longitude at which it errs least.

The error of a factor is the sum of absolute differences of planar and given distances, over the sum of the latter. One pass
over the pairs adds up the errors of all candidates at once, an array for each batch; the next pass narrows the range to
the neighbours of the best one. Only arrays of ``candidates`` numbers leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def errors(pairs: DataFrame, factors: np.ndarray) -> np.ndarray:
    """The error of each factor over (lat_a, lon_a, lat_b, lon_b, distance); rows with a null or NaN are left out."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 2_000_000 // len(factors))
        for batch in batches:
            y, x, d = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            total = np.zeros(len(factors))
            for a in range(0, len(d), step):
                cut = slice(a, a + step)
                total += np.abs(np.hypot(y[cut, None], x[cut, None] * factors) - d[cut, None]).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64())), pa.array([float(d.sum())])], names=["sums", "total"])

    gaps = [((F.col("lat_a") - F.col("lat_b")) * geo.KM_LATITUDE).alias("y"), (F.col("lon_a") - F.col("lon_b")).alias("x"), F.col("distance").cast("double").alias("d")]
    sound = pairs.select(*gaps).where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("y", "x", "d")))
    parts = sound.mapInArrow(add, "sums array<double>, total double")
    total = parts.agg(F.sum("total")).first()[0]
    rows = parts.select(F.posexplode("sums").alias("at", "error")).groupBy("at").agg(F.sum("error").alias("error")).orderBy("at").collect()
    return np.array([r["error"] for r in rows]) / total if total else np.full(len(factors), np.nan)


def longitude_factor(pairs: DataFrame, low: float = 0.0, high: float = geo.KM_LATITUDE, candidates: int = 1001, passes: int = 2) -> tuple[float, float]:
    """(factor, its error) after ``passes`` narrowings, each ``(candidates - 1) / 2`` times as fine as the one before; NaN without pairs."""
    best, error = float("nan"), float("nan")
    for _ in range(passes):
        factors = np.linspace(low, high, candidates)
        found = errors(pairs, factors)
        if np.isnan(found).all():
            break
        k = int(np.argmin(found))
        best, error = float(factors[k]), float(found[k])
        low, high = factors[max(0, k - 1)], factors[min(candidates - 1, k + 1)]
    return best, error

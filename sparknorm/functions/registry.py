"""Kernels of one series as SQL functions, for ``spark.sql`` and ``F.expr``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import signal

#: kernels of rows of equal length
SERIES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "permutation_entropy": signal.permutation_entropies,
    "sample_entropy": signal.sample_entropies,
    "spectral_flatness": lambda x: signal.spectral_entropy(signal.welch(x, 1.0)[1]) if x.shape[1] > 3 else np.full(len(x), np.nan),
}


def series_udf(kernel: Callable[[np.ndarray], np.ndarray]):
    """A pandas UDF of an array of doubles; a null, empty or non-finite series, and one for which the kernel is not defined, gives null. Series of one length go through the kernel together."""

    def run(column: pd.Series) -> pd.Series:
        values = [np.asarray([] if v is None else v, float) for v in column]
        sizes = np.array([len(v) if np.isfinite(v).all() else 0 for v in values], int)
        out = np.full(len(values), np.nan)
        for n in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == n)
            out[at] = kernel(np.stack([values[i] for i in at]))
        return pd.Series([v if v == v else None for v in out.tolist()], dtype=object)

    return F.pandas_udf(run, "double")


def register(spark: SparkSession) -> list[str]:
    for name, kernel in SERIES.items():
        spark.udf.register(name, series_udf(kernel))
    return list(SERIES)

"""Channels of recordings: which are used, their quality, and those that are restored from their neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparknorm.functions import signal as S

from . import extract, graph

QUALITY = ["n_channels", "duration_s", "mean_abs_uv", "std_mean_uv", "line_ratio"]
COMPLEXITY = ["permutation_entropy", "sample_entropy"]


def used(signals: DataFrame, bad: DataFrame | None = None, montage: DataFrame | None = None) -> DataFrame:
    """Channels that are not listed as bad (subject, run, channel) and, with a montage (channel), stand in it. Names are compared without case and blanks; a montage's name counts once however often it is listed."""
    name = F.upper(F.trim("channel"))
    rows = signals.withColumn("_name", name)
    if bad is not None:
        rows = rows.join(bad.select("subject", "run", name.alias("_name")), ["subject", "run", "_name"], "left_anti")
    if montage is not None:
        rows = rows.join(montage.select(name.alias("_name")), "_name", "left_semi")
    return rows.select(signals.columns)


def spreads(signals: DataFrame) -> DataFrame:
    """Rows (subject, run, channel, ch_idx, std): each channel's population deviation, null where it has no finite sample throughout."""
    fine = F.forall("samples", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("samples") > 0)
    mean = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v) / F.size("samples")
    rows = signals.where(F.col("samples").isNotNull()).withColumn("_m", F.when(fine, mean))
    square = F.aggregate("samples", F.lit(0.0), lambda s, v: s + (v - F.col("_m")) * (v - F.col("_m")))
    return rows.select("subject", "run", "channel", "ch_idx", F.when(F.col("_m").isNotNull(), F.sqrt(square / F.size("samples"))).alias("std"))


def bad_channels(signals: DataFrame, limit: float = 5.0) -> DataFrame:
    """(subject, run, channel) of channels whose deviation is an upper outlier of its run, or that have samples that are no numbers."""
    marked = graph.robust_outliers(spreads(signals), ["subject", "run"], "std", limit)
    return marked.where("bad or std is null").select("subject", "run", "channel")


def quality(signals: DataFrame) -> DataFrame:
    """One row a run: channels, duration, mean absolute value, mean deviation and mains noise."""
    return extract.per_recording(signals, S.recording_quality, QUALITY)


def complexity(signals: DataFrame) -> DataFrame:
    """One row a run: permutation and sample entropy, means over channels."""
    return extract.per_recording(signals, lambda x, _: S.complexity(x), COMPLEXITY)


def coherence_edges(signals: DataFrame, low: float, high: float, size: int = 256) -> DataFrame:
    """The mean coherence of each pair of channels over a band: subject, run, a, b, w."""
    return extract.edges(signals, lambda x, sfreq: S.coherence(x, sfreq, low, high, size))


def spline(cosine: np.ndarray, order: int = 4, terms: int = 50) -> np.ndarray:
    """The spherical spline's kernel: a Legendre series of the cosine between two places."""
    n = np.arange(1, terms + 1)
    series = np.concatenate([[0.0], (2 * n + 1) / (n**order * (n + 1.0) ** order) / (4 * np.pi)])
    return np.polynomial.legendre.legval(np.clip(cosine, -1, 1), series)


def restoring(known: np.ndarray, wanted: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """The matrix that takes values at known places to wanted ones (both unit rows): the spline through them whose weights add up to nothing, and a constant."""
    n = len(known)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = spline(known @ known.T) + ridge * np.eye(n)
    system[n, n] = 0
    values = np.vstack([np.eye(n), np.zeros(n)])
    return np.column_stack([spline(wanted @ known.T), np.ones(len(wanted))]) @ np.linalg.solve(system, values)


def interpolated(signals: DataFrame, places: DataFrame, bad: DataFrame, keys: tuple[str, ...] = ("subject", "run")) -> DataFrame:
    """Signals whose bad channels (subject, run, channel) are restored from the others of their run; the rest is returned as it is.

    ``places`` has channel, x, y, z, on a sphere of any radius. A channel
    without a place, or with a null one, raises ValueError that names it. Rows
    may be whole channels or, with ``start`` among the keys, time blocks, so
    that a group is as large as a block. A run with fewer than three good
    channels is returned as it is.
    """
    name = F.upper(F.trim("channel"))
    spots = places.select(name.alias("_name"), *[F.col(c).cast("double").alias(f"_{c}") for c in "xyz"]).dropDuplicates(["_name"])
    rows = signals.withColumn("_name", name).join(spots, "_name", "left")
    flags = bad.select("subject", "run", name.alias("_name"), F.lit(True).alias("_bad")).distinct()
    rows = rows.join(flags, ["subject", "run", "_name"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    ill = rows.groupBy(*keys).agg(F.max("_bad").alias("_any"))
    touched = rows.join(ill.where("_any").drop("_any"), list(keys), "left_semi")
    plain = rows.join(ill.where("_any").drop("_any"), list(keys), "left_anti").select(signals.columns)
    columns = signals.columns

    def restore(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["_x", "_y", "_z"]].to_numpy(float)
        length = np.linalg.norm(at, axis=1)
        if not (np.isfinite(length) & (length > 0)).all():
            raise ValueError(f"channels without a place: {sorted(pdf.loc[~(np.isfinite(length) & (length > 0)), 'channel'])}")
        at = at / length[:, None]
        ill = pdf["_bad"].to_numpy(bool)
        if (~ill).sum() >= 3:
            x = np.stack(pdf.loc[~ill, "samples"].to_list()).astype(float)
            pdf = pdf.copy()
            values = pdf["samples"].to_list()
            for i, row in zip(np.flatnonzero(ill), restoring(at[~ill], at[ill]) @ x, strict=True):
                values[i] = row
            pdf["samples"] = values
        return pdf[columns]

    return plain.unionByName(touched.groupBy(*keys).applyInPandas(restore, signals.schema))

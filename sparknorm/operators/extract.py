"""From signals to features: one grouped Arrow call a run, then subject rows.

A group holds the channels of one run, so its size is set by the recording and
not by the table. A run that cannot be read gives a row with its error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparknorm.functions import signal as S
from sparknorm.functions.contract import BANDS, C_METRICS, D_METRICS, EPS, FEATURES, G_METRICS, NETWORK_BANDS

from . import aggregate

POWERS = [f"{b}_abs" for b in BANDS]
RUN_COLUMNS = [*POWERS, "spectral_entropy_mean", *[f"{m}_{b}" for m in (*C_METRICS, *G_METRICS, "lambda2", *D_METRICS) for b in NETWORK_BANDS]]


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    """Channels in order, times samples. Unequal lengths or missing samples raise ValueError."""
    rows = pdf.sort_values("ch_idx")["samples"].tolist()
    if len({len(r) for r in rows}) != 1:
        raise ValueError("channels differ in length")
    x = np.array(rows, float)
    if not np.isfinite(x).all():
        raise ValueError("samples are not finite")
    return x


def run_features(x: np.ndarray, sfreq: float, notch: float | None = 60.0, window_s: float = 10.0, step_s: float = 5.0) -> dict[str, float]:
    """All features of one run."""
    x = S.preprocess(x, sfreq, notch=notch)
    hz, psd = S.welch(x * 1e6, sfreq)
    at = (hz >= 1) & (hz <= 45)
    power = S.band_powers(hz[at], psd[:, at])
    out = {p: power[p] for p in POWERS} | {"spectral_entropy_mean": float(S.spectral_entropy(psd[:, at]).mean())}
    for band in NETWORK_BANDS:
        y = S.band_pass(x, *BANDS[band], sfreq)  # the whole run is filtered before it is cut
        w = S.phase_locking(y)
        edge = w[np.triu_indices(len(w), 1)]
        row = {"plv_mean": float(edge.mean()) if len(edge) else math.nan, "plv_median": float(np.median(edge)) if len(edge) else math.nan} | S.graph_metrics(w)
        series = [S.phase_locking(y[:, a:b]) for a, b in S.windows(y.shape[1], sfreq, window_s, step_s)]
        d = S.transition_summary(S.transitions(series))
        each = [S.graph_metrics(m)["degree_cv"] for m in series]
        row |= {"mean_delta": d["mean_delta"], "cv_delta": d["cv_delta"], "mean_degree_cv": float(np.mean(each)) if each else math.nan, "temporal_cv_degree_cv": float(np.std(each) / (abs(np.mean(each)) + EPS)) if each else math.nan}
        out |= {f"{m}_{band}": v for m, v in row.items()}
    return out


def extract_runs(signals: DataFrame, notch: float | None = 60.0, window_s: float = 10.0, step_s: float = 5.0) -> DataFrame:
    """One row a subject and run: status, error, and the run's features (null after an error)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            f = run_features(matrix(pdf), float(pdf["sfreq"].iloc[0]), notch, window_s, step_s)
            status, error = "ok", None
        except (ValueError, np.linalg.LinAlgError, IndexError) as e:
            f, status, error = {}, "error", str(e)
        return pd.DataFrame([[*key, status, error, *[f.get(c) for c in RUN_COLUMNS]]], columns=["subject", "run", "status", "error", *RUN_COLUMNS])

    schema = "subject string, run string, status string, error string, " + ", ".join(f"{c} double" for c in RUN_COLUMNS)
    return signals.groupBy("subject", "run").applyInPandas(run, schema)


def subject_features(runs: DataFrame) -> DataFrame:
    """The 54 features of each subject: relative powers from mean absolute ones, all others as means over runs."""
    good = runs.where("status = 'ok'").select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in RUN_COLUMNS else F.col(c) for c in runs.columns])
    power = aggregate.ratio_of_means(good, POWERS, "subject")
    rest = aggregate.subject_mean(good, [c for c in RUN_COLUMNS if c not in POWERS], "subject")
    ratio = lambda a, b: F.log((F.col(f"{a}_abs") + EPS) / (F.col(f"{b}_abs") + EPS)).alias(f"log_{a}_{b}")
    se = power.select("subject", *[F.col(f"{b}_abs_rel").alias(f"{b}_rel") for b in BANDS], ratio("theta", "alpha"), ratio("theta", "beta"))
    return rest.join(se, "subject").select(F.col("subject").alias("participant_id"), "n_runs", *FEATURES)


def per_recording(signals: DataFrame, kernel, columns: list[str], keys: tuple[str, ...] = ("subject", "run")) -> DataFrame:
    """Applies a kernel (matrix, sfreq) -> dict of numbers to each recording."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = kernel(matrix(pdf), float(pdf["sfreq"].iloc[0]))
        return pd.DataFrame([[*key, *[got[c] for c in columns]]], columns=[*keys, *columns])

    return signals.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {signals.schema[k].dataType.simpleString()}" for k in keys], *[f"{c} double" for c in columns]]))


def edges(signals: DataFrame, weights, keys: tuple[str, ...] = ("subject", "run")) -> DataFrame:
    """A connectivity kernel's matrix as an edge list: keys, a, b, w with a < b."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ch_idx")
        w = weights(matrix(pdf), float(pdf["sfreq"].iloc[0]))
        i, j = np.triu_indices(len(w), 1)
        ch = pdf["ch_idx"].to_numpy()
        out = pd.DataFrame({"a": ch[i], "b": ch[j], "w": w[i, j]})
        for n, (k, v) in enumerate(zip(keys, key, strict=True)):
            out.insert(n, k, v)
        return out

    return signals.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {signals.schema[k].dataType.simpleString()}" for k in keys], "a int, b int, w double"]))

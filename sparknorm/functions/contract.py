"""The feature contract: bands, blocks, canonical column order."""

from __future__ import annotations

from pyspark.sql import types as T

# Half-open frequency bands in Hz, metric names, and their order.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}
NETWORK_BANDS = ("theta", "alpha", "beta", "gamma")
SE = ("alpha_rel", "beta_rel", "theta_rel", "spectral_entropy_mean", "log_theta_alpha", "log_theta_beta")
C_METRICS = ("plv_mean", "plv_median")
G_METRICS = ("mean_degree", "degree_cv", "clustering", "global_efficiency", "mean_path_length", "laplacian_entropy")
D_METRICS = ("mean_delta", "cv_delta", "mean_degree_cv", "temporal_cv_degree_cv")
EPS = 1e-12
REFERENCE_AGE = (8.0, 13.0)

BLOCKS: dict[str, tuple[str, ...]] = {"SE": SE} | {name: tuple(f"{m}_{b}" for m in metrics for b in NETWORK_BANDS) for name, metrics in (("C", C_METRICS), ("G", G_METRICS), ("D", D_METRICS))}
FEATURES: tuple[str, ...] = tuple(f for block in BLOCKS.values() for f in block)
AUXILIARY: tuple[str, ...] = tuple(f"lambda2_{b}" for b in NETWORK_BANDS)


def subject_schema(extra: tuple[str, ...] = ()) -> T.StructType:
    """One row a subject: id, age, group, and the features in canonical order."""
    fields = [T.StructField("participant_id", T.StringType(), False), T.StructField("age", T.DoubleType()), T.StructField("group", T.StringType())]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in (*FEATURES, *extra)])


SIGNALS = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("ch_idx", T.IntegerType()),
        T.StructField("sfreq", T.DoubleType()),
        T.StructField("samples", T.ArrayType(T.DoubleType())),
    ]
)


def require(columns: list[str], needed: list[str] | tuple[str, ...]) -> None:
    """Raises KeyError that lists what a table lacks."""
    missing = [c for c in needed if c not in columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")

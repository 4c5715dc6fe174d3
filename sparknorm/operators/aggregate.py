"""From runs to subjects, pivots and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparknorm.functions import columns as C
from sparknorm.functions.contract import EPS

from . import stats


def subject_mean(runs: DataFrame, features: Sequence[str], key: str = "participant_id", meta: Sequence[str] = (), order: str = "run") -> DataFrame:
    """Means over runs that skip NaN, the number of runs, and each meta column's first value in run order that is not null."""
    firsts = [F.min_by(F.col(m), F.when(F.col(m).isNotNull(), F.col(order))).alias(m) for m in meta]
    return runs.groupBy(key).agg(*firsts, *[F.avg(C.clean(F.col(f).cast("double"))).alias(f) for f in features], F.count(F.lit(1)).alias("n_runs"))


def ratio_of_means(runs: DataFrame, powers: Sequence[str], key: str = "participant_id", eps: float = EPS) -> DataFrame:
    """Mean absolute powers first, relative ones from them."""
    mean = runs.groupBy(key).agg(*[F.avg(p).alias(p) for p in powers])
    parts = C.relative([F.col(p) for p in powers], eps)
    return mean.select("*", *[c.alias(f"{p}_rel") for c, p in zip(parts, powers, strict=True)])


def band_pivot(rows: DataFrame, key: str, band: str, bands: Sequence, metrics: Sequence[str]) -> DataFrame:
    """Wide columns ``metric_band``; the bands are stated, so no pass looks for them."""
    wide = rows.groupBy(key).pivot(band, list(bands)).agg(*[F.avg(m).alias(m) for m in metrics])
    old = lambda b, m: f"{b}_{m}" if len(metrics) > 1 else str(b)
    return wide.select(key, *[F.col(f"`{old(b, m)}`").alias(f"{m}_{b}") for m in metrics for b in bands])


def describe(df: DataFrame, value: str, by: Sequence[str] = (), q: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """n, mean, sample deviation, least, quantiles (linear interpolation), greatest, and the quartiles' distance if both are asked for. Null and NaN are missing.

    Quantiles come from counts of distinct values in ranges, so no group is held by one task.
    """
    v = F.when(stats.present(value), F.col(value))
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    found = stats.quantiles(df, value, q, by).withColumnsRenamed({k: f"_q{i}" for i, k in enumerate(by)})
    match = F.lit(True)
    for i, k in enumerate(by):
        match = match & F.col(k).eqNullSafe(F.col(f"_q{i}"))
    out = out.join(found, match, "left")
    at = {x: F.col("q")[i] for i, x in enumerate(q)}
    iqr = [(at[0.75] - at[0.25]).alias("iqr")] if 0.25 in at and 0.75 in at else []
    return out.select(*by, "n", "mean", "std", "low", *[c.alias(f"p{100 * x:g}".replace(".", "_")) for x, c in at.items()], "high", *iqr)


def last_pivot(rows: DataFrame, key: str, band: str, bands: Sequence, metrics: Sequence[str], order: str) -> DataFrame:
    """Wide columns ``metric_band`` with the value of the last row of each key and band; nulls count as rows."""
    cell = lambda b, m: F.max_by(F.struct(F.col(m)), F.when(F.col(band) == b, F.col(order)))[m].alias(f"{m}_{b}")
    return rows.groupBy(key).agg(*[cell(b, m) for m in metrics for b in bands])


def z_by_block(profile: DataFrame, keys: Sequence[str], z: str = "z") -> DataFrame:
    """By key: root mean square, mean and largest absolute value of z."""
    return profile.groupBy(*keys).agg(F.sqrt(F.avg(F.col(z) * F.col(z))).alias("rms"), F.avg(F.abs(z)).alias("mean_abs"), F.max(F.abs(z)).alias("max_abs"))


def strata(df: DataFrame, value: str, groups: dict[str, Column]) -> DataFrame:
    """One row a stratum: its name, and count, mean, deviation and least and greatest of a value. Strata may overlap; all in one pass."""
    x = lambda c: F.when(c, F.col(value))
    cells = [F.struct(F.lit(k).alias("stratum"), F.count(x(c)).alias("n"), F.avg(x(c)).alias("mean"), F.stddev_samp(x(c)).alias("std"), F.min(x(c)).alias("low"), F.max(x(c)).alias("high")) for k, c in groups.items()]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def sample_audit(signals: DataFrame, keys: Sequence[str], samples: str = "samples", limit: float = 500.0, flat: float = 1e-12) -> DataFrame:
    """By recording, over rows of one channel each: channels, samples, those that are no numbers, mean absolute value, least, greatest, 99th percentile of absolute values, channels that do not vary, and samples beyond a limit."""
    fine = F.filter(F.col(samples), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    mean = F.aggregate("_f", F.lit(0.0), lambda s, x: s + x) / F.size("_f")
    spread = F.aggregate("_f", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / F.size("_f")
    rows = signals.withColumn("_f", fine).withColumn("_m", F.when(F.size("_f") > 0, mean)).withColumn("_s", F.sqrt(F.when(F.size("_f") > 0, spread)))
    one = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_channels"), F.sum(F.size(samples)).alias("n_samples"), F.sum(F.size(samples) - F.size("_f")).alias("n_bad"), F.avg("_s").alias("std_mean"), F.count_if(F.col("_s") <= flat).alias("flat_channels"), F.sum(F.size(F.filter("_f", lambda x: F.abs(x) > limit))).alias("extreme"), F.min(F.array_min("_f")).alias("low"), F.max(F.array_max("_f")).alias("high"), F.try_divide(F.sum(F.aggregate("_f", F.lit(0.0), lambda s, x: s + F.abs(x))), F.sum(F.size("_f"))).alias("mean_abs"))
    p99 = stats.quantiles(rows.select(*keys, F.explode("_f").alias("_x")).withColumn("_x", F.abs("_x")), "_x", [0.99], keys)
    return one.join(p99.select(*keys, F.col("q")[0].alias("p99_abs")), list(keys), "left")


def scale_audit(signals: DataFrame, keys: Sequence[str], samples: str = "samples", low: str = "pmin", high: str = "pmax", tolerance: float = 1e-6) -> DataFrame:
    """By recording: share of samples at the physical ends, and channels with more than 1 % of them at the upper one."""
    near = lambda end: F.size(F.filter(samples, lambda x: F.abs(x - F.col(end)) <= tolerance * F.greatest(F.abs(F.col(end)), F.lit(1.0))))
    rows = signals.withColumn("_n", F.size(samples)).withColumn("_h", near(high)).withColumn("_l", near(low))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_channels"), F.try_divide(F.sum("_h"), F.sum("_n")).alias("share_high"), F.try_divide(F.sum("_l"), F.sum("_n")).alias("share_low"), F.count_if(F.col("_h") > 0.01 * F.col("_n")).alias("saturated"))


def counts_table(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts by two columns, one of them spread out, 0 where there are none."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def above(df: DataFrame, value: str, limit: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(F.col(value) > limit).alias("n_above"), F.avg((F.col(value) > limit).cast("double")).alias("share_above"))


def column_audit(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row a column: nulls, infinities, distinct values, whether it varies."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("n_null"), F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("n_inf"), F.count_distinct(c).alias("n_distinct"), F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias("varies")) for c in names
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def presence(df: DataFrame, item: str, key: str, share: float) -> DataFrame:
    """Items that at least a share of all keys have."""
    total = df.select(key).distinct().count()
    return df.groupBy(item).agg(F.count_distinct(key).alias("n")).withColumn("share", F.col("n") / F.lit(max(total, 1))).where(F.col("share") >= share)


def stability(runs: DataFrame, value: str, key: str = "participant_id") -> DataFrame:
    """Spread over runs: population deviation by mean, and range."""
    v = C.clean(F.col(value).cast("double"))
    return runs.groupBy(key).agg((F.stddev_pop(v) / (F.avg(v) + EPS)).alias("cv"), (F.max(v) - F.min(v)).alias("range"))

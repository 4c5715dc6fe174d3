"""Input checks, reports and audits as projections: no row loops, so they run on streams as well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparknorm.functions import columns as C
from sparknorm.functions.contract import FEATURES, REFERENCE_AGE

RAW_SUFFIXES = ("bdf", "edf", "fif", "vhdr")


def validate_rows(df: DataFrame, features: Sequence[str] = FEATURES, age: str = "age", reference: tuple[float, float] = REFERENCE_AGE) -> DataFrame:
    """Rows with status, reason, bad_features and warnings.

    In this order: no age column, an age that is no finite number, missing
    feature columns, features that are no finite numbers. An age outside the
    reference range warns; a rejected row has no warnings.
    """
    missing = [f for f in features if f not in df.columns]
    number = lambda c: F.col(c).try_cast("double")
    invalid = F.filter(F.array(*[F.when(~C.finite(number(f)), F.lit(f)) for f in features if f in df.columns]).cast("array<string>"), lambda x: x.isNotNull())
    if age not in df.columns:
        reason, bad, warn = F.lit("MISSING_AGE"), F.array(F.lit(age)), F.array().cast("array<string>")
    else:
        a = number(age)
        reason = F.when(~C.finite(a), "INVALID_AGE").when(F.lit(bool(missing)), "MISSING_FEATURES").when(F.size(invalid) > 0, "INVALID_FEATURES")
        bad = F.when(~C.finite(a), F.array(F.lit(age))).when(F.lit(bool(missing)), F.array(*map(F.lit, missing)).cast("array<string>")).otherwise(invalid)
        warn = F.when(reason.isNull() & ~a.between(*reference), F.array(F.lit("AGE_OUT_OF_RANGE"))).otherwise(F.array().cast("array<string>"))
    return df.select("*", F.when(reason.isNull(), "PASS").otherwise("REJECT").alias("status"), reason.alias("reason"), bad.alias("bad_features"), warn.alias("warnings"))


def validate_recordings(df: DataFrame, sfreq: float = 512.0, tolerance: float = 0.5, channels: int = 64, seconds: float = 30.0) -> DataFrame:
    """Recording metadata (path, sfreq, duration_s, n_channels) with status, reason and warnings: format, rate, length, channels."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(~suffix.isin(list(RAW_SUFFIXES)), "UNSUPPORTED_FORMAT").when(~C.finite(F.col("sfreq")) | (F.abs(F.col("sfreq") - sfreq) > tolerance), "BAD_SFREQ").when(F.col("duration_s") < seconds, "TOO_SHORT").when(F.col("n_channels") < channels, "TOO_FEW_CHANNELS")
    warn = F.when(reason.isNull() & (F.col("n_channels") > channels), F.array(F.lit("EXTRA_CHANNELS"))).otherwise(F.array().cast("array<string>"))
    return df.select("*", F.when(reason.isNull(), "PASS").otherwise("REJECT").alias("status"), reason.alias("reason"), warn.alias("warnings"))


def reports(scored: DataFrame, version: str, lam: float, identity: str = "participant_id", blocks: Sequence[str] = ("SE", "C", "G", "D")) -> DataFrame:
    """One JSON document a validated and scored row; a rejected one has null scores. For research use, not a diagnosis."""
    ok = F.col("status") == "PASS"
    scores = F.when(ok, F.struct(*[F.col(f"D_{b}") for b in blocks], "composite"))
    body = F.struct("status", F.when(ok, "score").otherwise("validation").alias("stage"), "reason", F.struct("bad_features").alias("details"), "warnings", F.lit(version).alias("model_version"), F.lit(float(lam)).alias("lambda"), F.col(identity).alias("participant_id"), "age", scores.alias("scores"), F.lit("research use only").alias("note"))
    return scored.select(F.col(identity), F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row a check: rows that break it, and whether it passed. A null result breaks a check."""
    cells = F.array(*[F.struct(F.lit(k).alias("check"), F.count_if(~F.coalesce(c, F.lit(False))).alias("broken")) for k, c in checks.items()])
    return df.agg(cells.alias("c")).select(F.inline("c")).withColumn("passed", F.col("broken") == 0)


def dataset_audit(df: DataFrame, features: Sequence[str], key: str, label: str, labels: Sequence, age: str, sizes: dict | None = None, allowed: Sequence[str] = ()) -> DataFrame:
    """The audit of a training table by section: ids, labels, age, features, columns. One row a check: section, check, n, status.

    n counts what breaks the check: ids that stand more than once, rows with a
    label that is not allowed, with no age (null or NaN), cells that are
    missing or infinite, features that are absent or do not vary, columns
    beside those named. Surplus columns and group sizes other than ``sizes``
    warn, anything else fails. An absent key, label or age counts as one broken
    check, and a null id as an id.
    """
    here = [f for f in features if f in df.columns]
    lacks = {c: c not in df.columns for c in (key, label, age)}
    number = lambda c: F.col(c).cast("double")
    gone = lambda c: number(c).isNull() | F.isnan(number(c))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    total = lambda f: sum([F.count_if(f(c)) for c in here], none)
    fixed = sum([(~F.coalesce(F.min(F.when(~gone(c), number(c))) < F.max(F.when(~gone(c), number(c))), F.lit(False))).cast("long") for c in here], none)
    cells = [
        ("labels", "allowed", one if lacks[label] else F.count_if(~F.coalesce(F.col(label).isin(list(labels)), F.lit(False)))),
        *[("labels", f"size of {k}", none if lacks[label] else F.abs(F.count_if(F.col(label) == k) - n)) for k, n in (sizes or {}).items()],
        ("age", "complete", one if lacks[age] else F.count_if(gone(age))),
        ("features", "present", F.lit(len(features) - len(here)).cast("long")),
        ("features", "no missing values", total(gone)),
        ("features", "finite", total(lambda c: F.abs(number(c)) == float("inf"))),
        ("features", "vary", fixed),
        ("columns", "expected", F.lit(len(set(df.columns) - {key, label, age, *features, *allowed})).cast("long")),
    ]
    kind = F.when(F.col("check").startswith("size of ") | (F.col("section") == "columns"), "WARN").otherwise("FAIL")
    rows = df.agg(F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("check"), c.alias("n")) for a, b, c in cells]).alias("c")).select(F.inline("c"))
    again = df.sparkSession.createDataFrame([(1,)], "n long") if lacks[key] else df.groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias("n"))
    rows = rows.union(again.select(F.lit("ids"), F.lit("unique"), "n"))
    return rows.withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise(kind))


def manifest_gate(manifests: DataFrame, body: str, required: Sequence[str], wished: Sequence[str] = ()) -> DataFrame:
    """JSON manifests with a verdict: NO-GO without a required key, PASS_WITH_WARNINGS without a wished one."""
    lacks = lambda keys: F.filter(F.array(*[F.when(F.get_json_object(F.col(body), f"$.{k}").isNull(), F.lit(k)) for k in keys]).cast("array<string>"), lambda x: x.isNotNull())
    out = manifests.withColumn("missing", lacks(required)).withColumn("unmet", lacks(wished))
    return out.withColumn("verdict", F.when(F.size("missing") > 0, "NO-GO").when(F.size("unmet") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))


def formula_guard(df: DataFrame, parts: Sequence[str], whole: str, tolerance: float = 1e-6) -> DataFrame:
    """The table itself; raises ValueError if the parts' mean is not the whole."""
    mean = sum([F.col(p) for p in parts[1:]], F.col(parts[0])) / len(parts)
    worst = df.agg(F.max(F.abs(mean - F.col(whole)))).first()[0]
    if worst is not None and worst > tolerance:
        raise ValueError(f"{whole} differs from the mean of {list(parts)} by {worst}")
    return df

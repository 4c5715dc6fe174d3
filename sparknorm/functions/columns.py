"""Scalar functions as Catalyst columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contract import EPS


def clean(c: Column) -> Column:
    """NaN becomes null, so that averages skip it."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def subject_token(path: Column) -> Column:
    """``sub-…`` of a file name; raises where there is none."""
    found = F.regexp_extract(path, r"(sub-[A-Za-z0-9]+)", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no subject in "), path)).cast("string"))


def run_token(path: Column, default: str = "01") -> Column:
    """``run-…`` of a file name, two digits."""
    found = F.regexp_extract(path, r"run-([0-9]+)", 1)
    return F.when(found != "", two_digits(found)).otherwise(F.lit(default))


def two_digits(run: Column) -> Column:
    """Run labels that passed through a number: ``1``, ``1.0`` and ``01`` are the same."""
    plain = F.regexp_replace(run.cast("string"), r"\.0$", "")
    return F.when(F.length(plain) < 2, F.lpad(plain, 2, "0")).otherwise(plain)


def participant_number(stem: Column) -> Column:
    return F.regexp_extract(stem, r"(?i)part([0-9]+)_resteo", 1).try_cast("int")


def age_from_comment(comment: Column, missing: int = 99) -> Column:
    """The number after ``age``; the placeholder counts as null."""
    return F.nullif(F.regexp_extract(comment, r"(?i)age\D{0,3}([0-9]{1,3})", 1).try_cast("int"), F.lit(missing))


def standard_montage(labels: Column, limit: int = 5) -> Column:
    """Fewer than ``limit`` labels of the A1 … D32 kind."""
    return F.size(F.filter(labels, lambda x: x.rlike(r"^[A-D][0-9]+$"))) < limit


def log_ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.log((a + eps) / (b + eps))


def ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    return a / (b + eps)


def relative(values: Sequence[Column], eps: float = EPS) -> list[Column]:
    total = sum(values[1:], values[0]) + eps
    return [v / total for v in values]


def shares(values: Sequence[Column]) -> list[Column]:
    """Contributions that sum to 1; null where the total is 0."""
    total = sum(values[1:], values[0])
    return [F.try_divide(v, total) for v in values]


def entropy(parts: Sequence[Column], floor: float = 1e-15) -> Column:
    """Shannon entropy, natural logarithm, of parts made positive and scaled to sum to 1."""
    p = [F.greatest(c, F.lit(floor)) for c in parts]
    total = sum(p[1:], p[0])
    terms = [-(c / total) * F.log(c / total) for c in p]
    return sum(terms[1:], terms[0])


def first_largest(named: Mapping[str, Column]) -> Column:
    """Name of the largest value; the first in order on ties."""
    top = F.greatest(*named.values())
    out = F.lit(None).cast("string")
    for name, c in reversed(named.items()):
        out = F.when(c == top, F.lit(name)).otherwise(out)
    return out


def binned(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bins; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        out = F.when((c >= low) & (c < high), F.lit(label)).otherwise(out)
    return out


def cases(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Ordered overrides: the last rule that holds wins."""
    out = F.lit(default)
    for condition, value in rules:
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def weighted(values: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean of distances; weights must cover the values and sum to 1. Equal by default."""
    if not values:
        raise ValueError("no values to combine")
    weights = weights or dict.fromkeys(values, 1 / len(values))
    if set(values) - set(weights):
        raise ValueError(f"no weight for {sorted(set(values) - set(weights))}")
    if not math.isclose(sum(weights[k] for k in values), 1.0, abs_tol=1e-6):
        raise ValueError("weights do not sum to 1")
    terms = [c * weights[k] for k, c in values.items()]
    return sum(terms[1:], terms[0])


def extreme_share(samples: Column, limit: float = 150.0) -> Column:
    """Share of samples beyond a limit, strictly."""
    return F.try_divide(F.size(F.filter(samples, lambda x: F.abs(x) > limit)), F.size(samples))


def is_close(a: Column, b: Column, rtol: float = 1e-4, atol: float = 1e-5) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def amplitude_flag(p99: Column, extreme: Column) -> Column:
    """Triage of a recording by its 99th percentile and count of extreme samples: extreme before borderline."""
    return F.when((p99 > 500) | (extreme > 1000), "extreme").when((p99 > 150) | (extreme > 0), "borderline").otherwise("clean")


def stem_of(path: Column) -> Column:
    """A file name without its folders and last suffix."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def group_of(path: Column, prefixes: Mapping[str, str], default: str) -> Column:
    """A group by how a file's name begins, the first prefix that fits."""
    out = F.lit(default)
    for prefix, group in reversed(prefixes.items()):
        out = F.when(F.startswith(stem_of(path), F.lit(prefix)), F.lit(group)).otherwise(out)
    return out


def vector(features: Sequence[str]) -> Column:
    """Columns as one array, in order."""
    return F.array(*[F.col(f).cast("double") for f in features])


def named_vector(values: Column, features: Sequence[str]) -> Column:
    """An array as a map by name; raises where the lengths differ."""
    fits = F.size(values) == len(features)
    return F.when(fits, F.map_from_arrays(F.array(*map(F.lit, features)), values)).otherwise(F.raise_error(F.lit(f"a vector does not have {len(features)} values")).cast("map<string,double>"))


def merged(base: Column, extra: Column) -> Column:
    """Two maps as one, where the second's values count for keys of both; null if either is."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra)


def interval(point: Column, low: Column, high: Column, mean: Column) -> Column:
    """Struct of an interval's relative width, the mean's bias, and whether it holds the point."""
    return F.struct(((high - low) / F.greatest(F.abs(point), F.lit(1e-8))).alias("relative_width"), (mean - point).alias("bias"), within(low, high, point).alias("inside"))


def number_text(c: Column, digits: int = 10) -> Column:
    """A number with so many significant digits, as text."""
    return F.format_string(f"%.{digits}g", c.cast("double"))


def within(low: Column, high: Column, point: Column) -> Column:
    return (point >= low) & (point <= high)


def label_code(label: Column, codes: Mapping[str, int]) -> Column:
    """A label, trimmed and upper-cased, as its code; unknown ones are null."""
    out = F.lit(None).cast("int")
    for name, code in codes.items():
        out = F.when(F.upper(F.trim(label)) == name.upper(), F.lit(code)).otherwise(out)
    return out

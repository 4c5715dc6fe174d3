"""Cohort tables: quality flags, joins with their checks, set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparknorm.functions import columns as C


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table itself; raises ValueError if a key occurs twice."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{list(keys)} is not unique")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return assert_unique(left, keys).join(assert_unique(right, keys), list(keys))


def flag(df: DataFrame, rules: Sequence[tuple[Column, str]], default: str = "ok", name: str = "qc_flag") -> DataFrame:
    """A quality flag by ordered rules; later ones win."""
    return df.withColumn(name, C.cases(rules, default))


def not_in(c: Column, values: Sequence) -> Column:
    """Exclusion that keeps nulls."""
    return c.isNull() | ~c.isin(list(values))


def canonical(tables: Sequence[DataFrame], key: str = "participant_id", keep: Sequence[str] = ("ok", "very_low_alpha"), exclude: Sequence[str] = (), flag_col: str = "qc_flag", needed: Sequence[str] = ("age", "group")) -> DataFrame:
    """Inner join of tables by subject, with the usable flags, without excluded subjects and without nulls in what is needed.

    Columns that several tables have come from the first one that has a value.
    """
    out = tables[0]
    for t in tables[1:]:
        shared = [c for c in t.columns if c in out.columns and c != key]
        t = t.withColumnsRenamed({c: f"_{c}" for c in shared})
        out = out.join(t, key).withColumns({c: F.coalesce(c, f"_{c}") for c in shared}).drop(*[f"_{c}" for c in shared])
    if flag_col in out.columns:
        out = out.where(F.col(flag_col).isin(list(keep)))
    return out.where(not_in(F.col(key), exclude)).dropna(subset=[c for c in needed if c in out.columns])


def meets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys both have, only the first, only the second."""
    sides = a.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(key), F.lit(0), F.lit(1)))
    each = sides.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if(F.col("b") == 0).alias("only_first"), F.count_if(F.col("a") == 0).alias("only_second"))


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: rows compared, and the largest, mean and median absolute difference."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    gap = F.abs(F.col("x") - F.col("y"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_abs"), F.avg(gap).alias("mean_abs"), F.median(gap).alias("median_abs"))

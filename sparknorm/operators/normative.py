"""Normative models: age regression, shrunk residual covariance, block distances.

Everything is fitted from one set of second moments of z = [1, a, x], with a
the covariate and x the features, both taken from a fixed offset: the residual
covariance is (S_xx - S_xa S_ax / S_aa) / (n - 1). Moments are summed by task
and then cell by cell, so fitting moves p squared numbers a task, and
shrinkage grids, leave-one-out (a rank-one downdate) and transfers need no
further pass. Scoring is a projection: one matrix product a block and Arrow batch.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparknorm.functions import columns as C
from sparknorm.functions.contract import BLOCKS, EPS, require

LAMBDA = 0.10
Blocks = Mapping[str, Sequence[str]]


@dataclass(frozen=True)
class Moments:
    """Sums over rows of the outer product of z, where z is measured from ``offset``."""

    features: tuple[str, ...]
    offset: np.ndarray  # covariate first
    total: np.ndarray

    @property
    def n(self) -> float:
        return float(self.total[0, 0])

    def of(self, names: Sequence[str]) -> Moments:
        at = [self.features.index(f) for f in names]
        keep = [0, 1, *(i + 2 for i in at)]
        return Moments(tuple(names), self.offset[[0, *(i + 1 for i in at)]], self.total[np.ix_(keep, keep)])

    def fit(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intercepts, slopes, and the sample covariance of the residuals."""
        if self.n < 2:
            raise ValueError("a reference needs at least 2 rows")
        mean = self.total[0, 1:] / self.n
        s = self.total[1:, 1:] - self.n * np.outer(mean, mean)
        slope = s[0, 1:] / s[0, 0] if s[0, 0] > 0 else np.zeros(len(self.features))
        center = mean + self.offset
        cov = (s[1:, 1:] - np.outer(s[1:, 0], slope)) / (self.n - 1)
        return center[1:] - slope * center[0], slope, (cov + cov.T) / 2


def moments(df: DataFrame, features: Sequence[str], age: str = "age", weight: str | None = None, offset: np.ndarray | None = None) -> Moments:
    """Second moments of the complete rows of a table."""
    names = [age, *features]
    require(df.columns, names)
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    fine = C.finite(F.col("v0"))
    for i in range(1, len(names)):
        fine = fine & C.finite(F.col(f"v{i}"))
    rows = rows.where(fine)
    if offset is None:
        first = rows.agg(*[F.avg(f"v{i}") for i in range(len(names))]).first()
        offset = np.array([x or 0.0 for x in first])
    width = len(names) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            z = np.column_stack([np.ones(len(v)), v[:, :-1] - offset])
            total += z.T @ (z * v[:, -1:])
        at = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"k": pa.array(at[0] * width + at[1], pa.int64()), "v": pa.array(total[at])})

    cells = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((width, width))
    for r in cells:
        i, j = divmod(r["k"], width)
        total[i, j] = total[j, i] = r["v"]
    return Moments(tuple(features), offset, total)


def shrink(cov: np.ndarray, lam: float) -> np.ndarray:
    """(1 - lam) cov + lam (trace / p) I."""
    if cov.ndim != 2 or cov.shape[0] != cov.shape[1]:
        raise ValueError("a covariance is square")
    if not 0 <= lam <= 1:
        raise ValueError("shrinkage lies between 0 and 1")
    return (1 - lam) * cov + lam * np.trace(cov) / len(cov) * np.eye(len(cov))


def whitening(cov: np.ndarray) -> np.ndarray:
    """W with |W r| the Mahalanobis length of r; from the pseudo-inverse where there is no Cholesky factor."""
    try:
        return np.linalg.inv(np.linalg.cholesky(cov))
    except np.linalg.LinAlgError:
        value, vector = np.linalg.eigh(np.linalg.pinv(cov))
        return np.sqrt(np.maximum(value, 0))[:, None] * vector.T


def diagnostics(raw: np.ndarray, lam: float) -> dict[str, float]:
    value = np.linalg.svd(raw, compute_uv=False)
    return {"rank": int((value > 1e-8).sum()), "cond_raw": float(np.linalg.cond(raw)), "cond_reg": float(np.linalg.cond(shrink(raw, lam)))}


@dataclass(frozen=True)
class Block:
    features: tuple[str, ...]
    intercept: np.ndarray
    slope: np.ndarray
    raw: np.ndarray
    cov: np.ndarray

    def __post_init__(self) -> None:
        p = len(self.features)
        if self.intercept.shape != (p,) or self.slope.shape != (p,) or self.cov.shape != (p, p):
            raise ValueError(f"a block of {p} features has coefficients of another shape")

    def residuals(self, age: Column) -> list[Column]:
        return [F.col(f).cast("double") - (float(b0) + float(b1) * age) for f, b0, b1 in zip(self.features, self.intercept, self.slope, strict=True)]


def distances(blocks: Mapping[str, Block]) -> Callable[[Column, Column], Column]:
    """A function of (age, struct of all features) that gives a struct of D_<block>.

    One matrix product a block and batch. As column expressions, a block of p
    features takes p squared terms, which outgrow code generation and, once a
    filter on a distance is pushed down, the optimiser. A missing input gives null.
    """
    names = list(dict.fromkeys(f for b in blocks.values() for f in b.features))
    parts = {f"D_{k}": ([names.index(f) for f in b.features], b.intercept, b.slope, whitening(b.cov).T) for k, b in blocks.items()}

    @F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in parts]))
    def run(age: pd.Series, x: pd.DataFrame) -> pd.DataFrame:
        a, v = age.to_numpy(float)[:, None], x.to_numpy(float)
        return pd.DataFrame({k: np.linalg.norm((v[:, at] - b0 - a * b1) @ w, axis=1) for k, (at, b0, b1, w) in parts.items()})

    once = run.asNondeterministic()  # else a filter on a distance would compute it twice
    return lambda age, x: once(age, x)


@dataclass(frozen=True)
class Model:
    blocks: dict[str, Block]
    lam: float
    n: int
    version: str = "1"
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, df: DataFrame, age: str = "age") -> DataFrame:
        """The rows with D_<block> and their composite. A missing input gives a null distance."""
        require(df.columns, [age, *(f for b in self.blocks.values() for f in b.features)])
        names = dict.fromkeys(f for b in self.blocks.values() for f in b.features)
        found = distances(self.blocks)(F.col(age).cast("double"), F.struct(*[F.col(f).cast("double").alias(f) for f in names]))
        staged = df.select("*", found.alias("_d")).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_d.D_{name}") for name in self.blocks])
        return staged.withColumn("composite", C.weighted({name: F.col(f"D_{name}") for name in self.blocks}, self.weights or None))

    def profile(self, df: DataFrame, ids: Sequence[str], age: str = "age", unshrunk: bool = False) -> DataFrame:
        """One row a subject and feature: observed, expected, residual, its spread, z and |z|."""
        cells = []
        for name, b in self.blocks.items():
            spread = np.sqrt(np.diag(b.raw if unshrunk else b.cov)) + EPS
            for f, b0, b1, sd in zip(b.features, b.intercept, b.slope, spread, strict=True):
                x, expected = F.col(f).cast("double"), float(b0) + float(b1) * F.col(age).cast("double")
                cells.append(F.struct(F.lit(name).alias("block"), F.lit(f).alias("feature"), x.alias("observed"), expected.alias("age_expected"), (x - expected).alias("residual"), F.lit(float(sd)).alias("residual_sd"), ((x - expected) / float(sd)).alias("z")))
        return df.select(*ids, F.inline(F.array(*cells))).withColumn("abs_z", F.abs("z"))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Coefficients (block, feature, ord, intercept, slope) and covariances (block, i, j, raw, cov)."""
        coef = [(n, f, i, float(b.intercept[i]), float(b.slope[i])) for n, b in self.blocks.items() for i, f in enumerate(b.features)]
        cov = [(n, i, j, float(b.raw[i, j]), float(b.cov[i, j])) for n, b in self.blocks.items() for i in range(len(b.features)) for j in range(len(b.features))]
        return spark.createDataFrame(coef, "block string, feature string, ord int, intercept double, slope double"), spark.createDataFrame(cov, "block string, i int, j int, raw double, cov double")

    def age_lines(self, least: int = 39) -> dict[str, dict[str, float]]:
        """Intercept and slope by feature, for export; ValueError where fewer reference rows than ``least`` were fitted."""
        if self.n < least:
            raise ValueError(f"{self.n} reference rows, {least} are needed")
        return {f: {"intercept": float(b0), "slope": float(b1)} for b in self.blocks.values() for f, b0, b1 in zip(b.features, b.intercept, b.slope, strict=True)}

    def save(self, spark: SparkSession, path: str) -> None:
        coef, cov = self.tables(spark)
        coef.coalesce(1).write.parquet(f"{path}/coefficients")
        cov.coalesce(1).write.parquet(f"{path}/covariances")
        manifest = {"version": self.version, "lambda": self.lam, "n": self.n, "dims": {k: len(b.features) for k, b in self.blocks.items()}, "weights": self.weights}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
        coef = spark.read.parquet(f"{path}/coefficients").toPandas().sort_values("ord")
        cov = spark.read.parquet(f"{path}/covariances").toPandas().sort_values(["i", "j"])
        blocks = {}
        for name, p in manifest["dims"].items():
            c, v = coef[coef["block"] == name], cov[cov["block"] == name]
            if len(c) != p or len(v) != p * p:
                raise ValueError(f"block {name} does not have {p} features")
            blocks[name] = Block(tuple(c["feature"]), c["intercept"].to_numpy(), c["slope"].to_numpy(), v["raw"].to_numpy().reshape(p, p), v["cov"].to_numpy().reshape(p, p))
        return cls(blocks, manifest["lambda"], manifest["n"], manifest["version"], manifest["weights"])


def model_of(m: Moments, lam: float = LAMBDA, blocks: Blocks = BLOCKS) -> Model:
    found = {}
    for name, names in blocks.items():
        b0, b1, raw = m.of(names).fit()
        found[name] = Block(tuple(names), b0, b1, raw, shrink(raw, lam))
    return Model(found, lam, int(m.n))


def fit(df: DataFrame, reference: Column, lam: float = LAMBDA, blocks: Blocks = BLOCKS, age: str = "age") -> Model:
    """A model from the reference rows alone: nothing outside of them can change it."""
    return model_of(moments(df.where(reference), [f for b in blocks.values() for f in b], age), lam, blocks)


def score_cohort(df: DataFrame, reference: Column, lam: float = LAMBDA, blocks: Blocks = BLOCKS, age: str = "age") -> DataFrame:
    return fit(df, reference, lam, blocks, age).score(df, age)


def lambda_grid(df: DataFrame, reference: Column, grid: Sequence[float], blocks: Blocks = BLOCKS, age: str = "age") -> DataFrame:
    """Rows times shrinkages, scored: the moments are taken once, and all shrinkages are scored in one pass."""
    names = list(dict.fromkeys(f for b in blocks.values() for f in b))
    m = moments(df.where(reference), names, age)
    models = [model_of(m, lam, blocks) for lam in grid]
    every = {f"{k}_{i}": b for i, model in enumerate(models) for k, b in model.blocks.items()}
    d = distances(every)(F.col(age).cast("double"), F.struct(*[F.col(f).cast("double").alias(f) for f in names]))
    staged = df.select("*", d.alias("_d"))
    cells = [F.struct(F.lit(float(lam)).alias("lambda"), *[F.col(f"_d.D_{k}_{i}").alias(f"D_{k}") for k in blocks]) for i, lam in enumerate(grid)]
    out = staged.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(*cells)))
    return out.withColumn("composite", C.weighted({k: F.col(f"D_{k}") for k in blocks}))


def left_out(m: Moments, z: np.ndarray, lam: float) -> np.ndarray:
    """Distance of each row of z = [1, age, x] from the model of all rows of ``m`` but itself, all by rank-one downdates. NaN where that cannot be fitted."""
    n = m.n
    if n < 3:
        return np.full(len(z), np.nan)
    mean = m.total[0, 1:] / n
    s = m.total[1:, 1:] - n * np.outer(mean, mean)
    d, c = z[:, 1:] - mean, n / (n - 1)
    da, dx = d[:, 0], d[:, 1:]
    saa = s[0, 0] - c * da**2
    sxa = s[1:, 0] - c * dx * da[:, None]
    slope = np.divide(sxa, saa[:, None], out=np.zeros_like(sxa), where=saa[:, None] > 1e-12 * max(s[0, 0], 1e-300))
    cov = (s[1:, 1:] - c * dx[:, :, None] * dx[:, None, :] - sxa[:, :, None] * slope[:, None, :]) / (n - 2)
    cov = (cov + cov.transpose(0, 2, 1)) / 2
    p = cov.shape[1]
    cov = (1 - lam) * cov + (lam * np.trace(cov, axis1=1, axis2=2) / p)[:, None, None] * np.eye(p)
    r = c * (dx - slope * da[:, None])
    try:
        return np.linalg.norm(np.linalg.solve(np.linalg.cholesky(cov), r[:, :, None])[:, :, 0], axis=1)
    except np.linalg.LinAlgError:  # some of them have no factor
        return np.array([np.linalg.norm(whitening(v) @ x) for v, x in zip(cov, r, strict=True)])


def leave_one_out(df: DataFrame, reference: Column, ids: Sequence[str], lam: float = LAMBDA, blocks: Blocks = BLOCKS, age: str = "age") -> DataFrame:
    """Each reference row scored by the model of all others: its outer product is taken from the moments, for a batch at a time.

    A row that is not complete is no part of any model and has null distances.
    """
    names = [f for b in blocks.values() for f in b]
    m = moments(df.where(reference), names, age)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(m)  # (p + 2) squared numbers
    block_names = {k: tuple(v) for k, v in blocks.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        parts = {k: m.of(v) for k, v in block_names.items()}
        at = {k: [m.features.index(f) for f in v] for k, v in block_names.items()}
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[len(ids) :]])
            out = {k: np.full(len(v), np.nan) for k in parts}
            inside = np.isfinite(v).all(axis=1)  # only complete rows are in the moments
            for k, p in parts.items():
                for i in range(0, len(v), 512):
                    own = np.flatnonzero(inside[i : i + 512]) + i
                    if len(own):
                        z = np.column_stack([np.ones(len(own)), v[own][:, [0, *(j + 1 for j in at[k])]] - p.offset])
                        out[k][own] = left_out(p, z, lam)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], *(pa.array(x) for x in out.values())], [*ids, *(f"D_{k}_loo" for k in out)])

    rows = df.where(reference).select(*ids, F.col(age).cast("double").alias("_age"), *[F.col(f).cast("double") for f in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(ids)])
    out = rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"D_{k}_loo double" for k in blocks))
    cols = [F.col(f"D_{k}_loo") for k in blocks]
    used = [F.when(~F.isnan(c), c) for c in cols]  # a block that cannot be fitted is left out of the mean
    total = sum([F.coalesce(u, F.lit(0.0)) for u in used[1:]], F.coalesce(used[0], F.lit(0.0)))
    count = sum([u.isNotNull().cast("int") for u in used[1:]], used[0].isNotNull().cast("int"))
    return out.withColumn("composite_loo", F.try_divide(total, count))


def exact_mixed(df: DataFrame, reference: Column, ids: Sequence[str], lam: float = LAMBDA, blocks: Blocks = BLOCKS, age: str = "age") -> DataFrame:
    """Controls by leave-one-out, all others, also those of no known group, by the full model."""
    inside = leave_one_out(df, reference, ids, lam, blocks, age).select(*ids, F.col("composite_loo").alias("score"))
    outside = fit(df, reference, lam, blocks, age).score(df.where(~F.coalesce(reference, F.lit(False))), age).select(*ids, F.col("composite").alias("score"))
    return inside.unionByName(outside)


def ledoit_wolf(df: DataFrame, features: Sequence[str], centered: bool = True) -> tuple[np.ndarray, float]:
    """Covariance and its optimal shrinkage; one pass for the moments and one for the sum of fourth powers of lengths."""
    base = df.withColumn("_zero", F.lit(0.0))
    m = moments(base, list(features), "_zero", offset=np.zeros(len(features) + 1))
    n, p = m.n, len(features)
    mean = np.zeros(p) if centered else m.total[0, 2:] / n
    e = m.total[2:, 2:] / n - np.outer(mean, mean)
    length = sum(((F.col(f) - float(u)) * (F.col(f) - float(u)) for f, u in zip(features, mean, strict=True)), F.lit(0.0))
    fourth = df.agg(F.sum(length * length)).first()[0]
    mu = np.trace(e) / p
    delta = ((e - mu * np.eye(p)) ** 2).sum() / p
    beta = min((fourth / n - (e**2).sum()) / (n * p), delta)
    s = float(beta / delta) if delta > 0 else 0.0
    return (1 - s) * e + s * mu * np.eye(p), s


def quadratic(df: DataFrame, features: Sequence[str], age: str = "age") -> DataFrame:
    """Per feature b0 + b1 a + b2 a²; the age is centred while solving."""
    center = df.agg(F.avg(age)).first()[0]
    a = F.col(age).cast("double") - float(center)
    rows = df.select(a.alias("a1"), (a * a).alias("a2"), *[F.col(f).cast("double").alias(f) for f in features])
    m = moments(rows, ["a2", *features], "a1", offset=np.zeros(len(features) + 2))
    design, target = m.total[:3, :3], m.total[:3, 3:]
    b = np.linalg.solve(design, target)
    out = [(f, float(b[0, i] - b[1, i] * center + b[2, i] * center**2), float(b[1, i] - 2 * b[2, i] * center), float(b[2, i])) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(out, "feature string, b0 double, b1 double, b2 double")


def poisson_weights(h: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Rows times draws of Poisson(1) weights, each from a 64-bit mix of the row's hash and the draw."""
    x = h.astype(np.uint64)[:, None] + (np.arange(draws, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(np.cumsum(np.exp(-1.0) / np.array([math.factorial(k) for k in range(18)], float)), u, side="right").astype(float)


def bootstrap_models(df: DataFrame, reference: Column, ids: Sequence[str], draws: int = 1000, seed: int = 42, lam: float = LAMBDA, blocks: Blocks = BLOCKS, age: str = "age") -> list[Model]:
    """A model a draw of resampled reference rows.

    Each complete reference row has an independent Poisson(1) weight in each
    draw, by a hash of its id, so a resample needs neither a shuffle nor the
    rows in one place. A task sends one row a draw, its weighted moments.
    """
    names = [f for b in blocks.values() for f in b]
    rows = df.where(reference).select(*ids, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate([age, *names])])
    for i in range(len(names) + 1):
        rows = rows.where(C.finite(F.col(f"_v{i}")))
    values = [f"_v{i}" for i in range(len(names) + 1)]
    offset = np.array([x or 0.0 for x in rows.agg(*[F.avg(v) for v in values]).first()])
    width = len(names) + 2
    at = np.triu_indices(width)
    rows = rows.select(F.xxhash64(*ids).alias("_h"), *values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, len(at[0])))
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            z = np.column_stack([np.ones(len(v)), v - offset])
            for i in range(0, len(z), 256):
                part = z[i : i + 256]
                total += poisson_weights(batch.column(0).to_numpy()[i : i + 256], draws, seed).T @ (part[:, at[0]] * part[:, at[1]])
        yield pa.RecordBatch.from_pydict({"boot": pa.array(range(draws), pa.int32()), "cells": pa.array([t.tobytes() for t in total], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"boot": pdf["boot"].iloc[:1], "cells": [np.sum([np.frombuffer(c) for c in pdf["cells"]], axis=0).tobytes()]})

    out = []
    for r in sorted(rows.mapInArrow(run, "boot int, cells binary").groupBy("boot").applyInPandas(add, "boot int, cells binary").collect()):  # draws times cells, whatever the rows
        total = np.zeros((width, width))
        total[at] = np.frombuffer(r["cells"])
        total = np.triu(total) + np.triu(total, 1).T
        out.append(model_of(Moments(tuple(names), offset, total), lam, blocks))
    return out


def _drawn(df: DataFrame, ids: Sequence[str], models: list[Model], age: str, columns: str, emit: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Rows' ids with what ``emit`` makes of their composites, rows times draws. A row with a missing input has NaN there."""
    names = list(dict.fromkeys(f for b in models[0].blocks.values() for f in b.features)) if models else []
    shared = df.sparkSession.sparkContext.broadcast([[([1 + names.index(f) for f in b.features], b.intercept, b.slope, whitening(b.cov).T) for b in m.blocks.values()] for m in models])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[len(ids) :]])
            d = np.stack([sum(np.linalg.norm((v[:, at] - b0 - v[:, :1] * b1) @ w, axis=1) for at, b0, b1, w in parts) / len(parts) for parts in shared.value], axis=1)
            made = emit(d)
            times = np.repeat(np.arange(len(v)), len(next(iter(made.values()))) // max(1, len(v)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(times)) for c in batch.columns[: len(ids)]), *(pa.array(x, from_pandas=True) for x in made.values())], [*ids, *made])

    every = df.select(*ids, F.col(age).cast("double").alias("_age"), *[F.col(f).cast("double").alias(f"_{f}") for f in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in every.schema.fields[: len(ids)])
    return every.mapInArrow(score, f"{kinds}, {columns}")


def bootstrap(df: DataFrame, reference: Column, ids: Sequence[str], draws: int = 1000, seed: int = 42, lam: float = LAMBDA, blocks: Blocks = BLOCKS, age: str = "age") -> DataFrame:
    """Rows times resampled models: id, boot, composite (null for a row with a missing input)."""
    models = bootstrap_models(df, reference, ids, draws, seed, lam, blocks, age)
    return _drawn(df, ids, models, age, "boot int, composite double", lambda d: {"boot": np.tile(np.arange(d.shape[1], dtype=np.int32), len(d)), "composite": d.reshape(-1)})


def bootstrap_intervals(df: DataFrame, reference: Column, ids: Sequence[str], draws: int = 1000, seed: int = 42, lam: float = LAMBDA, blocks: Blocks = BLOCKS, age: str = "age") -> DataFrame:
    """Each row's spread over the resampled models, without a row a draw: mean, sample deviation, and the 2.5, 50 and 97.5 % quantiles."""

    def emit(d: np.ndarray) -> dict[str, np.ndarray]:
        low, mid, high = np.quantile(d, [0.025, 0.5, 0.975], axis=1)
        return {"boot_mean": d.mean(axis=1), "boot_std": d.std(axis=1, ddof=1), "q025": low, "q50": mid, "q975": high, "ci_width": high - low}

    models = bootstrap_models(df, reference, ids, draws, seed, lam, blocks, age)
    return _drawn(df, ids, models, age, "boot_mean double, boot_std double, q025 double, q50 double, q975 double, ci_width double", emit)


def is_symmetric(m: np.ndarray, tolerance: float = 1e-10) -> bool:
    return m.ndim == 2 and m.shape[0] == m.shape[1] and bool(np.allclose(m, m.T, atol=tolerance))


def is_positive_definite(m: np.ndarray, tolerance: float = 1e-12) -> bool:
    """Symmetric, with a Cholesky factor after ``tolerance`` is taken from the diagonal."""
    try:
        np.linalg.cholesky(m - tolerance * np.eye(len(m)))
    except np.linalg.LinAlgError:
        return False
    return is_symmetric(m)

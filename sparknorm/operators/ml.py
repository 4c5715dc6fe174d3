"""Nested cross-validation, calibration and resampled AUCs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats
from .scratch import scratch_of

GRIDS = {"logistic": (0.01, 0.1, 1.0), "svm": (0.01, 0.1, 1.0), "forest": (3, 5)}
BUCKETS = 64  # of ids, in which classes are dealt to folds


def _hashed(key: Column | str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**31 - 1))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """A fold a row, each class dealt evenly in a seeded hash order.

    Classes are dealt inside hash buckets, so no class is sorted in one task.
    """
    return _dealt(df, label, key, {name: (folds, seed)}, seed)


def _dealt(df: DataFrame, label: str, key: str, wanted: dict[str, tuple[int, int]], seed: int) -> DataFrame:
    """Several folds at once: name to number of folds and seed of the order. All have the same buckets, so the rows are shuffled once."""
    bucket = stats._free(df, "_bucket")
    out = df.withColumn(bucket, _hashed(key, seed) % BUCKETS)
    place = lambda s: F.row_number().over(Window.partitionBy(label, bucket).orderBy(_hashed(key, s), key))
    return out.withColumns({name: ((place(s) + F.col(bucket)) % n).cast("int") for name, (n, s) in wanted.items()}).drop(bucket)


def scaled(train: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with features standardised by the training rows' means and population deviations."""
    s = train.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return rows.select(*[c for c in rows.columns if c not in features], *[((F.col(c) - (s[f"m{i}"] or 0.0)) / (s[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(features)])


@dataclass
class Models:
    """Linear models of one kind: of each its training rows (a number of ``sets``), penalty, and weights with the intercept last, on standardised features."""

    kind: str
    sets: list[tuple[int, int]]  # outer fold left out, inner fold left out (-1: none)
    of: np.ndarray
    penalty: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    balance: np.ndarray  # by set, of negatives and positives
    weight: np.ndarray

    def member(self, outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Which rows train which set, from each row's outer fold and its inner fold for every outer one."""
        return np.column_stack([(outer != k) & ((inner[:, k] != j) if j >= 0 else True) for k, j in self.sets])

    def margins(self, x: np.ndarray, models: np.ndarray) -> np.ndarray:
        """Rows times models."""
        s = self.of[models]
        slope = self.weight[models, :-1] / self.spread[s]
        return x @ slope.T + (self.weight[models, -1] - (slope * self.mean[s]).sum(axis=1))

    def sums(self, x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
        """By model: gradient and Hessian of the weighted loss, summed over rows, flat."""
        out = []
        for s in range(len(self.sets)):
            at = member[:, s]
            z = np.column_stack([(x[at] - self.mean[s]) / self.spread[s], np.ones(at.sum())])
            w, t = self.balance[s][y[at].astype(int)], y[at]
            for m in np.flatnonzero(self.of == s):
                g, h = _slopes(self.kind, z @ self.weight[m], t)
                out.append((m, np.concatenate([z.T @ (w * g), ((z * (w * h)[:, None]).T @ z).ravel()])))
        return np.array([v for _, v in sorted(out, key=lambda p: p[0])])


def _slopes(kind: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the margin: logistic, or squared hinge."""
    if kind == "logistic":
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return p - y, p * (1 - p)
    sign = 2 * y - 1
    short = np.maximum(1 - sign * margin, 0)
    return -2 * sign * short, 2.0 * (short > 0)


def _summed(rows: DataFrame, size: int, sums) -> np.ndarray:
    """``sums`` of an Arrow batch gives an array of a fixed size; the tasks' are added in groups of a piece each, so none gathers all."""
    piece = 1 << 15

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += sums(batch)
        parts = [total[k : k + piece].tobytes() for k in range(0, size, piece)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], ["k", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    found = rows.mapInArrow(run, "k int, v binary").groupBy("k").applyInPandas(add, "k int, v binary").collect()
    return np.concatenate([np.frombuffer(r["v"]) for r in sorted(found, key=lambda r: r["k"])]) if found else np.zeros(size)


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy().reshape(-1, width)
    return x, batch.column("y").to_numpy().astype(float), batch.column("fold").to_numpy(), np.stack(batch.column("inner").to_numpy(zero_copy_only=False))


def fit_models(rows: DataFrame, width: int, kind: str, sets: list[tuple[int, int]], penalties: Sequence[float], steps: int = 30, tolerance: float = 1e-9) -> Models:
    """Every set with every penalty by Newton's method; an iteration is one pass for all of them.

    ``rows`` has x (an array of ``width`` numbers), y (0 or 1), fold and inner
    (an inner fold for each outer one). Features are standardised on a set's own
    rows, classes weighted evenly there; the loss is the weighted mean plus half
    the penalty times the squared weights, the intercept's left out. Steps are
    halved for the models whose gradient they would not shrink. The driver
    holds width squared numbers a model.
    """
    n, p = len(sets), width + 1
    plain = Models(kind, sets, np.zeros(0, int), np.zeros(0), np.zeros((n, width)), np.ones((n, width)), np.ones((n, 2)), np.zeros((0, p)))

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        x, y, fold, inner = _unpacked(batch, width)
        m = plain.member(fold, inner).astype(float)
        return np.column_stack([m.T @ x, m.T @ (1 - y), m.T @ y]).ravel()

    first = _summed(rows, n * (width + 2), counts).reshape(n, -1)
    classes = first[:, width:]
    total = np.maximum(classes.sum(axis=1), 1)
    mean = first[:, :width] / total[:, None]

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        x, _, fold, inner = _unpacked(batch, width)
        m = plain.member(fold, inner)
        return np.stack([((x[m[:, s]] - mean[s]) ** 2).sum(axis=0) for s in range(n)]).ravel()

    spread = np.sqrt(_summed(rows, n * width, squares).reshape(n, width) / total[:, None])
    spread[spread == 0] = 1.0
    of, penalty = np.repeat(np.arange(n), len(penalties)), np.tile(np.array(penalties, float), n)
    models = Models(kind, sets, of, penalty, mean, spread, total[:, None] / (2 * np.maximum(classes, 1)), np.zeros((n * len(penalties), p)))
    mass = (models.balance * classes).sum(axis=1)[of]
    ridge = np.append(np.ones(width), 0.0)
    last, step = np.full(len(of), np.inf), np.zeros_like(models.weight)
    for _ in range(steps):

        def slopes(batch: pa.RecordBatch) -> np.ndarray:
            x, y, fold, inner = _unpacked(batch, width)
            return models.sums(x, y, models.member(fold, inner)).ravel()  # noqa: B023

        got = _summed(rows, len(of) * (p + p * p), slopes).reshape(len(of), -1) / np.maximum(mass, 1)[:, None]
        gradient = got[:, :p] + penalty[:, None] * ridge * models.weight
        norm = np.abs(gradient).max(axis=1)
        if (norm <= tolerance).all():
            break
        worse = norm > 2 * last  # Newton's step went too far: half of it
        models.weight = models.weight - np.where(worse[:, None], 0.5 * step, 0)
        step = np.where(worse[:, None], 0.5 * step, 0)
        hessian = got[:, p:].reshape(-1, p, p) + penalty[:, None, None] * np.diag(ridge) + 1e-12 * np.eye(p)
        own = -np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        step = np.where(worse[:, None], step, np.where((norm <= tolerance)[:, None], 0, own))
        models.weight = models.weight + np.where(worse[:, None], 0, step)
        last = np.where(worse, last, norm)
    return models


def _nested_linear(rows: DataFrame, width: int, kind: str, outer: int, inner: int, values: Sequence[float]) -> DataFrame:
    """All inner and outer models at once, then the penalty of each outer fold by the mean AUC of its inner ones."""
    sets = [(k, j) for k in range(outer) for j in range(-1, inner)]
    models = fit_models(rows, width, kind, sets, values)
    n = len(values)
    inside = [(s, v) for s, (_, j) in enumerate(sets) if j >= 0 for v in range(n)]

    def validate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of the rows that a set leaves out inside its outer fold's training rows."""
        for batch in batches:
            x, y, fold, within = _unpacked(batch, width)
            z = models.margins(x, np.arange(len(models.of)))
            for s, v in inside:
                k, j = sets[s]
                at = np.flatnonzero((fold != k) & (within[:, k] == j))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s * n + v, np.int32)), pa.array(z[at, s * n + v]), pa.array(y[at].astype(np.int32))], ["m", "score", "y"])

    auc = {r["m"]: r["auc"] or 0.0 for r in grouped_auc(rows.mapInArrow(validate, "m int, score double, y int"), "score", F.col("y") == 1, ["m"]).collect()}
    chosen = []
    for k in range(outer):
        mean = [sum(auc.get(s * n + v, 0.0) for s, (o, j) in enumerate(sets) if o == k and j >= 0) for v in range(n)]
        chosen.append(int(np.argmax(mean)))
    final = np.array([sets.index((k, -1)) * n + v for k, v in enumerate(chosen)])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fold, _ = _unpacked(batch, width)
            if len(x):
                z = models.margins(x, final)[np.arange(len(x)), fold]
                value = np.array(values, float)[np.array(chosen)[fold]]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(y), batch.column("fold"), pa.array(value), pa.array(z)], ["id", "y", "fold", "value", "score"])

    kind_of_id = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind_of_id}, y double, fold int, value double, score double")


def _forest_scores(value: float, train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
    """Test rows with a score: standardised on the training rows, classes weighted evenly."""
    n = {r["_y"]: r["count"] for r in train.groupBy("_y").count().collect()}
    weight = F.create_map(*[x for k, c in n.items() for x in (F.lit(k), F.lit(sum(n.values()) / (2.0 * c)))])[F.col("_y")]
    both = scaled(train, train.withColumn("_part", F.lit(0)).unionByName(test.withColumn("_part", F.lit(1))), features).withColumn("_w", weight)
    both = VectorAssembler(inputCols=list(features), outputCol="_x").transform(both)
    forest = RandomForestClassifier(maxDepth=int(value), numTrees=30, seed=42, featuresCol="_x", labelCol="_y", weightCol="_w")
    return forest.fit(both.where("_part = 0")).transform(both.where("_part = 1")).withColumn("score", vector_to_array("rawPrediction")[1]).select("_id", "_y", "score")


def _nested_forest(rows: DataFrame, features: Sequence[str], outer: int, inner: int, values: Sequence[float], threads: int) -> DataFrame:
    """Fits of a fold run side by side."""
    plain = [f"_in{k}" for k in range(outer)]

    def one(task: tuple[int, float, int]) -> float:
        k, value, j = task
        train = rows.where(F.col("_fold") != k)
        inside = F.col(f"_in{k}") == j
        s = _forest_scores(value, train.where(~inside).drop("_fold", *plain), train.where(inside).drop("_fold", *plain), features)
        return stats.rank_sum(s, "score", F.col("_y") == 1).first()["auc"] or 0.0

    tasks = [(k, v, j) for k in range(outer) for v in values for j in range(inner)]
    with ThreadPoolExecutor(threads) as pool:
        auc = dict(zip(tasks, pool.map(one, tasks), strict=True))
    out = None
    for k in range(outer):
        chosen = max(values, key=lambda v: sum(auc[k, v, j] for j in range(inner)))  # noqa: B023
        train, test = rows.where(F.col("_fold") != k).drop("_fold", *plain), rows.where(F.col("_fold") == k).drop("_fold", *plain)
        part = _forest_scores(chosen, train, test, features).select(F.col("_id").alias("id"), F.col("_y").alias("y"), F.lit(k).alias("fold"), F.lit(float(chosen)).alias("value"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def nested_cv(df: DataFrame, features: Sequence[str], label: str, key: str, kind: str = "logistic", outer: int = 5, inner: int = 5, grid: Sequence[float] | None = None, threads: int = 4) -> DataFrame:
    """Out-of-fold scores: id, y, fold, value (chosen inside), score. Rows with a null, or a label that is not 0 or 1, are left out.

    Logistic and svm (linear, squared hinge) fit all folds and penalties in
    common passes; forests are fitted one by one.
    """
    rows = df.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_y"), *features).dropna().where("_y in (0, 1)")
    rows = _dealt(rows, "_y", "_id", {"_fold": (outer, 42)} | {f"_in{k}": (inner, 43 + k) for k in range(outer)}, 42)
    values = list(grid or GRIDS[kind])
    scratch = scratch_of(df.sparkSession)
    if kind == "forest":
        return _nested_forest(scratch.save(rows, "folds"), features, outer, inner, values, threads)
    x = F.array(*[F.col(f).cast("double") for f in features])
    packed = rows.select(F.col("_id").alias("id"), F.col("_y").cast("int").alias("y"), x.alias("x"), F.col("_fold").alias("fold"), F.array(*[F.col(f"_in{k}") for k in range(outer)]).alias("inner"))
    return _nested_linear(scratch.save(packed, "folds"), len(features), kind, outer, inner, values)


def grouped_auc(df: DataFrame, score: str, positive: Column, keys: Sequence[str]) -> DataFrame:
    """By group: n_pos, n_neg, the area under the ROC curve, and average precision; null where a class is absent."""
    c = stats.value_counts(df.where(positive.isNotNull()), score, {"pos": positive}, keys)
    after = F.col("total_pos") - F.col("below_pos")  # positives of this score or a higher one
    seen = F.col("total") - F.col("below")
    negative = (F.col("below") - F.col("below_pos")) + (F.col("n") - F.col("n_pos")) / 2
    sums = c.groupBy(*keys).agg(F.max("total_pos").alias("n_pos"), F.max(F.col("total") - F.col("total_pos")).alias("n_neg"), F.sum(F.col("n_pos") * negative).alias("u"), F.sum(F.col("n_pos") * after / seen).alias("hits"))
    return sums.select(*keys, "n_pos", "n_neg", F.try_divide("u", F.col("n_pos") * F.col("n_neg")).alias("auc"), F.try_divide("hits", "n_pos").alias("average_precision"))


def fold_metrics(scored: DataFrame, cut: float = 0.0) -> DataFrame:
    """By fold: counts, balanced accuracy, F1 and accuracy at a cut of the score, ROC AUC and average precision."""
    p, y = F.col("score") > cut, F.col("y") == 1
    c = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    tpr, tnr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    c = c.select("*", ((tpr + tnr) / 2).alias("balanced_accuracy"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"))
    return c.join(grouped_auc(scored, "score", y, ["fold"]).drop("n_pos", "n_neg"), "fold")


def average_precision(scored: DataFrame, score: str, positive) -> DataFrame:
    """One row: the area under precision and recall, by steps over distinct scores."""
    return grouped_auc(scored, score, positive, []).select("average_precision")


def sigmoid(scored: DataFrame, score: str = "score", label: str = "y", steps: int = 50) -> tuple[float, float]:
    """a and b of the probability 1 / (1 + exp(a * score + b)) that fits labels best, by Newton's method, a pass an iteration.

    Targets are smoothed: (positives + 1) / (positives + 2) and
    1 / (negatives + 2). Scores should come from folds that did not train them.
    """
    rows = scored.where(stats.present(score) & F.col(label).isin(0, 1)).select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
    pos, n = rows.agg(F.sum("y"), F.count("y")).first()
    pos = pos or 0.0
    neg = n - pos
    t = F.when(F.col("y") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    a, b = 0.0, float(np.log((neg + 1) / (pos + 1)))
    da = db = 0.0
    last = np.inf
    for _ in range(steps):
        z = F.col("s") * a + b
        p = 1 / (1 + F.exp(F.least(F.greatest(z, F.lit(-700.0)), F.lit(700.0))))
        g, h, s = t - p, p * (1 - p), F.col("s")
        loss = t * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        r = rows.agg(F.sum(g * s), F.sum(g), F.sum(h * s * s), F.sum(h * s), F.sum(h), F.sum(loss)).first()
        if r[0] is None:
            break
        if r[5] > last + 1e-12 * abs(last):  # too far: back, and a shorter step
            da, db = da / 2, db / 2
            a, b = a - da, b - db
            continue
        last = r[5]
        if max(abs(r[0]), abs(r[1])) <= 1e-10 * max(n, 1):
            break
        hess = np.array([[r[2], r[3]], [r[3], r[4]]]) + 1e-12 * np.eye(2)
        da, db = -np.linalg.solve(hess, [r[0], r[1]])
        a, b = a + float(da), b + float(db)
    return float(a), float(b)


def calibrated(scored: DataFrame, score: str = "score", label: str = "y", name: str = "probability") -> DataFrame:
    """Rows with the sigmoid's probability of their score; null where the score is missing."""
    a, b = sigmoid(scored, score, label)
    z = F.least(F.greatest(F.col(score).cast("double") * a + b, F.lit(-700.0)), F.lit(700.0))
    return scored.withColumn(name, F.when(stats.present(score), 1 / (1 + F.exp(z))))


#: distribution function of Poisson(1), up to 8
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers that spreads every bit: two rounds of shift and product, which other engines have as well."""
    h = (h ^ (h >> np.uint64(16))) * np.uint64(2246822507) & np.uint64(0xFFFFFFFF)
    h = (h ^ (h >> np.uint64(13))) * np.uint64(3266489909) & np.uint64(0xFFFFFFFF)
    return h ^ (h >> np.uint64(16))


def draw_weights(s1: np.ndarray, s2: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) weights, rows times draws, from two 32-bit seeds a row."""
    b = np.arange(draws, dtype=np.uint64)
    u = mixed(s1.astype(np.uint64)[:, None] ^ mixed((s2.astype(np.uint64)[:, None] + b) & np.uint64(0xFFFFFFFF)))
    return np.searchsorted(np.array(POISSON) * 2.0**32, u, side="right").astype(float)


def _tied(v: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return v[first], np.add.reduceat(own, first, axis=0)


def resampled_auc(df: DataFrame, value: str, positive, key: str, draws: int = 5000, seed: int = 42) -> DataFrame:
    """(b, auc) of each bootstrap draw, with Poisson weights by hash of the id; a draw without one of the classes has a null AUC.

    Rows are sorted by value in ranges, and a range's rows stand for all draws
    as vectors, so what is shuffled on does not grow with rows times draws: a
    range gives its draws' sums and, by themselves, the values at its two ends,
    which other ranges may hold as well.
    """
    seeds = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    part = lambda at: F.conv(F.substring(seeds, at, 8), 16, 10).cast("long")
    rows = df.where(positive.isNotNull() & stats.present(value)).select(F.col(value).cast("double").alias("v"), positive.cast("int").alias("y"), part(1).alias("s1"), part(9).alias("s2"))
    dealt = rows.repartitionByRange("v", "s1").sortWithinPartitions("v")
    step = max(1, (1 << 18) // draws)  # rows times draws at a time

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positives, negatives and ordered pairs by draw: of the first value, of those between, and of the last one."""
        zero = np.zeros(draws)
        ends: list[tuple[float, np.ndarray, np.ndarray]] = []  # the first value and, later, the last one so far
        start, pos, neg, pairs = None, zero.copy(), zero.copy(), zero.copy()

        def inside(v: float, p: np.ndarray, n: np.ndarray) -> None:
            nonlocal start, pos, neg, pairs
            start = v if start is None else start
            pairs, pos, neg = pairs + p * (neg + n / 2), pos + p, neg + n

        for batch in batches:
            for k in range(0, batch.num_rows, step):
                c = batch.slice(k, step)
                v, y = c.column("v").to_numpy(), c.column("y").to_numpy()[:, None]
                w = draw_weights(c.column("s1").to_numpy(), c.column("s2").to_numpy(), draws)
                values, p = _tied(v, w * y)
                _, n = _tied(v, w * (1 - y))
                if ends and ends[-1][0] == values[0]:
                    p[0] += ends[-1][1]
                    n[0] += ends[-1][2]
                    ends.pop()
                for i, one in enumerate(values.tolist()):
                    if len(ends) == 2:
                        inside(*ends.pop())
                    if i + 1 < len(values) and len(ends) == 1:
                        # all but the last at once
                        seen = neg + np.cumsum(n[i:-1], axis=0) - n[i:-1] / 2
                        start = one if start is None else start
                        pairs = pairs + (p[i:-1] * seen).sum(axis=0)
                        pos, neg = pos + p[i:-1].sum(axis=0), neg + n[i:-1].sum(axis=0)
                        ends.append((float(values[-1]), p[-1], n[-1]))
                        break
                    ends.append((one, p[i], n[i]))
        pieces = [(v, True, p, n, zero) for v, p, n in ends] + ([(start, False, pos, neg, pairs)] if start is not None else [])
        for v, single, *sums in pieces:
            yield pa.RecordBatch.from_arrays([pa.array([v]), pa.array([single]), *(pa.array([s], pa.list_(pa.float64())) for s in sums)], ["v", "single", "p", "n", "u"])

    pieces = dealt.mapInArrow(run, "v double, single boolean, p array<double>, n array<double>, u array<double>")
    flat = pieces.select("v", "single", F.posexplode(F.arrays_zip("p", "n", "u")).alias("b", "s"))
    summed = flat.groupBy("b", "v", "single").agg(*[F.sum(f"s.{c}").alias(c) for c in "pnu"])
    before = Window.partitionBy("b").orderBy("v", F.desc("single")).rowsBetween(Window.unboundedPreceding, -1)  # three rows a range
    own = F.when(F.col("single"), F.col("p") * F.col("n") / 2).otherwise(F.col("u"))
    placed = summed.withColumn("u", own + F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    return placed.groupBy("b").agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("n")).alias("auc"))


MOST_LABELS = 10**9 - 1  # that the hypergeometric sampler takes


def permuted_auc(df: DataFrame, value: str, positive, draws: int = 5000, seed: int = 42) -> tuple[DataFrame, float | None]:
    """(b, auc) of each permutation of the labels, which keeps the number of positives, and the AUC of the labels as they are.

    Values are counted once. A draw deals its positives to ranges of values by
    a multivariate hypergeometric draw, for all draws on the driver (ranges
    times draws numbers), and inside a range value by value in one task. No row
    is ever copied. One class only, or none: no draws and no AUC. More than
    ``MOST_LABELS`` rows raise ValueError.
    """
    spark = df.sparkSession
    counts = stats.value_counts(df.where(positive.isNotNull()), value, {"pos": positive})
    scratch = scratch_of(spark)
    ranged = counts.select("value", "n", "n_pos").repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())
    ranged = scratch.save(ranged, "labels")
    sizes = {r["part"]: (r["n"], r["p"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("p")).collect()}  # a row a range
    parts = sorted(sizes)
    size, pos = np.array([sizes[k][0] for k in parts], np.int64), sum(sizes[k][1] for k in parts)
    n = int(size.sum())
    empty = spark.createDataFrame([], "b int, auc double")
    if not pos or pos == n:
        return empty, None
    if n > MOST_LABELS:
        raise ValueError(f"{n} labels are more than {MOST_LABELS}")
    took = np.random.default_rng(seed).multivariate_hypergeometric(size, pos, size=draws, method="marginals")
    rest = (size - took).cumsum(axis=1) - (size - took)  # negatives before each range
    at = {k: i for i, k in enumerate(parts)}
    pairs = float(pos) * float(n - pos)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i = at[key[0]]
        rng = np.random.default_rng([seed, i])
        pdf = pdf.sort_values("value")
        left, below, u = took[:, i].copy(), rest[:, i].astype(float), np.zeros(draws)
        remaining = int(size[i])
        for c in pdf["n"].tolist():
            p = rng.hypergeometric(left, remaining - left, c) if c < remaining else left.copy()
            u += p * (below + (c - p) / 2)
            below += c - p
            left -= p
            remaining -= c
        return pd.DataFrame({"u": [u]})

    sums = ranged.groupBy("part").applyInPandas(run, "u array<double>").select(F.posexplode("u").alias("b", "u"))
    seen = counts.agg(F.sum(F.col("n_pos") * (F.col("below") - F.col("below_pos") + (F.col("n") - F.col("n_pos")) / 2))).first()[0]
    return sums.groupBy("b").agg((F.sum("u") / pairs).alias("auc")), seen / pairs


def permutation_p(df: DataFrame, value: str, positive, draws: int = 5000, seed: int = 42) -> DataFrame:
    """One row: the AUC, and the share of label permutations that reach it; both null with one class only."""
    null, seen = permuted_auc(df, value, positive, draws, seed)
    share = F.avg((F.col("auc") >= F.lit(seen) - 1e-12).cast("double"))
    return null.agg(F.lit(seen).cast("double").alias("auc"), share.alias("p"))

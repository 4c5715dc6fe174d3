"""Document quality by hierarchical empirical Bayes.

A logistic model gives each document's evidence, as a log-likelihood ratio, from
the shape of the whole text and from its words: a naive Bayes score of hashed
words and word pairs, whose table is counted on one half of the labelled sample
and weighed on the other. Its probabilities are summed by host and by each
level of the path below; a level's rate is shrunk toward that of the level
above, the host's toward the global rate, each by a weight estimated from the
spread between groups, so sparse sites say little. A document's posterior adds
its evidence to the log odds of its deepest level's rate, from which the
document itself is taken out. Words that mark toxic labels give a second,
additive evidence.

Only the fit sees labels: at most about ``SAMPLE`` labelled documents, chosen
by a hash of the id. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_slice, spread_join, trimmed
from .shingles import mix, word_hashes

SAMPLE = 20_000  # labelled documents that the fit takes, about
WORDS = 2_000  # words kept as marks of toxicity
MARK_SHARE = 0.03  # of toxic documents that a mark is in, at least
BITS = 15  # of the number of a bucket of words and word pairs
SHAPES = 7
_CLASS = np.full(256, 4, np.uint8)  # other: bytes of letters beyond ASCII
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
for _c in range(33, 127):
    _CLASS[_c] = 1 if chr(_c).isupper() else 2 if chr(_c).isdigit() else 4 if chr(_c).isalpha() else 5 if chr(_c) in ".,;:!?'\"()-" else 3


class Model(NamedTuple):
    table: np.ndarray  # by bucket: the log-likelihood ratio of good documents
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the first is the intercept
    prior: float  # labelled rate of good documents
    words: np.ndarray  # sorted hashes of marks
    odds: np.ndarray  # their log-likelihood ratios
    toxic_prior: float


class Parts(NamedTuple):
    """Of several texts: shape features, and distinct words and buckets of each, joined, with their counts."""

    shapes: np.ndarray
    words: np.ndarray
    n_words: np.ndarray
    buckets: np.ndarray
    n_buckets: np.ndarray


def _distinct(doc: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=texts)


def read(texts: list[str]) -> Parts:
    """Shapes: shares of capitals, digits, symbols and marks among non-space bytes, log words, mean word length, share of distinct words."""
    hashes, count = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), count)
    words, n_words = _distinct(doc, hashes, len(texts))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = mix(hashes[pair] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[pair + 1])
    buckets, n_buckets = _distinct(np.concatenate([doc, doc[pair]]), np.concatenate([hashes, pairs]) >> np.uint64(64 - BITS), len(texts))
    shapes = np.zeros((len(texts), SHAPES))
    for i, (t, n, k) in enumerate(zip(texts, count.tolist(), n_words.tolist(), strict=True)):
        if n:
            r = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            c = np.bincount(_CLASS[r], minlength=6)
            solid = len(r) - c[0]
            shapes[i] = c[1] / solid, c[2] / solid, c[3] / solid, c[5] / solid, np.log1p(n), solid / n, k / n**0.9
    return Parts(shapes, words, n_words, buckets.astype(np.int64), n_buckets)


def features(table: np.ndarray, p: Parts) -> np.ndarray:
    """Shapes, then the mean of the buckets' log-likelihood ratios and the mean square of the negative ones."""
    doc = np.repeat(np.arange(len(p.n_buckets)), p.n_buckets)
    value = table[p.buckets]
    mean = np.bincount(doc, value, len(p.n_buckets)) / np.maximum(p.n_buckets, 1)
    low = np.bincount(doc, np.minimum(value, 0) ** 2, len(p.n_buckets)) / np.maximum(p.n_buckets, 1)
    return np.column_stack([p.shapes, mean, low])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all weights but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    pen = ridge * np.eye(len(w))
    pen[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen, x.T @ (y - p) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """From rows with labels quality and toxic (null: not used for that part).

    Labels of one id that differ are not used either; documents of one id all
    are. No labels: no evidence, an even prior.
    """
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    chosen = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(same(F.col("quality").cast("int")).alias("q"), same(F.col("toxic").cast("int")).alias("x"))
    n = chosen.count()
    if n > sample:
        chosen = chosen.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id").select("q", "x", half, "t")  # about sample rows

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        p = read(texts)
        lists = [pa.LargeListArray.from_arrays(np.append(0, np.cumsum(n)), pa.array(v.view(np.int64))).cast(pa.list_(pa.int64())) for v, n in ((p.words, p.n_words), (p.buckets, p.n_buckets))]
        return pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(list(p.shapes), pa.list_(pa.float64())), *lists], ["q", "x", "half", "f", "w", "b"])

    seen = rows.mapInArrow(per_slice(run, "t"), "q int, x int, half int, f array<double>, w array<long>, b array<long>").persist()
    first = seen.where("q is not null and half = 0")
    good, all_ = first.agg(F.coalesce(F.sum("q"), F.lit(0)), F.count("q")).first()
    counts = first.select("q", F.explode("b").alias("b")).groupBy("b").agg(F.sum("q").alias("good"), F.count(F.lit(1)).alias("n")).toPandas()  # a row a bucket
    hit, total = np.zeros((2, 1 << BITS)), np.array([all_ - good, good], float)
    hit[1, counts["b"].to_numpy(np.int64)] = counts["good"].to_numpy(float)
    hit[0, counts["b"].to_numpy(np.int64)] = (counts["n"] - counts["good"]).to_numpy(float)
    table = np.log((hit[1] + 1) / (total[1] + 2)) - np.log((hit[0] + 1) / (total[0] + 2)) if total.all() else np.zeros(1 << BITS)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(2)
            n = np.diff(b.offsets.to_numpy())
            p = Parts(np.array(batch.column(1).to_pylist(), float).reshape(-1, SHAPES), np.empty(0), np.empty(0), b.flatten().to_numpy(), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(table, p)), pa.list_(pa.float64()))], ["q", "f"])

    frame = seen.where("q is not null and half = 1").select("q", "f", "b").mapInArrow(trimmed(weigh), "q int, f array<double>").toPandas()
    f = np.stack(frame["f"].to_numpy()) if len(frame) else np.zeros((0, SHAPES + 2))
    q = frame["q"].to_numpy(float)
    mean, scale = (f.mean(axis=0), f.std(axis=0) + 1e-9) if len(f) else (np.zeros(SHAPES + 2), np.ones(SHAPES + 2))
    weight = logistic((f - mean) / scale, q) if len(set(q)) == 2 else np.zeros(SHAPES + 3)
    rate = (q.sum() + good + 1) / (len(q) + all_ + 2)
    total = {r["x"]: r["count"] for r in seen.where("x is not null").groupBy("x").count().collect()}
    bad, clean = total.get(1, 0), total.get(0, 0)
    by_word = seen.where("x is not null").select("x", F.explode("w").alias("w")).groupBy("w").agg(F.sum("x").alias("bad"), F.sum(1 - F.col("x")).alias("good")).where(F.col("bad") >= max(3, MARK_SHARE * bad))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (clean + 1.0))
    top = by_word.select("w", odds.alias("o")).where("o > 2").orderBy(F.desc("o"), "w").limit(WORDS).toPandas().sort_values("w")
    seen.unpersist()
    words = top["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return Model(table, mean, scale, weight, float(rate), words[order], top["o"].to_numpy(float)[order], (bad + 1) / (bad + clean + 2))


def evidence(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratios of quality, and of toxicity, clipped to +-20."""
    p = read(texts)
    x = (features(model.table, p) - model.mean) / model.scale
    fit_ = model.weight[0] + x @ model.weight[1:] - (np.log(model.prior / (1 - model.prior)) if model.weight.any() else 0.0)
    toxic = np.zeros(len(texts))
    if len(model.words) and len(p.words):
        at = np.minimum(np.searchsorted(model.words, p.words), len(model.words) - 1)
        hit = model.words[at] == p.words
        toxic = np.bincount(np.repeat(np.arange(len(texts)), p.n_words)[hit], model.odds[at[hit]], len(texts)).astype(float)  # without hits it counts in integers
    return np.clip(fit_, -20, 20), np.clip(toxic, -20, 20)


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _weight(groups: DataFrame, rate: float) -> float:
    """Pseudo-documents of the prior: variance inside groups over that between groups and what is above them, by moments."""
    gap = F.col("p") / F.col("n") - F.col("above")
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * gap * gap).alias("q")).first()
    if not r["n"] or r["k"] < 2:
        return 10.0
    within = max(rate * (1 - rate), 1e-6)
    between = (r["q"] - (r["k"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(min(max(within / max(between, 1e-9) - 1, 1.0), 1e4))


def score(docs: DataFrame, model: Model, scratch: Scratch, host: Column, path: Column | Sequence[Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, quality, toxic, keep) of every row.

    ``path`` is one level below the host, or several, each inside the one
    before; path_rate is that of the deepest. A null host is a host of its own,
    and so is a null path of a host. A null text is empty: it has the features
    of no words. Repeated rows all count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers and WORDS marks
    levels = [host, *([path] if isinstance(path, Column) else path)]
    names = [f"level{i}" for i in range(len(levels))]

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        good, bad = evidence(shared.value, texts)
        return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(good), pa.array(bad)], ["doc_id", *names, "evidence", "bad"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias(k) for k, c in zip(names, levels, strict=True)], F.col(text_col).alias("t"))
    prior = float(np.log(model.prior / (1 - model.prior)))
    seen = rows.mapInArrow(per_slice(run, "t"), "doc_id long, " + ", ".join(f"{k} string" for k in names) + ", evidence double, bad double")
    seen = scratch.save(seen.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + prior)))), "evidence")
    rate = float(seen.agg(F.avg("p")).first()[0] or model.prior)
    groups = scratch.save(seen.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")), "groups")
    table, shrink = groups.withColumnsRenamed({"n": "n_all", "p": "p_all"}), []
    above = F.lit(rate)
    for d in range(len(names)):
        keys = names[: d + 1]
        level = groups.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("w"))
        if d:  # the mean of the level above
            over = groups.groupBy(*keys[:-1]).agg(F.sum("n").alias("n0"), F.sum("p").alias("p0"), F.count_distinct(keys[-1]).alias("w0"))
            level = spread_join(scratch.save(level, "level"), over, keys[:-1], "w0")
            above = F.col("p0") / F.col("n0")
        level = scratch.save(level.withColumn("above", above), "level")
        shrink.append(_weight(level, rate))
        table = scratch.save(spread_join(table, level.select(*keys, F.col("n").alias(f"n{d}"), F.col("p").alias(f"p{d}"), "w"), keys, "w"), "table")
    out = spread_join(seen, table.drop("p_all"), names, "n_all")
    last = F.lit(rate)
    for d, w in enumerate(shrink):
        out = out.withColumn(f"rate{d}", (F.col(f"p{d}") - F.col("p") + w * last) / (F.col(f"n{d}") - 1 + w))
        last = F.col(f"rate{d}")
    out = out.withColumn("quality", 1 / (1 + F.exp(-(F.col("evidence") + _odds(last)))))
    out = out.withColumn("toxic", 1 / (1 + F.exp(-(F.col("bad") + float(np.log(model.toxic_prior / (1 - model.toxic_prior)))))))
    return out.select("doc_id", "evidence", F.col("rate0").alias("host_rate"), last.alias("path_rate"), "quality", "toxic", ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("keep"))

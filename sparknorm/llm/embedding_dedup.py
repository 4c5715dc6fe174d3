"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale each; the exact length of each
vector's quantisation error bounds the error of every approximate cosine
(Cauchy-Schwarz). Tiles of codes are stored once and multiplied; a pair whose
lower bound reaches the threshold is a link, one whose upper bound stays below
is none, and only for the pairs between are full vectors fetched, each once a
tile pair, and computed in double precision. No pair is lost.

Equal vectors are one class first. Classes of one label are dealt to slabs by
their projection on a fixed direction, and a slab is cut into tiles along a
second one. Unit vectors with cosine c are sqrt(2 - 2c) apart, and their
projections on orthogonal axes no further, so only tiles meet whose boxes along
``AXES`` directions are that near. A tile pair yields sums of links and a
spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, spread_join

TILE = 1024  # vectors of a tile, about
SLAB = 0.05  # width of a slab
AXES = 8  # directions of a tile's box
QUANTILES = 64
FOUND = ["a", "b", "n", "size", "ids", "weights", "pairs"]
SLACK = 1e-9  # more than rounding adds to a cosine or a projection


def even(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square leaves the range of doubles; exact."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of length > 0: int8 codes, scales, lengths of the codes' vectors, lengths of the errors."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    code = np.rint(unit / scale[:, None])
    near = code * scale[:, None]
    return code.astype(np.int8), scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


@lru_cache(maxsize=16)
def axes(dim: int) -> np.ndarray:
    """Orthonormal directions, the same in every task."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, min(AXES, dim))))[0]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows: float32 holds sums of up to 1024 of them exactly."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return out


def decide(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of two sides' codes, scales, lengths and errors: which pairs surely reach the threshold, and which may."""
    (qa, sa, ra, ea), (qb, sb, rb, eb) = a, b
    near = products(qa, qb) * sa[:, None] * sb
    bound = ra[:, None] * eb + ea[:, None] * rb + ea[:, None] * eb + SLACK
    return near - bound >= threshold, np.abs(near - threshold) <= bound


def reaches(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of pairs of rows, in double precision, reach the threshold."""
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 15):
        p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        keep[k : k + (1 << 15)] = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
    return keep


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            return root
        root = new


def _sums(i: np.ndarray, j: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Links between places of ``ids``: each vector with its partners' weight and the smallest place it is connected with."""
    got = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    hit = np.nonzero(got)[0]
    return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[forest(len(ids), i, j)[hit]]), pa.array(got[hit].astype(np.int64))], ["a", "b", "n"])


def _usable(v: Column, label: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Only vectors of one label and dimension are compared. A null label, a null,
    empty or zero vector, and one with null or non-finite components link with
    nothing. Rows are vectors, also when an id repeats; a null id counts as a
    link but names no component, and is kept nowhere.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", _usable(F.col("v"), F.col("label")))
    rows = rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64("label", F.size("v"), "v"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit("second"), "v", "label")))
    classes = rows.where("ok").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"), F.first("v").alias("v"), F.first("label").cast("string").alias("label"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    near = math.sqrt(2 - 2 * threshold) + SLACK
    reach = math.ceil(near / SLAB)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims = batch.column(0).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = even(np.stack([np.asarray(vectors[k], float) for k in own.tolist()]))
                code, *numbers = quantise(x)
                place = (x / np.linalg.norm(x, axis=1)[:, None]) @ axes(dim)
                kept = batch.take(pa.array(own))
                arrays = [pa.array(np.floor(place[:, 0] / SLAB).astype(np.int32)), pa.array(list(place), pa.list_(pa.float64())), pa.array([c.tobytes() for c in code], pa.binary()), *(pa.array(n) for n in numbers)]
                yield pa.RecordBatch.from_arrays([*kept.columns[1:], *arrays], ["cid", "copies", "label", "dim", "slab", "place", "code", "scale", "length", "error"])

    placed = classes.select("v", "cid", "copies", "label", F.size("v").alias("dim")).mapInArrow(project, "cid long, copies long, label string, dim int, slab int, place array<double>, code binary, scale double, length double, error double")
    placed = scratch.save(placed, "placed")
    second = F.when(F.size("place") > 1, F.col("place")[1]).otherwise(0.0)
    cells = placed.groupBy("label", "dim", "slab").agg(F.count(F.lit(1)).alias("w"), F.percentile_approx(second, [i / QUANTILES for i in range(1, QUANTILES)]).alias("cuts"))
    cells = scratch.save(cells.withColumn("tiles", F.ceil(F.col("w") / tile)), "cells")
    part = F.size(F.filter("cuts", lambda c: c <= second)) + F.pmod(F.xxhash64("cid"), F.lit(1024)) / 1024
    dealt = spread_join(placed, cells, ["label", "dim", "slab"], "w").withColumn("chunk", F.floor(part / QUANTILES * F.col("tiles"))).drop("cuts", "tiles")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        place = np.stack(pdf["place"].to_numpy())
        first = pdf.iloc[:1][["label", "dim", "slab", "chunk"]]
        packed = {c: pdf[c].to_numpy(k).tobytes() for c, k in (("cid", "<i8"), ("copies", "<i8"), ("scale", "<f8"), ("length", "<f8"), ("error", "<f8"))}
        return first.assign(low=[place.min(axis=0)], high=[place.max(axis=0)], code=b"".join(pdf["code"]), **packed)

    parts = ("cid", "copies", "code", "scale", "length", "error")
    tiles = dealt.groupBy("label", "dim", "slab", "chunk").applyInPandas(gather, "label string, dim int, slab int, chunk long, low array<double>, high array<double>, code binary, " + ", ".join(f"{c} binary" for c in parts if c != "code"))
    tiles = scratch.save(tiles.withColumn("tid", F.monotonically_increasing_id()), "tiles")
    boxes = tiles.select("tid", "label", "dim", "slab", "chunk", "low", "high")
    left = boxes.select("label", "dim", F.explode(F.sequence(F.col("slab"), F.col("slab") + reach)).alias("slab"), F.col("tid").alias("ta"), F.col("slab").alias("sa"), F.col("chunk").alias("ca"), F.col("low").alias("la"), F.col("high").alias("ha"))
    gaps = F.zip_with(F.zip_with("low", "ha", lambda x, y: x - y), F.zip_with("la", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = left.join(boxes.withColumnRenamed("tid", "tb"), ["label", "dim", "slab"]).where("sa < slab or ca <= chunk").where(apart <= near * near + SLACK).select("ta", "tb")
    sides = [tiles.select(F.col("tid").alias(t), *[F.col(c).alias(c + t[1]) for c in parts]) for t in ("ta", "tb")]
    work = pairs.join(sides[0], "ta").join(sides[1], "tb")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over sure links, and the open pairs of each tile pair as places i * (vectors of b) + j, with the vectors in them."""
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r["cid" + t], "<i8") for t in "ab")
                na, nb = (np.frombuffer(r["copies" + t], "<i8") for t in "ab")
                qa, qb = ((np.frombuffer(r["code" + t], np.int8).reshape(n, -1), *(np.frombuffer(r[c + t]) for c in ("scale", "length", "error"))) for t, n in (("a", len(a)), ("b", len(b))))
                sure, open_ = decide(qa, qb, threshold)
                if r["ta"] == r["tb"]:
                    sure, open_ = np.triu(sure, 1), np.triu(open_, 1)
                i, j = np.nonzero(sure)
                if len(i):
                    s = _sums(i, j + len(a), np.concatenate([a, b]), np.concatenate([na, nb])) if r["ta"] != r["tb"] else _sums(i, j, a, na)
                    yield pa.RecordBatch.from_arrays([*s.columns, *(pa.nulls(s.num_rows, k) for k in (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], FOUND)
                i, j = np.nonzero(open_)
                if len(i):
                    ids, place = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
                    weight = np.zeros(len(ids), "<i8")
                    weight[place] = np.concatenate([na[i], nb[j]])
                    yield pa.RecordBatch.from_arrays([pa.array([r["ta"]]), pa.array([r["tb"]]), pa.nulls(1, pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.astype("<i8").tobytes()]), pa.array([weight.tobytes()]), pa.array([place.astype("<i4").tobytes()])], FOUND)

    met = scratch.save(work.mapInArrow(compare, "a long, b long, n long, size long, ids binary, weights binary, pairs binary"), "met")
    open_ = met.where("size is not null").select(F.col("a").alias("ta"), F.col("b").alias("tb"), "ids", "weights", "pairs")

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([r["ta"]] * len(ids)), pa.array([r["tb"]] * len(ids)), pa.array(ids)], ["ta", "tb", "cid"])

    fetched = open_.select("ta", "tb", "ids").mapInArrow(spell, "ta long, tb long, cid long").join(classes.select("cid", "v"), "cid")
    none = lambda kind: F.lit(None).cast(kind)
    rows_of = fetched.select("ta", "tb", "cid", "v", none("binary").alias("weights"), none("binary").alias("pairs"))
    rows_of = rows_of.union(open_.select("ta", "tb", none("long").alias("cid"), none("array<double>").alias("v"), "weights", "pairs"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["pairs"].notna()
        vectors = pdf[~head].sort_values("cid")
        place = np.frombuffer(pdf.loc[head, "pairs"].iloc[0], "<i4")
        weight = np.frombuffer(pdf.loc[head, "weights"].iloc[0], "<i8")
        i, j = place[: len(place) // 2], place[len(place) // 2 :]
        x = even(np.stack([np.asarray(v, float) for v in vectors["v"]]))
        keep = reaches(x, x, i, j, threshold)
        return _sums(i[keep], j[keep], vectors["cid"].to_numpy(np.int64), weight).to_pandas()

    checked = rows_of.groupBy("ta", "tb").applyInPandas(verify, "a long, b long, n long")
    found = scratch.save(met.where("size is null").select("a", "b", "n").union(checked), "found")
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    comp = components(found.select("a", "b"), scratch)
    of = classes.select("cid", "low").join(comp, F.col("cid") == F.col("node")).select("cid", "low", "root")
    lows = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(lows, "root").select("cid", "component_id")
    info = classes.select("k1", "k2", "cid", "copies", "low").join(links, "cid", "left").join(of, "cid", "left")
    info = info.select("k1", "k2", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    out = spread_join(scratch.save(rows.select("vec_id", "k1", "k2"), "ids"), info, ["k1", "k2"], "copies", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

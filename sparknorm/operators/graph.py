"""Edge-list forms of graph and window operators, in DataFrame operations.

An edge table has the graph's keys and a, b, w with a < b.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparknorm.functions.contract import EPS

from . import stats
from .joins import salted_join


HELD = 256  # groups whose moments a task holds


def both_ways(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "w"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "w"))).alias("e")).select(*keys, "e.*")


def cleaned(edges: DataFrame, keys: Sequence[str], times: str | None = None) -> DataFrame:
    """One undirected edge a pair: the mean of what is given, within 0 and 1, no loops.

    With ``times``, a row's w is the mean of as many weights as that column says.
    """
    mean = F.avg("w")
    if times is not None:
        n = F.when(F.col("w").isNotNull(), F.nullif(F.col(times), F.lit(0)))
        mean = F.sum(F.col("w") * n) / F.sum(n)
    return edges.where("a <> b").groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("w"))


def correlation_edges(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """A graph for each group: the absolute correlations of an array's components over its rows, (group, a, b, w), components from 1.

    A task sends rows of second moments of its groups, at most ``HELD`` of which
    it holds at a time; vectors are never gathered. Null vectors and those with
    a null or non-finite component are left out; lengths that differ raise
    ValueError.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def moments() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["g", "m"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            if len(set(sizes.tolist())) > 1:
                raise ValueError(f"vectors of {sorted(set(sizes.tolist()))} components")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
            code, keys = pd.factorize(batch.column(0).to_pandas(), use_na_sentinel=False)
            order = np.argsort(code, kind="stable")
            z = np.column_stack([np.ones(len(x)), x])[order]
            bounds = np.searchsorted(code[order], np.arange(len(keys) + 1))
            for k, start, stop in zip(batch.column(0).take(pa.array(order[bounds[:-1]])).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                own = z[start:stop].T @ z[start:stop]
                old = sums.get(k)
                if old is not None and old.shape != own.shape:
                    raise ValueError(f"vectors of {sorted({old.shape[0] - 1, own.shape[0] - 1})} components")
                sums[k] = own if old is None else old + own
                if len(sums) > HELD:
                    yield moments()
                    sums = {}
        if sums:
            yield moments()

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b) for b in pdf["m"]]
        if len(sizes := {math.isqrt(len(p)) - 1 for p in parts}) > 1:
            raise ValueError(f"vectors of {sorted(sizes)} components")
        m = np.sum(parts, axis=0)
        m = m.reshape(math.isqrt(len(m)), -1)
        mean = m[0, 1:] / m[0, 0]
        cov = m[1:, 1:] - m[0, 0] * np.outer(mean, mean)
        dev = np.sqrt(np.maximum(np.diag(cov), 0))
        i, j = np.triu_indices(len(dev), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.abs(cov[i, j] / (dev[i] * dev[j]))
        return pd.DataFrame({group: pdf["g"].iloc[0], "a": i + 1, "b": j + 1, "w": w})

    kind = to_arrow_type(rows.schema[group].dataType)
    name = rows.schema[group].dataType.simpleString()
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    summed = rows.where(fine & (F.size(v) > 0)).select(F.col(group).alias("g"), v).mapInArrow(run, f"g {name}, m binary")
    return summed.groupBy("g").applyInPandas(edges, f"{group} {name}, a int, b int, w double")


def strength(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By graph: mean strength and its variation over nodes."""
    nodes = both_ways(edges, keys).groupBy(*keys, "u").agg(F.sum("w").alias("s"))
    return nodes.groupBy(*keys).agg(F.avg("s").alias("mean_degree"), (F.stddev_pop("s") / (F.avg("s") + EPS)).alias("degree_cv"))


def clustering(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By graph: mean over nodes of two neighbours or more of the triangles' cube-root weights. Triangles are found from their smallest corner."""
    e = edges.where("w > 0").select(*keys, "a", "b", F.cbrt("w").alias("c"))
    second = e.select(*keys, F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("c").alias("c2"))
    third = e.select(*keys, F.col("a").alias("a3"), F.col("b").alias("b3"), F.col("c").alias("c3"))
    k = list(keys)
    wedge = e.join(second, k).where("a = a2 and b < b2")
    tri = wedge.join(third, k).where("b = a3 and b2 = b3").select(*keys, F.array("a", "b", "b2").alias("n"), (F.col("c") * F.col("c2") * F.col("c3")).alias("t"))
    of_node = tri.select(*keys, F.explode("n").alias("u"), "t").groupBy(*keys, "u").agg(F.sum(2 * F.col("t")).alias("t"))
    degree = both_ways(edges.where("w > 0"), keys).groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    each = degree.join(of_node, [*k, "u"], "left").withColumn("c", F.coalesce("t", F.lit(0.0)) / (F.col("d") * (F.col("d") - 1)))
    return each.groupBy(*keys).agg(F.avg("c").alias("clustering"))


def densest(edges: DataFrame, keys: Sequence[str], density: float) -> DataFrame:
    """The strongest share of a graph's edges; equal ones at the limit stay."""
    if not 0 < density <= 1:
        raise ValueError("density lies in (0, 1]")
    w = Window.partitionBy(*keys)
    limit = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * density))
    most, rank = stats._free(edges, "_most"), stats._free(edges, "_rank")
    return edges.withColumn(most, limit).withColumn(rank, F.rank().over(w.orderBy(F.desc("w")))).where(F.col(rank) <= F.col(most)).drop(most, rank)


def changes(edges: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Relative Frobenius change from each window's graph to the next, by keys and window.

    Both triangles of a matrix count alike, so the edge list gives the same ratio.
    """
    own = Window.partitionBy(*keys, "a", "b").orderBy(order)
    step = edges.withColumn("_p", F.lag("w").over(own)).where("_p is not null")
    return step.groupBy(*keys, order).agg((F.sqrt(F.sum(F.pow(F.col("w") - F.col("_p"), 2))) / (F.sqrt(F.sum(F.col("_p") * F.col("_p"))) + EPS / 2**0.5)).alias("delta"))


def average_reference(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples (keys, t, v) less the mean over channels at each time."""
    return samples.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(*keys, "t")))


def robust_outliers(channels: DataFrame, keys: Sequence[str], value: str, limit: float = 5.0) -> DataFrame:
    """Channels with their robust z of a spread; an outlier lies above the limit. Where the spread is missing, so are both.

    The spreads are counted once; the distances from the medians are those of
    the distinct values, so the second medians need no reading of the channels.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    named = channels.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).cast("double").alias("v"))
    scratch = stats.scratch_of(channels.sparkSession)
    same = lambda: [F.col(o).eqNullSafe(F.col(f"g{o}")) for o in own]
    grouped = lambda df, name: df.select(*[F.col(o).alias(f"g{o}") for o in own], F.col("q")[0].alias(name), F.col("total").alias("_all"))
    counts = stats.value_counts(named, "v", keys=own)
    middle = scratch.save(grouped(stats.of_counts(counts, [0.5], own), "_m"), "medians")
    apart = counts.join(middle, same() or F.lit(True)).select(*own, F.abs(F.col("value") - F.col("_m")).alias("d"), "n")
    mad = grouped(stats.of_counts(stats.value_counts(apart, "d", keys=own, weight=F.col("n")), [0.5], own), "_mad")
    both = middle.join(mad.drop("_all").withColumnsRenamed({f"g{o}": f"h{o}" for o in own}), [F.col(f"g{o}").eqNullSafe(F.col(f"h{o}")) for o in own] or F.lit(True)).drop(*[f"h{o}" for o in own])
    # null is a group of its own: a struct is never null and equals another of null fields
    pair = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("key"))
    seats = own or ["_k"]
    group = lambda cs: {o: pair(c) for o, c in zip(own, cs, strict=True)} or {"_k": F.lit(0)}
    table = scratch.save(both.withColumns(group([f"g{o}" for o in own])).select(*seats, "_m", "_mad", "_all"), "robust")
    out = salted_join(channels.withColumns(group(keys)), table, seats, "_all")
    z = 0.6745 * (F.col(value) - F.col("_m")) / (F.col("_mad") + EPS)
    return out.select(*channels.columns, z.alias("robust_z"), (z > limit).alias("bad"))


def window_means(events: DataFrame, time: str, value: str, length: str, step: str, keys: Sequence[str] = ()) -> DataFrame:
    """Means over sliding event-time windows."""
    return events.groupBy(*keys, F.window(time, length, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("start"), "n", "mean")


def change_summary(steps: DataFrame, keys: Sequence[str], delta: str = "delta") -> DataFrame:
    """By graph: number, mean, population deviation, their ratio, and greatest of its changes."""
    return steps.groupBy(*keys).agg(F.count(delta).alias("n_transitions"), F.avg(delta).alias("mean_delta"), F.stddev_pop(delta).alias("std_delta"), (F.stddev_pop(delta) / (F.avg(delta) + EPS)).alias("cv_delta"), F.max(delta).alias("max_delta"))


def subset(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether all keys of the first table are in the second."""
    return not a.select(key).join(b.select(key), key, "left_anti").limit(1).count()


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return not a.select(key).join(b.select(key), key, "left_semi").limit(1).count()

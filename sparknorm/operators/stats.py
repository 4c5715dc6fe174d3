"""Ranks, percentiles and two-sample statistics without a global sort.

Values are counted once each, so ties and repeated values cost nothing; the
distinct values are dealt to ranges, counted up inside each range, and the
ranges' totals are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparknorm.functions.columns import finite
from sparknorm.functions.contract import EPS

from .joins import salted_join
from .scratch import scratch_of


def _free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


def present(value: str) -> Column:
    """Neither null nor NaN, which both count as missing here."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def value_counts(df: DataFrame, value: str, flags: dict[str, Column] | None = None, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Each distinct value, of each group where there are keys, with its count, the counts before it and of all; the same for rows with each flag.

    Columns: the keys, value, n, below, total, and n_, below_ and total_ of each
    flag. Nulls and NaN are left out; with a weight, a row counts so often.

    The rows are read once. Their counts are saved, dealt by ranges of group and
    value, and counted up inside a range; a range's share of the counts is even,
    so a large group has many and small ones share one. Only groups that cross
    a border of ranges, two a range at most, need the counts of earlier ranges.
    """
    flags, one = flags or {}, F.lit(1).cast("long") if weight is None else weight
    scratch = scratch_of(df.sparkSession)
    own = [f"_k{i}" for i in range(len(keys))]
    names = ["n", *[f"n_{k}" for k in flags]]
    sums = [F.sum(one).alias("n"), *[F.sum(F.when(c, one).otherwise(0)).alias(f"n_{k}") for k, c in flags.items()]]
    named = [F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]
    counted = scratch.save(df.where(present(value)).groupBy(*named, F.col(value).cast("double").alias("value")).agg(*sums), "counts")
    dealt = counted.repartitionByRange(*own, "value").withColumn("span", F.spark_partition_id())
    part = Window.partitionBy(*own, "span")
    before = part.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"i_{c}") for c in names], *[F.sum(c).over(part).alias(f"t_{c}") for c in names])
    inside = scratch.save(inside, "ranges")
    spans = inside.groupBy(*own, "span").agg(*[F.first(f"t_{c}").alias(c) for c in names])
    lists = spans.groupBy(*own).agg(F.collect_list(F.struct("span", *names)).alias("spans")).where(F.size("spans") > 1)
    zero = F.lit(0).cast("long")

    def up_to(c: str, limit: Column | None) -> Column:
        return F.aggregate("spans", zero, lambda s, x: s + (x[c] if limit is None else F.when(x["span"] < limit, x[c]).otherwise(zero)))

    borders = lists.withColumn("at", F.explode("spans.span"))
    borders = borders.select(*[F.col(o).alias(f"b{o}") for o in own], "at", *[up_to(c, F.col("at")).alias(f"b_{c}") for c in names], *[up_to(c, None).alias(f"a_{c}") for c in names])
    match = F.col("span") == F.col("at")
    for o in own:
        match = match & F.col(o).eqNullSafe(F.col(f"b{o}"))
    joined = inside.join(F.broadcast(borders), match, "left")
    below = [(F.col(f"i_{c}") + F.coalesce(f"b_{c}", zero)).alias(c.replace("n", "below", 1)) for c in names]
    total = [F.coalesce(f"a_{c}", f"t_{c}").alias(c.replace("n", "total", 1)) for c in names]
    return joined.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], "value", *names, *below, *total)


def of_counts(counts: DataFrame, q: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles by group from ``value_counts``: the keys, column q and the group's total."""
    own = [f"_k{i}" for i in range(len(keys))]
    counts = counts.withColumnsRenamed(dict(zip(keys, own, strict=True)))
    at = [(F.col("total") - 1) * float(x) for x in q]
    holds = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
    ends = [F.max(F.when(holds(g(p)), F.col("value"))).alias(f"{n}{i}") for i, p in enumerate(at) for n, g in (("low", F.floor), ("high", F.ceil))]
    found = counts.groupBy(*own).agg(F.max("total").alias("total"), *ends).where("total is not null")
    part = lambda i, p: F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (p - F.floor(p))
    return found.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], F.array(*[part(i, p) for i, p in enumerate(at)]).alias("q"), "total")


def quantiles(df: DataFrame, value: str, q: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """By group: the keys, and column q, the exact quantiles by linear interpolation, from counts of distinct values; no group is gathered."""
    return of_counts(value_counts(df, value, keys=keys), q, keys).drop("total")


def _mean_rank(descending: bool = False) -> Column:
    first = F.col("total") - F.col("below") - F.col("n") if descending else F.col("below")
    return first + (F.col("n") + 1) / 2


def average_rank(df: DataFrame, value: str, descending: bool = False, name: str = "rank") -> DataFrame:
    """Rows with their rank, equal values sharing the mean of theirs; null where the value is missing. A column of that name is replaced."""
    key, rank, weight = _free(df, "_v"), _free(df, "_rank"), _free(df, "_weight")
    ranks = value_counts(df, value).select(F.col("value").alias(key), _mean_rank(descending).alias(rank), F.col("n").alias(weight))
    keyed = df.withColumn(key, F.when(present(value), F.col(value).cast("double")))
    return salted_join(keyed, scratch_of(df.sparkSession).save(ranks, "ranks"), [key], weight).select(*[c for c in df.columns if c != name], F.col(rank).alias(name))


def rank_shift(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows with both columns' descending ranks and the distance between them. Both columns are counted in one pass."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate((first, second))])))
    ranks = value_counts(long, "v", keys=["f"]).select("f", "value", _mean_rank(True).alias("r"), "n")
    ranks = scratch_of(df.sparkSession).save(ranks, "ranks")
    out, columns = df, df.columns
    for i, (c, name) in enumerate(((first, "rank_first"), (second, "rank_second"))):
        key, weight = _free(df, f"_v{i}"), _free(df, f"_weight{i}")
        own = ranks.where(F.col("f") == i).select(F.col("value").alias(key), F.col("r").alias(name), F.col("n").alias(weight))
        out = salted_join(out.withColumn(key, F.when(present(c), F.col(c).cast("double"))), own, [key], weight)
        columns = [*columns, name]
        out = out.select(*columns)
    return out.withColumn("shift", F.abs(F.col("rank_first") - F.col("rank_second")))


def top_share(df: DataFrame, value: str, q: float = 0.75) -> DataFrame:
    """Rows whose value reaches the quantile, with the limit."""
    (row,) = quantiles(df, value, [q]).collect() or [None]
    limit = row["q"][0] if row else None
    return df.withColumn("limit", F.lit(limit).cast("double")).where(F.col(value) >= F.col("limit"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Each distinct value and the share of rows up to it."""
    return value_counts(df, value).select("value", ((F.col("below") + F.col("n")) / F.col("total")).alias("share"))


def percentile_of(df: DataFrame, value: str, reference: Column) -> DataFrame:
    """Rows with their percentile among reference rows: the mean-rank form and the strict one; 0 without reference rows."""
    left, same, n = F.col("below_ref"), F.col("n_ref"), F.greatest("total_ref", F.lit(1))
    key, weight = _free(df, "_v"), _free(df, "_weight")
    scores = value_counts(df, value, {"ref": reference}).select(F.col("value").alias(key), ((2 * left + same + (same > 0).cast("int")) * 50.0 / n).alias("percentile_rank"), (100.0 * left / n).alias("percentile_strict"), F.col("n").alias(weight))
    keyed = df.withColumn(key, F.when(present(value), F.col(value).cast("double")))
    return salted_join(keyed, scratch_of(df.sparkSession).save(scores, "scores"), [key], weight).select(*df.columns, "percentile_rank", "percentile_strict")


def rank_sum(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """One row: n_pos, n_neg, u (of the positives) and auc. One class only: auc null."""
    counts = value_counts(df.where(positive.isNotNull()), value, {"pos": positive})
    rank = F.col("below") + (F.col("n") + 1) / 2
    sums = counts.agg(F.sum("n_pos").alias("n_pos"), F.sum(F.col("n") - F.col("n_pos")).alias("n_neg"), F.sum(F.col("n_pos") * rank).alias("r"), F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("ties"))
    u = F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return sums.select("n_pos", "n_neg", u.alias("u"), F.try_divide(u, F.col("n_pos") * F.col("n_neg")).alias("auc"), "ties")


def mann_whitney(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """``rank_sum`` with z (normal approximation, continuity and tie corrected) and the one-sided p of larger positives."""
    s = rank_sum(df, value, positive)
    n = F.col("n_pos") + F.col("n_neg")
    spread = F.sqrt(F.col("n_pos") * F.col("n_neg") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    s = s.withColumn("z", F.try_divide(F.col("u") - F.col("n_pos") * F.col("n_neg") / 2.0 - 0.5, spread))
    row = s.first()
    p = None if row["z"] is None else 0.5 * math.erfc(row["z"] / math.sqrt(2))
    return s.select("n_pos", "n_neg", "u", "auc", "z", F.lit(p).cast("double").alias("p"))


def two_groups(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """One row: Welch's t with its degrees of freedom and two-sided p, and Cohen's d with population variances pooled by n - 1."""
    x = F.col(value)
    a = df.agg(*[f(F.when(c, x)).alias(f"{k}{g}") for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp), ("q", F.var_pop)) for g, c in ((1, positive), (2, ~positive))])
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    gap = F.col("m1") - F.col("m2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("q1") + (F.col("n2") - 1) * F.col("q2")) / (F.col("n1") + F.col("n2") - 2))
    df_ = F.pow(e1 + e2, 2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    found = a.select("n1", "n2", "m1", "m2", F.try_divide(gap, F.sqrt(e1 + e2)).alias("t"), df_.alias("dof"), F.try_divide(gap, pooled).alias("cohen_d"))
    row = found.first()
    p = t_tail(row["t"], row["dof"]) if row["t"] is not None and row["dof"] else None
    return found.withColumn("p", F.lit(p).cast("double"))


def t_tail(t: float, dof: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    return incomplete_beta(dof / 2, 0.5, x)


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def chi_square_quantile(p: float, dof: int) -> float:
    """By bisection on the regularised lower gamma function's series."""

    def cdf(x: float) -> float:
        s, term, k = 0.0, 1 / math.gamma(dof / 2 + 1), 0
        while term > 1e-17 * max(s, 1e-300) and k < 5000:
            s += term
            k += 1
            term *= (x / 2) / (dof / 2 + k)
        return s * math.exp(-x / 2) * (x / 2) ** (dof / 2)

    low, high = 0.0, dof + 20 * math.sqrt(2 * dof) + 20
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


SUMS = ("n", "sx", "sxx", "sxy")


def _pair_sums(rows: DataFrame, width: int, matrices: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]) -> dict[str, np.ndarray]:
    """Sums over rows for all pairs of columns, each task's added up before they are shuffled; columns squared come to the driver.

    ``matrices`` gives of a batch the pairs' n, and x, x * x and x * y where both are present.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, width, width))
        for batch in batches:
            if batch.num_rows:
                sums += np.stack(matrices(batch))
        i, j = np.indices((width, width)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(m.ravel()) for m in sums)], ["i", "j", *SUMS])

    parts = rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))
    out = {c: np.zeros((width, width)) for c in SUMS}
    for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS]).collect():
        for c in SUMS:
            out[c][r["i"], r["j"]] = r[c]
    return out


def _correlated(df: DataFrame, names: Sequence[str], s: dict[str, np.ndarray]) -> DataFrame:
    """The table of pairs from sums about any centre: s[i, j] is that of column i over rows where j is present as well."""
    n = np.maximum(s["n"], 1)
    cov = s["sxy"] - s["sx"] * s["sx"].T / n
    var = np.maximum(s["sxx"] - s["sx"] ** 2 / n, 0)
    var[var <= 1e-14 * s["sxx"]] = 0  # what rounding leaves of a column that does not vary
    out = []
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            d = math.sqrt(var[i, j] * var[j, i])
            r = float(np.clip(cov[i, j] / d, -1, 1)) if d > 0 else None
            count = int(s["n"][i, j])
            t = r * math.sqrt((count - 2) / (1 - r * r)) if r is not None and count > 2 and abs(r) < 1 else None
            out.append((a, names[j], r, count, t, t_tail(t, count - 2) if t is not None else None))
    return df.sparkSession.createDataFrame(out, "a string, b string, r double, n long, t double, p double")


def _missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns as doubles c0, c1 and so on, NaN where missing."""
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(names)])


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlations of all pairs of columns, each over the rows that have both: a, b, r with a before b in order, their n, t, and two-sided p.

    One pass for a centre, one for products of values, squares and masks, so the
    pairs cost no aggregates of their own. Null and NaN are missing. r is null
    where a column does not vary over a pair's rows.
    """
    rows = _missing(df, names)
    centre = np.array([v or 0.0 for v in rows.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in rows.columns]).first()])

    def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
        m = ~np.isnan(x)
        x, m = np.where(m, x, 0.0), m.astype(float)
        return m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x

    return _correlated(df, names, _pair_sums(rows, len(names), matrices))


def strong_pairs(df: DataFrame, names: Sequence[str], least: float = 0.85) -> DataFrame:
    """Pairs of columns whose absolute correlation exceeds a limit."""
    return correlations(df, names).where(F.abs("r") > least)


def spearman(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rank correlations of all pairs of columns: the Pearson table of ranks within each pair's rows.

    A value's rank among the rows where another column is present differs from
    that among all only where that column misses some, so values are counted
    once, with a count beside it for each such column. A row then carries its
    values' ranks, one more for each of those columns.
    """
    rows = _missing(df, names)
    missing = rows.agg(*[F.count_if(F.isnan(c)) for c in rows.columns]).first()
    gaps = [i for i, n in enumerate(missing) if n]
    seen = {f"{i}": ~F.isnan(F.col(f"c{i}")) for i in gaps}
    keyed = rows.withColumn("_id", F.monotonically_increasing_id())
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"c{i}").alias("v")) for i in range(len(names))])
    long = keyed.select("_id", *[c.alias(f"p{i}") for i, c in seen.items()], F.inline(cells)).where(~F.isnan("v"))
    counts = value_counts(long, "v", {i: F.col(f"p{i}") for i in seen}, ["f"])
    ranks = [F.col("below") + (F.col("n") + 1) / 2, *[F.col(f"below_{i}") + (F.col(f"n_{i}") + 1) / 2 for i in seen]]
    table = scratch_of(df.sparkSession).save(counts.select("f", F.col("value").alias("v"), *[r.alias(f"r{k}") for k, r in enumerate(ranks)], F.col("n").alias("_n")), "ranks")
    ranked = salted_join(long.select("_id", "f", "v"), table, ["f", "v"], "_n", "inner")
    cells = [F.max(F.when(F.col("f") == i, F.col(f"r{k}"))).alias(f"r{i}_{k}") for i in range(len(names)) for k in range(len(ranks))]
    wide = ranked.groupBy("_id").agg(*cells).drop("_id")
    depth, width = 1 + len(gaps), len(names)
    use = np.array([1 + gaps.index(j) if j in gaps else 0 for j in range(width)])  # which rank counts beside column j
    middle = (df.count() + 1) / 2

    def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        r = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).reshape(-1, width, depth)
        sums = [np.zeros((width, width)) for _ in SUMS]
        for k in range(0, len(r), 256):
            x = r[k : k + 256][:, :, use] - middle
            x = np.where(np.isnan(x) | np.isnan(x).transpose(0, 2, 1), np.nan, x)
            m = ~np.isnan(x)
            x = np.where(m, x, 0.0)
            for total, part in zip(sums, (m, x, x * x, x * x.transpose(0, 2, 1)), strict=True):
                total += part.sum(axis=0)
        return tuple(sums)

    return _correlated(df, names, _pair_sums(wide, width, matrices))


def collinearity(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Rank and condition of the standardised columns, from their correlation matrix."""
    c = np.eye(len(names))
    at = {f: i for i, f in enumerate(names)}
    for row in correlations(df, names).collect():  # columns squared
        c[at[row["a"]], at[row["b"]]] = c[at[row["b"]], at[row["a"]]] = row["r"] or 0.0
    value = np.linalg.eigvalsh(c)
    return {"rank": int((value > 1e-10 * value.max()).sum()), "cond": float(math.sqrt(value.max() / max(value.min(), 1e-300)))}


def zscore(df: DataFrame, names: Sequence[str], eps: float = EPS) -> DataFrame:
    """Columns less their mean, by their population deviation; NaN counts as null and stays null, and so is a column without a value."""
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    s = df.agg(*[f(clean(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (clean(c) - F.lit(s[f"m{i}"])) / (F.lit(s[f"s{i}"]) + eps) for i, c in enumerate(names)})


def adjusted(df: DataFrame, value: str, age: str, controls: Column, name: str = "adjusted") -> DataFrame:
    """Rows with what a line through the controls' ages leaves of a value; null throughout where the controls have no two ages."""
    r = df.where(controls).agg(F.regr_intercept(value, age).alias("a"), F.regr_slope(value, age).alias("b")).first()
    return df.withColumn(name, F.col(value) - (F.lit(r["a"]) + F.lit(r["b"]) * F.col(age)))


def median_cut(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """One row: the median, the confusion counts of values above it, and the balanced accuracy."""
    (row,) = quantiles(df.where(positive.isNotNull()), value, [0.5]).collect() or [None]
    cut = F.lit(row["q"][0] if row else None).cast("double")
    p = F.col(value) > cut
    c = df.where(positive.isNotNull() & F.col(value).isNotNull()).agg(F.count_if(p & positive).alias("tp"), F.count_if(p & ~positive).alias("fp"), F.count_if(~p & positive).alias("fn"), F.count_if(~p & ~positive).alias("tn"))
    return c.select(cut.alias("median"), "*", ((F.try_divide("tp", F.col("tp") + F.col("fn")) + F.try_divide("tn", F.col("tn") + F.col("fp"))) / 2).alias("balanced_accuracy"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal bins from the least to the greatest value, the last one closed: bin, n, density. Values that are no finite numbers are left out."""
    x = F.col(value).cast("double")
    df = df.where(finite(x))
    low, high, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, n long, density double")
    width = (high - low) / bins or 1.0
    k = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    return df.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("density", F.col("n") / (n * width))

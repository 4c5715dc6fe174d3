"""Queries over the driver's tables, each with its SQL where SQL can express it.

The 54 features of a subject stand in ``embeddings``: components 1 to 54 in
canonical order, the covariate in component 55, the group in ``label`` (the
reference is label 0). Numbers are rounded, so that two engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparknorm.functions import columns as C
from sparknorm.functions import registry
from sparknorm.functions import signal as S
from sparknorm.functions.contract import BLOCKS, FEATURES
from sparknorm.operators import aggregate, channels, cohort, extract, graph, ml, normative, recordings, stats, validate
from sparknorm.operators.scratch import scratch_of
from sparknorm.plans import sql
from sparknorm.plans.sql import AT
from sparknorm.sources import biosignal, readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SE = {"SE": BLOCKS["SE"]}


def query(text: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if text:
            ORACLES[fn.__name__] = text
        return fn

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return readers.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("participant_id"), F.col("label").alias("group"), at(54).alias("age"), *[at(i).alias(f) for i, f in enumerate(FEATURES)])


def saved(df: DataFrame) -> DataFrame:
    """A table for several passes."""
    return scratch_of(df.sparkSession).save(df, "query")


def reference() -> Column:
    return F.col("group") == 0


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normative.score_cohort(subjects(spark, sf_dir), reference())


def _model(spark: SparkSession, sf_dir: str) -> normative.Model:
    return normative.fit(subjects(spark, sf_dir), reference())


WITH = sql.scored()
D = [f"D_{b}" for b in BLOCKS]
ROUNDED = ", ".join(f"{sql.r(d)} AS {d}" for d in (*D, "composite"))


# scores


@query(f"{WITH} SELECT participant_id, grp AS \"group\", {ROUNDED} FROM scored")
def normative_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("participant_id", "group", *[r(d).alias(d) for d in (*D, "composite")])


@query("WITH " + sql.SUBJECTS + " " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {sql.r(f'regr_intercept(x{i}, age)')} AS intercept, {sql.r(f'regr_slope(x{i}, age)')} AS slope FROM subjects WHERE grp = 0" for f, i in AT.items()))
def age_models(spark, sf_dir):
    coef, _ = normative.fit(subjects(spark, sf_dir), reference()).tables(spark)
    return coef.select("feature", r("intercept").alias("intercept"), r("slope").alias("slope"))


def _fitted_sql(lam: str = "0.1") -> str:
    """WITH … up to v_<block> and s_<block>, the residual covariances, and r_<block>, the residuals."""
    parts = [sql.SUBJECTS]
    for name, features in BLOCKS.items():
        parts += [*sql.residuals(name, [AT[f] for f in features]), *sql.covariance(name, len(features), lam)]
    return "WITH " + ", ".join(parts) + " "


def _cells_sql() -> str:
    out = []
    for name, features in BLOCKS.items():
        cells = [(i, j, max(i, j), min(i, j)) for i in range(1, len(features) + 1) for j in range(1, len(features) + 1)]
        lists = {"i": [str(i - 1) for i, *_ in cells], "j": [str(j - 1) for _, j, *_ in cells], "raw": [sql.r(f"v_{a}_{b}") for *_, a, b in cells], "cov": [sql.r(f"s_{a}_{b}") for *_, a, b in cells]}
        out.append(f"SELECT '{name}' AS block, * FROM ({sql.listed(lists, f'v_{name}, s_{name}')})")
    return _fitted_sql() + " UNION ALL ".join(out)


@query(_cells_sql())
def residual_covariance(spark, sf_dir):
    _, cov = _model(spark, sf_dir).tables(spark)
    return cov.select("block", "i", "j", r("raw").alias("raw"), r("cov").alias("cov"))


GRID = (0.01, 0.05, 0.2, 0.5)


def _grid_sql(grid: tuple[float, ...]) -> str:
    parts = [sql.SUBJECTS]
    out = []
    for name, features in BLOCKS.items():
        parts += sql.residuals(name, [AT[f] for f in features])
    for n, lam in enumerate(grid):
        for name, features in BLOCKS.items():
            g, p = f"{name}{n}", len(features)
            parts += [c.replace(f"FROM r_{g}", f"FROM r_{name}") for c in sql.covariance(g, p, str(lam))]
            parts += [*sql.cholesky(g, p, f"s_{g}"), f"j_{g} AS (SELECT * FROM r_{name}, k_{g})", *sql.distance(g, p, f"j_{g}")]
        joins = " ".join(f"JOIN d_{b}{n} USING (participant_id)" for b in list(BLOCKS)[1:])
        mean = " + ".join(f"d_{b}{n}.d" for b in BLOCKS)
        out.append(f"SELECT participant_id, CAST({lam} AS DOUBLE) AS lambda, " + ", ".join(f"{sql.r(f'd_{b}{n}.d')} AS D_{b}" for b in BLOCKS) + f", {sql.r(f'({mean}) / {len(BLOCKS)}')} AS composite FROM d_{list(BLOCKS)[0]}{n} {joins}")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(out)


@query(_grid_sql(GRID))
def lambda_grid(spark, sf_dir):
    out = normative.lambda_grid(subjects(spark, sf_dir), reference(), GRID)
    return out.select("participant_id", "lambda", *[r(d).alias(d) for d in (*D, "composite")])


_LOO = [f"d_{b}.d" for b in BLOCKS]


@query(sql.leave_one_out() + f" SELECT participant_id, {', '.join(f'{sql.r(c)} AS D_{b}_loo' for b, c in zip(BLOCKS, _LOO, strict=True))}, {sql.r('(' + ' + '.join(_LOO) + f') / {len(_LOO)}')} AS composite_loo FROM d_SE " + " ".join(f"JOIN d_{b} USING (participant_id)" for b in list(BLOCKS)[1:]))
def leave_one_out(spark, sf_dir):
    out = normative.leave_one_out(subjects(spark, sf_dir), reference(), ["participant_id"])
    return out.select("participant_id", *[r(f"{d}_loo").alias(f"{d}_loo") for d in (*D, "composite")])


def _profile_sql() -> str:
    out = []
    for name, features in BLOCKS.items():
        p = range(1, len(features) + 1)
        lists = {"feature": sql.quoted(features), "residual": [f"r{i}" for i in p], "z": [f"r{i} / (sqrt(s_{i}_{i}) + 1e-12)" for i in p]}
        out.append("SELECT participant_id, '" + name + "' AS block, " + ", ".join(f"unnest([{', '.join(v)}]) AS {k}" for k, v in lists.items()) + f" FROM r_{name}, s_{name}")
    return _fitted_sql().rstrip() + ", profile AS (" + " UNION ALL ".join(out) + ")"


@query(_profile_sql() + f" SELECT participant_id, block, feature, {sql.r('residual')} AS residual, {sql.r('z')} AS z FROM profile")
def residual_profile(spark, sf_dir):
    return _model(spark, sf_dir).profile(subjects(spark, sf_dir), ["participant_id"]).select("participant_id", "block", "feature", r("residual").alias("residual"), r("z").alias("z"))


@query(_profile_sql() + f" SELECT participant_id, block, {sql.r('sqrt(avg(z * z))')} AS rms, {sql.r('avg(abs(z))')} AS mean_abs, {sql.r('max(abs(z))')} AS max_abs FROM profile GROUP BY 1, 2")
def z_by_block(spark, sf_dir):
    out = aggregate.z_by_block(_model(spark, sf_dir).profile(subjects(spark, sf_dir), ["participant_id"]), ["participant_id", "block"])
    return out.select("participant_id", "block", *[r(c).alias(c) for c in ("rms", "mean_abs", "max_abs")])


_SHARE = ", ".join(f"D_{b} / (D_SE + D_C + D_G + D_D) AS c_{b}" for b in BLOCKS)
_TOP = "CASE greatest(D_SE, D_C, D_G, D_D) " + " ".join(f"WHEN D_{b} THEN '{b}'" for b in BLOCKS) + " END"
_ENTROPY = " + ".join(f"-c_{b} * ln(c_{b})" for b in BLOCKS)


@query(f"{WITH}, shares AS (SELECT participant_id, {_TOP} AS dominant, {_SHARE} FROM scored) SELECT participant_id, dominant, {', '.join(f'{sql.r(f"c_{b}")} AS c_{b}' for b in BLOCKS)}, {sql.r(_ENTROPY)} AS entropy, CASE WHEN greatest(c_SE, c_C, c_G, c_D) < 0.3 THEN 'flat' WHEN greatest(c_SE, c_C, c_G, c_D) < 0.4 THEN 'mild' WHEN greatest(c_SE, c_C, c_G, c_D) < 0.5 THEN 'strong' ELSE 'single' END AS shape FROM shares")
def contributions(spark, sf_dir):
    parts = C.shares([F.col(d) for d in D])
    named = _scored(spark, sf_dir).select("participant_id", C.first_largest({b: F.col(f"D_{b}") for b in BLOCKS}).alias("dominant"), *[c.alias(f"c_{b}") for c, b in zip(parts, BLOCKS, strict=True)])
    own = [F.col(f"c_{b}") for b in BLOCKS]
    shape = C.binned(F.greatest(*own), (0, 0.3, 0.4, 0.5, 1.01), ("flat", "mild", "strong", "single"))
    return named.select("participant_id", "dominant", *[r(c).alias(f"c_{b}") for c, b in zip(own, BLOCKS, strict=True)], r(C.entropy(own)).alias("entropy"), shape.alias("shape"))


@query(f"{WITH}, ref AS (SELECT composite AS c FROM scored WHERE grp = 0) SELECT participant_id, {sql.r('100.0 * (SELECT count(*) FROM ref WHERE c < composite) / (SELECT count(*) FROM ref)')} AS percentile_strict, {sql.r('50.0 * ((SELECT count(*) FROM ref WHERE c < composite) + (SELECT count(*) FROM ref WHERE c <= composite) + (CASE WHEN (SELECT count(*) FROM ref WHERE c = composite) > 0 THEN 1 ELSE 0 END)) / (SELECT count(*) FROM ref)')} AS percentile_rank FROM scored")
def reference_percentiles(spark, sf_dir):
    rows = saved(_scored(spark, sf_dir).select("participant_id", "group", "composite"))
    return stats.percentile_of(rows, "composite", reference()).select("participant_id", r("percentile_strict").alias("percentile_strict"), r("percentile_rank").alias("percentile_rank"))


@query(f"{WITH}, cut AS (SELECT quantile_cont(composite, 0.95) AS p95 FROM scored WHERE grp = 0) SELECT grp AS \"group\", count(*) AS n, count(*) FILTER (composite > p95) AS n_above, {sql.r('avg(CASE WHEN composite > p95 THEN 1.0 ELSE 0.0 END)')} AS share_above FROM scored, cut GROUP BY grp")
def exceedance(spark, sf_dir):
    rows = saved(_scored(spark, sf_dir).select("group", "composite"))
    p95 = stats.quantiles(rows.where(reference()), "composite", [0.95]).first()["q"][0]
    return aggregate.above(rows, "composite", F.lit(p95), ["group"]).withColumn("share_above", r("share_above"))


@query(f"{WITH}, q AS (SELECT quantile_cont(composite, 0.75) AS l FROM scored) SELECT participant_id, {sql.r('composite')} AS composite, {sql.r('l')} AS \"limit\" FROM scored, q WHERE composite >= l")
def top_quartile(spark, sf_dir):
    rows = saved(_scored(spark, sf_dir).select("participant_id", "composite"))
    return stats.top_share(rows, "composite").select("participant_id", r("composite").alias("composite"), r("limit").alias("limit"))


@query(f"{WITH}, k AS (SELECT participant_id, rank() OVER (ORDER BY D_SE DESC) AS a, rank() OVER (ORDER BY composite DESC) AS b FROM scored) SELECT participant_id, CAST(a AS DOUBLE) AS rank_first, CAST(b AS DOUBLE) AS rank_second, CAST(abs(a - b) AS DOUBLE) AS shift FROM k")
def rank_shift(spark, sf_dir):
    rows = saved(_scored(spark, sf_dir).select("participant_id", "D_SE", "composite"))
    return stats.rank_shift(rows, "D_SE", "composite").select("participant_id", "rank_first", "rank_second", "shift")


@query()
def bootstrap_intervals(spark, sf_dir):
    """1000 draws of all blocks. Draws come from a 64-bit mix of ids, so no SQL; tests compare with plain NumPy."""
    return normative.bootstrap_intervals(subjects(spark, sf_dir), reference(), ["participant_id"], draws=1000)


def _ledoit_wolf_sql() -> str:
    """Of each block's residuals r1 .. rp of the reference: E = R'R / n, its distance to mu I, and the part that is noise."""
    parts, out = [], []
    for name, features in BLOCKS.items():
        p = range(1, len(features) + 1)
        e = lambda i, j: f"e_{max(i, j)}_{min(i, j)}"
        length = " + ".join(f"r{i} * r{i}" for i in p)
        parts.append(f"e_{name} AS (SELECT count(*) AS n, avg(({length}) * ({length})) AS fourth, " + ", ".join(f"avg(r{i} * r{j}) AS e_{i}_{j}" for i in p for j in range(1, i + 1)) + f" FROM r_{name} WHERE grp = 0)")
        mu = "(" + " + ".join(e(i, i) for i in p) + f") / {len(features)}"
        parts.append(f"m_{name} AS (SELECT *, {mu} AS mu FROM e_{name})")
        square = " + ".join(f"{e(i, j)} * {e(i, j)}" for i in p for j in p)
        gap = " + ".join(f"pow({e(i, j)} - mu, 2)" if i == j else f"{e(i, j)} * {e(i, j)}" for i in p for j in p)
        parts.append(f"w_{name} AS (SELECT *, ({gap}) / {len(features)} AS delta, (fourth - ({square})) / (n * {len(features)}) AS noise FROM m_{name})")
        parts.append(f"l_{name} AS (SELECT *, least(noise, delta) / delta AS s FROM w_{name})")
        cells = [(i, j) for i in p for j in p]
        lists = {"a": sql.quoted([features[i - 1] for i, _ in cells]), "b": sql.quoted([features[j - 1] for _, j in cells]), "cov": [sql.r(f"(1 - s) * {e(i, j)}" + (" + s * mu" if i == j else "")) for i, j in cells], "shrinkage": [sql.r("s")] * len(cells)}
        out.append(f"SELECT '{name}' AS block, * FROM ({sql.listed(lists, f'l_{name}')})")
    fits = [sql.SUBJECTS]
    for name, features in BLOCKS.items():
        fits += sql.residuals(name, [AT[f] for f in features])
    return "WITH " + ", ".join([*fits, *parts]) + " " + " UNION ALL ".join(out)


@query(_ledoit_wolf_sql())
def ledoit_wolf_shrinkage(spark, sf_dir):
    model, rows, out = _model(spark, sf_dir), subjects(spark, sf_dir).where(reference()), []
    for name, b in model.blocks.items():
        res = rows.select(*[c.alias(f) for c, f in zip(b.residuals(F.col("age")), b.features, strict=True)])
        cov, s = normative.ledoit_wolf(res, list(b.features))
        out += [(name, b.features[i], b.features[j], float(cov[i, j]), s) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(out, "block string, a string, b string, cov double, shrinkage double").withColumns({c: r(c) for c in ("cov", "shrinkage")})


def _quadratic_sql() -> str:
    """The age is centred; a² is freed of its linear part, whose slope then is that of the square."""
    x = list(AT.values())
    parts = [
        sql.SUBJECTS,
        "c AS (SELECT avg(age) AS c FROM subjects WHERE grp = 0)",
        "a AS (SELECT subjects.*, c, age - c AS a1, (age - c) * (age - c) AS a2 FROM subjects, c WHERE grp = 0)",
        "l AS (SELECT regr_slope(a2, a1) AS ls, regr_intercept(a2, a1) AS li FROM a)",
        "q AS (SELECT a.*, ls, a2 - li - ls * a1 AS q FROM a, l)",
        "s AS (SELECT max(c) AS c, max(ls) AS ls, avg(a1) AS m1, avg(a2) AS m2, " + ", ".join(f"regr_slope(x{i}, q) AS s{i}, regr_slope(x{i}, a1) AS t{i}, avg(x{i}) AS u{i}" for i in x) + " FROM q)",
    ]
    b1 = lambda i: f"(t{i} - s{i} * ls)"
    lists = {"feature": sql.quoted(list(AT)), "b0": [sql.r(f"u{i} - {b1(i)} * m1 - s{i} * m2 - {b1(i)} * c + s{i} * c * c", 5) for i in x], "b1": [sql.r(f"{b1(i)} - 2 * s{i} * c", 5) for i in x], "b2": [sql.r(f"s{i}", 5) for i in x]}
    return "WITH " + ", ".join(parts) + " " + sql.listed(lists, "s")


@query(_quadratic_sql())
def quadratic_age(spark, sf_dir):
    return normative.quadratic(subjects(spark, sf_dir).where(reference()), FEATURES).select("feature", *[r(c, 5).alias(c) for c in ("b0", "b1", "b2")])


@query(f"{WITH}, f AS (SELECT regr_intercept(composite, age) AS a, regr_slope(composite, age) AS b FROM scored WHERE grp = 0), j AS (SELECT composite - (a + b * age) AS v, grp FROM scored, f WHERE grp IN (0, 1)), k AS (SELECT grp, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM j), s AS (SELECT count(*) FILTER (grp = 1) AS n_pos, count(*) FILTER (grp = 0) AS n_neg, sum(k) FILTER (grp = 1) AS rs FROM k) SELECT n_pos, n_neg, {sql.r('(rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)')} AS auc FROM s")
def age_adjusted_auc(spark, sf_dir):
    rows = saved(_scored(spark, sf_dir).where("group in (0, 1)").select("group", "age", "composite"))
    out = stats.rank_sum(stats.adjusted(rows, "composite", "age", reference()), "adjusted", F.col("group") == 1)
    return out.select("n_pos", "n_neg", r("auc").alias("auc"))


@query(f"{WITH}, j AS (SELECT composite AS v, grp FROM scored WHERE grp IN (0, 1)), m AS (SELECT quantile_cont(v, 0.5) AS m FROM j), c AS (SELECT max(m) AS m, count(*) FILTER (v > m AND grp = 1) AS tp, count(*) FILTER (v > m AND grp = 0) AS fp, count(*) FILTER (v <= m AND grp = 1) AS fn, count(*) FILTER (v <= m AND grp = 0) AS tn FROM j, m) SELECT {sql.r('m')} AS median, tp, fp, fn, tn, {sql.r('(tp / (tp + fn) + tn / (tn + fp)) / 2')} AS balanced_accuracy FROM c")
def median_cut(spark, sf_dir):
    rows = saved(_scored(spark, sf_dir).where("group in (0, 1)").select("group", "composite"))
    return stats.median_cut(rows, "composite", F.col("group") == 1).withColumns({c: r(c) for c in ("median", "balanced_accuracy")})


@query(f"{WITH}, g AS (SELECT *, grp = 0 AS ref, age > 0 AS old, composite > 6 AS extreme FROM scored) " + " UNION ALL ".join(f"SELECT '{k}' AS stratum, count(composite) AS n, {sql.r('avg(composite)')} AS mean, {sql.r('stddev_samp(composite)')} AS std, {sql.r('min(composite)')} AS low, {sql.r('max(composite)')} AS high FROM g WHERE {w}" for k, w in {"all": "true", "reference": "ref", "older": "old", "without_extremes": "NOT extreme"}.items()))
def sensitivity_strata(spark, sf_dir):
    groups = {"all": F.lit(True), "reference": reference(), "older": F.col("age") > 0, "without_extremes": F.col("composite") <= 6}
    return aggregate.strata(_scored(spark, sf_dir), "composite", groups).withColumns({c: r(c) for c in ("mean", "std", "low", "high")})


@query(f"{WITH} SELECT participant_id, {sql.r('0.5 * D_SE + 0.25 * D_C + 0.25 * D_G')} AS composite FROM scored")
def weighted_composite(spark, sf_dir):
    weights = {"SE": 0.5, "C": 0.25, "G": 0.25}
    return _scored(spark, sf_dir).select("participant_id", r(C.weighted({b: F.col(f"D_{b}") for b in weights}, weights)).alias("composite"))


# aggregation, joins and sets


@query(f"SELECT o_custkey, count(*) AS n_runs, {sql.r('avg(o_totalprice)')} AS o_totalprice, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def subject_mean(spark, sf_dir):
    return aggregate.subject_mean(readers.table(spark, sf_dir, "orders"), ["o_totalprice"], "o_custkey", ["o_orderstatus"], "o_orderkey").withColumn("o_totalprice", r("o_totalprice"))


@query(f"WITH m AS (SELECT l_orderkey, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem GROUP BY 1) SELECT l_orderkey, {sql.r('a / (a + b + c + 1e-12)')} AS quantity_rel, {sql.r('b / (a + b + c + 1e-12)')} AS discount_rel, {sql.r('ln((a + 1e-12) / (c + 1e-12))')} AS log_quantity_tax FROM m")
def ratio_of_means(spark, sf_dir):
    out = aggregate.ratio_of_means(readers.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_orderkey")
    return out.select("l_orderkey", r("l_quantity_rel").alias("quantity_rel"), r("l_discount_rel").alias("discount_rel"), r(C.log_ratio(F.col("l_quantity"), F.col("l_tax"))).alias("log_quantity_tax"))


@query("SELECT o_custkey, " + ", ".join(f"{sql.r(f"avg(o_totalprice) FILTER (o_orderstatus = '{s}')")} AS o_totalprice_{s}" for s in "FOP") + " FROM orders GROUP BY 1")
def band_pivot(spark, sf_dir):
    wide = aggregate.band_pivot(readers.table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"], ["o_totalprice"])
    return wide.select("o_custkey", *[r(f"o_totalprice_{s}").alias(f"o_totalprice_{s}") for s in "FOP"])


@query("SELECT o_custkey, " + ", ".join(f"arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = '{x}') AS o_totalprice_{x}" for x in "FOP") + " FROM orders GROUP BY 1")
def last_pivot(spark, sf_dir):
    return aggregate.last_pivot(readers.table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"], ["o_totalprice"], "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i = 1")
def keep_first(spark, sf_dir):
    return writers.keep_first(readers.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(f"SELECT c_custkey, {sql.r('(c_acctbal - avg(c_acctbal) OVER ()) / (stddev_pop(c_acctbal) OVER () + 1e-12)')} AS z FROM customer")
def zscore(spark, sf_dir):
    return stats.zscore(readers.table(spark, sf_dir, "customer"), ["c_acctbal"]).select("c_custkey", r("c_acctbal").alias("z"))


@query("SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
def group_counts(spark, sf_dir):
    return aggregate.counts_table(readers.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT c_mktsegment, count(*) AS n, " + ", ".join(f"{sql.r(e, 4)} AS {n}" for n, e in {"mean": "avg(c_acctbal)", "std": "stddev_samp(c_acctbal)", "low": "min(c_acctbal)", "high": "max(c_acctbal)", "iqr": "quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)"}.items()) + ", " + ", ".join(f"{sql.r(f'quantile_cont(c_acctbal, {q / 100})', 4)} AS p{q}" for q in (10, 25, 50, 75, 90)) + " FROM customer GROUP BY 1")
def describe_by_group(spark, sf_dir):
    out = aggregate.describe(readers.table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"])
    return out.select(*[c if c in ("c_mktsegment", "n") else r(c, 4).alias(c) for c in out.columns])


_FLAG = "CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN c_acctbal > 9000 THEN 'very_low_alpha' WHEN c_acctbal < 0 THEN 'extreme' ELSE 'ok' END"


@query(f"WITH f AS (SELECT c_custkey, c_acctbal, {_FLAG} AS qc_flag FROM customer), o AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) SELECT c_custkey, qc_flag, n_orders FROM f JOIN o USING (c_custkey) WHERE qc_flag IN ('ok', 'very_low_alpha') AND c_custkey <> 7 AND c_acctbal IS NOT NULL")
def cohort_filter(spark, sf_dir):
    c = readers.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    c = cohort.flag(c, [(F.col("c_acctbal") < 0, "extreme"), (F.col("c_acctbal") > 9000, "very_low_alpha"), (F.col("c_acctbal").isNull(), "missing")])
    o = readers.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return cohort.canonical([c, o], "c_custkey", exclude=[7], needed=["c_acctbal"]).select("c_custkey", "qc_flag", "n_orders")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def one_to_one_join(spark, sf_dir):
    n = cohort.assert_unique(readers.table(spark, sf_dir, "nation"), ["n_nationkey"])
    g = cohort.assert_unique(readers.table(spark, sf_dir, "region"), ["r_regionkey"])
    return n.join(g, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def metadata_join(spark, sf_dir):
    n = readers.table(spark, sf_dir, "nation")
    return readers.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(spark, sf_dir):
    o = readers.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return readers.table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) >= 3)")
def pending_work(spark, sf_dir):
    done = readers.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("band"))
    return writers.pending(readers.table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"], 3)


@query("WITH b AS (SELECT o_custkey, o_totalprice, 0 AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_totalprice, 1 FROM orders WHERE o_orderstatus = 'P'), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC, o_totalprice DESC) AS i FROM b) SELECT o_custkey, o_totalprice FROM n WHERE i = 1")
def keep_last(spark, sf_dir):
    o = readers.table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    return writers.keep_last(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'P'").drop("o_orderstatus"), ["o_custkey"])


@query("SELECT count(*) FILTER (a AND b) AS \"both\", count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second FROM (SELECT k, bool_or(s = 'F') AS a, bool_or(s = 'P') AS b FROM (SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'P')) GROUP BY k)")
def key_overlap(spark, sf_dir):
    o = readers.table(spark, sf_dir, "orders")
    return cohort.meets(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf_dir):
    return readers.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(readers.table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, sf_dir):
    return readers.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(readers.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier")
def stacked_tables(spark, sf_dir):
    c, s = readers.table(spark, sf_dir, "customer"), readers.table(spark, sf_dir, "supplier")
    return c.select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance")).unionByName(s.select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf_dir):
    return readers.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("WITH u AS (SELECT count(DISTINCT user_id) AS total FROM events) SELECT event_type, count(DISTINCT user_id) AS n, count(DISTINCT user_id) / max(total) AS share FROM events, u GROUP BY 1 HAVING count(DISTINCT user_id) >= 0.5 * max(total)")
def item_presence(spark, sf_dir):
    return aggregate.presence(readers.table(spark, sf_dir, "events"), "event_type", "user_id", 0.5)


@query(f"SELECT user_id, {sql.r('stddev_pop(value) / (avg(value) + 1e-12)')} AS cv, {sql.r('max(value) - min(value)')} AS \"range\" FROM events GROUP BY 1")
def run_stability(spark, sf_dir):
    out = aggregate.stability(readers.table(spark, sf_dir, "events"), "value", "user_id")
    return out.select("user_id", r("cv").alias("cv"), r("range").alias("range"))


# ranks and tests


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS \"rank\" FROM part")
def average_rank(spark, sf_dir):
    return stats.average_rank(readers.table(spark, sf_dir, "part"), "p_size").select("p_partkey", "rank")


@query(f"SELECT CAST(p_size AS DOUBLE) AS value, {sql.r('max(cume)')} AS share FROM (SELECT p_size, cume_dist() OVER (ORDER BY p_size) AS cume FROM part) GROUP BY 1")
def cumulative_shares(spark, sf_dir):
    return stats.ecdf(readers.table(spark, sf_dir, "part"), "p_size").select("value", r("share").alias("share"))


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


def _pairs_sql(prefix: str, source: str) -> str:
    return sql.listed({"a": sql.quoted([a for a, _ in _PAIRS]), "b": sql.quoted([b for _, b in _PAIRS]), "r": [sql.r(f"corr({prefix}{AT[a]}, {prefix}{AT[b]})") for a, b in _PAIRS]}, source)


@query(f"WITH {sql.SUBJECTS} {_pairs_sql('x', 'subjects')}")
def pearson(spark, sf_dir):
    return stats.correlations(subjects(spark, sf_dir), FEATURES).select("a", "b", r("r").alias("r"))


@query(f"WITH {sql.SUBJECTS} SELECT * FROM ({_pairs_sql('x', 'subjects')}) WHERE abs(r) > 0.12")
def strong_pairs(spark, sf_dir):
    return stats.correlations(subjects(spark, sf_dir), FEATURES).select("a", "b", r("r").alias("r")).where("abs(r) > 0.12")


_RANKS = ", ".join(f"rank() OVER (ORDER BY x{i}) + (count(*) OVER (PARTITION BY x{i}) - 1) / 2.0 AS k{i}" for i in AT.values())


@query(f"WITH {sql.SUBJECTS}, k AS (SELECT {_RANKS} FROM subjects) {_pairs_sql('k', 'k')}")
def spearman(spark, sf_dir):
    return stats.spearman(subjects(spark, sf_dir), FEATURES).select("a", "b", r("r").alias("r"))


_GAPS = list(FEATURES)[:8]


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight features, rounded so that they tie, of which all but the first two are missing in every 5th, 6th and so on subject."""
    gap = lambda i, f: F.when((F.col("participant_id") % (i + 3) != 0) | F.lit(i < 2), F.round(f, 2)).alias(f)
    return subjects(spark, sf_dir).select("participant_id", *[gap(i, f) for i, f in enumerate(_GAPS)])


def _gaps_sql() -> str:
    columns = ", ".join((f"round(x{AT[f]}, 2)" if i < 2 else f"CASE WHEN participant_id % {i + 3} <> 0 THEN round(x{AT[f]}, 2) END") + f" AS v{i}" for i, f in enumerate(_GAPS))
    out = []
    for i, a in enumerate(_GAPS):
        for j in range(i + 1, len(_GAPS)):
            rank = lambda k: f"rank() OVER (ORDER BY v{k}) + (count(*) OVER (PARTITION BY v{k}) - 1) / 2.0"
            pair = f"SELECT v{i} AS a, v{j} AS b, {rank(i)} AS ra, {rank(j)} AS rb FROM g WHERE v{i} IS NOT NULL AND v{j} IS NOT NULL"
            out.append(f"SELECT '{a}' AS a, '{_GAPS[j]}' AS b, count(*) AS n, {sql.r('corr(a, b)')} AS pearson, {sql.r('corr(ra, rb)')} AS spearman FROM ({pair})")
    return f"WITH {sql.SUBJECTS}, g AS (SELECT {columns} FROM subjects) " + " UNION ALL ".join(out)


@query(_gaps_sql())
def correlations_with_gaps(spark, sf_dir):
    """Each pair over the subjects that have both."""
    rows = with_gaps(spark, sf_dir)
    ranked = stats.spearman(rows, _GAPS).select("a", "b", r("r").alias("spearman"))
    return stats.correlations(rows, _GAPS).select("a", "b", "n", r("r").alias("pearson")).join(ranked, ["a", "b"])


_LABELLED = "SELECT quality, CAST(n_chars AS DOUBLE) AS v FROM labels JOIN documents USING (doc_id)"
_RANKED = f"WITH j AS ({_LABELLED}), k AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM j), s AS (SELECT count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg, sum(k) FILTER (quality = 1) AS rs FROM k), u AS (SELECT n_pos, n_neg, rs - n_pos * (n_pos + 1) / 2.0 AS u FROM s)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "labels").join(readers.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


@query(f"{_RANKED} SELECT n_pos, n_neg, {sql.r('u', 4)} AS u, {sql.r('u / (n_pos * n_neg)')} AS auc FROM u")
def rank_auc(spark, sf_dir):
    out = stats.rank_sum(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1)
    return out.select("n_pos", "n_neg", r("u", 4).alias("u"), r("auc").alias("auc"))


@query(f"{_RANKED}, t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM j GROUP BY v)) SELECT {sql.r('u', 4)} AS u, {sql.r('(u - n_pos * n_neg / 2.0 - 0.5) / sqrt(n_pos * n_neg / 12.0 * (n_pos + n_neg + 1 - ties / ((n_pos + n_neg) * (n_pos + n_neg - 1.0))))')} AS z FROM u, t")
def mann_whitney(spark, sf_dir):
    return stats.mann_whitney(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1).select(r("u", 4).alias("u"), r("z").alias("z"))


@query(f"WITH j AS ({_LABELLED}), a AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality <> 1) AS n2, avg(v) FILTER (quality = 1) AS m1, avg(v) FILTER (quality <> 1) AS m2, var_samp(v) FILTER (quality = 1) AS v1, var_samp(v) FILTER (quality <> 1) AS v2, var_pop(v) FILTER (quality = 1) AS q1, var_pop(v) FILTER (quality <> 1) AS q2 FROM j) SELECT n1, n2, {sql.r('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)')} AS t, {sql.r('(m1 - m2) / sqrt(((n1 - 1) * q1 + (n2 - 1) * q2) / (n1 + n2 - 2))')} AS cohen_d FROM a")
def two_group_tests(spark, sf_dir):
    out = stats.two_groups(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1)
    return out.select("n1", "n2", r("t").alias("t"), r("cohen_d").alias("cohen_d"))


_DRAWS = 1000


def _mix(h: str, source: str, name: str, keep: str) -> str:
    """The 32-bit mixing of ``ml.mixed`` as three steps of a WITH clause, column h to ``name``."""
    return (
        f"{name}1 AS (SELECT {keep}, xor({h}, {h} >> 16) * 2246822507 % 4294967296 AS h FROM {source}), "
        f"{name}2 AS (SELECT {keep}, xor(h, h >> 13) * 3266489909 % 4294967296 AS h FROM {name}1), "
        f"{name} AS (SELECT {keep}, xor(h, h >> 16) AS h FROM {name}2)"
    )


_SEEDS = "md5(doc_id || '-42')"
_DRAWN = (
    f"WITH l AS (SELECT quality, CAST(n_chars AS DOUBLE) AS v, ('0x' || substr({_SEEDS}, 1, 8))::UBIGINT AS s1, ('0x' || substr({_SEEDS}, 9, 8))::UBIGINT AS s2 FROM labels JOIN documents USING (doc_id)), "
    f"d AS (SELECT quality, v, b, s1, (s2 + b::UBIGINT) % 4294967296 AS k FROM l, (SELECT CAST(unnest(range({_DRAWS})) AS INTEGER) AS b)), "
    + _mix("k", "d", "m", "quality, v, b, s1")
    + ", x AS (SELECT quality, v, b, xor(s1, h) AS k FROM m), "
    + _mix("k", "x", "u", "quality, v, b")
    + ", "
)
_DRAWN_AUC = "c AS (SELECT b, v, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM e GROUP BY b, v), f AS (SELECT b, p, n, p * (coalesce(sum(n) OVER (PARTITION BY b ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0) AS u FROM c), g AS (SELECT b, sum(u) / nullif(sum(p) * sum(n), 0) AS auc FROM f GROUP BY b)"
_WEIGHT = " + ".join(f"(h / 4294967296.0 >= {x})::INTEGER" for x in ml.POISSON)


@query(f"{_DRAWN} e AS (SELECT b, v, {_WEIGHT} AS w, quality AS y FROM u), {_DRAWN_AUC} SELECT b, {sql.r('auc')} AS auc FROM g")
def resampled_auc(spark, sf_dir):
    """1000 draws."""
    return ml.resampled_auc(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1, "doc_id", draws=_DRAWS).select("b", r("auc").alias("auc"))


@query()
def permutation_p(spark, sf_dir):
    """1000 permutations of the labels, drawn as counts by value; tests compare with all permutations of few rows."""
    return ml.permutation_p(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1, draws=_DRAWS).select(r("auc").alias("auc"), r("p").alias("p"))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects(spark, sf_dir).withColumn("label", (F.col("group") < 5).cast("int"))


@query()
def nested_cross_validation(spark, sf_dir):
    """All features, 5 outer and 5 inner folds, 3 penalties: a solver's result, which has no SQL; tests compare with plain NumPy."""
    return ml.fold_metrics(ml.nested_cv(_halves(spark, sf_dir), FEATURES, "label", "participant_id"))


@query()
def calibrated_svm(spark, sf_dir):
    """Out-of-fold margins of linear support vectors as probabilities."""
    scored = saved(ml.nested_cv(_halves(spark, sf_dir), FEATURES, "label", "participant_id", "svm"))
    return ml.calibrated(scored).select(F.col("id").alias("participant_id"), "y", "fold", r("score").alias("score"), r("probability").alias("probability"))


@query(f"WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 8 AS w, count(value) AS n FROM events), k AS (SELECT CAST(least(floor((value - lo) / w), 7) AS INTEGER) AS bin, n AS total, w FROM events, b) SELECT bin, count(*) AS n, {sql.r('count(*) / (max(total) * max(w))')} AS density FROM k GROUP BY bin")
def histogram(spark, sf_dir):
    return stats.histogram(readers.table(spark, sf_dir, "events"), "value", 8).withColumn("density", r("density"))


# graphs, windows and signals

_NODES = 64
_NODE_PAIRS = [(a, b) for a in range(1, _NODES + 1) for b in range(a + 1, _NODES + 1)]
_EDGE = "SELECT label AS g, " + ", ".join(f"unnest([{', '.join(v)}]) AS {k}" for k, v in {"a": [str(a) for a, _ in _NODE_PAIRS], "b": [str(b) for _, b in _NODE_PAIRS], "w": [f"abs(corr(CAST(embedding[{a}] AS DOUBLE), CAST(embedding[{b}] AS DOUBLE)))" for a, b in _NODE_PAIRS]}.items()) + " FROM embeddings GROUP BY label"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each group: the absolute correlations of all components."""
    return graph.correlation_edges(readers.table(spark, sf_dir, "embeddings"), "label", "embedding").withColumnRenamed("label", "g")


@query(f"WITH e AS ({_EDGE}), s AS (SELECT g, n, sum(w) AS s FROM (SELECT g, a AS n, w FROM e UNION ALL SELECT g, b, w FROM e) GROUP BY 1, 2) SELECT g, {sql.r('avg(s)')} AS mean_degree, {sql.r('stddev_pop(s) / (avg(s) + 1e-12)')} AS degree_cv FROM s GROUP BY g")
def graph_strength(spark, sf_dir):
    return graph.strength(edges(spark, sf_dir), ["g"]).select("g", r("mean_degree").alias("mean_degree"), r("degree_cv").alias("degree_cv"))


@query(f"WITH e AS ({_EDGE}), t AS (SELECT x.g, x.a, x.b, y.b AS c, cbrt(x.w) * cbrt(y.w) * cbrt(z.w) AS t FROM e x JOIN e y ON x.g = y.g AND x.a = y.a AND x.b < y.b JOIN e z ON z.g = x.g AND z.a = x.b AND z.b = y.b), n AS (SELECT g, a AS n, t FROM t UNION ALL SELECT g, b, t FROM t UNION ALL SELECT g, c, t FROM t), k AS (SELECT g, n, 2 * sum(t) / {(_NODES - 1) * (_NODES - 2)} AS c FROM n GROUP BY 1, 2) SELECT g, {sql.r('avg(c)')} AS clustering FROM k GROUP BY g")
def graph_clustering(spark, sf_dir):
    return graph.clustering(edges(spark, sf_dir), ["g"]).select("g", r("clustering").alias("clustering"))


@query(f"WITH e AS ({_EDGE}), k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY w DESC) AS i, count(*) OVER (PARTITION BY g) AS n FROM e) SELECT g, a, b, {sql.r('w')} AS w FROM k WHERE i <= greatest(1, floor(n * 0.3))")
def graph_density(spark, sf_dir):
    return graph.densest(edges(spark, sf_dir), ["g"], 0.3).select("g", "a", "b", r("w").alias("w"))


@query()
def graph_paths(spark, sf_dir):
    """Shortest paths and Laplacian spectra of each group's graph, from its samples."""
    kernel = lambda x, _: S.graph_metrics(S.cleaned(np.atleast_2d(abs(np.corrcoef(x)))))
    return extract.per_recording(signals(spark, sf_dir), kernel, ["global_efficiency", "mean_path_length", "lambda2", "laplacian_entropy"])


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as channels of 64 samples; a group's vectors of 400 ids in a row make a run."""
    e = readers.table(spark, sf_dir, "embeddings")
    run = F.lpad(F.floor(F.col("vec_id") / 400).cast("string"), 6, "0")
    return e.select(F.col("label").cast("string").alias("subject"), run.alias("run"), F.col("vec_id").cast("string").alias("channel"), F.col("vec_id").cast("int").alias("ch_idx"), F.lit(128.0).alias("sfreq"), F.col("embedding").cast("array<double>").alias("samples"))


@query()
def recording_quality(spark, sf_dir):
    """Densities have no SQL; tests compare each run with the kernel, here and in the two below."""
    return channels.quality(signals(spark, sf_dir)).select("subject", "run", *[r(c).alias(c) for c in channels.QUALITY])


@query()
def recording_complexity(spark, sf_dir):
    return channels.complexity(signals(spark, sf_dir)).select("subject", "run", *[r(c).alias(c) for c in channels.COMPLEXITY])


@query()
def coherence_edges(spark, sf_dir):
    return channels.coherence_edges(signals(spark, sf_dir), 8.0, 30.0, 32).withColumn("w", r("w"))


@query(f"WITH s AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) * CASE WHEN vec_id % 17 = 0 THEN 5 ELSE 1 END AS v FROM embeddings), c AS (SELECT CAST(label AS VARCHAR) AS subject, lpad(CAST(vec_id // 400 AS VARCHAR), 6, '0') AS run, CAST(vec_id AS VARCHAR) AS channel, stddev_pop(v) AS sd FROM s GROUP BY ALL), m AS (SELECT *, median(sd) OVER (PARTITION BY subject, run) AS m FROM c), d AS (SELECT *, median(abs(sd - m)) OVER (PARTITION BY subject, run) + 1e-12 AS mad FROM m) SELECT subject, run, channel FROM d WHERE 0.6745 * (sd - m) / mad > 5")
def bad_channels(spark, sf_dir):
    """Every 17th channel is five times as loud."""
    loud = F.transform("samples", lambda v: v * F.when(F.col("ch_idx") % 17 == 0, 5.0).otherwise(1.0))
    return channels.bad_channels(signals(spark, sf_dir).withColumn("samples", loud))


@query()
def signal_features(spark, sf_dir):
    runs = extract.extract_runs(signals(spark, sf_dir), notch=None, window_s=0.25, step_s=0.125)
    return extract.subject_features(runs)


ORDERS = 1 << 16  # of a run


def order_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lines' sums of each order as four channels at 128 Hz, an order a sample: blocks of 4096 samples, and runs. An order without lines is 0."""
    block = 4096
    sums = [F.sum(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    lines = readers.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(*sums)
    last = lines.agg(F.max("id")).first()[0]
    every = spark.range(0 if last is None else last + 1).join(lines, "id", "left").na.fill(0.0)
    orders = every.select(F.expr(f"id div {ORDERS}").cast("string").alias("run"), (F.col("id") % ORDERS).alias("i"), *[c for c in lines.columns if c != "id"])
    runs = orders.groupBy("run").agg((F.max("i") + 1).alias("n")).select(F.lit("orders").alias("subject"), "run", "n", F.lit(128.0).alias("sfreq"), F.lit(None).cast("string").alias("error"))
    scale = {"l_quantity": 1e-7, "l_extendedprice": 1e-10, "l_discount": 1e-4, "l_tax": 1e-4}  # to volts of a usual size
    held = orders.groupBy("run", F.expr(f"i div {block}").alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", *[(F.col(c) * v).alias(c) for c, v in scale.items()]))).alias("s"))
    channels = F.array(*[F.struct(F.lit(k).alias("ch_idx"), F.col(f"s.{c}").alias("samples")) for k, c in enumerate(scale)])
    return held.select(F.lit("orders").alias("subject"), "run", F.lit(128.0).alias("sfreq"), (F.col("b") * block).alias("start"), F.inline(channels)), runs


@query()
def long_recordings(spark, sf_dir):
    """Features of runs of 65,536 samples from minute blocks. Filters and phases have no SQL; tests compare with whole runs in NumPy."""
    blocks, runs = order_blocks(spark, sf_dir)
    return recordings.run_features(runs, 60.0, blocks=blocks)


_EDF = "floor((least(greatest(CAST(v AS DOUBLE), -1), 1) + 1) / 2 * 65535 + 0.5) * 2 / 65535 - 1"


@query(f"WITH s AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings), d AS (SELECT vec_id, {_EDF} AS d FROM s) SELECT vec_id, count(*) AS n, {sql.r('avg(d)')} AS mean, {sql.r('min(d)')} AS low, {sql.r('max(d)')} AS high FROM d GROUP BY vec_id")
def edf_round_trip(spark, sf_dir):
    """Each group's run as an EDF file of 16-bit samples in -1 .. 1, read again."""

    def encode(key, pdf):
        x = extract.matrix(pdf)
        names = pdf.sort_values("ch_idx")["channel"].tolist()
        return pd.DataFrame({"path": ["/".join(key)], "content": [biosignal.edf_bytes(x, 128.0, names, -1, 1, per_record=x.shape[1])]})

    files = signals(spark, sf_dir).groupBy("subject", "run").applyInPandas(encode, "path string, content binary")
    v = biosignal.from_content(files)
    mean = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x) / F.size("samples")
    return v.select(F.col("channel").cast("long").alias("vec_id"), "n", r(mean).alias("mean"), r(F.array_min("samples")).alias("low"), r(F.array_max("samples")).alias("high"))


@query("WITH s AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings) SELECT vec_id, CAST(t AS INTEGER) AS t, " + sql.r("v - avg(CAST(v AS DOUBLE)) OVER (PARTITION BY label, t)", 5) + " AS v FROM s")
def average_reference(spark, sf_dir):
    e = readers.table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("t", "v"))
    return graph.average_reference(e, ["label"]).select("vec_id", "t", r("v", 5).alias("v"))


@query(f"WITH u AS (SELECT event_type, user_id, stddev_samp(value) AS s FROM events GROUP BY 1, 2), m AS (SELECT *, median(s) OVER (PARTITION BY event_type) AS m FROM u WHERE s IS NOT NULL), d AS (SELECT *, median(abs(s - m)) OVER (PARTITION BY event_type) + 1e-12 AS mad FROM m) SELECT event_type, user_id, {sql.r('0.6745 * (s - m) / mad', 5)} AS robust_z, 0.6745 * (s - m) / mad > 2.0 AS bad FROM d")
def robust_outliers(spark, sf_dir):
    u = readers.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.stddev_samp("value").alias("s")).where("s is not null")
    return graph.robust_outliers(u, ["event_type"], "s", 2.0).select("event_type", "user_id", r("robust_z", 5).alias("robust_z"), "bad")


@query(f"WITH w AS (SELECT date_trunc('day', ts) - to_days(k) AS start, value FROM events, (SELECT unnest([0, 1]) AS k)) SELECT start, count(*) AS n, {sql.r('avg(value)')} AS mean FROM w GROUP BY 1")
def sliding_means(spark, sf_dir):
    return graph.window_means(readers.table(spark, sf_dir, "events"), "ts", "value", "2 days", "1 day").withColumn("mean", r("mean"))


@query(f"WITH e AS (SELECT CAST(dayofyear(ts) AS INTEGER) AS day, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS b, avg(value) AS w FROM events GROUP BY 1, 2), p AS (SELECT *, lag(w) OVER (PARTITION BY b ORDER BY day) AS q FROM e) SELECT day, {sql.r('sqrt(sum((w - q) * (w - q))) / sqrt(sum(q * q))')} AS delta FROM p WHERE q IS NOT NULL GROUP BY day")
def window_changes(spark, sf_dir):
    b = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    e = readers.table(spark, sf_dir, "events").groupBy(F.dayofyear("ts").alias("day"), b.alias("b")).agg(F.avg("value").alias("w")).withColumns({"g": F.lit(0), "a": F.lit(0)})
    return graph.changes(e, ["g"], "day").select("day", r("delta").alias("delta"))


_CHANGES = "e AS (SELECT CAST(dayofyear(ts) AS INTEGER) AS day, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS b, avg(value) AS w FROM events GROUP BY 1, 2), p AS (SELECT *, lag(w) OVER (PARTITION BY b ORDER BY day) AS q FROM e), d AS (SELECT day, sqrt(sum((w - q) * (w - q))) / sqrt(sum(q * q)) AS delta FROM p WHERE q IS NOT NULL GROUP BY day)"


@query(f"WITH {_CHANGES} SELECT 0 AS g, count(*) AS n_transitions, {sql.r('avg(delta)')} AS mean_delta, {sql.r('stddev_pop(delta)')} AS std_delta, {sql.r('stddev_pop(delta) / (avg(delta) + 1e-12)')} AS cv_delta, {sql.r('max(delta)')} AS max_delta FROM d")
def transition_summary(spark, sf_dir):
    b = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    e = readers.table(spark, sf_dir, "events").groupBy(F.dayofyear("ts").alias("day"), b.alias("b")).agg(F.avg("value").alias("w")).withColumns({"g": F.lit(0), "a": F.lit(0)})
    out = graph.change_summary(graph.changes(e, ["g"], "day"), ["g"])
    return out.select("g", "n_transitions", *[r(c).alias(c) for c in ("mean_delta", "std_delta", "cv_delta", "max_delta")])


_SERIES = "s AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS t FROM embeddings), w AS (SELECT *, lead(v) OVER o AS v1, lead(v, 2) OVER o AS v2 FROM s WINDOW o AS (PARTITION BY vec_id ORDER BY t))"


@query(f"WITH {_SERIES}, k AS (SELECT vec_id, v <= v1 AS a, v1 <= v2 AS b, v <= v2 AS c, count(*) AS n FROM w WHERE v2 IS NOT NULL GROUP BY ALL), p AS (SELECT vec_id, n / sum(n) OVER (PARTITION BY vec_id) AS p FROM k) SELECT vec_id, {sql.r('-sum(p * log2(p)) / log2(6)')} AS entropy FROM p GROUP BY 1")
def permutation_entropy(spark, sf_dir):
    registry.register(spark)
    return readers.table(spark, sf_dir, "embeddings").select("vec_id", r(F.expr("permutation_entropy(cast(embedding as array<double>))")).alias("entropy"))


_NEAR = "abs(x.v - y.v) <= tol AND abs(x.v1 - y.v1) <= tol"


@query(f"WITH {_SERIES}, d AS (SELECT vec_id, 0.2 * stddev_pop(v) AS tol, count(*) AS len FROM s GROUP BY 1), m AS (SELECT x.vec_id, count(*) FILTER ({_NEAR}) AS b, count(*) FILTER ({_NEAR} AND abs(x.v2 - y.v2) <= tol AND x.t < len - 2 AND y.t < len - 2) AS a FROM w x JOIN w y ON x.vec_id = y.vec_id AND x.t < y.t JOIN d ON d.vec_id = x.vec_id WHERE x.t <= len - 2 AND y.t <= len - 2 GROUP BY 1) SELECT vec_id, CASE WHEN a > 0 AND b > 0 THEN {sql.r('-ln(a / b)')} END AS entropy FROM m")
def sample_entropy(spark, sf_dir):
    registry.register(spark)
    return readers.table(spark, sf_dir, "embeddings").select("vec_id", r(F.expr("sample_entropy(cast(embedding as array<double>))")).alias("entropy"))


@query(f"WITH s AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT label, vec_id, stddev_pop(v) AS sd FROM s GROUP BY 1, 2), a AS (SELECT label, count(*) AS n_samples, count(*) FILTER (abs(v) > 0.3) AS extreme, {sql.r('min(v)')} AS low, {sql.r('max(v)')} AS high, {sql.r('avg(abs(v))')} AS mean_abs, {sql.r('quantile_cont(abs(v), 0.99)')} AS p99_abs FROM s GROUP BY 1), b AS (SELECT label, count(*) AS n_channels, {sql.r('avg(sd)')} AS std_mean, count(*) FILTER (sd <= 1e-12) AS flat_channels FROM c GROUP BY 1) SELECT a.*, n_channels, std_mean, flat_channels, 0 AS n_bad FROM a JOIN b USING (label)")
def sample_audit(spark, sf_dir):
    e = readers.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("samples"))
    return aggregate.sample_audit(e, ["label"], limit=0.3).withColumns({c: r(c) for c in ("low", "high", "mean_abs", "p99_abs", "std_mean")})


@query(f"WITH s AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), p AS (SELECT label, vec_id, count(*) AS n, count(*) FILTER (abs(v - 0.25) <= 1e-2) AS h, count(*) FILTER (abs(v + 0.25) <= 1e-2) AS l FROM s GROUP BY 1, 2) SELECT label, count(*) AS n_channels, {sql.r('sum(h) / sum(n)')} AS share_high, {sql.r('sum(l) / sum(n)')} AS share_low, count(*) FILTER (h > 0.01 * n) AS saturated FROM p GROUP BY 1")
def scale_audit(spark, sf_dir):
    e = readers.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("samples"), F.lit(-0.25).alias("pmin"), F.lit(0.25).alias("pmax"))
    return aggregate.scale_audit(e, ["label"], tolerance=1e-2).withColumns({c: r(c) for c in ("share_high", "share_low")})


@query(f"SELECT vec_id, {sql.r('len(list_filter(embedding, lambda x: abs(x) > 0.2)) / len(embedding)')} AS share FROM embeddings")
def extreme_samples(spark, sf_dir):
    return readers.table(spark, sf_dir, "embeddings").select("vec_id", r(C.extreme_share(F.col("embedding"), 0.2)).alias("share"))


@query("WITH q AS (SELECT user_id, quantile_cont(value, 0.99) AS p99, count(*) FILTER (value > 400) AS extreme FROM events GROUP BY 1) SELECT user_id, CASE WHEN p99 > 500 OR extreme > 1000 THEN 'extreme' WHEN p99 > 150 OR extreme > 0 THEN 'borderline' ELSE 'clean' END AS flag FROM q")
def amplitude_triage(spark, sf_dir):
    q = readers.table(spark, sf_dir, "events").groupBy("user_id").agg(F.percentile("value", 0.99).alias("p99"), F.count_if(F.col("value") > 400).alias("extreme"))
    return q.select("user_id", C.amplitude_flag(F.col("p99"), F.col("extreme")).alias("flag"))


# text, checks and reports


@query("SELECT page_id, 'sub-' || page_id AS subject, CASE WHEN page_id % 3 = 0 THEN '01' ELSE lpad(CAST(page_id % 12 AS VARCHAR), 2, '0') END AS run, CAST(page_id % 100 AS INTEGER) AS participant, CASE WHEN page_id % 100 = 99 THEN -1 ELSE CAST(page_id % 100 AS INTEGER) END AS age, CASE WHEN page_id % 2 = 0 THEN 'ASD' ELSE 'TD' END AS grp, CASE WHEN page_id % 2 = 0 THEN 'ASD_' ELSE 'x_' END || 'sub-' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE '_run-' || page_id % 12 END || '_Part' || page_id % 100 || '_RestEO' AS stem FROM pages")
def path_tokens(spark, sf_dir):
    """Names of recordings made of the pages' ids, taken apart again."""
    n = F.col("page_id")
    run = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("_run-"), n % 12))
    pages = readers.table(spark, sf_dir, "pages").withColumn("path", F.concat(F.lit("/data/"), F.when(n % 2 == 0, "ASD_").otherwise("x_"), F.lit("sub-"), n, run, F.lit("_Part"), n % 100, F.lit("_RestEO.bdf"))).withColumn("comment", F.concat(F.lit("Age: "), n % 100))
    p = F.col("path")
    return pages.select("page_id", C.subject_token(p).alias("subject"), C.run_token(p).alias("run"), C.participant_number(p).alias("participant"), F.coalesce(C.age_from_comment(F.col("comment")), F.lit(-1)).alias("age"), C.group_of(p, {"ASD": "ASD"}, "TD").alias("grp"), C.stem_of(p).alias("stem"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(spark, sf_dir):
    return readers.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT vec_id AS participant_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0 THEN 'REJECT' ELSE 'PASS' END AS status, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN 'INVALID_AGE' WHEN vec_id % 13 = 0 THEN 'INVALID_FEATURES' END AS reason, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN 'age' WHEN vec_id % 13 = 0 THEN CASE WHEN vec_id % 2 = 0 THEN 'alpha_rel,beta_rel' ELSE 'beta_rel' END ELSE '' END AS bad, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0 OR embedding[55] BETWEEN -0.1 AND 0.1 THEN 0 ELSE 1 END AS n_warnings FROM embeddings")
def validated_rows(spark, sf_dir):
    """Some rows are spoilt: no age, an infinite age, one or two features that are no numbers."""
    n = F.col("participant_id")
    rows = subjects(spark, sf_dir).withColumn("age", F.when(n % 7 == 0, None).when(n % 11 == 0, float("inf")).otherwise(F.col("age")))
    rows = rows.withColumn("beta_rel", F.when(n % 13 == 0, float("nan")).otherwise(F.col("beta_rel"))).withColumn("alpha_rel", F.when((n % 13 == 0) & (n % 2 == 0), None).otherwise(F.col("alpha_rel")))
    out = validate.validate_rows(rows, reference=(-0.1, 0.1))
    return out.select("participant_id", "status", "reason", F.array_join("bad_features", ",").alias("bad"), F.size("warnings").alias("n_warnings"))


@query(f"{WITH}, a AS (SELECT *, age BETWEEN -1 AND 1 AND participant_id % 9 <> 0 AS fine FROM scored) SELECT participant_id, CASE WHEN fine THEN 'PASS' ELSE 'REJECT' END AS status, CASE WHEN fine THEN {sql.r('composite')} END AS composite FROM a")
def json_reports(spark, sf_dir):
    """Every ninth row has no age and is rejected."""
    spoilt = subjects(spark, sf_dir).withColumn("age", F.when(F.col("participant_id") % 9 != 0, F.col("age")))
    checked = validate.validate_rows(spoilt)
    out = validate.reports(normative.fit(subjects(spark, sf_dir), reference()).score(checked), "1", normative.LAMBDA)
    return out.select("participant_id", F.get_json_object("report", "$.status").alias("status"), r(F.get_json_object("report", "$.scores.composite").cast("double")).alias("composite"))


@query("SELECT 'positive_price' AS \"check\", count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) AS broken, count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) = 0 AS passed FROM orders UNION ALL SELECT 'finished', count(*) FILTER (NOT coalesce(o_orderstatus = 'F', false)), count(*) FILTER (NOT coalesce(o_orderstatus = 'F', false)) = 0 FROM orders")
def quality_audit(spark, sf_dir):
    return validate.audit(readers.table(spark, sf_dir, "orders"), {"positive_price": F.col("o_totalprice") > 0, "finished": F.col("o_orderstatus") == "F"})


@query("SELECT 'c_acctbal' AS \"column\", count(*) FILTER (c_acctbal IS NULL) AS n_null, 0::BIGINT AS n_inf, count(DISTINCT c_acctbal) AS n_distinct, coalesce(min(c_acctbal) < max(c_acctbal), false) AS varies FROM customer UNION ALL SELECT 'c_nationkey', count(*) FILTER (c_nationkey IS NULL), 0, count(DISTINCT c_nationkey), coalesce(min(c_nationkey) < max(c_nationkey), false) FROM customer")
def column_audit(spark, sf_dir):
    return aggregate.column_audit(readers.table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


def _audit_sql() -> str:
    gone = lambda c: f"({c} IS NULL OR isnan({c}))"
    spoilt = "spoilt AS (SELECT *, CASE WHEN participant_id % 13 = 0 THEN 'nan'::DOUBLE WHEN participant_id % 17 = 0 THEN 'inf'::DOUBLE ELSE x1 END AS y1, CASE WHEN participant_id % 7 <> 0 THEN age END AS years FROM subjects)"
    x = ["y1", *[f"x{i}" for i in list(AT.values())[1:]]]
    checks = [
        ("labels", "allowed", "count(*) FILTER (NOT coalesce(grp IN (0, 1, 2, 3, 4, 5, 6, 7, 8), false))", "FAIL"),
        ("labels", "size of 0", "abs(count(*) FILTER (grp = 0) - 39)", "WARN"),
        ("age", "complete", f"count(*) FILTER ({gone('years')})", "FAIL"),
        ("features", "present", "0 * count(*)", "FAIL"),
        ("features", "no missing values", " + ".join(f"count(*) FILTER ({gone(c)})" for c in x), "FAIL"),
        ("features", "finite", " + ".join(f"count(*) FILTER (isinf({c}))" for c in x), "FAIL"),
        ("features", "vary", " + ".join(f"(NOT coalesce(min({c}) FILTER (NOT {gone(c)}) < max({c}) FILTER (NOT {gone(c)}), false))::BIGINT" for c in x), "FAIL"),
        ("columns", "expected", "1 + 0 * count(*)", "WARN"),
        ("ids", "unique", "count(*) - count(DISTINCT participant_id)", "FAIL"),
    ]
    rows = " UNION ALL ".join(f"SELECT '{a}' AS section, '{b}' AS \"check\", CAST({n} AS BIGINT) AS n, '{bad}' AS bad FROM spoilt" for a, b, n, bad in checks)
    return f"WITH {sql.SUBJECTS}, {spoilt} SELECT section, \"check\", n, CASE WHEN n = 0 THEN 'PASS' ELSE bad END AS status FROM ({rows})"


@query(_audit_sql())
def dataset_audit(spark, sf_dir):
    """Some values of the first feature are missing or infinite, some ages missing, one column is not expected."""
    n, f = F.col("participant_id"), FEATURES[0]
    rows = subjects(spark, sf_dir).withColumn(f, F.when(n % 13 == 0, float("nan")).when(n % 17 == 0, float("inf")).otherwise(F.col(f)))
    rows = rows.withColumn("age", F.when(n % 7 != 0, F.col("age"))).withColumn("site", F.lit("one"))
    return validate.dataset_audit(rows, FEATURES, "participant_id", "group", list(range(9)), "age", {0: 39})


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'NO-GO' WHEN event_id % 4 = 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n_missing, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS n_unmet FROM events")
def manifest_gate(spark, sf_dir):
    """Manifests made of the events, some without a required or a wished key."""
    n = F.col("event_id")
    body = F.to_json(F.struct(F.when(n % 3 != 0, n).alias("k"), F.when(n % 4 != 0, F.col("event_type")).alias("site")))
    out = validate.manifest_gate(readers.table(spark, sf_dir, "events").withColumn("body", body), "body", ["k"], ["site"])
    return out.select("event_id", "verdict", F.size("missing").alias("n_missing"), F.size("unmet").alias("n_unmet"))


# smaller operators


@query(_fitted_sql() + " UNION ALL ".join("SELECT participant_id, '" + name + "' AS block, " + ", ".join(f"unnest([{', '.join(v)}]) AS {k}" for k, v in {"feature": sql.quoted(features), "z": [sql.r(f"r{i} / (sqrt(v_{i}_{i}) + 1e-12)") for i in range(1, len(features) + 1)]}.items()) + f" FROM r_{name}, v_{name}" for name, features in BLOCKS.items()))
def unshrunk_profile(spark, sf_dir):
    return _model(spark, sf_dir).profile(subjects(spark, sf_dir), ["participant_id"], unshrunk=True).select("participant_id", "block", "feature", r("z").alias("z"))


@query(f"SELECT * FROM ({sql.leave_one_out()} SELECT participant_id, {sql.r('(' + ' + '.join(_LOO) + f') / {len(_LOO)}')} AS score FROM d_SE " + " ".join(f"JOIN d_{b} USING (participant_id)" for b in list(BLOCKS)[1:]) + f") UNION ALL SELECT * FROM ({WITH} SELECT participant_id, {sql.r('composite')} AS score FROM scored WHERE grp <> 0)")
def mixed_scores(spark, sf_dir):
    return normative.exact_mixed(subjects(spark, sf_dir), reference(), ["participant_id"]).select("participant_id", r("score").alias("score"))


@query(f"{WITH}, g AS (SELECT abs(D_SE - composite) AS g FROM scored) SELECT count(*) AS n, {sql.r('max(g)')} AS max_abs, {sql.r('avg(g)')} AS mean_abs, {sql.r('median(g)')} AS median_abs FROM g")
def score_comparison(spark, sf_dir):
    rows = saved(_scored(spark, sf_dir))
    out = cohort.compare(rows.select("participant_id", F.col("D_SE").alias("v")), rows.select("participant_id", F.col("composite").alias("v")), "participant_id", "v")
    return out.withColumns({c: r(c) for c in ("max_abs", "mean_abs", "median_abs")})


@query(f"WITH e AS ({_EDGE}) SELECT g, count(*) AS n, {sql.r('avg(w)')} AS mean, {sql.r('median(w)')} AS median FROM e GROUP BY g")
def edge_summary(spark, sf_dir):
    e = saved(edges(spark, sf_dir))
    mid = stats.quantiles(e, "w", [0.5], ["g"]).select("g", r(F.col("q")[0]).alias("median"))
    return e.groupBy("g").agg(F.count(F.lit(1)).alias("n"), r(F.avg("w")).alias("mean")).join(mid, "g")


@query(f"WITH e AS (SELECT c_nationkey AS g, s_nationkey % 7 AS a, c_custkey % 7 AS b, s_acctbal / 5000 AS w FROM customer JOIN supplier ON c_nationkey = s_nationkey) SELECT g, least(a, b) AS a, greatest(a, b) AS b, {sql.r('least(greatest(avg(w), 0), 1)')} AS w FROM e WHERE a <> b GROUP BY 1, 2, 3")
def clean_edges(spark, sf_dir):
    """Equal ends are counted before the join, whose rows would else be all pairs of a nation's customers and suppliers."""
    c, s = readers.table(spark, sf_dir, "customer"), readers.table(spark, sf_dir, "supplier")
    c = c.groupBy(F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 7).alias("b")).agg(F.count(F.lit(1)).alias("n_b"))
    s = s.groupBy(F.col("s_nationkey").alias("g"), (F.col("s_nationkey") % 7).alias("a")).agg(F.avg(F.col("s_acctbal") / 5000).alias("w"), F.count("s_acctbal").alias("n_a"))
    e = c.join(s, "g").select("g", "a", "b", "w", (F.col("n_a") * F.col("n_b")).alias("n"))
    return graph.cleaned(e, ["g"], "n").withColumn("w", r("w"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'REJECT' WHEN vec_id % 7 = 0 THEN 'REJECT' WHEN vec_id % 11 = 0 THEN 'REJECT' WHEN vec_id % 13 = 0 THEN 'REJECT' ELSE 'PASS' END AS status, CASE WHEN vec_id % 5 = 0 THEN 'UNSUPPORTED_FORMAT' WHEN vec_id % 7 = 0 THEN 'BAD_SFREQ' WHEN vec_id % 11 = 0 THEN 'TOO_SHORT' WHEN vec_id % 13 = 0 THEN 'TOO_FEW_CHANNELS' END AS reason, CASE WHEN vec_id % 5 > 0 AND vec_id % 7 > 0 AND vec_id % 11 > 0 AND vec_id % 13 > 0 AND vec_id % 3 = 0 THEN 1 ELSE 0 END AS n_warnings FROM embeddings")
def validated_recordings(spark, sf_dir):
    """Metadata of recordings made of the vectors' ids, with every kind of fault."""
    n = F.col("vec_id")
    rows = readers.table(spark, sf_dir, "embeddings").select("vec_id", F.when(n % 5 == 0, "x.txt").otherwise("x.BDF").alias("path"), F.when(n % 7 == 0, 256.0).otherwise(512.2).alias("sfreq"), F.when(n % 11 == 0, 29.9).otherwise(30.0).alias("duration_s"), F.when(n % 13 == 0, 63).when(n % 3 == 0, 65).otherwise(64).alias("n_channels"))
    return validate.validate_recordings(rows).select("vec_id", "status", "reason", F.size("warnings").alias("n_warnings"))


@query(f"SELECT o_custkey, o_orderstatus AS band, {sql.r('avg(o_totalprice)')} AS mean, count(DISTINCT o_orderpriority) AS n_distinct, max(o_orderkey) AS latest FROM orders GROUP BY 1, 2")
def band_summary(spark, sf_dir):
    o = readers.table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.col("o_orderstatus").alias("band")).agg(r(F.avg("o_totalprice")).alias("mean"), F.count_distinct("o_orderpriority").alias("n_distinct"), F.max("o_orderkey").alias("latest"))


@query("SELECT nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS n FROM customer GROUP BY 1")
def groups_with_null(spark, sf_dir):
    return readers.table(spark, sf_dir, "customer").groupBy(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return readers.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(readers.table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query(f"SELECT l_orderkey, l_linenumber, {sql.r('l_discount / greatest(abs(l_tax), 1e-8)')} AS relative_width, {sql.r('l_quantity - l_tax')} AS bias, l_tax >= 0.02 AND l_tax <= 0.02 + l_discount AS inside, abs(l_tax - l_discount) <= 1e-5 + 1e-4 * abs(l_discount) AS close FROM lineitem")
def interval_checks(spark, sf_dir):
    rows = readers.table(spark, sf_dir, "lineitem").withColumns({c: F.col(c).cast("double") for c in ("l_tax", "l_discount", "l_quantity")})
    i = C.interval(F.col("l_tax"), F.lit(0.02), F.lit(0.02) + F.col("l_discount"), F.col("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", r(i["relative_width"]).alias("relative_width"), r(i["bias"]).alias("bias"), i["inside"].alias("inside"), C.is_close(F.col("l_tax"), F.col("l_discount")).alias("close"))


@query("SELECT c_custkey, CASE upper(trim(' ' || lower(c_mktsegment) || ' ')) WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE -1 END AS code FROM customer WHERE isfinite(CAST(c_acctbal AS DOUBLE))")
def label_codes(spark, sf_dir):
    c = readers.table(spark, sf_dir, "customer").where(C.finite(F.col("c_acctbal").cast("double")))
    return c.select("c_custkey", F.coalesce(C.label_code(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")), {"building": 0, "machinery": 1}), F.lit(-1)).alias("code"))

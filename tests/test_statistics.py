"""Statistics against plain NumPy, with nulls, ties, infinities and clashing names."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparknorm.functions import columns as C
from sparknorm.functions import registry
from sparknorm.functions import signal as S
from sparknorm.functions.contract import BANDS, BLOCKS, FEATURES
from sparknorm.operators import aggregate, graph, joins, ml, normative, stats
from sparknorm.sources import writers

def ref():
    return F.col("group") == "ref"



def table(spark, n=60, cases=10, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(FEATURES)))
    rows = [(f"s{i:02d}", float(rng.uniform(8, 13)), "case" if i >= n - cases else "ref", *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["participant_id", "age", "group", *FEATURES])


def holed(df):
    """A null age, a null and a NaN feature, and a row of no known group."""
    df = df.withColumn("age", F.when(F.col("participant_id") != "s03", F.col("age")))
    first, second = FEATURES[0], FEATURES[20]
    df = df.withColumn(first, F.when(F.col("participant_id") == "s05", None).otherwise(F.col(first)))
    df = df.withColumn(second, F.when(F.col("participant_id") == "s07", float("nan")).otherwise(F.col(second)))
    return df.withColumn("group", F.when(F.col("participant_id") != "s09", F.col("group")))


def test_bootstrap_equals_plain_numpy(spark):
    df = holed(table(spark))
    got = {r["participant_id"]: r for r in normative.bootstrap_intervals(df, ref(), ["participant_id"], draws=40, blocks={"SE": BLOCKS["SE"], "C": BLOCKS["C"]}).collect()}
    every = normative.bootstrap(df, ref(), ["participant_id"], draws=40, blocks={"SE": BLOCKS["SE"], "C": BLOCKS["C"]})
    assert every.count() == 60 * 40 and len(got) == 60
    pdf = df.withColumn("h", F.xxhash64("participant_id")).toPandas().set_index("participant_id")
    used = [*BLOCKS["SE"], *BLOCKS["C"]]
    whole = np.isfinite(pdf[["age", *used]].to_numpy(float)).all(axis=1)
    chosen = pdf[(pdf["group"] == "ref") & whole]
    w = normative.poisson_weights(chosen["h"].to_numpy(), 40, 42)
    assert 0.8 < w.mean() < 1.2 and w.std() > 0.8
    scores = np.zeros((len(pdf), 40))
    for b in range(40):
        for cols in (BLOCKS["SE"], BLOCKS["C"]):
            rows = np.repeat(np.arange(len(chosen)), w[:, b].astype(int))
            x, a = chosen[list(cols)].to_numpy()[rows], chosen["age"].to_numpy()[rows]
            design = np.column_stack([np.ones(len(a)), a])
            beta, *_ = np.linalg.lstsq(design, x, rcond=None)
            inv = np.linalg.inv(normative.shrink(np.cov(x - design @ beta, rowvar=False), 0.1))
            r = pdf[list(cols)].to_numpy(float) - np.column_stack([np.ones(len(pdf)), pdf["age"].to_numpy(float)]) @ beta
            scores[:, b] += np.sqrt(np.einsum("ij,jk,ik->i", r, inv, r)) / 2
    for i, name in enumerate(pdf.index):
        if np.isfinite(scores[i]).all():
            assert np.allclose([got[name]["boot_mean"], got[name]["q025"], got[name]["q50"], got[name]["q975"]], [scores[i].mean(), *np.quantile(scores[i], [0.025, 0.5, 0.975])])
        else:
            assert got[name]["boot_mean"] is None
    assert {n for n in got if got[n]["boot_mean"] is None} == {"s03", "s05"}


def test_mixed_scores_keep_every_row(spark):
    got = {r["participant_id"]: r["score"] for r in normative.exact_mixed(holed(table(spark)), ref(), ["participant_id"]).collect()}
    assert len(got) == 60 and got["s09"] > 0 and {n for n, v in got.items() if v is None} == {"s03", "s05", "s07"}


def test_leave_one_out_is_a_refit_in_every_block(spark):
    df = holed(table(spark, 40, 5)).where("group is not null")
    got = {r["participant_id"]: r for r in normative.leave_one_out(df, ref(), ["participant_id"]).collect()}
    for name in ("s00", "s20"):
        again = normative.fit(df, ref() & (F.col("participant_id") != name)).score(df.where(F.col("participant_id") == name)).first()
        for b in BLOCKS:
            assert math.isclose(got[name][f"D_{b}_loo"], again[f"D_{b}"], rel_tol=1e-7)
    assert got["s05"]["composite_loo"] is None
    same = spark.createDataFrame([(f"a{i}", 9.0, "ref", *([1.0] * len(FEATURES))) for i in range(4)], ["participant_id", "age", "group", *FEATURES])
    assert all(r["composite_loo"] == 0 for r in normative.leave_one_out(same, ref(), ["participant_id"]).collect())


def test_grid_equals_single_scores(spark):
    df = table(spark)
    for lam, rows in ((0.05, 60), (0.5, 60)):
        grid = {r["participant_id"]: r for r in normative.lambda_grid(df, ref(), [0.05, 0.5]).where(F.col("lambda") == lam).collect()}
        assert len(grid) == rows
        for r in normative.score_cohort(df, ref(), lam).collect():
            assert math.isclose(r["composite"], grid[r["participant_id"]]["composite"], rel_tol=1e-9)


def test_ranks_of_a_column_named_value(spark):
    df = spark.createDataFrame([(i, [5.0, 5.0, 1.0, None][i % 4], "x") for i in range(4000)], "k int, value double, rank_ string")
    got = stats.average_rank(df, "value")
    assert got.columns == [*df.columns, "rank"] and {(r["value"], r["rank"]) for r in got.collect()} == {(5.0, 2000.5), (1.0, 500.5), (None, None)}
    down = stats.average_rank(df, "value", descending=True)
    assert {(r["value"], r["rank"]) for r in down.collect()} == {(5.0, 1000.5), (1.0, 2500.5), (None, None)}
    got = stats.percentile_of(df, "value", F.col("k") < 8)
    assert got.columns == [*df.columns, "percentile_rank", "percentile_strict"] and got.count() == 4000
    assert stats.average_rank(df.limit(0), "value").count() == 0


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(0)
    rows = [(["a", "b", None][int(g)], float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 30, 500), strict=True)] + [("a", None), ("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    q = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["g"]: r["q"] for r in stats.quantiles(df, "v", q, ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], q))
    assert np.allclose(stats.quantiles(df, "v", q).first()["q"], np.quantile([v for _, v in rows if v is not None], q))
    assert stats.quantiles(df.where("v is null"), "v", q).count() == 0
    z = graph.robust_outliers(df, ["g"], "v", 1.0)
    assert z.count() == len(rows) and z.columns == ["g", "v", "robust_z", "bad"]
    assert {r["g"]: r["n"] for r in aggregate.describe(df, "v", ["g"]).collect()}["one"] == 1


def test_histogram_leaves_infinities_out(spark):
    df = spark.createDataFrame([(float(v),) for v in (*range(11), math.inf, -math.inf, math.nan)] + [(None,)], "v double")
    assert sorted((r["bin"], r["n"]) for r in stats.histogram(df, "v", 5).collect()) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]
    assert stats.histogram(df.where("v is null"), "v", 5).count() == 0


def test_correlations_and_collinearity(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    x[:, 3] = x[:, 0] + 1e-2 * rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list("abcd"))
    got = {(r["a"], r["b"]): r for r in stats.correlations(df, list("abcd")).collect()}
    c = np.corrcoef(x, rowvar=False)
    assert all(math.isclose(got[p, q]["r"], c["abcd".index(p), "abcd".index(q)], abs_tol=1e-9) for p, q in got)
    r = got["a", "b"]
    assert math.isclose(r["p"], stats.t_tail(r["t"], 198)) and 0 < r["p"] < 1
    assert [(s["a"], s["b"]) for s in stats.strong_pairs(df, list("abcd")).collect()] == [("a", "d")]
    found = stats.collinearity(df, list("abcd"))
    assert found["rank"] == 4 and math.isclose(found["cond"], np.linalg.cond((x - x.mean(axis=0)) / x.std(axis=0)), rel_tol=1e-3)
    flat = df.withColumn("d", F.lit(1.0))
    assert {r["r"] for r in stats.correlations(flat, list("cd")).collect()} == {None}


def test_tests_of_two_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal(i % 2)), i % 2, float(rng.uniform(8, 13))) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, v double, y int, age double")
    one = stats.two_groups(df, "v", F.col("y") == 1).first()
    assert math.isclose(one["p"], stats.t_tail(one["t"], one["dof"]))
    p = ml.permutation_p(df, "v", F.col("y") == 1, draws=200).first()
    assert p["p"] < 0.01 and p["auc"] > 0.6
    assert ml.permutation_p(df, "age", F.col("y") == 1, draws=200).first()["p"] > 0.01
    cut = stats.median_cut(df, "v", F.col("y") == 1).first()
    assert cut["tp"] + cut["fp"] == 50 and cut["balanced_accuracy"] > 0.5
    left = stats.adjusted(df, "v", "age", F.col("y") == 0)
    assert abs(left.where("y = 0").agg(F.corr("adjusted", "age")).first()[0]) < 1e-9
    z = stats.zscore(df.withColumn("v", F.when(F.col("k") == 1, float("nan")).otherwise(F.col("v"))), ["v"])
    assert z.where("v is null").count() == 1 and abs(z.agg(F.avg("v")).first()[0]) < 1e-9


def test_nested_folds(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, i % 2, float(rng.normal(i % 2)), float(rng.normal())) for i in range(80)], "k int, y int, a double, b double")
    out = ml.nested_cv(df, ["a", "b"], "y", "k", outer=2, inner=2, grid=(0.1,)).collect()
    assert sorted(r["id"] for r in out) == list(range(80)) and {r["fold"] for r in out} == {0, 1}


def test_matrix_checks():
    assert normative.is_positive_definite(np.eye(3)) and not normative.is_positive_definite(np.ones((3, 3)))
    assert normative.is_symmetric(np.ones((2, 2))) and not normative.is_symmetric(np.array([[0.0, 1.0], [0.0, 0.0]]))


def test_band_powers_are_trapezoids():
    rng = np.random.default_rng(5)
    hz, psd = S.welch(rng.normal(size=(3, 4000)), 250.0)
    got = S.band_powers(hz, psd)
    for name, (low, high) in BANDS.items():
        at = (hz >= low) & (hz < high)
        assert math.isclose(got[f"{name}_abs"], np.trapezoid(psd.mean(axis=0)[at], hz[at]), rel_tol=1e-12)


def test_entropies_and_quality():
    x = np.random.default_rng(6).normal(size=300)
    t = [x[i : i + 3] for i in range(297)]
    tol = 0.2 * x.std()
    near = lambda a, b, k: np.abs(a[:k] - b[:k]).max() <= tol
    b = sum(near(np.array([x[i], x[i + 1]]), np.array([x[j], x[j + 1]]), 2) for i in range(298) for j in range(298) if i != j)
    a = sum(near(t[i], t[j], 3) for i in range(297) for j in range(297) if i != j)
    assert math.isclose(S.sample_entropy(x), -math.log(a / b)) and S.sample_entropy(x, r=tol) == S.sample_entropy(x)
    assert all(math.isnan(S.sample_entropy(x[:n])) for n in range(4)) and math.isnan(S.permutation_entropy(x[:2]))
    both = S.complexity(np.stack([x, np.zeros(300)]))
    assert 0 < both["permutation_entropy"] <= 1 and both["sample_entropy"] > 0
    t = np.arange(4096) / 256
    tone = np.stack([np.sin(2 * np.pi * 60 * t), np.sin(2 * np.pi * 10 * t)])
    q = S.recording_quality(tone * 1e-5, 256.0)
    assert q["line_ratio"] > 0.95 and math.isclose(q["mean_abs_uv"], 20 / np.pi, rel_tol=0.01) and math.isclose(q["duration_s"], 4095 / 256)
    assert S.recording_quality(tone * 5, 256.0)["mean_abs_uv"] < 10
    hz, psd = S.welch(tone, 256.0)
    assert abs(S.peaks(hz, psd[1], 1, 45, 1)[0][0] - 10) < 0.2 and len(S.peaks(hz, psd[1], 1, 45)) == 3
    assert (S.pick(tone, ["Fz", "Cz"], ["CZ", "FZ"]) == tone[::-1]).all()
    with pytest.raises(KeyError):
        S.pick(tone, ["Fz", "Cz"], ["Pz"])


def test_trajectories_and_regimes():
    rng = np.random.default_rng(7)
    series = [S.cleaned(rng.uniform(size=(6, 6))) for _ in range(4)]
    got = S.trajectories(series)
    each = [S.graph_metrics(w)["degree_cv"] for w in series]
    assert math.isclose(got["degree_cv_mean"], np.mean(each)) and math.isclose(got["degree_cv_std"], np.std(each))
    assert math.isnan(S.trajectories([])["lambda2_mean"])
    assert [r["edges"] for r in S.density_regimes(series[0])] == [15.0, 1.0, 3.0, 4.0]
    assert S.transition_summary(np.array([]))["n_transitions"] == 0
    one = S.transition_summary(np.array([1.0, 1.0, 3.0]))
    assert math.isclose(one["mean_delta"], 5 / 3) and math.isclose(one["temporal_entropy"], -(2 / 3) * math.log(2 / 3) - math.log(1 / 3) / 3, abs_tol=1e-9)


def test_columns_and_registry(spark):
    names = registry.register(spark)
    df = spark.createDataFrame([([1.0, 2.0, 1.5, 3.0, 2.5, 4.0],), ([],), (None,), ([1.0],), ([1.0, float("nan"), 2.0],)], "v array<double>")
    got = [r[0] for r in df.selectExpr("permutation_entropy(v)").collect()]
    assert "sample_entropy" in names and got[0] > 0 and got[1:] == [None] * 4
    row = spark.createDataFrame([("/a/b/ASD_Part12_restEO.bdf", [1.0, 2.0])], "p string, v array<double>").select(C.stem_of(F.col("p")).alias("stem"), C.group_of(F.col("p"), {"ASD": "case"}, "ref").alias("g"), C.named_vector(F.col("v"), ["a", "b"]).alias("m"), C.participant_number(F.col("p")).alias("n"), C.interval(F.lit(2.0), F.lit(1.0), F.lit(4.0), F.lit(2.5)).alias("i"), C.number_text(F.lit(0.1)).alias("t")).first()
    assert (row["stem"], row["g"], row["m"], row["n"]) == ("ASD_Part12_restEO", "case", {"a": 1.0, "b": 2.0}, 12)
    assert tuple(row["i"]) == (1.5, 0.5, True) and float(row["t"]) == 0.1
    with pytest.raises(Exception, match="3 values"):
        df.select(C.named_vector(F.col("v"), ["a", "b", "c"])).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    assert {tuple(r) for r in writers.keep_first(df, ["k"], ["v"]).collect()} == {("a", 1), ("b", 5)}
    assert tuple(writers.row_at(df, ["v"], 1).first()) == ("a", 2)
    with pytest.raises(IndexError):
        writers.row_at(df, ["v"], 3)
    reports = spark.createDataFrame([("s1", '{"status":"PASS"}'), ("s2", '{"status":"REJECT"}'), ("s3", '{"status":"PASS"}')], "participant_id string, report string")
    assert writers.subject_reports(reports, str(tmp_path / "r")) == {"PASS": 2, "REJECT": 1} and (tmp_path / "r" / "participant_id=s1").is_dir()
    writers.summary_json(df.limit(1), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1
    assert graph.subset(df, df, "k") and graph.disjoint(df, df.where("false"), "k") and not graph.subset(df, df.where("k = 'a'"), "k")


def test_audits(spark):
    rows = [("r", [1.0, 600.0, None]), ("r", [2.0, 2.0, 2.0]), ("q", [])]
    got = {r["g"]: r for r in aggregate.sample_audit(spark.createDataFrame(rows, "g string, samples array<double>"), ["g"]).collect()}
    assert (got["r"]["n_bad"], got["r"]["extreme"], got["r"]["flat_channels"], got["r"]["low"], got["r"]["high"]) == (1, 1, 1, 1.0, 600.0)
    assert got["q"]["n_samples"] == 0 and got["q"]["mean_abs"] is None
    df = spark.createDataFrame([("r", [1.0, 5.0, 5.0], 0.0, 5.0)], "g string, samples array<double>, pmin double, pmax double")
    one = aggregate.scale_audit(df, ["g"]).first()
    assert math.isclose(one["share_high"], 2 / 3) and one["share_low"] == 0 and one["saturated"] == 1


def test_correlations_are_pairwise(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((400, 6)) + rng.standard_normal((400, 1)), 1)
    x[:, 3] = 2.5
    x[rng.random((400, 6)) < [0, 0, 0.3, 0.1, 0.5, 0.9]] = np.nan
    names = list("abcdef")
    frame = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)) for r in x], ", ".join(f"{c} double" for c in names)).repartition(5)
    for found, method in ((stats.correlations(df, names), "pearson"), (stats.spearman(df, names), "spearman")):
        for r in found.collect():
            pair = frame[[r["a"], r["b"]]].dropna()
            assert r["n"] == len(pair)
            if "d" in (r["a"], r["b"]):
                assert r["r"] is None
            else:
                assert math.isclose(r["r"], pair.corr(method=method).iloc[0, 1], abs_tol=1e-12)
    none = stats.spearman(df.limit(0), names).collect()
    assert len(none) == 15 and {(r["r"], r["n"]) for r in none} == {(None, 0)}


def test_spearman_with_one_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (2.0, 1.0), (4.0, 9.0)], "a double, b double")
    assert math.isclose(stats.spearman(df, ["a", "b"]).first()["r"], 0.5)


def test_rank_shift_with_ties_and_gaps(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(rng.integers(0, 40)), None if i % 7 == 0 else math.nan if i % 11 == 0 else float(rng.integers(0, 5))) for i in range(3000)]
    got = {r["k"]: r for r in stats.rank_shift(spark.createDataFrame(rows, "k long, x double, y double").repartition(6), "x", "y").collect()}
    want = pd.DataFrame(rows, columns=["k", "x", "y"]).set_index("k").rank(ascending=False)
    assert len(got) == 3000
    for k, r in got.items():
        assert r["rank_first"] == want.loc[k, "x"] and (r["rank_second"] == want.loc[k, "y"] if want.loc[k, "y"] == want.loc[k, "y"] else r["rank_second"] is None and r["shift"] is None)


def test_counts_over_many_ranges_and_groups(spark):
    """A hot group of a narrow scale beside many small ones of their own, with a null group and flags."""
    rng = np.random.default_rng(10)
    rows = [("hot", 1e-6 * float(v)) for v in rng.integers(0, 20000, 30000)] + [(f"g{i % 40}" if i % 41 else None, float(10 ** (i % 9)) * float(rng.integers(0, 9))) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = stats.value_counts(spark.createDataFrame(rows, "g string, v double"), "v", {"even": F.floor(F.col("v") * 1e6) % 2 == 0}, ["g"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert len(got) == sum(len(set(v)) for v in by.values())
    ordered = {g: np.sort(v) for g, v in by.items()}
    for r in got:
        own = ordered[r["g"]]
        assert (r["below"], r["n"], r["total"]) == (np.searchsorted(own, r["value"]), np.searchsorted(own, r["value"], "right") - np.searchsorted(own, r["value"]), len(own))
    hot = [r for r in got if r["g"] == "hot"]
    last = max(hot, key=lambda r: r["value"])
    assert last["below_even"] + last["n_even"] == last["total_even"] == sum(r["n_even"] for r in hot)


def test_robust_outliers_of_null_groups(spark):
    rng = np.random.default_rng(11)
    rows = [([None, "a", "b"][i % 3], [1, None][i % 2], float(rng.standard_normal()) if i % 50 else None) for i in range(900)] + [("only", 1, None)]
    got = graph.robust_outliers(spark.createDataFrame(rows, "g string, h int, v double"), ["g", "h"], "v", 2.0).collect()
    assert len(got) == len(rows)
    by = {}
    for g, h, v in rows:
        by.setdefault((g, h), []).append(v)
    for r in got:
        own = np.array([v for v in by[r["g"], r["h"]] if v is not None])
        if r["v"] is None:
            assert r["robust_z"] is None and r["bad"] is None
        else:
            z = 0.6745 * (r["v"] - np.median(own)) / (np.median(np.abs(own - np.median(own))) + 1e-12)
            assert math.isclose(r["robust_z"], z, rel_tol=1e-9, abs_tol=1e-12) and r["bad"] == (z > 2.0)
    alone = graph.robust_outliers(spark.createDataFrame([(1.0,), (2.0,), (30.0,)], "v double"), [], "v", 2.0).collect()
    assert sorted(r["bad"] for r in alone) == [False, False, True]


def test_describe_skips_nan_and_densest_keeps_columns(spark):
    row = aggregate.describe(spark.createDataFrame([(1.0,), (math.nan,), (3.0,), (None,)], "v double"), "v").first()
    assert (row["n"], row["mean"], row["high"], row["p50"]) == (2, 2.0, 3.0, 2.0)
    edges = spark.createDataFrame([(0, 1, 2, 0.5, "x", "y"), (0, 1, 3, 0.9, "x", "y")], "g int, a int, b int, w double, _k string, _rank string")
    kept = graph.densest(edges, ["g"], 0.5)
    assert kept.columns == edges.columns and [tuple(r) for r in kept.collect()] == [(0, 1, 3, 0.9, "x", "y")]


def test_cleaned_edges_that_stand_for_several(spark):
    rows = [(g, a, b, w, n) for g in (1, None) for a, b, w, n in [(1, 2, 0.25, 3), (2, 1, 0.5, 1), (2, 2, 0.9, 4), (1, 3, None, 5), (3, 1, 0.75, 2), (2, 3, None, 0), (4, 5, 9.0, 2), (5, 6, -1.0, 2), (None, 1, 0.5, 2)]]
    edges = spark.createDataFrame(rows, "g int, a int, b int, w double, n int")
    each = spark.createDataFrame([row[:4] for row in rows for _ in range(max(1, row[4]))], "g int, a int, b int, w double")
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = order(graph.cleaned(edges, ["g"], "n"))
    assert got == order(graph.cleaned(each, ["g"])) and (1, 1, 2, 0.3125) in got and (1, 2, 3, 0.0) in got and len(got) == 10


def test_a_rank_column_is_replaced(spark):
    got = stats.average_rank(spark.createDataFrame([(2.0, 7), (1.0, 8)], "v double, rank int"), "v").collect()
    assert sorted(map(tuple, got)) == [(1.0, 1.0), (2.0, 2.0)]


def test_salted_join_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else 7 if i % 2 else i % 50) for i in range(20000)], "i int, k int").repartition(4)
    table = spark.createDataFrame([(k, f"t{k}", 8000 if k == 7 else 160) for k in range(50)], "k int, t string, n int")
    got = joins.salted_join(rows, table, ["k"], "n")
    assert got.count() == 20000 and got.where("t = concat('t', k) or (t is null and k is null)").count() == 20000
    assert joins.salted_join(rows, table, ["k"], "n", "inner").count() == 16000


def folds_of(spark, n=240, width=4):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((n, width)) * [1, 5, 0.1, 1] + [0, 3, 0, 0]
    y = (x @ [1.0, 0.1, 3.0, 0.0] + rng.standard_normal(n) > 0.8).astype(int)
    x[:, 3] = 7.0  # does not vary
    rows = [(i, int(y[i]), x[i].tolist(), int(rng.integers(0, 3)), rng.integers(0, 3, 3).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, y int, x array<double>, fold int, inner array<int>").repartition(4)


@pytest.mark.parametrize("kind", ["logistic", "svm"])
def test_many_models_equal_single_fits(spark, kind):
    """Each model against gradient descent on its own rows, with the same loss."""
    rows, df = folds_of(spark)
    sets = [(0, -1), (1, 2), (2, 0)]
    got = ml.fit_models(df, 4, kind, sets, (0.01, 1.0))
    x, y, fold, inner = (np.array([r[k] for r in rows]) for k in (2, 1, 3, 4))
    for m in range(6):
        k, j = sets[m // 2]
        at = (fold != k) & ((inner[:, k] != j) | (j < 0))
        spread = x[at].std(axis=0)
        z = np.column_stack([(x[at] - x[at].mean(axis=0)) / np.where(spread > 1e-9, spread, 1), np.ones(at.sum())])
        t = y[at]
        w = len(t) / (2 * np.bincount(t)[t])
        w = w / w.sum()
        b = np.zeros(5)
        for _ in range(20000):
            s = z @ b
            g = 1 / (1 + np.exp(-s)) - t if kind == "logistic" else -2 * (2 * t - 1) * np.maximum(1 - (2 * t - 1) * s, 0)
            step = z.T @ (w * g) + [0.01, 1.0][m % 2] * np.append(b[:4], 0)
            b -= 0.2 * step
        assert np.abs(step).max() < 1e-10 and np.allclose(got.weight[m], b, atol=1e-7)
        assert np.allclose(got.margins(x[:5], np.array([m]))[:, 0], ((x[:5] - got.mean[m // 2]) / got.spread[m // 2]) @ b[:4] + b[4], atol=1e-6)


def test_nested_folds_choose_by_auc(spark):
    rng = np.random.default_rng(13)
    rows = [(i, i % 3 == 0, *(rng.standard_normal(3) + (i % 3 == 0))) for i in range(300)] + [(300, True, None, 1.0, 1.0), (301, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, None if y is None else int(y), *(None if v is None else float(v) for v in f)) for i, y, *f in rows], "k int, y int, a double, b double, c double")
    for kind in ("logistic", "svm"):
        out = ml.nested_cv(df, ["a", "b", "c"], "y", "k", kind, outer=3, inner=3).collect()
        assert sorted(r["id"] for r in out) == list(range(300)) and {r["value"] for r in out} <= {0.01, 0.1, 1.0}
        metrics = ml.fold_metrics(spark.createDataFrame(out)).collect()
        for r in metrics:
            own = [(o["score"], o["y"]) for o in out if o["fold"] == r["fold"]]
            pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
            auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
            precision = [np.mean([y for s, y in own if s >= p]) for p in pos]
            assert math.isclose(r["auc"], auc) and math.isclose(r["average_precision"], np.mean(precision)) and r["auc"] > 0.75
            assert abs(len(pos) - 100 / 3) < 14


def test_calibration(spark):
    rng = np.random.default_rng(14)
    y = rng.integers(0, 2, 2000)
    s = rng.standard_normal(2000) + 1.5 * y - 0.2
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)] + [(None, 1), (1.0, None)], "score double, y int")
    a, b = ml.sigmoid(df)
    pos = y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (2000 - pos + 2))
    v = np.zeros(2)
    z = np.column_stack([s, np.ones(2000)])
    for _ in range(100):
        p = 1 / (1 + np.exp(z @ v))
        v -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (t - p))
    assert np.allclose([a, b], v, atol=1e-6)
    found = ml.calibrated(df).where("score is not null and y is not null").toPandas()
    assert ((found["probability"] - found["y"]) ** 2).mean() < ((1 / (1 + np.exp(-found["score"])) - found["y"]) ** 2).mean()
    assert ml.calibrated(df).where("score is null").first()["probability"] is None


def test_permutations_keep_the_positives(spark):
    from itertools import combinations

    values = [1.0, 2.0, 2.0, 3.0, 4.0, 4.0, 4.0, 6.0, 7.0, 9.0]
    labels = [0, 0, 1, 0, 0, 1, 0, 1, 1, 0]
    df = spark.createDataFrame([(v, y) for v, y in zip(values, labels, strict=True)] + [(None, 1), (5.0, None)], "v double, y int")

    def auc(chosen):
        return np.mean([(values[p] > values[q]) + 0.5 * (values[p] == values[q]) for p in chosen for q in range(10) if q not in chosen])

    every = [auc(c) for c in combinations(range(10), 4)]
    null, seen = ml.permuted_auc(df, "v", F.col("y") == 1, 20000)
    got = np.array([r["auc"] for r in null.collect()])
    assert len(got) == 20000 and math.isclose(seen, auc([2, 5, 7, 8]))
    assert set(got.round(9)) <= set(np.round(every, 9))
    assert abs(np.mean(got >= seen - 1e-12) - np.mean(np.array(every) >= seen - 1e-12)) < 0.015 and abs(got.mean() - 0.5) < 0.01 and abs(got.std() - np.std(every)) < 0.01
    one = ml.permutation_p(df.where("y = 1"), "v", F.col("y") == 1, 10).first()
    assert tuple(one) == (None, None)


def test_permutations_over_several_ranges(spark):
    rng = np.random.default_rng(15)
    df = spark.createDataFrame([(float(v), int(y)) for v, y in zip(rng.normal(size=4000), rng.random(4000) < 0.3, strict=True)], "v double, y int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        null, _ = ml.permuted_auc(df, "v", F.col("y") == 1, 500)
        got = np.array([r["auc"] for r in null.collect()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pos = df.where("y = 1").count()
    want = math.sqrt(4001 / (12 * pos * (4000 - pos)))
    assert abs(got.mean() - 0.5) < 3 * want / math.sqrt(500) and 0.85 < got.std() / want < 1.15


def test_draws_equal_a_draw_at_a_time(spark):
    rng = np.random.default_rng(16)
    rows = [(i, float(rng.integers(0, 12)) if i % 3 else 5.0, int(rng.random() < 0.4)) for i in range(700)] + [(700, None, 1), (701, 1.0, None), (702, math.nan, 1)]
    df = spark.createDataFrame(rows, "k int, v double, y int")
    for split in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", split)
        got = {r["b"]: r["auc"] for r in ml.resampled_auc(df, "v", F.col("y") == 1, "k", 30).collect()}
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        import hashlib

        keep = rows[:700]
        seeds = [hashlib.md5(f"{k}-42".encode()).hexdigest() for k, *_ in keep]
        w = ml.draw_weights(np.array([int(s[:8], 16) for s in seeds]), np.array([int(s[8:16], 16) for s in seeds]), 30)
        assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
        v, y = np.array([r[1] for r in keep]), np.array([r[2] for r in keep])
        for b in range(30):
            p, n = w[:, b] * y, w[:, b] * (1 - y)
            u = sum(p[i] * ((n[v < v[i]]).sum() + n[v == v[i]].sum() / 2) for i in np.flatnonzero(p))
            assert math.isclose(got[b], u / (p.sum() * n.sum()))

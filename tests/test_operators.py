"""Invariants of the operators on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparknorm.functions import columns as C
from sparknorm.functions import signal as S
from sparknorm.functions.contract import BLOCKS, FEATURES
from sparknorm.operators import aggregate, cohort, extract, ml, normative, stats, validate
from sparknorm.sources import readers, writers
from sparknorm.streaming import scoring


def table(spark, n=60, cases=10, seed=3, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(FEATURES)))
    x[n - cases :] += shift
    rows = [(f"s{i:02d}", float(rng.uniform(8, 13)), "case" if i >= n - cases else "ref", *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["participant_id", "age", "group", *FEATURES])


def test_contract():
    assert [len(b) for b in BLOCKS.values()] == [6, 8, 24, 16] and len(set(FEATURES)) == 54


def test_scores_against_plain_numpy(spark):
    df = table(spark)
    got = normative.score_cohort(df, F.col("group") == "ref").toPandas().set_index("participant_id")
    pdf = df.toPandas().set_index("participant_id")
    ref = pdf[pdf["group"] == "ref"]
    total = 0
    for name, cols in BLOCKS.items():
        design = np.column_stack([np.ones(len(ref)), ref["age"]])
        beta, *_ = np.linalg.lstsq(design, ref[list(cols)].to_numpy(), rcond=None)
        res = pdf[list(cols)].to_numpy() - np.column_stack([np.ones(len(pdf)), pdf["age"]]) @ beta
        cov = np.cov(res[(pdf["group"] == "ref").to_numpy()], rowvar=False)
        inv = np.linalg.inv(normative.shrink(cov, 0.1))
        d = np.sqrt(np.einsum("ij,jk,ik->i", res, inv, res))
        assert np.allclose(got.loc[pdf.index, f"D_{name}"], d, rtol=1e-9)
        total = total + d
    assert np.allclose(got.loc[pdf.index, "composite"], total / 4, rtol=1e-9)


def test_fit_sees_the_reference_alone(spark):
    ref = F.col("group") == "ref"
    a = normative.score_cohort(table(spark), ref).where(ref).select("participant_id", "composite").toPandas()
    b = normative.score_cohort(table(spark, shift=1e6), ref).where(ref).select("participant_id", "composite").toPandas()
    assert np.allclose(a["composite"], b["composite"], atol=1e-10)


def test_missing_columns_and_values(spark):
    df = table(spark)
    with pytest.raises(KeyError):
        normative.score_cohort(df.drop(FEATURES[0]), F.col("group") == "ref")
    with pytest.raises(ValueError):
        normative.fit(df.where("false"), F.lit(True))
    model = normative.fit(df, F.col("group") == "ref")
    row = model.score(df.limit(1).withColumn(FEATURES[0], F.lit(None).cast("double"))).first()
    assert row["D_SE"] is None and row["composite"] is None and row["D_C"] > 0


def test_leave_one_out_is_a_refit(spark):
    df = table(spark)
    ref = F.col("group") == "ref"
    got = normative.leave_one_out(df, ref, ["participant_id"], blocks={"SE": BLOCKS["SE"]}).toPandas().set_index("participant_id")
    again = normative.fit(df, ref & (F.col("participant_id") != "s07"), blocks={"SE": BLOCKS["SE"]}).score(df.where("participant_id = 's07'")).first()
    assert math.isclose(got.loc["s07", "D_SE_loo"], again["D_SE"], rel_tol=1e-9)


def test_model_round_trip(spark, tmp_path):
    df = table(spark)
    model = normative.fit(df, F.col("group") == "ref")
    model.save(spark, str(tmp_path / "m"))
    again = normative.Model.load(spark, str(tmp_path / "m"))
    a, b = (m.score(df).orderBy("participant_id").toPandas()["composite"] for m in (model, again))
    assert np.allclose(a, b)


def test_ledoit_wolf(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(40, 6))], list("abcdef"))
    cov, s = normative.ledoit_wolf(df, list("abcdef"))
    assert 0 <= s <= 1 and np.allclose(cov, cov.T) and np.linalg.eigvalsh(cov).min() > 0


def test_combination_rules(spark):
    one = spark.range(1).select(C.weighted({k: F.lit(float(v)) for v, k in enumerate("abcd", 1)}).alias("x")).first()
    assert one["x"] == 2.5
    with pytest.raises(ValueError):
        C.weighted({})
    with pytest.raises(ValueError):
        C.weighted({"a": F.lit(1.0)}, {"a": 0.5})
    with pytest.raises(ValueError):
        normative.shrink(np.eye(2), 1.5)


def test_subject_mean(spark):
    df = spark.createDataFrame([("a", "01", 10, 1.0, 2.0), ("a", "02", None, 3.0, 4.0), ("b", "01", 11, 5.0, float("nan"))], "participant_id string, run string, age int, f1 double, f2 double")
    got = {r["participant_id"]: r for r in aggregate.subject_mean(df, ["f1", "f2"], meta=["age"]).collect()}
    assert (got["a"]["f1"], got["a"]["f2"], got["a"]["n_runs"], got["a"]["age"]) == (2.0, 3.0, 2, 10) and got["b"]["f2"] is None


def test_cohort_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError):
        cohort.assert_unique(df, ["k"])
    assert cohort.meets(df, df.where("v = 3"), "k").first().asDict() == {"both": 0, "only_first": 1, "only_second": 0}


def test_keep_last_and_readers(spark, tmp_path):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    new = spark.createDataFrame([("b", 1.0)], "k string, v double")
    assert {tuple(r) for r in writers.keep_last(old, new, ["k"]).collect()} == {("a", 1.0), ("b", 1.0)}
    writers.csv(old.withColumn("v", F.when(F.col("k") == "a", F.col("v"))), str(tmp_path / "c"))
    assert {tuple(r) for r in readers.delimited(spark, str(tmp_path / "c"), "k string, v double").collect()} == {("a", 1.0), ("b", None)}


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "k int, v double")
    assert {r["k"]: r["rank"] for r in stats.average_rank(df, "v").collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: None}
    one = stats.rank_sum(df, "v", F.col("k") == 3).first()
    assert one["auc"] == 0.0 and one["n_pos"] == 1


def test_quantiles_of_distributions():
    assert math.isclose(stats.chi_square_quantile(0.95, 6), 12.591587, rel_tol=1e-6)
    assert math.isclose(stats.t_tail(2.0, 10), 0.0733880, rel_tol=1e-5)


def test_folds_are_stratified(spark):
    df = spark.range(400).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    n = ml.stratified_folds(df, "y", "id", 4).groupBy("fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    assert len(n) == 4 and all(10 <= r["p"] <= 40 for r in n)


def test_validation_order(spark):
    df = table(spark, 3, 1)
    df = df.withColumn("age", F.when(F.col("participant_id") == "s00", float("nan")).when(F.col("participant_id") == "s01", 40.0).otherwise(F.col("age")))
    got = {r["participant_id"]: r for r in validate.validate_rows(df).collect()}
    assert got["s00"]["reason"] == "INVALID_AGE" and got["s00"]["warnings"] == []
    assert got["s01"]["status"] == "PASS" and got["s01"]["warnings"] == ["AGE_OUT_OF_RANGE"]
    assert validate.validate_rows(df.drop("age")).first()["reason"] == "MISSING_AGE"
    assert validate.validate_rows(df.drop(FEATURES[3])).where("participant_id = 's02'").first()["reason"] == "MISSING_FEATURES"


def test_recording_validation(spark):
    df = spark.createDataFrame([("x.txt", 512.0, 60.0, 64), ("x.bdf", 256.0, 60.0, 64), ("x.bdf", 512.0, 10.0, 64), ("x.bdf", 512.0, 60.0, 70)], "path string, sfreq double, duration_s double, n_channels int")
    got = validate.validate_recordings(df).collect()
    assert [r["reason"] for r in got] == ["UNSUPPORTED_FORMAT", "BAD_SFREQ", "TOO_SHORT", None] and got[3]["warnings"] == ["EXTRA_CHANNELS"]


def test_signal_kernels():
    t = np.arange(2560) / 256
    tone = np.stack([np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 10 * t + 1.0)])
    hz, psd = S.welch(tone, 256.0)
    powers = S.band_powers(hz, psd)
    assert powers["alpha_rel"] > 0.99 and math.isclose(sum(powers[f"{b}_rel"] for b in ("delta", "theta", "alpha", "beta", "gamma")), 1, abs_tol=1e-6)
    assert S.phase_locking(tone)[0, 1] > 0.99  # a constant lag is full locking
    noise = np.random.default_rng(0).normal(size=(4, 4096))
    entropy = S.spectral_entropy(S.welch(noise, 256.0)[1])
    assert (0.9 < entropy).all() and (entropy <= 1).all()
    w = S.phase_locking(noise)
    assert np.allclose(w, w.T) and (np.diag(w) == 0).all() and (0 <= w).all() and (w <= 1).all()
    assert ((S.threshold(w, 0.5) > 0) <= (w > 0)).all()
    metrics = S.graph_metrics(np.ones((5, 5)))
    assert metrics["degree_cv"] < 1e-9 and math.isclose(metrics["global_efficiency"], 1) and math.isclose(metrics["clustering"], 1)
    assert list(S.transitions([w, w])) == [0.0] and len(S.transitions([np.eye(5) * (i + 1) for i in range(4)])) == 3
    kept = S.band_pass(noise + 100, 8, 13, 256.0)
    assert abs(kept.mean()) < 1


def test_extraction(spark):
    rng = np.random.default_rng(1)
    rows = [("s", run, f"c{i}", i, 128.0, [float(x) for x in rng.normal(size=2560) * 1e-6]) for run in ("01", "02") for i in range(4)]
    rows.append(("s", "03", "c0", 0, 128.0, [0.0, float("nan")]))
    sig = spark.createDataFrame(rows, "subject string, run string, channel string, ch_idx int, sfreq double, samples array<double>")
    runs = extract.extract_runs(sig).cache()
    assert {r["run"]: r["status"] for r in runs.collect()} == {"01": "ok", "02": "ok", "03": "error"}
    one = extract.subject_features(runs).first()
    assert one["n_runs"] == 2 and all(one[f] is not None and math.isfinite(one[f]) for f in FEATURES)


def test_streaming_scores(spark, tmp_path):
    df = table(spark)
    df.write.parquet(str(tmp_path / "in"))
    model = normative.fit(df, F.col("group") == "ref")
    q = scoring.to_parquet(scoring.scored(scoring.rows(spark, str(tmp_path / "in"), df.schema), model), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("composite > 0").count() == 60


def test_dataset_audit_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 2.0, 5.0), (1, "b", None, 2.0, math.inf), (None, None, math.nan, 2.0, None)], "id int, g string, age double, x double, y double")
    got = {(r["section"], r["check"]): (r["n"], r["status"]) for r in validate.dataset_audit(rows, ["x", "y", "z"], "id", "g", ["a"], "age", {"a": 2}, ["other"]).collect()}
    assert got == {("ids", "unique"): (1, "FAIL"), ("labels", "allowed"): (2, "FAIL"), ("labels", "size of a"): (1, "WARN"), ("age", "complete"): (2, "FAIL"), ("features", "present"): (1, "FAIL"), ("features", "no missing values"): (1, "FAIL"), ("features", "finite"): (1, "FAIL"), ("features", "vary"): (1, "FAIL"), ("columns", "expected"): (0, "PASS")}
    bare = {(r["section"], r["check"]): r["n"] for r in validate.dataset_audit(rows.select("x").limit(0), ["x"], "id", "g", ["a"], "age").collect()}
    assert bare["ids", "unique"] == bare["labels", "allowed"] == bare["age", "complete"] == bare["features", "vary"] == 1


def test_merged_maps_and_exported_lines(spark):
    one = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"b": 3.0, "c": 4.0}), ({"a": 1.0}, {}), (None, {"a": 1.0})], "x map<string,double>, y map<string,double>")
    assert [r[0] for r in one.select(C.merged(F.col("x"), F.col("y"))).collect()] == [{"a": 1.0, "b": 3.0, "c": 4.0}, {"a": 1.0}, None]
    rows = spark.createDataFrame([(float(i), 2.0 * i + 1, float(i % 3)) for i in range(10)], "age double, f double, g double")
    model = normative.fit(rows, F.lit(True), blocks={"A": ("f", "g")})
    lines = model.age_lines(10)
    assert math.isclose(lines["f"]["slope"], 2.0) and math.isclose(lines["f"]["intercept"], 1.0) and set(lines) == {"f", "g"}
    with pytest.raises(ValueError, match="39"):
        model.age_lines()

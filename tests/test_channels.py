import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparknorm import queries
from sparknorm.functions import registry
from sparknorm.functions import signal as S
from sparknorm.functions.contract import SIGNALS
from sparknorm.operators import channels, extract, graph

DIR = "/root/testdata/sf0.001"


def sphere(n):
    k = np.arange(n) + 0.5
    z, turn = 1 - 2 * k / n, np.pi * (1 + 5**0.5) * k
    return np.column_stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z])


def test_a_dropped_channel_of_a_smooth_field_is_restored(spark):
    at = sphere(40)
    t = np.arange(200) / 100
    field = np.outer(at[:, 2] ** 2 + at[:, 0], np.sin(t)) + np.outer(at[:, 1] * at[:, 0], np.cos(3 * t)) + 2
    rows = [(s, "1", f"c{c}", c, 100.0, field[c].tolist()) for s in ("a", "b") for c in range(40)]
    rows[17] = (*rows[17][:5], [9.9] * 200)
    signals = spark.createDataFrame(rows, SIGNALS)
    places = spark.createDataFrame([(f" C{c}", *map(float, 85 * p)) for c, p in enumerate(at)], "channel string, x double, y double, z double")
    bad = spark.createDataFrame([("a", "1", "c17"), ("a", "1", "C17 ")], "subject string, run string, channel string")
    got = {(r["subject"], r["ch_idx"]): np.array(r["samples"]) for r in channels.interpolated(signals, places, bad).collect()}
    assert len(got) == 80 and np.abs(got["a", 17] - field[17]).max() < 0.02 * np.ptp(field)
    assert all((got[k] == rows[i][5]).all() for i, k in enumerate((r[0], r[3]) for r in rows) if i != 17)
    blocks = signals.withColumns({"start": F.explode(F.array(F.lit(0), F.lit(120)))}).withColumn("samples", F.when(F.col("start") == 0, F.slice("samples", 1, 120)).otherwise(F.slice("samples", 121, 80)))
    cut = channels.interpolated(blocks, places, bad, ("subject", "run", "start")).where("subject = 'a' and ch_idx = 17").orderBy("start").collect()
    assert np.allclose(np.concatenate([r["samples"] for r in cut]), got["a", 17])
    with pytest.raises(Exception, match="without a place.*c3"):
        channels.interpolated(signals, places.withColumn("x", F.when(F.col("channel") != " C3", F.col("x"))), bad).collect()
    few = signals.where("ch_idx in (16, 17)")
    assert channels.interpolated(few, places, bad).where("subject = 'a' and ch_idx = 17").first()["samples"] == [9.9] * 200


def test_restoring_keeps_constants_and_known_places():
    at = sphere(20)
    w = channels.restoring(at[:15], at[15:])
    assert np.allclose(w.sum(axis=1), 1)
    v = np.random.default_rng(1).standard_normal(15)
    assert np.allclose(channels.restoring(at[:15], at[:15], 0.0) @ v, v)
    x = np.linspace(-1, 1, 7)
    n = range(1, 51)
    legendre = [np.ones(7), x]
    for k in n:
        legendre.append(((2 * k + 1) * x * legendre[k] - k * legendre[k - 1]) / (k + 1))
    assert np.allclose(channels.spline(x), sum((2 * k + 1) / (k * (k + 1)) ** 4 * legendre[k] for k in n) / (4 * np.pi))


def test_bad_and_used_channels(spark):
    rng = np.random.default_rng(2)
    rows = [("a", "1", f"c{c}", c, 100.0, (rng.standard_normal(100) * (50 if c == 3 else 1 + c / 50)).tolist()) for c in range(8)]
    rows += [("a", "1", "nan", 8, 100.0, [math.nan] * 100), ("b", "1", "c0", 0, 100.0, [0.0] * 10), ("b", "1", "c1", 1, 100.0, None)]
    signals = spark.createDataFrame(rows, SIGNALS)
    bad = channels.bad_channels(signals)
    assert sorted(tuple(r) for r in bad.collect()) == [("a", "1", "c3"), ("a", "1", "nan")]
    montage = spark.createDataFrame([("C0",), ("c1 ",), ("c3",), ("C3",)], "channel string")
    assert sorted((r["subject"], r["channel"]) for r in channels.used(signals, bad, montage).collect()) == [("a", "c0"), ("a", "c1"), ("b", "c0"), ("b", "c1")]


def recordings_of(spark):
    rows = queries.signals(spark, DIR).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["ch_idx"]):
        out.setdefault((r["subject"], r["run"]), []).append(r["samples"])
    return {k: np.array(v) for k, v in out.items()}


def near(a, b):
    return (a is None or a != a) and b != b or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)


def test_queries_of_kernels(spark):
    """Each group's row against the kernel on its samples."""
    found = recordings_of(spark)
    for name, kernel, columns in (
        ("recording_quality", lambda x: S.recording_quality(x, 128.0), channels.QUALITY),
        ("recording_complexity", S.complexity, channels.COMPLEXITY),
        ("graph_paths", lambda x: S.graph_metrics(S.cleaned(abs(np.corrcoef(x)))), ["global_efficiency", "mean_path_length", "lambda2", "laplacian_entropy"]),
    ):
        got = {(r["subject"], r["run"]): r for r in queries.QUERIES[name](spark, DIR).collect()}
        assert set(got) == set(found)
        for k, x in found.items():
            want = kernel(x)
            assert all(near(got[k][c], want[c]) for c in columns), (name, k)
    edges = {(r["subject"], r["run"], r["a"], r["b"]): r["w"] for r in queries.QUERIES["coherence_edges"](spark, DIR).collect()}
    ids = {}
    for r in queries.signals(spark, DIR).select("subject", "run", "ch_idx").collect():
        ids.setdefault((r["subject"], r["run"]), []).append(r["ch_idx"])
    for k, x in found.items():
        w, ch = S.coherence(x, 128.0, 8.0, 30.0, 32), sorted(ids[k])
        assert all(near(edges[(*k, ch[i], ch[j])], w[i, j]) for i in range(len(ch)) for j in range(i + 1, len(ch)))
    assert len(edges) == sum(len(v) * (len(v) - 1) // 2 for v in ids.values())


def test_signal_features_of_each_subject(spark):
    found, subjects = recordings_of(spark), {}
    for (s, _), x in found.items():
        try:
            subjects.setdefault(s, []).append(extract.run_features(x, 128.0, None, 0.25, 0.125))
        except (ValueError, IndexError):
            continue
    got = {r["participant_id"]: r for r in queries.QUERIES["signal_features"](spark, DIR).collect()}
    assert set(got) == set(subjects)
    for s, runs in subjects.items():
        mean = lambda c: np.nanmean([r[c] for r in runs])  # noqa: E731, B023
        power = {b: mean(f"{b}_abs") for b in ("delta", "theta", "alpha", "beta", "gamma")}
        assert near(got[s]["alpha_rel"], power["alpha"] / (sum(power.values()) + 1e-12))
        assert near(got[s]["log_theta_beta"], math.log((power["theta"] + 1e-12) / (power["beta"] + 1e-12)))
        assert all(near(got[s][c], mean(c)) for c in ("plv_mean_alpha", "clustering_beta", "mean_delta_theta", "temporal_cv_degree_cv_gamma"))


def plain_sample_entropy(x, m, tol):
    def count(k):
        t = [x[i : i + k] for i in range(len(x) - k)]
        return sum(max(abs(u - v) for u, v in zip(a, b, strict=True)) <= tol for i, a in enumerate(t) for j, b in enumerate(t) if i != j)

    b, a = count(m), count(m + 1)
    return -math.log(a / b) if a and b else math.nan


def test_stacked_entropies_equal_single_ones(spark):
    x = np.random.default_rng(3).standard_normal((6, 150)).round(1)
    want = [plain_sample_entropy(v.tolist(), 2, 0.2 * v.std()) for v in x]
    assert np.allclose(S.sample_entropies(x), want) and np.allclose(S.sample_entropies(x, cells=1), want)
    registry.register(spark)
    rows = [(v.tolist(),) for v in x] + [([1.0, 2.0, 1.5, 3.0],), (None,), ([],), ([math.nan, 1.0],)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "v array<double>").selectExpr("permutation_entropy(v)", "sample_entropy(v)", "spectral_flatness(v)").collect()]
    for v, g in zip(x, got, strict=False):
        assert math.isclose(g[0], S.permutation_entropy(v)) and math.isclose(g[1], S.sample_entropy(v)) and math.isclose(g[2], S.spectral_entropy(S.welch(v[None], 1.0)[1])[0])
    assert got[-3:] == [(None,) * 3] * 3


def test_correlation_edges_of_many_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(None if i % 9 == 0 else i % 9, rng.standard_normal(4).tolist()) for i in range(900)] + [(1, None), (2, [1.0, None, 2.0, 3.0]), (3, [math.inf, 1.0, 2.0, 3.0])]
    monkeypatch.setattr(graph, "HELD", 2)
    got = graph.correlation_edges(spark.createDataFrame(rows, "g int, v array<double>").repartition(3), "g", "v").collect()
    assert len(got) == 9 * 6
    for g in (None, *range(1, 9)):
        x = np.array([v for k, v in rows[:900] if k == g])
        want = np.abs(np.corrcoef(x.T))
        assert all(math.isclose(r["w"], want[r["a"] - 1, r["b"] - 1], rel_tol=1e-9) for r in got if r["g"] == g)
    with pytest.raises(Exception, match="components"):
        graph.correlation_edges(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "g int, v array<double>"), "g", "v").collect()

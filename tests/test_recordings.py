import math

import numpy as np
import pytest

from sparknorm.functions import signal as S
from sparknorm.functions.contract import BANDS, NETWORK_BANDS, SIGNALS
from sparknorm.operators import extract, recordings

FS = 128.0


def long_filter(x, low, high, sfreq):
    """The band-pass one sample at a time in long doubles, whose direct form keeps enough digits."""
    poles, gain = S.poles_of(low, high, sfreq)
    a = np.ones(1, np.clongdouble)
    for p in poles:
        a = np.convolve(a, np.array([1, -p], np.clongdouble))
    b = np.ones(1, np.longdouble)
    for z in (1, -1) * 4:
        b = np.convolve(b, np.array([1, -z], np.longdouble))
    a, b = np.real(a).astype(np.longdouble), b * np.longdouble(gain)
    pad = 27
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1).astype(np.longdouble)

    def once(x):
        # from steady state: the filter's answer to a constant is zero, so the first sample is taken off
        x = x - x[:, :1]
        z, y = np.zeros((len(x), 8), np.longdouble), np.empty_like(x)
        for t in range(x.shape[1]):
            y[:, t] = b[0] * x[:, t] + z[:, 0]
            z = np.concatenate([z[:, 1:], np.zeros((len(x), 1), np.longdouble)], axis=1) + x[:, t : t + 1] * b[1:] - y[:, t : t + 1] * a[1:]
        return y

    y = once(once(ext)[:, ::-1])[:, ::-1]
    return y[:, pad:-pad].astype(float)


@pytest.mark.parametrize("band", NETWORK_BANDS)
@pytest.mark.parametrize("sfreq", [128.0, 256.0])
def test_band_pass_by_blocks(band, sfreq):
    x = np.random.default_rng(1).standard_normal((2, 3000)) + 3
    assert np.abs(S.band_pass(x, *BANDS[band], sfreq) - long_filter(x, *BANDS[band], sfreq)).max() < (1e-10 if sfreq < 200 else 1e-9)


def test_filter_state_is_carried():
    x = np.random.default_rng(2).standard_normal((3, 1000))
    system = S.band_system(8.0, 13.0, FS)
    whole = system.run(x, np.zeros((3, 8)))
    assert np.allclose(whole, system.run(x, np.zeros((3, 8)), block=7), atol=1e-13, rtol=0)
    assert np.abs(system.run(np.pad(x[:, :1], ((0, 0), (0, 4000))), np.zeros((3, 8)))[:, S.settle(8.0, 13.0, FS) :]).max() < 1e-12


def rows(runs):
    return [(f"s{i}", "1", f"c{c}", c, FS, v) for i, x in enumerate(runs) for c, v in enumerate(x if isinstance(x, list) else x.tolist())]


def same(a, b, tol):
    for c in extract.RUN_COLUMNS:
        x, y = (math.nan if r[c] is None else r[c] for r in (a, b))
        assert (math.isnan(x) and math.isnan(y)) or abs(x - y) <= tol * max(1.0, abs(y)), c


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(3)
    shared = rng.standard_normal((1, 12000))
    return [1e-5 * (rng.standard_normal((4, n)) + s * shared[:, :n]) for n, s in ((12000, 0.8), (9001, 0.3), (700, 0.5))]


def whole(x, **how):
    """One block, without Spark, by the kernels' own formulas."""
    w, hop = round(how["window_s"] * FS), round(how["step_s"] * FS)
    clean = S.preprocess(x, FS)
    hz, psd = S.welch(clean * 1e6, FS)
    at = (hz >= 1) & (hz <= 45)
    out = {k: v for k, v in S.band_powers(hz[at], psd[:, at]).items() if k.endswith("_abs")} | {"spectral_entropy_mean": S.spectral_entropy(psd[:, at]).mean()}
    for band in NETWORK_BANDS:
        u = recordings.turned(S.band_pass(clean, *BANDS[band], FS), BANDS[band][0], FS)
        full = S.cleaned(np.abs(u @ u.conj().T) / u.shape[1])
        edge = full[np.triu_indices(len(full), 1)]
        series = [S.cleaned(np.abs(u[:, a:b] @ u[:, a:b].conj().T) / w) for a, b in S.windows(u.shape[1], FS, w / FS, hop / FS)]
        delta, each = S.transitions(series), np.array([S.graph_metrics(m)["degree_cv"] for m in series])
        got = {"plv_mean": edge.mean(), "plv_median": np.median(edge)} | S.graph_metrics(full)
        got |= {"mean_delta": delta.mean() if len(delta) else math.nan, "cv_delta": delta.std() / (delta.mean() + 1e-12) if len(delta) else math.nan, "mean_degree_cv": each.mean() if len(each) else math.nan, "temporal_cv_degree_cv": each.std() / (abs(each.mean()) + 1e-12) if len(each) else math.nan}
        out |= {f"{k}_{band}": v for k, v in got.items()}
    return out


@pytest.mark.parametrize("seconds", [1.0, 23.7, 1000.0])
def test_blocks_equal_the_whole_run(spark, made, seconds):
    table = spark.createDataFrame(rows(made), SIGNALS)
    got = {r["subject"]: r for r in recordings.run_features(table, seconds, window_s=4.0, step_s=1.5).collect()}
    assert {r["status"] for r in got.values()} == {"ok"}
    for i, x in enumerate(made):
        want = whole(x, window_s=4.0, step_s=1.5)
        same(got[f"s{i}"], want, 1e-9)


def test_close_to_phases_of_the_whole_run_by_fft(spark, made):
    table = spark.createDataFrame(rows(made[:1]), SIGNALS)
    a, b = recordings.run_features(table, 20.0, window_s=4.0, step_s=2.0).first(), extract.extract_runs(table, window_s=4.0, step_s=2.0).first()
    for c in extract.RUN_COLUMNS:
        tol = 1e-9 if c.endswith("_abs") or c == "spectral_entropy_mean" else 0.02
        assert abs(a[c] - b[c]) <= tol * max(1.0, abs(b[c])), c


def test_blocks_of_a_source_are_dealt_anew(spark, made):
    table = spark.createDataFrame(rows(made[:2]), SIGNALS)
    runs = recordings._checked(table)
    a = recordings.run_features(runs, 30.0, blocks=recordings.cut(table, 0.7)).collect()
    b = {r["subject"]: r for r in recordings.run_features(table, 1000.0).collect()}
    for r in a:
        same(r, b[r["subject"]], 1e-9)


def test_runs_that_cannot_be_read(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((2, 600))
    bad = [good.tolist(), [[1.0] * 600, [1.0] * 500], [[1.0] * 599 + [math.nan], [1.0] * 600], [[1.0] * 599 + [None], [1.0] * 600], [[], []], [None, [1.0]]]
    table = spark.createDataFrame([*rows(bad), ("twice", "1", "a", 0, FS, [1.0] * 300), ("twice", "1", "b", 0, FS, [1.0] * 300), ("rate", "1", "a", 0, FS, [1.0] * 300), ("rate", "1", "b", 1, 64.0, [1.0] * 300)], SIGNALS)
    got = {r["subject"]: (r["status"], r["error"]) for r in recordings.run_features(table, 2.0).collect()}
    assert got.pop("s0") == ("ok", None)
    assert len(got) == 7 and all(s == "error" and e for s, e in got.values())
    assert recordings.run_features(spark.createDataFrame([], SIGNALS)).count() == 0


def test_the_query(spark):
    from sparknorm import queries

    sf = "/root/testdata/sf0.001"
    blocks, runs = queries.order_blocks(spark, sf)
    found = {}
    for r in blocks.orderBy("run", "ch_idx", "start").collect():
        found.setdefault(r["run"], {}).setdefault(r["ch_idx"], []).extend(r["samples"])
    got = {r["run"]: r for r in queries.long_recordings(spark, sf).collect()}
    assert set(got) == set(found) == {r["run"] for r in runs.collect()}
    for run, channels in found.items():
        x = np.array([channels[c] for c in range(4)])
        same(got[run], whole(x, window_s=10.0, step_s=5.0), 1e-9)

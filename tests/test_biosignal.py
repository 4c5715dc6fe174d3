import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparknorm.operators import recordings
from sparknorm.sources import biosignal

PER, RECORDS = 50, 37


def bdf_bytes(digits, pmax=1000.0):
    """24-bit digits, channels times samples; the second channel has half the rate, and annotations follow."""
    n = len(digits) + 1
    per = [PER] + [PER // 2] * (len(digits) - 1) + [4]
    text = lambda v, w: str(v).ljust(w).encode()
    names = [f"C{i}" for i in range(len(digits))] + ["BDF Annotations"]
    columns = [(names, 16), ([""] * n, 80), (["uV"] * n, 8), ([-pmax] * n, 8), ([pmax] * n, 8), ([-8388608] * n, 8), ([8388607] * n, 8), ([""] * n, 80), (per, 8), ([""] * n, 32)]
    head = b"\xffBIOSEMI" + text("", 176) + text(256 * (n + 1), 8) + text("24BIT", 44) + text(-1, 8) + text(0.5, 8) + text(n, 4)
    out = head + b"".join(text(v, w) for values, w in columns for v in values)
    for r in range(RECORDS):
        for k, d in zip(per[:-1], digits, strict=True):
            out += b"".join(int(v).to_bytes(3, "little", signed=True) for v in d[r * k : (r + 1) * k])
        out += bytes(12)
    return out


def gdf_bytes(channels, kinds, per):
    """GDF 2.1 of channels of sample types; digits are physical values."""
    n = len(channels)
    body = bytearray(256 * n)
    put = lambda at, fmt, values: [struct.pack_into(fmt, body, at * n + i * struct.calcsize(fmt), v) for i, v in enumerate(values)]
    put(0, "16s", [f"G{i}".encode() for i in range(n)])
    put(96, "6s", [b"uV"] * n)
    for at, v in ((104, -5.0), (112, 5.0), (120, -10.0), (128, 10.0)):
        put(at, "<d", [v] * n)
    put(216, "<I", [per] * n)
    put(220, "<I", kinds)
    head = bytearray(256)
    head[:8] = b"GDF 2.10"
    struct.pack_into("<H", head, 184, n + 1)
    struct.pack_into("<q", head, 236, RECORDS)
    struct.pack_into("<II", head, 244, 1, 4)
    struct.pack_into("<H", head, 252, n)
    return bytes(head) + bytes(body) + b"".join(c[r * per : (r + 1) * per].tobytes() for r in range(RECORDS) for c in channels)


def joined(df):
    out = {}
    for r in df.orderBy("channel", "start").collect():
        assert r["start"] == len(out.get(r["channel"], []))
        out.setdefault(r["channel"], []).extend(r["samples"])
    return {k: np.array(v) for k, v in out.items()}


def test_edf_by_records(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-100, 100, (3, PER * RECORDS))
    (tmp_path / "a.edf").write_bytes(biosignal.edf_bytes(x, 100.0, ["Fz", "Cz", "Pz"], -100, 100, per_record=PER))
    df = biosignal.recordings(spark, str(tmp_path), records_per_partition=10, records_per_row=4)
    assert df.rdd.getNumPartitions() == 4
    got = joined(df)
    assert list(got) == ["Cz", "Fz", "Pz"]
    assert max(np.abs(got[c] - v).max() for c, v in zip(["Fz", "Cz", "Pz"], x, strict=True)) <= 200 / 65535 / 2 + 1e-9
    row = df.first()
    assert (row["sfreq"], row["unit"], row["n"]) == (100.0, "uV", PER * RECORDS)


@pytest.mark.parametrize("push", ["true", "false"])
def test_channels_are_chosen(spark, tmp_path, push):
    x = np.random.default_rng(2).uniform(-1, 1, (3, 500))
    (tmp_path / "a.edf").write_bytes(biosignal.edf_bytes(x, 100.0, ["Fz", "Cz", "Pz"], -1, 1))
    assert set(joined(biosignal.recordings(spark, str(tmp_path / "*.edf"), ["cz", "none"]))) == {"Cz"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
    try:
        df = biosignal.recordings(spark, f"file://{tmp_path}/a.edf")
        assert set(joined(df.where("channel = 'Pz'"))) == {"Pz"}
        assert set(joined(df.where("channel in ('Pz', 'Fz')").where("channel = 'Fz'"))) == {"Fz"}
        assert df.where("channel = 'pz'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bdf_to_the_sample(spark, tmp_path):
    rng = np.random.default_rng(3)
    digits = [rng.integers(-(2**23), 2**23, PER * RECORDS), rng.integers(-(2**23), 2**23, PER // 2 * RECORDS)]
    (tmp_path / "b.bdf").write_bytes(bdf_bytes(digits) + b"cut")  # an open file: its count comes from its length
    df = biosignal.recordings(spark, str(tmp_path / "b.bdf"), records_per_row=5)
    got = joined(df)
    assert set(got) == {"C0", "C1"}
    for c, d in zip(("C0", "C1"), digits, strict=True):
        assert np.allclose(got[c], (d + 8388608) * 2000 / 16777215 - 1000, atol=1e-9, rtol=0)
    assert {r["channel"]: r["sfreq"] for r in df.collect()} == {"C0": 100.0, "C1": 50.0}


@pytest.mark.parametrize("kind,dtype", [(1, "<i1"), (3, "<i2"), (4, "<u2"), (5, "<i4"), (6, "<u4"), (7, "<i8"), (16, "<f4"), (17, "<f8")])
def test_gdf_types(spark, tmp_path, kind, dtype):
    rng = np.random.default_rng(4)
    channels = [rng.integers(0, 10, 8 * RECORDS).astype(dtype) for _ in range(2)]
    (tmp_path / "g.gdf").write_bytes(gdf_bytes(channels, [kind] * 2, 8))
    got = joined(biosignal.recordings(spark, str(tmp_path / "g.gdf"), records_per_partition=5))
    assert all(np.allclose(got[f"G{i}"], c.astype(float) / 2) for i, c in enumerate(channels))


def test_files_that_cannot_be_read(spark, tmp_path):
    good = biosignal.edf_bytes(np.zeros((2, 300)), 100.0, ["a", "b"], -1, 1)
    bad = {"short.edf": (good[:-1], "header asks"), "text.edf": (b"no recording", "neither"), "gaps.edf": (good[:192] + b"EDF+D".ljust(44) + good[236:], "gaps"), "count.edf": (good[:252] + b"x   " + good[256:], "no number"), "g.gdf": (b"GDF 1.25" + bytes(248), "only 2")}
    for name, (data, why) in bad.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=why):
            biosignal.recordings(spark, str(tmp_path / name)).count()
    with pytest.raises(Exception, match="nowhere"):
        biosignal.recordings(spark, str(tmp_path / "nowhere.edf")).count()
    (tmp_path / "empty").mkdir()
    assert biosignal.recordings(spark, str(tmp_path / "empty")).count() == 0


def test_from_files_to_features(spark, tmp_path):
    rng = np.random.default_rng(5)
    for s in ("s1", "s2"):
        (tmp_path / f"{s}.edf").write_bytes(biosignal.edf_bytes(rng.normal(0, 20, (3, 4000)), 128.0, ["a", "b", "c"], -200, 200))
    rows = biosignal.recordings(spark, str(tmp_path), records_per_row=3)
    subject = F.regexp_extract("path", r"([^/]+)\.edf$", 1)
    blocks, runs = biosignal.blocks_of(rows, subject, F.lit("1"), 1e-6)
    got = recordings.run_features(runs, 10.0, window_s=4.0, step_s=2.0, blocks=blocks).collect()
    assert {(r["subject"], r["status"]) for r in got} == {("s1", "ok"), ("s2", "ok")}
    assert all(0 < r["plv_mean_alpha"] < 1 and r["alpha_abs"] > 0 for r in got)
    same = biosignal.from_content(spark.read.format("binaryFile").load(str(tmp_path)))
    assert same.agg(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v))).first()[0] == pytest.approx(rows.agg(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v))).first()[0])

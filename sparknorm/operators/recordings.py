"""Features of recordings of any length: time blocks with a halo, merged by partial sums.

A recording is cut into blocks of a stated length, and a block gets from its
neighbours the samples that its filters reach. Filters treat the ends of the
recording as the whole-run kernels do; at the borders of blocks the FIR filters
lose half their length and the band-pass what its transient needs, all of it
halo. Densities, phase products and window measures of the blocks are summed,
so a task holds one block of all channels, however long the recording is.

Phases come from an FIR Hilbert transform, which is local; that of the whole
run by FFT lets every sample depend on all others, and differs from it at the
ends of a recording.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparknorm.functions import signal as S
from sparknorm.functions.contract import BANDS, EPS, NETWORK_BANDS

from .extract import POWERS, RUN_COLUMNS

KEYS = ["subject", "run"]
SEGMENT = 2048  # samples of a Welch segment
PARTS = "kind string, band string, a int, b int, x double, y double, n double"


@lru_cache(maxsize=64)
def hilbert_kernel(low: float, sfreq: float, stop: float = 120.0) -> np.ndarray:
    """Odd FIR Hilbert kernel, a Kaiser window of ``stop`` decibels, that has settled at three quarters of a band's lower edge."""
    half = math.ceil((stop - 8) / (2.285 * 2 * math.pi * 0.75 * low / sfreq)) // 2 + 1
    n = np.arange(-half, half + 1)
    ideal = np.where(n % 2 != 0, 2 / (np.pi * np.where(n == 0, 1, n)), 0.0)
    return ideal * np.kaiser(2 * half + 1, 0.1102 * (stop - 8.7))


def turned(y: np.ndarray, low: float, sfreq: float, first: bool = True, last: bool = True) -> np.ndarray:
    """exp(i phase) of rows of y by the FIR Hilbert transform; nothing stands beyond the ends of a recording, and at other ends half the kernel is lost."""
    kernel = hilbert_kernel(low, sfreq)
    none = [np.zeros((len(y), len(kernel) // 2))]
    im = S.convolved(y, kernel, none if first else [], none if last else [])
    re = y[:, 0 if first else len(kernel) // 2 :][:, : im.shape[1]]
    return np.exp(1j * np.arctan2(im, re))


@dataclass(frozen=True)
class Plan:
    """What a recording of n samples is filtered with, and how far that reaches."""

    n: int
    sfreq: float
    notch: float | None
    window: int
    hop: int
    low: float = 1.0
    high: float = 45.0

    @property
    def stops(self) -> bool:
        return bool(self.notch and self.notch + 1 < self.sfreq / 2)

    def clean(self, x: np.ndarray, first: bool, last: bool) -> np.ndarray:
        """The whole-run kernel's notch, band-pass and average reference; inner ends lose ``cleaning`` samples."""
        if self.stops:
            x = S.fir(x, self.notch - 1, self.notch + 1, self.sfreq, True, S.taps_of(self.notch - 1, self.sfreq, self.n), first, last)
        x = S.fir(x, self.low, min(self.high, 0.49 * self.sfreq), self.sfreq, False, S.taps_of(self.low, self.sfreq, self.n), first, last)
        return x - x.mean(axis=0)

    @property
    def cleaning(self) -> int:
        return S.taps_of(self.low, self.sfreq, self.n) // 2 + (S.taps_of(self.notch - 1, self.sfreq, self.n) // 2 if self.stops else 0)

    def reach(self, band: str) -> int:
        return S.settle(*BANDS[band], self.sfreq) + len(hilbert_kernel(BANDS[band][0], self.sfreq)) // 2

    @property
    def halo(self) -> tuple[int, int]:
        """Samples before and after a block: filters on both sides, and behind it the windows and the segment that start in it."""
        side = self.cleaning + max(self.reach(b) for b in NETWORK_BANDS)
        return side, side + max(self.window + self.hop, SEGMENT)

    def parts(self, x: np.ndarray, at: int, start: int, end: int) -> list[tuple]:
        """Partial sums of the block [start, end) from raw samples x that begin at ``at``."""
        first, last = at == 0, at + x.shape[1] == self.n
        x = self.clean(x, first, last)
        at += 0 if first else self.cleaning
        return [*self._densities(x, at, start, end), *(row for band in NETWORK_BANDS for row in self._phases(band, x, at, start, end, first, last))]

    def _densities(self, x: np.ndarray, at: int, start: int, end: int) -> list[tuple]:
        size = min(SEGMENT, self.n)
        begins = [s for s in range(-(-start // size) * size, end, size) if s + size <= self.n]
        if not begins:
            return []
        hz = np.fft.rfftfreq(size, 1 / self.sfreq)
        keep = np.flatnonzero((hz >= 1) & (hz <= 45))
        total = sum(S.welch(x[:, s - at : s - at + size] * 1e6, self.sfreq)[1][:, keep] for s in begins)
        return [("density", None, c, int(k), float(v), 0.0, float(len(begins))) for c in range(len(x)) for k, v in zip(keep, total[c], strict=True)]

    def _phases(self, band: str, x: np.ndarray, at: int, start: int, end: int, first: bool, last: bool) -> list[tuple]:
        low, high = BANDS[band]
        y = S.both_ways(x, low, high, self.sfreq, first=first, last=last)
        cut = 0 if first else S.settle(low, high, self.sfreq)
        y = y[:, cut : y.shape[1] - (0 if last else S.settle(low, high, self.sfreq))]
        u = turned(y, low, self.sfreq, first, last)
        at += cut + (0 if first else len(hilbert_kernel(low, self.sfreq)) // 2)
        own = u[:, start - at : end - at]
        product = own @ own.conj().T
        i, j = np.triu_indices(len(u), 1)
        rows = [("edge", band, int(a), int(b), float(v.real), float(v.imag), float(own.shape[1])) for a, b, v in zip(i, j, product[i, j], strict=True)]
        before = None
        for s in range(-(-start // self.hop) * self.hop, min(end + self.hop, self.n - self.window + 1), self.hop):
            part = u[:, s - at : s - at + self.window]
            w = S.cleaned(np.abs(part @ part.conj().T) / self.window)
            if before is not None:  # the change to the next window, which may start in the next block
                rows.append(("change", band, None, None, float(S.transitions([before, w])[0]), 0.0, 1.0))
            if s < end:
                rows.append(("window", band, None, None, S.graph_metrics(w)["degree_cv"], 0.0, 1.0))
            before = w
        return rows


def _checked(signals: DataFrame) -> DataFrame:
    """By run: n, sfreq, channels, and an error where a run cannot be read."""
    bad = F.coalesce(F.exists("samples", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    size = F.size("samples")
    runs = signals.groupBy(*KEYS).agg(F.min(size).alias("n"), F.max(size).alias("longest"), F.max("sfreq").alias("sfreq"), F.min("sfreq").alias("least"), F.count(F.lit(1)).alias("channels"), F.count_distinct("ch_idx").alias("places"), F.max(bad).alias("bad"))
    error = F.when((F.col("n") != F.col("longest")) | (F.col("n") < 1), "channels differ in length").when(F.col("bad"), "samples are not finite").when(F.col("sfreq").isNull() | (F.col("sfreq") != F.col("least")) | (F.col("sfreq") <= 0), "channels differ in rate").when(F.col("places") < F.col("channels"), "a channel stands twice")
    return runs.select(*KEYS, F.col("n").cast("long").alias("n"), "sfreq", error.alias("error"))


def cut(signals: DataFrame, seconds: float) -> DataFrame:
    """Rows (subject, run, ch_idx, sfreq, samples) of whole channels as blocks: the same with ``start``, the place of the first sample."""
    size = F.greatest(F.lit(1), F.round(F.col("sfreq") * seconds).cast("int"))
    starts = F.sequence(F.lit(0), F.size("samples") - 1, size)
    return signals.where(F.size("samples") > 0).select(*KEYS, "ch_idx", "sfreq", "samples", F.explode(starts).alias("start")).select(*KEYS, "ch_idx", "sfreq", F.col("start").cast("long").alias("start"), F.slice("samples", F.col("start") + 1, size).alias("samples"))


def partial_sums(blocks: DataFrame, runs: DataFrame, seconds: float, notch: float | None = 60.0, window_s: float = 10.0, step_s: float = 5.0) -> DataFrame:
    """The partial sums of all blocks: subject, run, and ``PARTS``.

    ``blocks`` may be cut as their source likes; they are dealt anew to blocks
    of about ``seconds``, each with its halo. ``runs`` has n and sfreq.
    """

    def plan(n: int, sfreq: float) -> Plan:
        return Plan(int(n), float(sfreq), notch, round(window_s * sfreq), max(1, round(step_s * sfreq)))

    @F.pandas_udf("size long, before long, after long")
    def layout(n: pd.Series, sfreq: pd.Series) -> pd.DataFrame:
        """Blocks are no shorter than the halo before them, and the last one takes the rest."""
        out = []
        for count, rate in zip(n, sfreq, strict=True):
            before, after = plan(count, rate).halo
            out.append((min(max(round(seconds * rate), before, 1), max(int(count), 1)), before, after))
        return pd.DataFrame(out, columns=["size", "before", "after"])

    sized = runs.where("error is null").select(*KEYS, "n", layout("n", "sfreq").alias("l")).select(*KEYS, "n", "l.*")
    rows = blocks.join(sized, KEYS)
    last = F.greatest(F.expr("n div size") - 1, F.lit(0))  # the number of the last block
    end = F.col("start") + F.size("samples")
    low = F.greatest(F.lit(0), F.floor((F.col("start") - F.col("after")) / F.col("size")))
    high = F.least(last, F.floor((end - 1 + F.col("before")) / F.col("size")))
    rows = rows.where(end > F.col("start")).withColumn("block", F.explode(F.sequence(F.least(low, last), high)))
    begin, stop = F.col("block") * F.col("size"), F.when(F.col("block") == last, F.col("n")).otherwise((F.col("block") + 1) * F.col("size"))
    a = F.greatest(F.col("start"), begin - F.col("before"))
    b = F.least(end, stop + F.col("after"))
    rows = rows.where(a < b).select(*KEYS, "block", "ch_idx", "sfreq", "n", begin.alias("begin"), stop.alias("stop"), a.alias("start"), F.slice("samples", (a - F.col("start") + 1).cast("int"), (b - a).cast("int")).alias("samples"))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ch_idx", "start"])
        one = pdf.iloc[0]
        x = np.stack([np.concatenate(g.to_list()) for _, g in pdf.groupby("ch_idx")["samples"]]).astype(float)
        found = plan(one["n"], one["sfreq"]).parts(x, int(one["start"]), int(one["begin"]), int(one["stop"]))
        out = pd.DataFrame(found, columns=[c.split()[0] for c in PARTS.split(", ")])
        out.insert(0, "subject", key[0])
        out.insert(1, "run", key[1])
        return out

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a block is small and its work is not: tasks are not merged by size
    return rows.repartition(tasks, *KEYS, "block").groupBy(*KEYS, "block").applyInPandas(work, f"subject string, run string, {PARTS}")


def summed(parts: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a run: its features from partial sums. What a run gathers is its channels' densities and its graphs, whatever its length."""
    square = F.sum(F.when(F.col("kind").isin("change", "window"), F.col("x") * F.col("x"))).alias("square")
    moments = parts.groupBy(*KEYS, "kind", "band", "a", "b").agg(*[F.sum(c).alias(c) for c in ("x", "y", "n")], square)
    moments = moments.join(runs.select(*KEYS, F.least("n", F.lit(SEGMENT)).alias("size"), "sfreq"), KEYS)

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = {}
        d = pdf[pdf["kind"] == "density"].sort_values(["a", "b"])
        if len(d):
            psd = (d["x"] / d["n"]).to_numpy().reshape(d["a"].nunique(), -1)
            size, sfreq = d["size"].iloc[0], d["sfreq"].iloc[0]
            power = S.band_powers(np.fft.rfftfreq(int(size), 1 / sfreq)[np.sort(d["b"].unique()).astype(int)], psd)
            row = {p: power[p] for p in POWERS} | {"spectral_entropy_mean": float(S.spectral_entropy(psd).mean())}
        for band in NETWORK_BANDS:
            own = pdf[pdf["band"] == band]
            e = own[own["kind"] == "edge"]
            count = int(e["b"].max()) + 1 if len(e) else 1
            w = np.zeros((count, count))
            w[e["a"].to_numpy(int), e["b"].to_numpy(int)] = np.hypot(e["x"], e["y"]) / e["n"]
            w = w + w.T
            edge = S.cleaned(w)[np.triu_indices(count, 1)]
            got = {"plv_mean": float(edge.mean()) if len(edge) else math.nan, "plv_median": float(np.median(edge)) if len(edge) else math.nan} | S.graph_metrics(w)
            for kind, names in (("change", ("mean_delta", "cv_delta")), ("window", ("mean_degree_cv", "temporal_cv_degree_cv"))):
                m = own[own["kind"] == kind]
                mean, spread = math.nan, math.nan
                if len(m):
                    mean = m["x"].iloc[0] / m["n"].iloc[0]
                    spread = math.sqrt(max(m["square"].iloc[0] / m["n"].iloc[0] - mean * mean, 0.0))
                got |= dict(zip(names, (mean, spread / ((mean if kind == "change" else abs(mean)) + EPS)), strict=True))
            row |= {f"{m}_{band}": v for m, v in got.items()}
        return pd.DataFrame([[*key, *[row.get(c) for c in RUN_COLUMNS]]], columns=[*KEYS, *RUN_COLUMNS])

    return moments.groupBy(*KEYS).applyInPandas(finish, "subject string, run string, " + ", ".join(f"{c} double" for c in RUN_COLUMNS))


def run_features(signals: DataFrame, seconds: float = 60.0, notch: float | None = 60.0, window_s: float = 10.0, step_s: float = 5.0, blocks: DataFrame | None = None) -> DataFrame:
    """One row a subject and run: status, error and the features of ``extract.extract_runs`` (null after an error).

    ``signals`` has whole channels; ``blocks``, where given, has the samples
    instead (see ``cut``), and ``signals`` only n and sfreq by run, as
    ``_checked`` gives them. Null and non-finite samples, unequal lengths or
    rates and repeated channels are errors of a run, as in ``extract``. The
    variance of window measures comes from sums of squares.
    """
    runs = signals if blocks is not None else _checked(signals)
    found = summed(partial_sums(blocks if blocks is not None else cut(signals, seconds), runs, seconds, notch, window_s, step_s), runs)
    status = F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status")
    return runs.select(*KEYS, status, "error").join(found, KEYS, "left").select(*KEYS, "status", "error", *RUN_COLUMNS)

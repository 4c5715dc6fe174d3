"""NumPy kernels for one recording (channels times samples), used inside grouped Arrow tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .contract import BANDS, EPS


def poles_of(low: float, high: float, sfreq: float, order: int = 4) -> tuple[np.ndarray, float]:
    """Poles and gain of a Butterworth band-pass by the bilinear transform; its zeros are ``order`` times 1 and -1."""
    nyq = sfreq / 2
    warp = 2 * sfreq * np.tan(np.pi * np.array([low, min(high, 0.999 * nyq)]) / sfreq)
    width, center = warp[1] - warp[0], math.sqrt(warp[0] * warp[1])
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half**2 - center**2)
    poles = np.concatenate([half + root, half - root])
    fs2 = 2 * sfreq
    return (fs2 + poles) / (fs2 - poles), width**order * float(np.real(fs2**order / np.prod(fs2 - poles)))


def butterworth(low: float, high: float, sfreq: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Band-pass coefficients (b, a)."""
    poles, gain = poles_of(low, high, sfreq, order)
    return gain * np.real(np.poly(np.concatenate([np.ones(order), -np.ones(order)]))), np.real(np.poly(poles))


@dataclass(frozen=True)
class System:
    """A linear filter: state' = a state + b x, y = c state + d x."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    def settled(self) -> np.ndarray:
        """The state of a constant input of 1."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)

    def run(self, x: np.ndarray, state: np.ndarray, block: int = 64) -> np.ndarray:
        """Filters rows of x from a state for each. Inside a block output and next state are products with powers of ``a``; only the states between blocks follow one another."""
        n, count = x.shape[1], len(self.b)
        powers = [np.eye(count)]
        for _ in range(block):
            powers.append(powers[-1] @ self.a)
        seen = np.array([self.c @ p for p in powers[:block]])  # of the state, at each place of a block
        into = np.array([p @ self.b for p in powers[:block]])[::-1]  # of each place, in the next state
        answer = np.concatenate([[self.d], (np.array([p @ self.b for p in powers[: block - 1]]) @ self.c)])
        lag = np.subtract.outer(np.arange(block), np.arange(block))
        within = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)
        parts = np.pad(x, ((0, 0), (0, -n % block))).reshape(len(x), -1, block)
        add = parts @ into
        states = np.empty_like(add)
        step = powers[block].T
        for k in range(add.shape[1]):
            states[:, k] = state
            state = state @ step + add[:, k]
        return (parts @ within.T + states @ seen.T).reshape(len(x), -1)[:, :n]


@lru_cache(maxsize=64)
def band_system(low: float, high: float, sfreq: float, order: int = 4) -> System:
    """The band-pass as a chain of second-order sections in one state; a chain keeps close poles apart, so powers of its matrix stay exact."""
    poles, gain = poles_of(low, high, sfreq, order)
    upper, real = poles[poles.imag > 1e-12], np.sort(poles[np.abs(poles.imag) <= 1e-12].real)
    pairs = [(2 * p.real, abs(p) ** 2) for p in upper[np.argsort(np.abs(upper))]] + [(u + v, u * v) for u, v in zip(real[::2], real[1::2], strict=True)]
    n = 2 * len(pairs)
    rows, signal = np.zeros((n, n + 1)), np.eye(n + 1)[n]  # linear in the states and, last, the input
    each = gain ** (1 / len(pairs))
    for k, (total, product) in enumerate(pairs):
        first, second = np.eye(n + 1)[2 * k], np.eye(n + 1)[2 * k + 1]
        out = each * signal + first  # the section's zeros are 1 and -1
        rows[2 * k] = second + total * out
        rows[2 * k + 1] = -each * signal - product * out
        signal = out
    return System(rows[:, :n], rows[:, n], signal[:n], float(signal[n]))


def settle(low: float, high: float, sfreq: float, order: int = 4, left: float = 1e-14) -> int:
    """Samples after which less than a share of any start remains in the band-pass."""
    system, n = band_system(low, high, sfreq, order), 64
    step = np.linalg.matrix_power(system.a, n)
    power = step
    while np.abs(power).max() > left:
        power, n = power @ step, n + 64
    return n


def both_ways(x: np.ndarray, low: float, high: float, sfreq: float, order: int = 4, first: bool = True, last: bool = True) -> np.ndarray:
    """The band-pass forward and backward. Ends of the recording are extended oddly and start from steady state; at other ends the transient stays in the result."""
    system = band_system(low, high, sfreq, order)
    pad = min(3 * (2 * order + 1), x.shape[1] - 1)
    head = [2 * x[:, :1] - x[:, pad:0:-1]] if first else []
    tail = [2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]] if last else []
    y = np.concatenate([*head, x, *tail], axis=1)
    y = system.run(y, y[:, :1] * system.settled())[:, ::-1]
    y = system.run(y, y[:, :1] * system.settled())[:, ::-1]
    return y[:, pad * first : pad * first + x.shape[1]]


def band_pass(x: np.ndarray, low: float, high: float, sfreq: float, order: int = 4) -> np.ndarray:
    """Zero phase: forward and backward over an odd extension, from steady state."""
    return both_ways(x, low, high, sfreq, order)


def taps_of(low: float, sfreq: float, n: int) -> int:
    """Length of the FIR filter of a recording of n samples."""
    return min(int(3.3 * sfreq / max(min(low, 2.0), 0.5)) | 1, (n - 1) | 1)


def fir(x: np.ndarray, low: float, high: float, sfreq: float, stop: bool = False, taps: int | None = None, first: bool = True, last: bool = True) -> np.ndarray:
    """Zero-phase windowed-sinc band-pass, or band-stop, with ends of the recording reflected; at other ends half the filter is lost."""
    taps = taps or taps_of(low, sfreq, x.shape[1])
    t = np.arange(taps) - taps // 2
    kernel = (2 * high / sfreq * np.sinc(2 * high * t / sfreq) - 2 * low / sfreq * np.sinc(2 * low * t / sfreq)) * np.hamming(taps)
    if stop:
        kernel = -kernel
        kernel[taps // 2] += 1
    return convolved(x, kernel, [2 * x[:, :1] - x[:, taps // 2 : 0 : -1]] if first else [], [2 * x[:, -1:] - x[:, -2 : -(taps // 2) - 2 : -1]] if last else [])


def convolved(x: np.ndarray, kernel: np.ndarray, head: list[np.ndarray], tail: list[np.ndarray]) -> np.ndarray:
    """Where an odd kernel lies within head, x and tail."""
    pad = len(kernel) // 2
    if not pad:
        return x * kernel[0]
    ext = np.concatenate([*head, x, *tail], axis=1)
    size = 1 << (ext.shape[1] + len(kernel) - 2).bit_length()
    y = np.fft.irfft(np.fft.rfft(ext, size) * np.fft.rfft(kernel, size), size)
    return y[:, 2 * pad : ext.shape[1]]


def preprocess(x: np.ndarray, sfreq: float, low: float = 1.0, high: float = 45.0, notch: float | None = 60.0) -> np.ndarray:
    """Notch, band-pass, then the average reference."""
    if notch and notch + 1 < sfreq / 2:
        x = fir(x, notch - 1, notch + 1, sfreq, stop=True)
    x = fir(x, low, min(high, 0.49 * sfreq), sfreq)
    return x - x.mean(axis=0)


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def cleaned(w: np.ndarray) -> np.ndarray:
    """Symmetric, within 0 and 1, nothing on the diagonal."""
    w = np.clip((w + w.T) / 2, 0, 1)
    np.fill_diagonal(w, 0)
    return w


def phase_locking(x: np.ndarray, clean: bool = True) -> np.ndarray:
    """|mean exp(i difference of phases)| for all pairs, as one product."""
    u = np.exp(1j * np.angle(analytic(x)))
    w = np.abs(u @ u.conj().T) / x.shape[1]
    return cleaned(w) if clean else w


def welch(x: np.ndarray, sfreq: float, size: int = 2048, overlap: float = 0.0, window: str = "hamming", detrend: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided density, averaged over segments."""
    size = min(size, x.shape[1])
    step = max(1, int(size * (1 - overlap)))
    w = np.hamming(size) if window == "hamming" else np.hanning(size + 1)[:-1]
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::step]
    if detrend:
        parts = parts - parts.mean(axis=2, keepdims=True)
    p = (np.abs(np.fft.rfft(parts * w)) ** 2).mean(axis=1) / (sfreq * (w**2).sum())
    p[:, 1 : (size + 1) // 2] *= 2
    return np.fft.rfftfreq(size, 1 / sfreq), p


def coherence(x: np.ndarray, sfreq: float, low: float, high: float, size: int = 256) -> np.ndarray:
    """Magnitude-squared coherence averaged over a closed band; half-overlapping Hann segments."""
    size = min(size, x.shape[1])
    w = np.hanning(size + 1)[:-1]
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, :: max(1, size // 2)]
    f = np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * w)
    cross = np.einsum("ask,bsk->abk", f, f.conj()) / f.shape[1]
    power = np.real(np.einsum("aak->ak", cross))
    c = np.abs(cross) ** 2 / np.maximum(power[:, None] * power[None], 1e-300)
    hz = np.fft.rfftfreq(size, 1 / sfreq)
    return cleaned(c[:, :, (hz >= low) & (hz <= high)].mean(axis=2))


def band_integrals(hz: np.ndarray, psd: np.ndarray) -> np.ndarray:
    """Channels times bands: trapezoids over the points of each half-open band, all bands by one product."""
    edges = np.array(list(BANDS.values()))
    inside = (hz >= edges[:, :1]) & (hz < edges[:, 1:])
    both = inside[:, 1:] & inside[:, :-1]  # a step counts for a band that holds its two ends
    weight = np.zeros(inside.shape)
    half = both * np.diff(hz) / 2
    weight[:, 1:] += half
    weight[:, :-1] += half
    return psd @ weight.T


def band_powers(hz: np.ndarray, psd: np.ndarray) -> dict[str, float]:
    """Mean power of each band over channels, its share of all bands, and log ratios."""
    power = dict(zip(BANDS, band_integrals(hz, psd).mean(axis=0).tolist(), strict=True))
    whole = math.fsum(power.values()) + EPS
    log_ratio = lambda a, b: math.log(power[a] + EPS) - math.log(power[b] + EPS)
    pairs = (("theta", "alpha"), ("theta", "beta"), ("alpha", "beta"))
    return {f"{b}_abs": p for b, p in power.items()} | {f"{b}_rel": p / whole for b, p in power.items()} | {f"log_{a}_{b}": log_ratio(a, b) for a, b in pairs}


def spectral_entropy(psd: np.ndarray) -> np.ndarray:
    """By channel, scaled to 1 for a flat spectrum."""
    p = np.maximum(psd, 1e-20)
    p = p / p.sum(axis=1, keepdims=True)
    return -(p * np.log(p)).sum(axis=1) / math.log(psd.shape[1])


def permutation_entropies(x: np.ndarray, order: int = 3, delay: int = 1) -> np.ndarray:
    """Of rows of equal length: the entropy of the patterns of ``order`` samples, in shares of the most that it can be; NaN without ``order`` * ``delay`` samples."""
    if x.shape[1] < order * delay:
        return np.full(len(x), math.nan)
    parts = np.lib.stride_tricks.sliding_window_view(x, (order - 1) * delay + 1, axis=1)[:, :, ::delay]
    code = np.argsort(parts, axis=2, kind="stable") @ order ** np.arange(order)
    most = order**order
    p = np.bincount((code + most * np.arange(len(x))[:, None]).ravel(), minlength=most * len(x)).reshape(len(x), -1) / code.shape[1]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1) / math.log2(math.factorial(order))


def permutation_entropy(x: np.ndarray, order: int = 3, delay: int = 1) -> float:
    """``permutation_entropies`` of one series."""
    return float(permutation_entropies(x[None], order, delay)[0])


def sample_entropies(x: np.ndarray, m: int = 2, r: float | None = None, cells: int = 1 << 20) -> np.ndarray:
    """Of rows of equal length: templates within a tolerance r (Chebyshev; 0.2 deviations by default), without self matches; NaN without matches or for m + 1 samples or fewer.

    Rows are compared together in parts of about ``cells`` distances.
    """
    n = x.shape[1]
    if n <= m + 1:
        return np.full(len(x), math.nan)
    tol = 0.2 * x.std(axis=1) if r is None else np.full(len(x), r)

    def matches(k: int) -> np.ndarray:
        count = n - k
        t = np.lib.stride_tricks.sliding_window_view(x, k, axis=1)[:, :count]
        found = np.zeros(len(x), np.int64)
        rows = max(1, cells // (count * min(count, 512)))
        for i in range(0, len(x), rows):
            part, limit = t[i : i + rows], tol[i : i + rows, None, None]
            for j in range(0, count, 512):
                near = np.ones((len(part), min(512, count - j), count), bool)
                for d in range(k):
                    near &= np.abs(part[:, j : j + 512, None, d] - part[:, None, :, d]) <= limit
                found[i : i + rows] += near.sum(axis=(1, 2))
        return found - count

    b, a = matches(m), matches(m + 1)
    fine = (a > 0) & (b > 0)
    return np.where(fine, -np.log(np.where(fine, a, 1) / np.where(fine, b, 1)), math.nan)


def sample_entropy(x: np.ndarray, m: int = 2, r: float | None = None) -> float:
    """``sample_entropies`` of one series."""
    return float(sample_entropies(x[None], m, r)[0])


def complexity(x: np.ndarray) -> dict[str, float]:
    """Permutation and sample entropy, means over channels that have one."""
    each = {"permutation_entropy": permutation_entropies(x), "sample_entropy": sample_entropies(x)}
    return {k: float(np.nanmean(v)) if np.isfinite(v).any() else math.nan for k, v in each.items()}


def peaks(hz: np.ndarray, density: np.ndarray, low: float, high: float, k: int = 3) -> list[tuple[float, float]]:
    """The k largest points of a spectrum in a closed band, as (frequency, density); the lower frequency first on ties."""
    at = np.flatnonzero((hz >= low) & (hz <= high))
    return [(float(hz[i]), float(density[i])) for i in at[np.lexsort((hz[at], -density[at]))][:k]]


def recording_quality(x: np.ndarray, sfreq: float) -> dict[str, float]:
    """Amplitude, spread and mains noise of a recording; one below 0.01 throughout is taken for volts and counted in microvolts."""
    if np.abs(x).max(initial=0) < 1e-2:
        x = x * 1e6
    hz, psd = welch(x, sfreq)
    mean = psd.mean(axis=0)
    power = lambda a, b: float(np.trapezoid(mean[(hz >= a) & (hz <= b)], hz[(hz >= a) & (hz <= b)]))
    around = power(55.0, 65.0)
    return {
        "n_channels": float(len(x)),
        "duration_s": (x.shape[1] - 1) / sfreq,
        "mean_abs_uv": float(np.abs(x).mean()),
        "std_mean_uv": float(x.std(axis=1).mean()),
        "line_ratio": power(58.0, 62.0) / around if around > 0 else math.nan,
    }


def pick(x: np.ndarray, names: list[str], wanted: list[str]) -> np.ndarray:
    """Channels in a fixed order; KeyError names those that are missing."""
    at = {n.strip().upper(): i for i, n in enumerate(names)}
    if missing := [w for w in wanted if w.upper() not in at]:
        raise KeyError(f"missing channels: {missing}")
    return x[[at[w.upper()] for w in wanted]]


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """Fourier resampling to n samples."""
    old = x.shape[1]
    f = np.fft.rfft(x)
    keep = min(n, old)
    out = np.zeros((x.shape[0], n // 2 + 1), complex)
    out[:, : keep // 2 + 1] = f[:, : keep // 2 + 1]
    if keep % 2 == 0 and n != old:
        out[:, keep // 2] *= 2 if n < old else 0.5
    return np.fft.irfft(out, n) * (n / old)


def windows(n: int, sfreq: float, length: float = 10.0, step: float = 5.0) -> list[tuple[int, int]]:
    """Complete windows in samples."""
    size, hop = round(length * sfreq), max(1, round(step * sfreq))
    return [(s, s + size) for s in range(0, n - size + 1, hop)]


def threshold(w: np.ndarray, density: float) -> np.ndarray:
    """Keeps the share of strongest edges; equal ones at the limit stay."""
    if not 0 < density <= 1:
        raise ValueError("density lies in (0, 1]")
    w = cleaned(w)
    edges = np.sort(w[np.triu_indices(len(w), 1)])[::-1]
    return np.where(w >= edges[max(1, int(len(edges) * density)) - 1], w, 0.0) if len(edges) else w


def shortest_paths(w: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        d = np.where(w > 0, 1 / w, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        np.minimum(d, d[:, k : k + 1] + d[k], out=d)
    return d


def graph_metrics(w: np.ndarray) -> dict[str, float]:
    """Strength, clustering, efficiency, path length and Laplacian spectrum; paths are found once."""
    w = cleaned(w)
    n = len(w)
    strength = w.sum(axis=1)
    cube = np.cbrt(w)
    degree = (w > 0).sum(axis=1)
    possible = np.where(degree > 1, degree * (degree - 1.0), np.nan)
    local = np.diag(cube @ cube @ cube) / possible
    d = shortest_paths(w)
    real = (d > 0) & np.isfinite(d)
    value = np.maximum(np.linalg.eigvalsh(np.diag(strength) - w), 0)
    p = value / value.sum() if value.sum() > 0 else np.zeros(n)
    p = p[p > EPS]
    return {
        "mean_degree": float(strength.mean()),
        "degree_cv": float(strength.std() / (strength.mean() + EPS)),
        "clustering": float(np.nanmean(local)) if np.isfinite(local).any() else math.nan,
        "global_efficiency": float((1 / d[real]).sum() / (n * (n - 1))) if n > 1 else math.nan,
        "mean_path_length": float(d[real & (d < 1e6)].mean()) if (real & (d < 1e6)).any() else math.nan,
        "lambda2": float(value[1]) if n > 1 else math.nan,
        "laplacian_entropy": float(-(p * np.log(p)).sum()),
    }


def transitions(series: list[np.ndarray]) -> np.ndarray:
    """Relative Frobenius change from each matrix to the next."""
    return np.array([np.linalg.norm(b - a) / (np.linalg.norm(a) + EPS) for a, b in zip(series, series[1:], strict=False)])


def transition_summary(delta: np.ndarray) -> dict[str, float]:
    """Moments of a series of changes, and the entropy of their histogram."""
    names = ("mean_delta", "std_delta", "cv_delta", "max_delta", "temporal_entropy")
    n = len(delta)
    if not n:
        return {"n_transitions": 0.0, **dict.fromkeys(names, math.nan)}
    center, spread = float(delta.mean()), float(delta.std())
    share = np.histogram(delta, bins=min(8, max(3, n // 2)))[0] / n
    entropy = float(np.where(share > 0, -share * np.log(share + EPS), 0.0).sum())
    return {"n_transitions": float(n), **dict(zip(names, (center, spread, spread / (center + EPS), float(delta.max()), entropy), strict=True))}


def trajectories(series: list[np.ndarray]) -> dict[str, float]:
    """Each graph metric over a series of matrices: mean, deviation and their ratio, without windows where it is not defined."""
    rows = [graph_metrics(w) for w in series]
    out = {}
    for name in rows[0] if rows else graph_metrics(np.zeros((3, 3))):
        v = np.array([r[name] for r in rows], float)
        v = v[np.isfinite(v)]
        mean, spread = (float(v.mean()), float(v.std())) if len(v) else (math.nan, math.nan)
        out |= {f"{name}_mean": mean, f"{name}_std": spread, f"{name}_cv": spread / (abs(mean) + EPS)}
    return out


def density_regimes(w: np.ndarray, densities: tuple[float, ...] = (1.0, 0.1, 0.2, 0.3)) -> list[dict[str, float]]:
    """Metrics of a graph at several densities, with the edges that are left and their share."""
    out = []
    for d in densities:
        kept = threshold(w, d)
        edges = int((kept[np.triu_indices(len(kept), 1)] > 0).sum())
        out.append({"density": d, "edges": float(edges), "share": edges / max(1, len(kept) * (len(kept) - 1) // 2)} | graph_metrics(kept))
    return out

"""Hashes of words and of word shingles, for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
LONG = 64  # bytes from which a word is hashed by itself
_rng = np.random.Generator(np.random.PCG64(20240607))
_MIX = _rng.integers(1, 2**63, WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIZE = _rng.integers(1, 2**63, LONG + 1, dtype=np.uint64)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_TAKE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
PAD = bytes(8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(data: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 0 to 8 bytes of each range as one little-endian integer; 8 bytes of padding stand behind the last range."""
    view = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    return view[at] & _TAKE[np.clip(size, 0, 8)]


def range_hashes(data: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of ``data``, which ends in ``PAD``.

    Eight bytes at a time go through ``mix``, which is no polynomial: for those,
    strings that clash whatever the base are known (Thue and Morse). A range of
    more than ``LONG`` bytes goes to the xxhash library.
    """
    size = last - first
    if not len(size):
        return np.empty(0, np.uint64)
    h = mix(chunks(data, first, size) ^ _SIZE[np.minimum(size, LONG)])
    for k in range(8, LONG, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        h[more] = mix(h[more] * _MIX[0] ^ chunks(data, first[more] + k, size[more] - k))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[first[i] : last[i]])
    return h


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the number of words of each text; words are runs of anything but ASCII white space."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join([*raw, b""]).translate(LOWER) + PAD
    data = np.frombuffer(joined, np.uint8)[: -len(PAD)]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[::2], edge[1::2]
    ends = np.cumsum([len(r) + 1 for r in raw])
    return range_hashes(joined, first, last), np.diff(np.searchsorted(first, ends), prepend=0)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's five-word shingles; with fewer words its whole sequence is one; no words: none."""
    words, count = word_hashes(texts)
    whole = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for j in range(WIDTH):
        whole += words[j : len(whole) + j] * _MIX[j]
    whole = mix(whole)
    out, at = [], 0
    for n in count.tolist():
        if n >= WIDTH:
            s = np.sort(whole[at : at + n - WIDTH + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif n:
            out.append(mix((words[at : at + n] * _MIX[:n]).sum(dtype=np.uint64, keepdims=True) + n * _MIX[WIDTH:]))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out

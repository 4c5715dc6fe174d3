"""Parity-sketch join of documents by the Jaccard similarity of shingle sets.

Let two sets of sizes a <= b have similarity 3/4 or more. Then a >= 3b/4 and at
most (a + b) / 7 shingles lie in one set only. Each set is cut into parts by
the first bits of its shingles' hashes, as many for all sets of a size band,
and the hashes of a part are xor-ed into one signature. A shingle in one set
only changes one part's signature, so the others agree: with n non-empty parts
and at most d differences, any d + 1 of a set's signatures hold an agreeing one
(pigeonhole). Both sides take their d + 1 rarest ones over the corpus, so
signatures of common passages are left out whenever the bound allows it, which
loses no pair. Below 32 shingles every shingle is its own part.

Documents that share such a signature are candidates. Parity bit sketches,
whose Hamming distance is at most the symmetric difference, reject most of
them, and the rest is verified on whole shingle sets. First each signature's
members meet their smallest one, the hub; then only members whose components
still differ meet each other, in blocks of a hub's members. A block yields
links between its components only, so all links between different texts count,
but neither pairs nor copies are multiplied out.

Signatures travel packed: one row for each pair of tasks, not one a signature.
The frequencies of very common ones are estimated beforehand on a sample of
texts, only so that their counting does not fill one task: both sides of a pair
rank them alike, and any ranking finds all pairs. Nodes are texts: rows with
equal text share the 64-bit hash of it; texts whose hashes clash are told apart
by a second hash. Shingles are compared by 64-bit hashes; two that differ agree
by chance once in 2**64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, shuffle_partitions, slices, spread_join, trimmed
from .shingles import mix, shingle_sets

SMALL = 32  # shingles from which sets are cut into parts
FLUSH = 500_000  # signatures that a task holds before it sends them
BLOCK = 256  # members of a hub compared at once
SAMPLE = 32  # one in so many texts is sampled for common signatures
COMMON = 64  # sampled texts with a signature that make it common; no more than MOST_COMMON are
MOST_COMMON = 8192
MOST_CLASHES = 1_000_000  # hashes shared by different texts: about (texts / 2**32)**2 / 2
_LOW40 = np.uint64((1 << 40) - 1)


def band_of(n: np.ndarray) -> np.ndarray:
    """The octave of a set's size; 0 for all small ones."""
    n = np.asarray(n)
    return np.where(n < SMALL, 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64))


def part_bits(band: np.ndarray) -> np.ndarray:
    """Bits of a part's number: about as many parts as shingles, twice as many for the smallest bands."""
    return np.where(band == 0, 64, band + (band < 7))


def most_differences(n: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Shingles in one set only, at most, against any partner of similarity 3/4 that meets it in the band of the smaller set."""
    n = np.asarray(n)
    own = band_of(n) == band
    top = np.where(band == 0, SMALL - 1, (2 << band) - 1)
    partner = np.where(own, 4 * n // 3, np.minimum(n, top))
    return (n + partner) // 7


def signatures(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For one or two bands a set: (set number, slack) of each record, and (record, signature) of each non-empty part.

    Slack is the number of signatures that a record may leave out.
    """
    n = np.array([len(s) for s in sets])
    own = band_of(n)
    lower = band_of(-(-3 * n // 4))
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    for band, chosen in ((own, n > 0), (lower, (n > 0) & (lower != own))):
        which = np.flatnonzero(chosen)
        if not len(which):
            continue
        size, b = n[which], band[which]
        value = every[np.repeat(chosen, n)]
        record = np.repeat(np.arange(len(which)), size)
        part = value >> np.repeat((64 - part_bits(b)).astype(np.uint64), size)
        new = np.ones(len(value), bool)
        new[1:] = (record[1:] != record[:-1]) | (part[1:] != part[:-1])
        start = np.flatnonzero(new)
        record = record[start]
        xor = np.bitwise_xor.reduceat(value, start)
        sig = mix(xor + mix(part[start] + np.uint64(1)) * np.uint64(3) + b[record].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        slack = np.bincount(record, minlength=len(which)) - most_differences(size, b) - 1
        yield which, np.maximum(slack, 0), record, sig


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits: bit i is the parity of the shingles whose first bits are i. Two to four bits a shingle, 256 at least."""
    bits = max(8, len(s).bit_length() + 1)
    parity = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<u8")


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bits from one of more: neighbouring bits are xor-ed."""
    while len(bits) > words:
        pairs = np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(-1, 2)
        bits = np.packbits(pairs[:, 0] ^ pairs[:, 1], bitorder="little").view("<u8")
    return bits


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= 75 * (len(both) - same)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _u40(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_u40(data: bytes, at: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8, 5 * n, at).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _rows(lanes: list[int], kinds: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lane": pa.array(lanes, pa.int32()), "kind": pa.array(kinds, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _many(found: list[tuple[int, bytes]], kind: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(found), 64):
        part = found[i : i + 64]
        yield _rows([x for x, _ in part], [kind] * len(part), [x for _, x in part])


def _to_lanes(keys: np.ndarray, lanes: int) -> list[tuple[int, np.ndarray]]:
    """Places of the keys by the lane of their text."""
    to = (keys % np.uint64(lanes)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return [(int(to[g[0]]), g) for g in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(g)]


PACKED = "lane int, kind int, blob binary"
SIGS, SIZES, READY = 0, 1, 2
TOP = 2**63 - 1  # stands for a null id
FULL = 1 << 63  # in place of a lane: names of 64 bits follow


def _send(keys: np.ndarray, slack: np.ndarray, record: np.ndarray, sig: np.ndarray, lanes: int) -> Iterator[tuple[int, bytes]]:
    """Packs signatures by lane: records with their key, slack (its highest bit: the second band) and count, then 40 bits a signature."""
    lane = ((sig >> np.uint64(40)) % np.uint64(lanes)).astype(np.uint32)
    order = np.argsort(lane.astype(np.uint16) if lanes <= 1 << 16 else lane, kind="stable")
    lane, record, sig = lane[order], record[order], sig[order]
    cut = np.flatnonzero(np.diff(lane)) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(lane)], strict=True):
        if i == j:
            continue
        rec, first, count = np.unique(record[i:j], return_index=True, return_counts=True)  # records come in order
        head = np.array([len(rec), j - i], "<u8").tobytes()
        yield int(lane[i]), head + keys[rec].astype("<u8").tobytes() + slack[rec].astype("<u4").tobytes() + count.astype("<u4").tobytes() + _u40(sig[i:j])


def _receive(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, slacks, sigs = [], [], []
    for b in blobs:
        n, m = np.frombuffer(b, "<u8", 2).tolist()
        count = np.frombuffer(b, "<u4", n, 16 + 12 * n)
        keys.append(np.repeat(np.frombuffer(b, "<u8", n, 16), count))
        slacks.append(np.repeat(np.frombuffer(b, "<u4", n, 16 + 8 * n), count))
        sigs.append(_from_u40(b, 16 + 16 * n, m))
    return np.concatenate(keys), np.concatenate(slacks), np.concatenate(sigs)


def _names(sig: np.ndarray, lanes: int) -> np.ndarray:
    """What tells signatures apart: the lane where they are counted, and 40 bits."""
    return (sig >> np.uint64(40)) % np.uint64(lanes) << np.uint64(40) | sig & _LOW40


def _common_signatures(texts: DataFrame, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of signatures that many sampled texts have, and how many texts have them, about."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            sig, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield pa.RecordBatch.from_pydict({"sig": pa.array(sig.view(np.int64)), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            for part, texts in slices(batch, "t"):
                fresh = []
                for i, k in enumerate(part.column(0).to_pylist()):
                    if k not in seen:
                        seen.add(k)
                        fresh.append(texts[i])
                held += [_names(sig, lanes) for _, _, _, sig in signatures(shingle_sets(fresh))]
                if sum(map(len, held)) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    chosen = texts.where(F.pmod("key", F.lit(SAMPLE)) == 0).select("key", "t").mapInArrow(trimmed(run), "sig long, n long")
    found = chosen.groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "sig").limit(MOST_COMMON).collect()
    sig, n = np.array([r["sig"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(sig)
    return sig[order], np.minimum(n[order] * SAMPLE, 2**32 - 1).astype("<u4")


def _sign(lanes: int, shared):
    """Signatures to their lanes, and set sizes to their texts' lanes. Common signatures go to their texts' lanes at once, with their frequency."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        common: list[tuple[np.ndarray, ...]] = []
        n = records = 0
        known, often = shared.value

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, common, n, records
            if held:
                yield from _many(list(_send(*(np.concatenate(x) for x in zip(*held, strict=True)), lanes)), SIGS)
            if common:
                key, slack, freq, name = (np.concatenate(x) for x in zip(*common, strict=True))
                yield from _many([(lane, np.array([len(g), FULL], "<u8").tobytes() + key[g].tobytes() + slack[g].tobytes() + freq[g].tobytes() + name[g].tobytes()) for lane, g in _to_lanes(key, lanes)], READY)
            held, common, n, records = [], [], 0, 0

        for batch in batches:
            for part, texts in slices(batch, "t"):
                fresh = []
                for i, k in enumerate(part.column(0).to_pylist()):
                    if k not in seen:  # one of a task's equal texts is enough
                        seen.add(k)
                        fresh.append((k, texts[i]))
                if not fresh:
                    continue
                keys = np.array([k for k, _ in fresh], np.int64).view(np.uint64)
                sets = shingle_sets([t for _, t in fresh])
                size = np.array([len(s) for s in sets], "<u4")
                yield from _many([(lane, keys[g].tobytes() + size[g].tobytes()) for lane, g in _to_lanes(keys, lanes)], SIZES)
                for second, (which, slack, record, sig) in enumerate(signatures(sets)):
                    slack = slack.astype("<u4") | np.uint32(second << 31)
                    if len(known):
                        name = _names(sig, lanes)
                        at = np.minimum(np.searchsorted(known, name), len(known) - 1)
                        hit = known[at] == name
                        common.append((keys[which][record[hit]], slack[record[hit]], often[at[hit]], name[hit]))
                        n += int(hit.sum())
                        record, sig = record[~hit], sig[~hit]
                    held.append((keys[which], slack, record + records, sig))
                    records += len(which)
                    n += len(sig)
                if n >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _by_lane(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows sorted by lane and kind, as (lane, kind, blobs)."""
    now, blobs = None, []
    for batch in batches:
        for lane, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lane, kind) != now:
                if blobs:
                    yield *now, blobs
                now, blobs = (lane, kind), []
            blobs.append(blob)
    if blobs:
        yield *now, blobs


def _count(lanes: int):
    """Signatures of one lane: those of two texts or more go back to their texts' lanes with their frequency."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane, kind, blobs in _by_lane(batches):
            if kind != SIGS:
                yield from _many([(lane, b) for b in blobs], SIGS if kind == READY else SIZES)
                continue
            key, slack, sig = _receive(blobs)
            order = np.argsort(sig)
            s = sig[order]
            twin = np.zeros(len(s), bool)
            twin[1:] = s[1:] == s[:-1]
            twin[:-1] |= twin[1:]
            order = order[twin]
            order = order[np.lexsort((key[order], sig[order]))]
            key, slack, sig = key[order], slack[order], sig[order]
            fresh = np.ones(len(sig), bool)  # tasks may have signed equal texts
            fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]) | (slack[1:] >> np.uint32(31) != slack[:-1] >> np.uint32(31))
            key, slack, sig = key[fresh], slack[fresh], sig[fresh]
            if not len(sig):
                continue
            _, where, freq = np.unique(sig, return_inverse=True, return_counts=True)
            freq = freq[where]
            many = freq > 1
            key, slack, sig, freq = key[many], slack[many], sig[many], freq[many]
            yield from _many([(to, np.array([len(g), lane], "<u8").tobytes() + key[g].tobytes() + slack[g].tobytes() + freq[g].astype("<u4").tobytes() + _u40(sig[g])) for to, g in _to_lanes(key, lanes)], SIGS)

    return run


def _choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record's rarest signatures, as many as the bound asks for: (sig, key)."""
    for _, _, blobs in _by_lane(batches):
        keys, slacks, freqs, sigs = [], [], [], []
        for b in blobs:
            n, lane = np.frombuffer(b, "<u8", 2).tolist()
            keys.append(np.frombuffer(b, "<u8", n, 16))
            slacks.append(np.frombuffer(b, "<u4", n, 16 + 8 * n))
            freqs.append(np.frombuffer(b, "<u4", n, 16 + 12 * n))
            sigs.append(np.frombuffer(b, "<u8", n, 16 + 16 * n) if lane == FULL else _from_u40(b, 16 + 16 * n, n) | np.uint64(lane << 40))
        key, slack, freq, sig = (np.concatenate(x) for x in (keys, slacks, freqs, sigs))
        second = slack >> np.uint32(31)
        order = np.lexsort((sig, freq, second, key))
        key, second, sig, slack = key[order], second[order], sig[order], slack[order] & np.uint32((1 << 31) - 1)
        new = np.ones(len(key), bool)  # tasks may have signed equal texts
        new[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1]) | (sig[1:] != sig[:-1])
        key, second, sig, slack = key[new], second[new], sig[new], slack[new]
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (second[1:] != second[:-1])]))
        size = np.diff(np.append(start, len(key)))
        rank = np.arange(len(key)) - np.repeat(start, size)
        # signatures that no other text has are the rarest: they are among those kept, so only the most frequent ones go
        keep = rank < np.repeat(size, size) - slack.astype(np.int64)
        yield pa.RecordBatch.from_pydict({"sig": pa.array(sig[keep].view(np.int64)), "key": pa.array(key[keep].view(np.int64))})


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for part, texts in slices(batch, "t"):
            fresh = []
            for i, k in enumerate(part.column(0).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    fresh.append((k, texts[i]))
            sets = shingle_sets([t for _, t in fresh])
            if fresh:
                yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in fresh], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "bits": pa.array([sketch(s).tobytes() for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})


def _near(n: np.ndarray, bits: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of texts i and j that sizes and sketches allow."""
    ok = 3 * np.maximum(n[i], n[j]) <= 4 * np.minimum(n[i], n[j])
    i, j = i[ok], j[ok]
    size = np.array([len(b) for b in bits])
    least = np.minimum(size[i], size[j])
    keep = np.zeros(len(i), bool)
    for words in np.unique(least).tolist():
        own = np.flatnonzero(least == words)
        used, where = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
        table = np.stack([fold(bits[k], words) for k in used.tolist()])
        step = max(1, (1 << 21) // words)
        for at in range(0, len(own), step):
            x, y = where[at : min(at + step, len(own))], where[len(own) + at : len(own) + min(at + step, len(own))]
            far = np.bitwise_count(table[x] ^ table[y]).sum(axis=1, dtype=np.int64)
            part = own[at : at + step]
            keep[part] = far <= (n[i[part]] + n[j[part]]) // 7
    return i[keep], j[keep]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of the left texts share a signature with which of the right ones."""
    out = np.zeros((len(left), len(right)), bool)
    sig = np.concatenate([*left, *right])
    who = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(sig, kind="stable")
    sig, who = sig[order], who[order]
    for g in np.split(who, np.flatnonzero(np.diff(sig)) + 1):
        at = int(np.searchsorted(g, len(left)))  # a stable sort keeps them ascending
        out[np.ix_(g[:at], g[at:] - len(left))] = True
    return out


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[tuple]]]:
    """Rows sorted by (hub, i, j), a cell at a time."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = row[:3], []
            rows.append(row[3:])
    if len(rows) > 1:
        yield now, rows


def _sides(cell: tuple[int, int, int], rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a cell's (key, comp, block, n, bits, …): left and right members, sizes, sketches and components."""
    block = np.array([r[2] for r in rows])
    return np.flatnonzero(block == cell[1]), np.flatnonzero(block == cell[2]), np.array([r[3] for r in rows], np.int64), [np.frombuffer(r[4], "<u8") for r in rows], np.array([r[1] for r in rows], np.int64)


MEMBER = "hub long, i int, j int, key long, comp long, block int, n long, bits binary"


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a cell that may be linked with one of another component: they share a signature, and sizes and sketches allow it."""
    for cell, rows in _cells(batches):
        left, right, n, bits, comp = _sides(cell, rows)
        if not len(left) or not len(right):
            continue
        sigs = [np.array(r[5], np.int64) for r in rows]
        both = _common([sigs[k] for k in left], [sigs[k] for k in right]) & (comp[left][:, None] != comp[right][None])
        x, y = np.nonzero(np.triu(both, 1) if cell[1] == cell[2] else both)
        x, y = _near(n, bits, left[x], right[y])
        chosen = [rows[k] for k in np.unique(np.concatenate([x, y])).tolist()]
        if chosen:
            columns = [[v] * len(chosen) for v in cell] + [[r[c] for r in chosen] for c in range(5)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hub", "i", "j", "key", "comp", "block", "n", "bits"])


def _bridge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a cell that join components, verified on whole sets: fewer than it has components."""
    for cell, rows in _cells(batches):
        left, right, n, bits, comp = _sides(cell, rows)
        both = comp[left][:, None] != comp[right][None]
        x, y = np.nonzero(np.triu(both, 1) if cell[1] == cell[2] else both)
        top: dict[int, int] = {}

        def root(c: int, top: dict[int, int] = top) -> int:
            while c in top:
                c = top[c]
            return c

        found = []
        for a, b in zip(*(k.tolist() for k in _near(n, bits, left[x], right[y])), strict=True):
            ra, rb = root(int(comp[a])), root(int(comp[b]))
            if ra != rb and similar(np.frombuffer(rows[a][5], "<u8"), np.frombuffer(rows[b][5], "<u8")):
                top[max(ra, rb)] = min(ra, rb)
                found.append((rows[a][0], rows[b][0]))
        if found:
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _hub_meets(fine: Callable[[tuple, tuple], bool]) -> Callable:
    """Rows sorted by (a, block, member) with a block's hub first: pairs (a, b, block) of it with members that pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, ()
        for batch in batches:
            found = []
            for a, block, b, *of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b is None:
                    now, hub = (a, block), of
                elif now == (a, block) and fine(hub, of):
                    found.append((a, b, block))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["a", "b", "block"])

    return trimmed(run)


def _allowed(hub: tuple, member: tuple) -> bool:
    """Sizes and sketches allow a link."""
    if 3 * max(hub[0], member[0]) > 4 * min(hub[0], member[0]):
        return False
    x, y = np.frombuffer(hub[1], "<u8"), np.frombuffer(member[1], "<u8")
    words = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum()) <= (hub[0] + member[0]) // 7


def _verified(hub: tuple, member: tuple) -> bool:
    return similar(np.frombuffer(hub[0], "<u8"), np.frombuffer(member[0], "<u8"))


def _meet_hubs(pairs: DataFrame, table: DataFrame, names: list[str], fine: Callable, lanes: int) -> DataFrame:
    """The pairs (a hub, b member, block) that pass. A hub's columns travel once a block, a member's once a pair."""
    members = pairs.join(table.select(F.col("key").alias("b"), *names), "b").select("a", "block", "b", *names)
    hubs = pairs.select("a", "block").distinct().join(table.select(F.col("key").alias("a"), *names), "a").select("a", "block", F.lit(None).cast("long").alias("b"), *names)
    return hubs.union(members).repartition(lanes, "a", "block").sortWithinPartitions("a", "block", "b").mapInArrow(_hub_meets(fine), "a long, b long, block int")


def links(texts: DataFrame, copies: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of (key, t), with non-null texts: (key, n) of every text, and (node, root), the components of those with a link.

    ``copies`` counts the rows of each key in ``texts``: (key, copies).
    """
    spark = texts.sparkSession
    lanes = shuffle_partitions(spark)
    common = spark.sparkContext.broadcast(_common_signatures(texts, lanes))  # MOST_COMMON numbers
    arrange = lambda df: df.repartition(lanes, "lane").sortWithinPartitions("lane", "kind")
    signed = texts.select("key", "t").mapInArrow(trimmed(_sign(lanes, common)), PACKED)
    counted = scratch.save(arrange(signed).mapInArrow(trimmed(_count(lanes)), PACKED), "counted")

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                n = len(b) // 12
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.frombuffer(b, "<i8", n)), "n": pa.array(np.frombuffer(b, "<u4", n, 8 * n).astype(np.int64))})

    sizes = counted.where(F.col("kind") == SIZES).select("blob").mapInArrow(unpack, "key long, n long").groupBy("key").agg(F.first("n").alias("n"))
    chosen = arrange(counted.where(F.col("kind") == SIGS)).mapInArrow(trimmed(_choose), "sig long, key long")
    chosen = scratch.save(chosen, "chosen")
    hubs = scratch.save(chosen.groupBy("sig").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").withColumn("w", F.col("members")), "hubs")
    member = scratch.save(spread_join(chosen, hubs, ["sig"], "w").select("sig", "key", "hub", "members"), "member")
    wanted = member.select("key").distinct().join(copies, "key")
    sets = spread_join(texts, wanted, ["key"], "copies", "left_semi").select("key", "t").mapInArrow(trimmed(_sets), "key long, n long, bits binary, shingles binary")
    sets = scratch.save(sets.groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("shingles").alias("shingles")), "sets")

    # each signature's members meet its hub, in blocks
    star = scratch.save(member.where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), "star")
    stars = star.groupBy("a").agg(F.count(F.lit(1)).alias("w")).withColumn("blocks", F.ceil(F.col("w") / BLOCK))
    star = spread_join(star, stars, ["a"], "w").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    near = scratch.save(_meet_hubs(star, sets, ["n", "bits"], _allowed, lanes), "near")
    first = components(_meet_hubs(near, sets, ["shingles"], _verified, lanes).select("a", "b"), scratch)
    first = scratch.save(first, "components")

    # members but the hub, where more than one component is left; a hub's signatures are met together, as they mostly have the same members
    rest = member.where("key <> hub and members > 2").join(first.withColumnRenamed("node", "key"), "key", "left").select("sig", "hub", "key", F.coalesce("root", "key").alias("comp"))
    rest = scratch.save(rest, "rest")
    mixed = rest.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("w")).where("x <> y").select("sig", "w")
    rest = spread_join(rest, mixed, ["sig"], "w", "left_semi").groupBy("hub", "key", "comp").agg(F.collect_list("sig").alias("sigs"))
    rest = scratch.save(rest.join(sets.select("key", "n", "bits"), "key"), "rest")
    blocks = rest.groupBy("hub").agg(F.count(F.lit(1)).alias("w")).withColumn("blocks", F.ceil(F.col("w") / BLOCK).cast("int"))
    rest = spread_join(rest, blocks, ["hub"], "w").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "comp", "block", "n", "bits", "sigs")
    by_cell = lambda df: df.repartition(lanes, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    open_ = scratch.save(by_cell(rest).mapInArrow(trimmed(_meet), MEMBER), "open")
    open_ = open_.join(sets.select("key", "shingles"), "key").select("hub", "i", "j", "key", "comp", "block", "n", "bits", "shingles")
    more = scratch.save(by_cell(open_).mapInArrow(trimmed(_bridge), "a long, b long").distinct(), "links")
    if not more.limit(1).count():
        return sizes, first
    # components of components
    root = first.select("node", "root")
    bridged = more.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    second = scratch.save(components(bridged.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), scratch), "components")
    known = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return sizes, known.union(second.join(first, "node", "left_anti").select("node", "root"))


def _keyed(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(d, doc_id, t, key) of the rows, d the whole row and key that of its text, and (key, copies, low) of the texts' keys.

    Texts whose keys clash, a handful in a corpus of billions, get others made of two hashes.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    rows = rows.withColumn("key", F.when(F.col("t").isNotNull(), text_key(F.col("t"))))
    second = F.xxhash64(F.lit(1), "t")
    counts = (F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"))
    seen = scratch.save(rows.where("t is not null").groupBy("key").agg(*counts, F.min(second).alias("x"), F.max(second).alias("y")), "copies")
    clash = [r["key"] for r in seen.where("x <> y").select("key").limit(MOST_CLASHES + 1).collect()]
    if not clash:
        return rows, seen.select("key", "copies", "low")
    if len(clash) > MOST_CLASHES:
        raise ValueError(f"more than {MOST_CLASHES} hashes clash")
    bad = F.broadcast(docs.sparkSession.createDataFrame([(k, True) for k in clash], "key long, clash boolean"))  # MOST_CLASHES at most
    rows = rows.join(bad, "key", "left").withColumn("key", F.when(F.col("clash"), F.xxhash64(F.lit(2), "t", second)).otherwise(F.col("key"))).select("d", "doc_id", "t", "key")
    return rows, scratch.save(rows.where("t is not null").groupBy("key").agg(*counts), "copies")


def _classes(rows: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    sizes, comp = links(rows.where("t is not null").select("key", "t"), copies.select("key", "copies"), scratch)
    nodes = sizes.join(copies, "key").join(comp.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "low", "copies", F.coalesce("root", "key").alias("root"))
    nodes = scratch.save(nodes, "nodes")
    heads = nodes.groupBy("root").agg(F.min(F.struct(F.coalesce("low", F.lit(TOP)).alias("low"), "key")).alias("h"), F.count(F.lit(1)).alias("w")).select("root", F.col("h.key").alias("head_key"), "w")
    heads = scratch.save(heads.join(nodes.select(F.col("key").alias("head_key"), F.col("low").alias("component_id")), "head_key"), "heads")
    info = scratch.save(spread_join(nodes, heads, ["root"], "w").select("key", "n", "component_id", "head_key", "copies"), "info")
    out = spread_join(scratch.save(rows.select("doc_id", "key"), "ids"), info, ["key"], "copies", "left")
    alone = F.coalesce(F.col("n") == 0, F.lit(True))
    head = alone | ((F.col("key") == F.col("head_key")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", head.alias("head"))


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, key, head) of every row; key is the hash of the text, null for a null one.

    ``head`` marks the text that stands for its component: the text of the
    component's smallest id, of several the one with the smallest hash; all
    rows of that id and text have it. A null text or one without words has no
    shingles, links with nothing, and is a component by itself, and so is a
    text whose rows have null ids only (component_id is null then).
    """
    return _classes(*_keyed(docs, scratch, id_col, text_col), scratch)


def one_of_each(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of each component, that of its smallest id. Rows equal in id and text count once."""
    rows, copies = _keyed(docs, scratch, id_col, text_col)
    name = (F.coalesce("doc_id", F.lit(TOP)).alias("k"), F.coalesce("key", F.lit(TOP)).alias("x"))
    heads = _classes(rows, copies, scratch).where("head").select(*name).distinct()
    return rows.select("d", *name).dropDuplicates(["k", "x"]).join(heads, ["k", "x"], "left_semi").select("d.*")

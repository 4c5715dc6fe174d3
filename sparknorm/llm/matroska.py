"""Matroska: writing byte payloads as 8-bit PCM audio, and packet tables of any file.

The parser walks variable-length EBML elements, reads tracks, clusters, blocks
with every kind of lacing, and cues; a packet is a byte range of the file with
its track and time. It never copies frames.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_slice

# Fixed values of the Matroska specification (RFC 9559, RFC 8794).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS = 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367
TOPS = {EBML, SEGMENT}
LEVEL_1 = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, ATTACHMENTS, CHAPTERS, TAGS}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 2, 4, 6

RATE, FRAME, LACE, BLOCKS = 8000, 512, 4, 16  # samples a second, samples a frame, frames a block, blocks a cluster
TICK_NS = 1_000_000


class Packet(NamedTuple):
    track: int
    time_ns: int
    start: int
    size: int
    keyframe: bool
    cluster: int
    lacing: int


class Track(NamedTuple):
    number: int
    kind: int
    codec: str
    rate: float
    channels: int
    bits: int
    frame_ns: int


class Media(NamedTuple):
    tracks: list[Track]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ns, track, byte position of the cluster
    clusters: int
    duration_ns: int


def vint(n: int, width: int = 0) -> bytes:
    """An EBML size of the least width, which leaves the all-ones value out."""
    width = width or max(1, -(-(n + 2).bit_length() // 7)) if n else width or 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes(-(-key.bit_length() // 8), "big") + vint(len(body)) + body


def uint(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Flag and body of a block: fixed lacing for equal sizes, EBML lacing otherwise."""
    if len(frames) == 1:
        return NO_LACING, frames[0]
    sizes = [len(f) for f in frames]
    count = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return FIXED_LACING, count + b"".join(frames)
    head = vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = 1
        while not -(1 << 7 * width - 1) < b - a < 1 << 7 * width - 1:
            width += 1
        head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return EBML_LACING, count + head + b"".join(frames)


_HEADER = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit samples; equal payloads give equal files."""
    info = element(INFO, uint(TIMESTAMP_SCALE, TICK_NS) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"sparknorm") + element(WRITING_APP, b"sparknorm"))
    body, cues = [info, _TRACKS], b""
    at = len(info) + len(_TRACKS)
    step = FRAME * LACE * BLOCKS
    for first in range(0, len(payload), step):
        base = first * 1000 // RATE
        blocks = [uint(TIMESTAMP, base)]
        for start in range(first, min(first + step, len(payload)), FRAME * LACE):
            stop = min(start + FRAME * LACE, first + step, len(payload))
            flag, data = lace([payload[i : min(i + FRAME, stop)] for i in range(start, stop, FRAME)])
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", start * 1000 // RATE - base, 0x80 | flag) + data))
        cluster = element(CLUSTER, b"".join(blocks))
        cues += element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at)))
        body.append(cluster)
        at += len(cluster)
    if cues:
        body.append(element(CUES, cues))
    return _HEADER + element(SEGMENT, b"".join(body))


def _number(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, next position, and whether all value bits are 1 (an unknown size)."""
    if at >= end or not data[at]:
        raise ValueError(f"bad variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"truncated number at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    ones = (1 << 7 * width) - 1
    return (n if keep_marker else n & ones), at + width, n & ones == ones


def _unknown_end(data: bytes, key: int, at: int, end: int) -> int:
    """Where an element of unknown size ends: at the next id that cannot stand in it, or with its parent."""
    behind = TOPS if key == SEGMENT else TOPS | LEVEL_1
    while at < end:
        inner, body, _ = _number(data, at, end, True)
        if inner in behind:
            return at
        size, body, unknown = _number(data, body, end, False)
        at = body if unknown else body + size  # what stands in one of unknown size is looked at alike
    if at > end:
        raise ValueError(f"element {inner:X} ends behind its parent, at byte {at}")
    return end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, stop) of each element's body in a range. An unknown size reaches to the next element of a level above."""
    while at < end:
        key, at, _ = _number(data, at, end, True)
        size, at, unknown = _number(data, at, end, False)
        stop = _unknown_end(data, key, at, end) if unknown else at + size
        if stop > end:
            raise ValueError(f"element {key:X} ends behind its parent, at byte {stop}")
        yield key, at, stop
        at = stop


def _float(data: bytes) -> float:
    return struct.unpack(">d" if len(data) == 8 else ">f", data)[0] if data else 0.0


def _frames(data: bytes, at: int, stop: int, lacing: int) -> list[tuple[int, int]]:
    if lacing == NO_LACING:
        return [(at, stop - at)]
    count, at = data[at] + 1, at + 1
    if lacing == FIXED_LACING:
        size, rest = divmod(stop - at, count)
        if rest:
            raise ValueError("fixed lacing does not divide the block")
        sizes = [size] * count
    elif lacing == XIPH_LACING:
        sizes = []
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        sizes = []
        for i in range(count - 1):
            n, after, _ = _number(data, at, stop, False)
            sizes.append(n if not i else sizes[-1] + n - (1 << 7 * (after - at) - 1) + 1)
            at = after
    if lacing != FIXED_LACING:
        sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    starts = [at]
    for n in sizes[:-1]:
        starts.append(starts[-1] + n)
    return list(zip(starts, sizes, strict=True))


def parse(data: bytes, wanted: Callable[[int], bool] = lambda at: True) -> Media:
    """Tracks, packets in file order, and cues. A file that is not Matroska or is cut off raises ValueError.

    ``wanted`` tells by its position whether a cluster is read; all are counted.
    """
    tops = list(elements(data, 0, len(data)))
    if not tops or tops[0][0] != EBML:
        raise ValueError("no EBML header")
    tracks: list[Track] = []
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    clusters, scale, duration, frame_ns = 0, TICK_NS, 0.0, {}
    number = lambda a, b: int.from_bytes(data[a:b], "big")

    for key, start, stop in tops:
        if key != SEGMENT:
            continue
        head = start
        for kid, a, b in elements(data, start, stop):
            here, head = head, b
            if kid == INFO:
                for k, x, y in elements(data, a, b):
                    if k == TIMESTAMP_SCALE:
                        scale = number(x, y)
                    elif k == DURATION:
                        duration = _float(data[x:y])
            elif kid == TRACKS:
                for k, x, y in elements(data, a, b):
                    if k != TRACK_ENTRY:
                        continue
                    v = {"n": 0, "kind": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0, "ns": 0}
                    for f, p, q in elements(data, x, y):
                        if f == TRACK_NUMBER:
                            v["n"] = number(p, q)
                        elif f == TRACK_TYPE:
                            v["kind"] = number(p, q)
                        elif f == CODEC_ID:
                            v["codec"] = data[p:q].rstrip(b"\0").decode("ascii", "replace")
                        elif f == DEFAULT_DURATION:
                            v["ns"] = number(p, q)
                        elif f == AUDIO:
                            for g, r, s in elements(data, p, q):
                                if g == SAMPLING_FREQUENCY:
                                    v["rate"] = _float(data[r:s])
                                elif g == CHANNELS:
                                    v["channels"] = number(r, s)
                                elif g == BIT_DEPTH:
                                    v["bits"] = number(r, s)
                    tracks.append(Track(*v.values()))
                    frame_ns[v["n"]] = v["ns"]
            elif kid == CLUSTER and not wanted(here):
                clusters += 1
            elif kid == CLUSTER:
                base = 0
                for k, x, y in elements(data, a, b):
                    if k == TIMESTAMP:
                        base = number(x, y)
                        continue
                    key_frame = None
                    if k == BLOCK_GROUP:
                        inner = {f: (p, q) for f, p, q in elements(data, x, y)}
                        if BLOCK not in inner:
                            continue
                        key_frame = REFERENCE_BLOCK not in inner
                        x, y = inner[BLOCK]
                    elif k != SIMPLE_BLOCK:
                        continue
                    track, at, _ = _number(data, x, y, False)
                    if at + 3 > y:
                        raise ValueError("truncated block")
                    rel, flags = struct.unpack_from(">hB", data, at)
                    time = (base + rel) * scale
                    for i, (p, n) in enumerate(_frames(data, at + 3, y, flags & 6)):
                        packets.append(Packet(track, time + i * frame_ns.get(track, 0), p, n, bool(flags & 0x80) if key_frame is None else key_frame, clusters, flags & 6))
                clusters += 1
            elif kid == CUES:
                for k, x, y in elements(data, a, b):
                    if k != CUE_POINT:
                        continue
                    time, places = 0, []
                    for f, p, q in elements(data, x, y):
                        if f == CUE_TIME:
                            time = number(p, q) * scale
                        elif f == CUE_TRACK_POSITIONS:
                            got = {g: number(r, s) for g, r, s in elements(data, p, q)}
                            places.append((got.get(CUE_TRACK, 0), start + got.get(CUE_CLUSTER_POSITION, 0)))
                    cues += [(time, t, at) for t, at in places]
    return Media(tracks, packets, cues, clusters, round(duration * scale))


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of one track, joined in file order."""
    return b"".join([data[p.start : p.start + p.size] for p in media.packets if p.track == track])


def in_range(data: bytes, start_ns: int, stop_ns: int, track: int = 1) -> list[Packet]:
    """One track's packets of a time range; of the clusters only those between the cues around it are read, without cues all."""
    cues = sorted((time, at) for time, n, at in parse(data, lambda at: False).cues if n == track)
    begin = max((at for time, at in cues if time <= start_ns), default=0)
    end = min((at for time, at in cues if time >= stop_ns and at > begin), default=len(data))
    return [p for p in parse(data, lambda at: begin <= at < end).packets if p.track == track and start_ns <= p.time_ns < stop_ns]


def payload(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def features(sound: bytes, media: Media) -> str:
    """Level statistics of the samples, with the shape of the packet table."""
    x = np.frombuffer(sound or b"\x80", np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    energy = int(np.dot(x, x))
    return f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};duration_us={media.duration_ns // 1000};mean={x.sum() / len(x):.6f};rms={math.sqrt(energy / len(x)):.6f};peak={int(np.abs(x).max())};crossings={crossings}"


def store(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row, written and read back. A null text is empty; equal texts give equal bytes."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        made = [payload(t) for t in texts]
        return pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_bytes": pa.array([n for n, _ in made], pa.int64()), "media": pa.array([mux(p) for _, p in made], pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return scratch.save(rows.mapInArrow(per_slice(run, "t"), "doc_id long, n_bytes long, media binary"), "media")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a packet: id, number, track, time_ns, start, size, keyframe, cluster, lacing.

    A null or broken file has no packets.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["track", "time_ns", "start", "size", "keyframe", "cluster", "lacing"]
        kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 2
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = parse(data).packets if data else []
                except (ValueError, IndexError):
                    found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True))], ["id", "number", *names])

    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(run, "id long, number long, track long, time_ns long, start long, size long, keyframe boolean, cluster long, lacing long")


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of ``store``'s rows, all from the stored bytes and their packets.

    Null media, and a file that is broken, have null digests and features.
    Repeated rows are described alike.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                try:
                    m = parse(data or b"")
                except (ValueError, IndexError):
                    out.append((None,) * 6)
                    continue
                sound = samples(data, m)
                out.append((len(sound), hashlib.sha256(sound).hexdigest(), zlib.crc32(sound[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(sound, m)))
            if out:
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

import hashlib
import random
import zlib

import pytest

from sparknorm.llm import matroska as m
from sparknorm.llm.common import Scratch


@pytest.mark.parametrize("n", [64, 128, 512, 576, 2048, 2112, 40000, 32768 * 3 + 64])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    stored = m.mux(data)
    media = m.parse(stored)
    assert m.samples(stored, media) == data
    assert media.tracks == [m.Track(1, 2, "A_PCM/INT/LIT", 8000.0, 1, 8, 64_000_000)]
    assert len(media.cues) == media.clusters == -(-n // (m.FRAME * m.LACE * m.BLOCKS))
    for _, _, at in media.cues:
        assert stored[at : at + 4] == m.CLUSTER.to_bytes(4, "big")
    times = [p.time_ns for p in media.packets]
    assert times == [i * 64_000_000 for i in range(len(times))]


def block(flags, body):
    inner = m.uint(m.TIMESTAMP, 5) + m.element(m.SIMPLE_BLOCK, b"\x81\x00\x02" + bytes([flags]) + body)
    return m._HEADER + m.element(m.SEGMENT, m.element(m.CLUSTER, inner))


def frames(data):
    return [data[p.start : p.start + p.size] for p in m.parse(data).packets]


def test_xiph_lacing():
    parts = [b"a" * 300, b"b" * 255, b"c" * 7]
    data = block(0x82, bytes([2, 255, 45, 255, 0]) + b"".join(parts))
    assert frames(data) == parts
    assert m.parse(data).packets[0].time_ns == 7_000_000


@pytest.mark.parametrize("sizes", [[5, 300, 2, 90], [800, 1, 20000, 3], [1, 1, 2]])
def test_ebml_lacing(sizes):
    parts = [bytes([65 + i]) * n for i, n in enumerate(sizes)]
    flag, body = m.lace(parts)
    assert flag == m.EBML_LACING
    assert frames(block(0x80 | flag, body)) == parts


def test_block_group_and_unknown_size():
    inner = m.uint(m.TIMESTAMP, 0) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x82\x00\x00\x00xyz") + m.uint(m.REFERENCE_BLOCK, 1))
    data = m._HEADER + m.SEGMENT.to_bytes(4, "big") + b"\xff" + m.element(m.CLUSTER, inner)
    (p,) = m.parse(data).packets
    assert (p.track, p.keyframe, data[p.start : p.start + p.size]) == (2, False, b"xyz")


@pytest.mark.parametrize("data", [b"", b"junk", m.mux(bytes(64))[:-3]])
def test_broken(data):
    with pytest.raises(ValueError):
        m.parse(data)


def test_query_form(spark, tmp_path):
    from sparknorm.llm.common import Scratch

    rows = [(1, "héllo wörld", 9), (2, None, 9), (3, "", 9), (4, "x" * 100_000, 9), (4, "x" * 100_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media long")
    stored = m.store(docs, Scratch(spark))
    got = sorted(tuple(r) for r in m.describe(stored).collect())
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 13, 64), (2, 0, 64), (3, 0, 64), (4, 100_000, 100_032), (4, 100_000, 100_032)]
    assert got[1][2:] == got[2][2:] and got[3] == got[4]
    assert m.packet_table(stored).where("id = 4").count() == 2 * 196
    assert m.describe(m.store(docs.limit(0), Scratch(spark))).count() == 0


UNKNOWN = b"\x01" + b"\xff" * 7


@pytest.mark.parametrize("segment_unknown", [True, False])
def test_clusters_of_unknown_size(segment_unknown):
    """As live streams have them: each cluster ends where the next level-1 element begins, the segment at the next header."""
    cluster = lambda t, *parts: m.CLUSTER.to_bytes(4, "big") + UNKNOWN + m.uint(m.TIMESTAMP, t) + b"".join(m.element(m.SIMPLE_BLOCK, b"\x81" + i.to_bytes(2, "big") + b"\x80" + p) for i, p in enumerate(parts))
    one, two, three = cluster(0, b"ab", b"c"), cluster(40, b"def"), cluster(90, b"g", m.CLUSTER.to_bytes(4, "big"))
    tags = m.element(0x1254C367, b"")  # Tags
    cues = m.element(m.CUES, m.element(m.CUE_POINT, m.uint(m.CUE_TIME, 40) + m.element(m.CUE_TRACK_POSITIONS, m.uint(m.CUE_TRACK, 1) + m.uint(m.CUE_CLUSTER_POSITION, len(m._TRACKS + one)))))
    body = m._TRACKS + one + two + tags + three + cues
    data = m._HEADER + (m.SEGMENT.to_bytes(4, "big") + UNKNOWN + body if segment_unknown else m.element(m.SEGMENT, body))
    for times in (1, 2):
        media = m.parse(data * times)
        found = [(p.cluster, p.time_ns // m.TICK_NS, (data * times)[p.start : p.start + p.size]) for p in media.packets]
        want = [(0, 0, b"ab"), (0, 1, b"c"), (1, 40, b"def"), (2, 90, b"g"), (2, 91, m.CLUSTER.to_bytes(4, "big"))]
        assert found == [(c + 3 * k, t, b) for k in range(times) for c, t, b in want]
        assert media.clusters == 3 * times and len(media.cues) == times
        for time, track, at in media.cues:
            assert (time, track) == (40 * m.TICK_NS, 1) and (data * times)[at:].startswith(two)
    with pytest.raises(ValueError):
        m.parse(data[:-1])


def test_range_read_by_cues():
    data = m.mux(random.Random(1).randbytes(m.FRAME * m.LACE * m.BLOCKS * 3 + 640))
    every = m.parse(data).packets
    for a, b in ((0, 10**18), (5 * 10**9, 6 * 10**9), (4 * 10**9, 4 * 10**9 + 1), (10**15, 10**16), (10**9, 13 * 10**9)):
        assert m.in_range(data, a, b) == [p for p in every if a <= p.time_ns < b]
    assert m.in_range(block(0x80, b"xyz"), 0, 10**10)[0].size == 3  # without cues


def test_digests_equal_plain_python(spark):
    rng = random.Random(8)
    texts = ["", None, "é", "a" * 64, "a" * 63, "漢" * 50_000, *("".join(rng.choices("abé \n", k=rng.randint(0, 5000))) for _ in range(20))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in m.describe(m.store(docs, Scratch(spark))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes((64 - len(raw) % 64) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = m.mux(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = [b - 128 for b in padded]
        fields = dict(f.split("=") for f in r["feature"].split(";"))
        assert int(fields["peak"]) == max(map(abs, x)) and abs(float(fields["mean"]) - sum(x) / len(x)) < 1e-5
        assert int(fields["packets"]) == -(-len(padded) // m.FRAME) == len(m.parse(stored).packets)
    odd = spark.createDataFrame([(1, 5, None), (2, 5, b"junk")], "doc_id long, n_bytes long, media binary")
    assert [r["payload_sha256"] for r in m.describe(odd).collect()] == [None, None]

import hashlib
import random
import zlib

import pytest

from sparknorm.llm import prefix_trie, queries
from sparknorm.llm.common import Scratch
from sparknorm.llm.turns import by_turn

SCHEMA = "conv_id long, turn long, role string, text string, pos string, depth int, k1 double, turns int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {k: [] for k in members}
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    rows = []
    for k, ms in members.items():
        sub = below[k]
        children = [s for s in sub if len(s) == len(k) + 1]
        leaves = [s for s in sub if len(below[s]) == 1]
        saved = sum((len(members[s]) - 1) * (len(s[-1][1]) if s else 0) for s in sub)
        ends = ",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(k))))
        rows.append((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def table(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 900), n):
        for t in range(rng.choice([1, 2, 3, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ééé", None, "\U0001f600x"])))
    start = [(t, rng.choice("ab"), f"long {t}") for t in range(40)]
    for c in range(2000, 2030):  # copies, and long common starts that part late
        cut = rng.choice([40, 40, 40, 25, 11, 3])
        rows += [(c, *s) for s in start[:cut]]
    rows += [(2030, t, "user", "x" * 3) for t in range(60)] + [(2031, None, None, None), (2031, None, "b", None), (2031, None, "b", None), (2031, 0, "user", "z" * 300_000), (None, 1, "user", "nobody")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 7, 0.5, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed,n,first,widest", [(1, 120, 1, 2), (2, 200, 4, 4096)])
def test_nodes_are_those_of_every_prefix(spark, seed, n, first, widest):
    rows = table(seed, n)
    scratch = Scratch(spark)
    turns, convs = prefix_trie.rebuild(*by_turn(frame(spark, rows).repartition(6), scratch), scratch)
    got = prefix_trie.build(turns, convs, scratch, first, widest).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == brute(rebuilt(ordered(rows)))


def test_plain_conversations_and_few(spark):
    scratch = Scratch(spark)
    for rows in ([(5, 0, "user", "a"), (5, 1, "b", "c")], [(5, 0, "user", "a"), (6, 0, "user", "a")], table(3, 30)):
        got = prefix_trie.build(*prefix_trie.whole(*by_turn(frame(spark, rows), scratch)), scratch).select(*COLUMNS).collect()
        assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == brute(ordered(rows))
    assert prefix_trie.build(*prefix_trie.whole(*by_turn(frame(spark, []), scratch)), scratch).count() == 0


def test_the_query(spark, tmp_path):
    rows = table(4, 150) + [(3, 0, "user", "only"), (7, 0, "user", "only")]  # all lent: the base 0 is absent
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_prefix_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == brute(rebuilt(ordered(rows)))

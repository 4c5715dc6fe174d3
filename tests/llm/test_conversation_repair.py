import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from sparknorm.llm import conversation_repair as cr
from sparknorm.llm import queries
from sparknorm.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, roles int, kind double"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        if c is None:
            continue
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, turn, "user" if k == 4 else role, text)] * (k != 0) * (1 + (k == 3))
    return out


def cheapest(rows):
    """By layers: the least (cost, audit, repaired) of every grammar state, any number of insertions before each row and at the end."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def grown(best):
        for _ in range(4):
            for s, (c, a, out) in list(best.items()):
                for role in ("user", "assistant"):
                    if t := step.get((s, role[0])):
                        best[t] = min(best.get(t, (10**9,)), (c + 3, a + "I", (*out, (role, ""))))
        return best

    for role, text, fault in rows:
        new = {}
        put = lambda t, *v: new.__setitem__(t, min(new.get(t, (10**9,)), v))  # noqa: E731, B023
        for s, (c, a, out) in grown(best).items():
            put(s, c + 4, a + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if t := step.get((s, role[:1])):
                    put(t, c + more, a + "K", (*out, (role, text)))
                for other in ("user", "assistant"):
                    if t := step.get((s, other[0])):
                        put(t, c + more + 3, a + "R", (*out, (other, text)))
        best = new
    cost, audit, out = min(v for s, v in grown(best).items() if s in ("", "a"))
    return cost, audit, out


def brute(rows):
    """Of rows (conv_id, turn, role, text) without nulls but turns."""
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role, text))
    out = {}
    for c, found in convs.items():
        found.sort()
        seen, kinds = set(), []
        for *_, role, text in found:
            real = re.findall(r"[^\x20\x09-\x0D]", text)
            kinds.append("blank" if not real else "duplicate" if (role, text) in seen else "" if real[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for there, t, *_ in found if there]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        cost, audit, fixed = cheapest([(r, t, k) for (*_, r, t), k in zip(found, kinds, strict=True)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[c] = (c, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)
    return out


def table(seed, n, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, rng.choice([t, t, t, t + 7, None]), role, rng.choice(["a.", "b!", "c", " ", "", None, "d? \n", " ", f"{t}.", "x.\x0b"])))
    rows += [(n, 3, "user", "long " * 300_000 + "."), (n + 1, None, None, None), (None, 1, "user", "no one.")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 7, 0.5) for r in rows], SCHEMA)


def test_every_sequence_of_edits_is_considered():
    """Against all edit sequences of short conversations, with up to two insertions at a place."""
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.choice([0, 0, cr.GONE, cr.CUT])) for _ in range(rng.randint(0, 3))]
        best = (10**9, "")
        for edits in product(*([p + e for p in ("", "I", "II", "III") for e in "DKR"] for _ in rows), ("", "I", "II", "III")):
            states, i, cost = {("", ""): 0}, 0, 0
            for e in "".join(edits):
                initial, fault = rows[i] if e != "I" else ("", 0)
                i += e != "I"
                cost += {"D": 4, "K": 0, "R": 3, "I": 3}[e] + 3 * (fault == cr.CUT and e != "D")
                if fault == cr.GONE and e != "D":
                    states = {}
                choices = {"D": [""], "K": [initial], "R": ["u", "a"], "I": ["u", "a"]}[e]
                states = {(x + y, ""): 0 for x, _ in states for y in choices}
            if any(GRAMMAR.fullmatch(x) for x, _ in states):
                best = min(best, (cost, "".join(edits)))
        assert list(cr.search(rows).values()) == [best]


@pytest.mark.parametrize("chunk_rows,partitions", [(256, 5), (3, 2), (1, 3)])
def test_repair_is_the_cheapest(spark, chunk_rows, partitions):
    rows = [(c, t, r, x) for c, t, r, x in damaged(table(2, 150))] + [(777, t, "user", "same.") for t in range(40)]
    chunks, gaps = cr.repair(frame(spark, rows).repartition(partitions), Scratch(spark), chunk_rows)
    want = brute(rows)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cr.summaries(chunks, gaps).collect()}
    assert got == want
    spelled = {}
    for r in cr.spelled(chunks).orderBy("conv_id", "chunk", "place").collect():
        spelled.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(spelled.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}


def test_the_query(spark, tmp_path):
    rows = table(3, 120, 5)
    rows += [(c, 0, "user", "x.") for c in range(1000, 1060)]  # some lose their only row
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op12_conversation_repair(spark, str(tmp_path))
    assert found.columns == COLUMNS and [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"] * 2
    want = brute(damaged(rows))
    none = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert sorted(map(tuple, found.collect())) == sorted(want.get(c, (c, *none)) for c in {r[0] for r in rows} - {None})
    assert len(want) < len({r[0] for r in rows} - {None})


def test_empty_table(spark):
    chunks, gaps = cr.repair(cr.damage(frame(spark, [])), Scratch(spark))
    assert cr.summaries(chunks, gaps).count() == 0

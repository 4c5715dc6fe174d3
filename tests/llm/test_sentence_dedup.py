import random
import re

import pytest

from sparknorm.llm import sentence_dedup as sd
from sparknorm.llm.common import Scratch


def sentences(text):
    out, start = [], None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        start = m.start() if start is None else start
        gap = re.match(r"[\x20\x09-\x0D]*", text[m.end() :])[0]
        if m[0][-1] in ".!?" or "\n" in gap or "\r" in gap or m.end() + len(gap) == len(text):
            out.append((start, m.end()))
            start = None
    return out


def brute(docs, least=0):
    first, occ = {}, []
    for i, t in sorted(docs.items()):
        s = sentences(t or "")
        words = [re.findall(r"[^\x20\x09-\x0D]+", t[a:b].lower()) for a, b in s]
        size = lambda a, b: sum(map(len, words[a:b]))  # noqa: E731, B023
        ok = lambda a, b: b - a >= sd.RUN and size(a, b) >= least  # noqa: E731, B023
        spans = set()
        for a in range(len(s)):
            spans |= {(a, b) for b in range(a, len(s) + 1) if ok(a, b) and not ok(a, b - 1)}
        for b in range(len(s) + 1):
            spans |= {(a, b) for a in range(b) if ok(a, b) and not ok(a + 1, b)}
        for a, b in sorted(spans):
            run = tuple(map(tuple, words[a:b]))
            first.setdefault(run, (i, a))
            occ.append((run, i, a, b))
    out = {}
    for i, t in docs.items():
        s, covered = sentences(t or ""), set()
        for run, d, a, b in occ:
            if d == i and first[run] != (i, a):
                covered |= set(range(a, b))
        spans, k = [], 0
        while k < len(s):
            e = k
            while e in covered:
                e += 1
            if e > k:
                spans.append((s[k][0], s[e - 1][1]))
            k = max(e, k + 1)
        out[i] = (len(s), len(covered), ",".join(f"{a}:{b}" for a, b in spans))
    return out


@pytest.mark.parametrize("words", [0, 25])
def test_equals_brute_force(spark, words):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abéd", k=rng.randint(1, 4))) + rng.choice(["", "", ",", ".", "?", "!\n"])
    passages = [" ".join(word() for _ in range(60)) for _ in range(5)]
    docs = {i: " ".join([*[word() for _ in range(rng.randint(0, 40))], *rng.sample(passages, rng.randint(0, 2)), *[word() for _ in range(rng.randint(0, 30))]]) for i in range(60)}
    docs |= {100: None, 101: "", 102: docs[3], 103: docs[3] + " " + docs[3]}
    docs |= {200 + i: docs[5] for i in range(1100)}  # a hot group of copies
    frame = spark.createDataFrame([(*r, 1, 2) for r in docs.items()], "doc_id long, text string, k int, ats int")
    got = {r["doc_id"]: r for r in sd.remove_repeats(frame, Scratch(spark), words=words).collect()}
    assert {i: (r["n_sentences"], r["n_removed"], r["removed"]) for i, r in got.items()} == brute(docs, words)
    assert got[100]["text"] is None and got[101]["text"] == ""
    assert sum(r["n_removed"] > 0 for r in got.values()) > 10


def test_edges(spark):
    frame = spark.createDataFrame([(None, "a b. c d. e f."), (1, "x " * 300_000), (1, "x " * 300_000)], "doc_id long, text string")
    got = sd.remove_repeats(frame, Scratch(spark)).collect()
    assert len(got) == 3 and all(r["n_removed"] == 0 for r in got)
    assert sd.remove_repeats(frame.limit(0), Scratch(spark)).count() == 0


def _plant(rng, words, passage, sep=" "):
    return sep.join([*(rng.choice(words) for _ in range(rng.randint(1, 60))), *passage, *(rng.choice(words) for _ in range(rng.randint(1, 60)))])


def test_finds_passages_without_marks(spark):
    """51 to 60 words that also stand in a smaller id: at most LONGEST stay at each end, whatever surrounds them."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    few = [*vocabulary[:400], *["of", "the"] * 60]
    docs, planted = {}, {}
    for i in range(300):
        passage = [rng.choice(few) + rng.choice(["", ","] if i % 3 == 0 and rng.random() < 0.1 else [""]) for _ in range(rng.randint(51, 60))]
        docs[2 * i], docs[2 * i + 1] = (_plant(rng, vocabulary, passage) for _ in range(2))
        planted[2 * i + 1] = " ".join(passage)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for r in sd.remove_repeats(frame, Scratch(spark)).collect():
        if r["doc_id"] % 2 == 0:
            assert r["n_removed"] == 0 and r["text"] == docs[r["doc_id"]]
            continue
        gone = " ".join(docs[r["doc_id"]][int(a) : int(b)] for a, b in (x.split(":") for x in r["removed"].split(",")))
        passage = planted[r["doc_id"]]
        assert gone in passage and len(gone.split()) >= len(passage.split()) - 2 * sd.LONGEST


def test_finds_passages_of_other_scripts(spark):
    rng = random.Random(10)
    han = [chr(c) for c in range(0x4E00, 0x5200)] + ["。", "，"] * 40
    thai = [chr(c) for c in range(0x0E01, 0x0E2F)]
    hindi = ["".join(rng.choices("कखगघचछजझ", k=5)) + rng.choice(["", "", "।"]) for _ in range(3000)]
    for words, n, sep in ((han, 102, ""), (thai, 204, ""), (hindi, 51, " ")):
        docs = {}
        for i in range(0, 60, 2):
            passage = rng.choices(words, k=n)
            docs[i], docs[i + 1] = (_plant(rng, words, passage, sep) for _ in range(2))
        frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {r["doc_id"]: r for r in sd.remove_repeats(frame, Scratch(spark)).collect()}
        assert all((got[i]["n_removed"] > 0) == (i % 2 == 1) for i in docs)
        assert all(len(got[i]["text"]) < len(docs[i]) - (n - 2 * sd.LONGEST) // 2 for i in docs if i % 2)


def test_cuts_do_not_depend_on_neighbours():
    texts = ["", "a b。c d 你好，world x", "  ", "z " * 20 + "q", "é…"]
    whole = sd.cut(texts)
    for i, t in enumerate(texts):
        alone = sd.cut([t])
        at = whole.text == i
        assert all((getattr(alone, f) == getattr(whole, f)[at]).all() for f in ("start", "stop", "words", "hash"))
    raw = texts[1].encode()
    one = sd.cut([texts[1]])
    assert [raw[a:b].decode() for a, b in zip(one.start, one.stop)] == ["a b。", "c d 你好，world x"]

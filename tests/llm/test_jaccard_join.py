import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparknorm.llm import jaccard_join as jj
from sparknorm.llm.common import Scratch
from sparknorm.llm.shingles import shingle_sets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((i, len(s), low[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, bases, passage=0):
    """Texts with chains of edited copies; all of them may hold one common passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 5)))
    common = [word() for _ in range(passage)]
    out = []
    for _ in range(bases):
        w = [word() for _ in range(rng.choice([1, 3, 6, 12, 30, 36, 44, 70, 90, 200, 400]))]
        for _ in range(rng.randint(1, 5)):
            out.append(" ".join(w[: len(w) // 2] + common + w[len(w) // 2 :]))
            w = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w += [word() for _ in range(rng.randint(0, len(w) // 4))]
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "bases", "passage"), [(1, 60, 0), (2, 50, 60)])
def test_equals_brute_force(spark, seed, bases, passage):
    rows = corpus(seed, bases, passage)
    rows += [(2000, rows[3][1].upper().replace("É", "é")), (2001, None), (2002, " \n"), (2003, rows[3][1] + "\n"), (2004, rows[3][1])]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, key int, n int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.near_duplicates(docs, Scratch(spark)).collect())
    assert got == brute(rows)


def test_one_head_a_component(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (7, "A b c d e f"), (None, "x y"), (8, "x y"), (9, None)], "doc_id long, text string")
    got = jj.near_duplicates(docs, Scratch(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["head"]) for r in got) == [(0, 8, False), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (9, 9, True)]
    assert jj.near_duplicates(docs.limit(0), Scratch(spark)).count() == 0


def test_bounds():
    """Sketch distances never exceed the symmetric difference, and linked sets always share one of their d + 1 rarest signatures."""
    rng = np.random.default_rng(0)
    for n in (3, 8, 24, 31, 32, 40, 63, 64, 100, 127, 200, 500, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        for _ in range(20):
            cut = int(rng.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate([a[: n - cut], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64) * np.uint64(2)]))
            x, y = jj.sketch(a), jj.sketch(b)
            m = min(len(x), len(y))
            assert np.bitwise_count(jj.fold(x, m) ^ jj.fold(y, m)).sum() <= len(np.setxor1d(a, b))
            if jj.similar(a, b):
                kept = []
                for s in (a, b):
                    mine = set()
                    for which, slack, record, sig in jj.signatures([s]):
                        mine |= set(np.sort(sig)[: len(sig) - int(slack[0])].tolist())
                    kept.append(mine)
                assert kept[0] & kept[1], n


def test_sets():
    texts = ["A b\tc d e f", "a  B c", "", "é x y z w v", "a a a a a a a a"]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    assert shingle_sets(["a b c d e"])[0] == shingle_sets(["x", " A\nB c D e "])[1]


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 300_000), (2, "z")], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in jj.near_duplicates(docs, Scratch(spark)).collect()) == [(1, 2, 1), (2, 1, 2)]


def test_clashing_keys_common_signatures_and_hot_groups(spark, monkeypatch):
    rows = corpus(5, 40, 40)
    rows += [(5000 + i, rows[0][1]) for i in range(1500)] + [(9000 + i, ["", None, " "][i % 3]) for i in range(60)]
    monkeypatch.setattr(jj, "text_key", lambda t: F.pmod(F.xxhash64(t), F.lit(97)))  # most keys clash
    monkeypatch.setattr(jj, "SAMPLE", 1)
    monkeypatch.setattr(jj, "COMMON", 3)  # most signatures that two texts have are counted beforehand
    docs = spark.createDataFrame([(*r, 0, "d", 1) for r in rows], "doc_id long, text string, key int, d string, x int").repartition(7)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.near_duplicates(docs, Scratch(spark)).collect())
    assert got == brute(rows)
    kept = jj.one_of_each(docs, Scratch(spark))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in got})


def test_words_that_clash_under_polynomial_hashes(spark):
    a = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"x y z {a} w"), (4, f"x y z {b} w")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jj.near_duplicates(docs, Scratch(spark)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}

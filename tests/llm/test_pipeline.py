import random
import re

import pytest

import corpus_pipeline as cp
from sparknorm.llm import language, mixing, pii
from sparknorm.llm.common import documents
from tests.llm.test_jaccard_join import brute
from tests.llm.test_mixing import targets_of
from tests.llm.test_packing import check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pattern string, d int, row int"
ODD = [(9001, None), (9002, ""), (9003, "99 %%"), (None, "the of land and quick brown house"), (9004, "xqzjk vvvqx zzxqk jjxqz kkqxz"), (9005, "mail a.b@c.example now and the land of the house"), (9006, "the land of house quick brown and " * 30_000)]


def corpus():
    rng = random.Random(3)
    words = {"en": "the of land and quick brown house".split(), "de": "der straße und holz zwei nacht haus".split()}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", str(rng.randint(0, 30))]) for _ in range(rng.choice([8, 30, 90]))), lang, rng.choice(["a", "b", None])))
    rows += [(500 + i, rows[i][1], "en", "a") for i in range(20)] + [rows[0], rows[0]]
    rows += [(i, t, "en", rng.choice(["a", "b"])) for i, t in ODD]
    return [(*r, len(r[1] or ""), "k", "p", 1, 2) for r in rows]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_stages_equal_plain_python(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stage = dict(cp.STAGES)
    assert [name for name, _ in cp.STAGES] == ["language ID", "near duplicates", "personal data", "source mixing", "packing"]

    found = stage["language ID"](spark, docs, "")
    known = [tuple(r) for r in found.collect()]
    names, _, hits = language.predict(language.fit(docs), [r[1] or "" for r in rows])
    assert found.schema == docs.schema and same(known, [r for r, n, h in zip(rows, names, hits, strict=True) if n != "und" and h >= language.LEAST_HITS])
    assert {r[0] for r in rows} - {r[0] for r in known} == {9001, 9002, 9003, 9004}

    one = stage["near duplicates"](spark, spark.createDataFrame(known, SCHEMA), "")
    heads = {c for i, _, c in brute([(r[0] if r[0] is not None else 2**62, r[1]) for r in known])}
    kept = [tuple(r) for r in one.collect()]
    assert one.schema == docs.schema and sorted(r[0] if r[0] is not None else 2**62 for r in kept) == sorted(heads)
    assert {r for r in kept} <= set(known)

    clean = stage["personal data"](spark, spark.createDataFrame(kept, SCHEMA), "")
    masked = [tuple(r) for r in clean.collect()]
    assert clean.schema == docs.schema and same(masked, [(r[0], pii.mask(r[1]), *r[2:4], len(pii.mask(r[1])), *r[5:]) for r in kept])
    assert any("<EMAIL>" in r[1] for r in masked)

    mixed = stage["source mixing"](spark, spark.createDataFrame(masked, SCHEMA), "")
    taken = [tuple(r) for r in mixed.collect()]
    assert mixed.schema == docs.schema and set(taken) <= set(masked)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, got = {}, {}
    for r in masked:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
        assert taken.count(r) <= mixing.MAX_REPEATS * masked.count(r)
    for r in taken:
        got[r[3]] = got.get(r[3], 0) + size(r[1])
    longest = max(size(r[1]) for r in masked)
    assert all(abs(got.get(s, 0) - want) <= max(longest, 0.1 * want) for s, want in targets_of(sizes).items())

    check(stage["packing"](spark, spark.createDataFrame(taken, SCHEMA), "").collect(), [r[:2] for r in taken])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None, None, None, None)]])
def test_nothing_to_keep(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert [f.name for f in docs.schema] == SCHEMA.replace(",", "").split()[::2]
    assert dict(cp.STAGES)["packing"](spark, docs, "").count() == 0


def test_run(spark):
    d = "/root/testdata/sf0.001"
    ids = {r["doc_id"] for r in documents(spark, d).collect()}
    got = cp.run(spark, d).collect()
    assert got and {r["doc_id"] for r in got} <= ids

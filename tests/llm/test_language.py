import zlib

import numpy as np
from pyspark.sql import functions as F

from sparknorm.llm import language as lg

WORDS = {"aa": "kiri lomo satu vana beku", "bb": "straf würde holz zwei nacht", "cc": "the of land every quick"}


def rows(n):
    rng = np.random.default_rng(1)
    names = sorted(WORDS)
    return [(i, " ".join(rng.choice(WORDS[names[i % 3]].split(), 12)), names[i % 3]) for i in range(n)]


def test_learns_and_predicts(spark):
    docs = spark.createDataFrame(rows(300), "doc_id long, text string, lang string")
    got = lg.identify(docs, lg.fit(docs)).collect()
    truth = {i: name for i, _, name in rows(300)}
    assert len(got) == 300
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["lang_pred"] == truth[r["doc_id"]] and 0 < r["score"] <= 1


def test_edge_cases(spark):
    docs = spark.createDataFrame(rows(300), "doc_id long, text string, lang string")
    model = lg.fit(docs)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "ж"), (5, "kiri " * 200_000), (None, "the land"), (6, "the of"), (6, "the of")]
    got = {}
    for r in lg.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [got[i][0]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert got[4][0]["lang_pred"] in WORDS and got[5][0]["lang_pred"] == "aa"
    assert got[None][0]["held_out"] is True and len(got[6]) == 2
    assert lg.identify(docs.limit(0), model).count() == 0
    nothing = lg.fit(docs.limit(0))
    assert lg.identify(docs.limit(2), nothing).collect()[0]["lang_pred"] == "und"


def test_filter_holds_every_gram_and_corrects_chance():
    rng = np.random.default_rng(0)
    found = {f"l{i:03}": rng.integers(0, 2**63, 500).astype(np.uint64) for i in range(70)}
    model = lg.build(sorted(found), found)
    assert model.slots.shape[1] == 2
    for i, name in enumerate(model.languages):
        for at in lg._probes(found[name], model.bits):
            assert (model.slots[at, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    assert model.chance.max() < 0.01


def test_languages_of_few_rows(spark):
    schema = "doc_id long, text string, lang string"
    free = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5]
    held = [i for i in range(1000, 1100) if not zlib.crc32(str(i).encode()) % 5]
    rare = [(free[0], "привет добрый мир", "ru"), (free[1], "καλημέρα κόσμε ωραία", "el"), (free[2], "καλημέρα κόσμε καλά", "el"), (free[3], "123", "el")]
    docs = spark.createDataFrame([*rows(300), *rare], schema)
    model = lg.fit(docs)
    assert not model.blind
    more = spark.createDataFrame([(1, "добрый привет", None), (2, "κόσμε καλημέρα", None), (3, "99", None), (4, None, None), (5, "漢字漢字", None), *rows(300)[6:66]], schema)
    got = {r["doc_id"]: r["lang_pred"] for r in lg.identify(more, model).collect()}
    assert (got[1], got[2]) == ("ru", "el") and all(got[i] == name for i, _, name in rows(300)[6:66])
    assert {r["doc_id"] for r in lg.known(more, model).collect()} == {1, 2, *range(6, 66)}
    # one rare row takes no n-gram from a language of many
    plain, odd = lg.fit(docs.where("lang = 'cc'")), lg.fit(docs.where("lang = 'cc'").union(spark.createDataFrame([(free[4], "the of land every quick", "zz")], schema)))
    assert lg.predict(plain, ["every quick land"])[0] == lg.predict(odd, ["every quick land"])[0] == ["cc"]
    # held-out rows decide nothing, not even where they alone have a language
    assert not lg.fit(docs.union(spark.createDataFrame([(held[0], "漢字", "zh")], schema))).blind
    # no labelled row: a letter is enough
    for blind in (docs.select("doc_id", "text", "lang").where("false"), docs.selectExpr("doc_id", "text", "cast(null as string) as lang")):
        model = lg.fit(blind)
        assert model.blind
        assert {r["doc_id"] for r in lg.known(more, model).collect()} == {1, 2, 5, *range(6, 66)}


def test_held_out_accuracy_and_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lg.fit(docs)
    got = lg.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) > 100 and (got["lang"] == got["lang_pred"]).mean() > 0.98
    rng = np.random.default_rng(0)
    junk = [(90_000_000 + i, "".join(rng.choice(list("bcdfghjkmnpqrtvwxz"), 300)), None) for i in range(20)] + [(91_000_000, "漢字漢字漢字", "en"), (91_000_001, "2 + 2", "en"), (91_000_002, None, "en")]
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang")).union(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    kept = {r["doc_id"]: r["lang"] for r in lg.known(rows, model).collect()}
    lettered = {r["doc_id"]: r["lang"] for r in docs.where("text rlike '[A-Za-z]'").collect()}
    assert set(kept) == set(lettered)
    assert sum(kept[i] == lettered[i] for i in kept) > 0.98 * len(kept)  # null ones got the prediction


def test_filter_equals_plain_sets(spark):
    """Counts of the bitmask filter are those of one set of n-grams a language, but for the corrected chance."""
    found = {}
    for name, text in WORDS.items():
        found[name] = np.unique(lg.grams([text])[0])
    model = lg.build(sorted(found), found)
    texts = [" ".join(WORDS[a].split()[:3] + WORDS[b].split()[:2]) for a in WORDS for b in WORDS] + ["quick " * 5]
    names, scores, hits = lg.predict(model, texts)
    for t, name, score, hit in zip(texts, names, scores, hits, strict=True):
        h = lg.grams([t])[0].tolist()
        count = {k: sum(x in set(v.tolist()) for x in h) for k, v in found.items()}
        best = max(sorted(count), key=lambda k: count[k])
        assert count[name] >= count[best] - 1
        assert abs(score - count[name] / sum(count.values())) < 0.1 and abs(hit - count[name] / len(h)) < 0.1

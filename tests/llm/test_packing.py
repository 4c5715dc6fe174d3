import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparknorm.llm import packing as pk
from sparknorm.llm import queries
from sparknorm.llm.common import Scratch
from sparknorm.llm.tokens import default_vocabulary

SCHEMA = "doc_id long, text string, source string, row int, n int, ids string, s string"


def check(pieces, rows, length=1024, end=0):
    """Every id lies in one piece, sequences have no gap, all but the last are full; checksums are those of the library's ids."""
    library = Tokenizer.from_file(default_vocabulary())
    want = sorted((d or -1, tuple([*library.encode(t or "", add_special_tokens=False).ids, end])) for d, t in rows)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"] or -1, []).append(p)
    known = {}
    for d, ids in want:
        known.setdefault(d, []).append(ids)
    for d, texts in known.items():
        lengths = sorted(len(t) for t in texts for _ in [0])
        assert sum(p["length"] for p in by_doc[d]) == sum(lengths)
        for p in by_doc[d]:  # each piece is a part of one of the id's documents
            assert p["length"] > 0 and any(len(t) == p["doc_tokens"] and zlib.crc32(np.array(t[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for t in texts)
        if len(texts) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    assert set(by_doc) == set(known)
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for seq, parts in windows.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length and (at == length or seq == max(windows))
    assert sorted(windows) == list(range(len(windows)))


def corpus(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["land", "über", "x,", "of", "漢"], k=rng.choice([0, 3, 40, 900, 3000]))), rng.choice(["a", "b", "b", None, ""])) for i in range(n)]


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1, 2, "i", "s") for r in rows], SCHEMA).repartition(3)
    scratch = Scratch(spark)
    tokens = pk.tokenise(docs, scratch)
    return pk.with_checksums(pk.pack(tokens, scratch, **kw), tokens).collect()


def test_every_id_once(spark):
    rows = [*corpus(120), (500, None, "a"), (501, "", None), (None, "no id", "a"), (502, "the land " * 120_000, "b"), (3, "again", "a"), (3, "again", "a"), (504, "x<|endoftext|>y", "c")]
    check(run(spark, rows), [r[:2] for r in rows])
    check(run(spark, rows, block_tokens=5000), [r[:2] for r in rows])
    check(run(spark, rows, length=64, block_tokens=3000), [r[:2] for r in rows], 64)
    assert run(spark, []) == []
    assert len(run(spark, [(1, None, None)])) == 1


def test_null_and_empty_sources_are_two(spark):
    rows = [(i, "a b c d e f " * 50, None if i % 2 else "") for i in range(40)]
    scratch = Scratch(spark)
    tokens = pk.tokenise(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch)
    got = pk.pack(tokens, scratch, length=256, targets={None: 3, "": 1}).join(tokens.select("row", "source"), "row")
    share = got.where("sequence_id < 10").groupBy("source").agg(F.sum("length").alias("n")).collect()
    n = {r["source"]: r["n"] for r in share}
    assert abs(n[None] / (n[None] + n[""]) - 0.75) < 0.1


def test_windows_hold_the_target_mixture(spark):
    rng = random.Random(4)
    rows = [(i, "land of the " * rng.choice([2, 30, 700]), rng.choice("abc")) for i in range(600)]
    scratch = Scratch(spark)
    tokens = pk.tokenise(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch)
    total = {r["source"]: r["n"] for r in tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    for targets in (None, {"a": 2, "b": 1, "c": 1}):
        pieces = pk.pack(tokens, scratch, targets=targets, block_tokens=1 << 17).join(tokens.select("row", "source"), "row")
        cells = pieces.groupBy("sequence_id").pivot("source", ["a", "b", "c"]).agg(F.sum("length")).na.fill(0).orderBy("sequence_id").collect()
        share = {k: v / sum(total.values()) for k, v in total.items()} if targets is None else {k: v / 4 for k, v in targets.items()}
        full = min(total[k] / share[k] for k in share)  # tokens until a source runs out
        off = [max(abs(r[k] / 1024 - share[k]) for k in "abc") for r in cells[: int(full // 1024) - 10]]
        # a window keeps to the target up to the deficit it was given and one least piece; not so where a block's queues end
        assert len(off) > 100 and sum(x <= 2 * pk.LEAST / 1024 for x in off) >= 0.9 * len(off) and sum(off) / len(off) < pk.LEAST / 1024


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op2_packing(spark, d).collect(), rows)


def test_windows_of_many_sources(spark):
    """26 sources, one of which has a third of all tokens: in nearly every window each is within its share and a small piece of its due."""
    rng = random.Random(5)
    rows = [(i, "land of the " * rng.choice([30, 300, 700]), "hot" if i % 3 == 0 else f"s{rng.randrange(25)}") for i in range(1500)]
    scratch = Scratch(spark)
    tokens = pk.tokenise(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch)
    names = [r[0] for r in tokens.select("source").distinct().collect()]
    total = {r["source"]: r["n"] for r in tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    pieces = pk.pack(tokens, scratch).join(tokens.select("row", "source"), "row")
    cells = pieces.groupBy("sequence_id").pivot("source", names).agg(F.sum("length")).na.fill(0).orderBy("sequence_id").collect()
    off = sorted(max(abs(r[s] - 1024 * total[s] / sum(total.values())) for s in names) for r in cells[:-1])
    assert off[len(off) // 2] <= 80 and off[int(0.9 * len(off))] <= 160 and len(names) == 26

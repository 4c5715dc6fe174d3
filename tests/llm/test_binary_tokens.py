import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparknorm.llm import binary_tokens as bt
from sparknorm.llm import queries
from sparknorm.llm.common import Scratch
from sparknorm.llm.tokens import default_vocabulary

SCHEMA = "doc_id long, text string, part int, segment int, k string, t string, body binary"


def plain(rows, end):
    """The contract's columns by plain Python."""
    library = Tokenizer.from_file(default_vocabulary())
    out, at = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_equals_plain_python(spark):
    rng = random.Random(2)
    words = ["the", "Straße", "漢字", "\n\n", "<|endoftext|>", "12.5,", "—", "x" * 30]
    rows = [(rng.randrange(-50, 400), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(150)]
    rows += [(7, None), (8, ""), (None, "no id"), (None, None), (500, "a b, " * 200_000), rows[0], rows[0], (9, "tie a"), (9, "tie b")]
    docs = spark.createDataFrame([(*r, 1, 2, "k", "t", b"") for r in rows], SCHEMA).repartition(5)
    got = bt.read_tokens(bt.write_tokens(docs, Scratch(spark), end_id=2)).orderBy("start").collect()
    assert [tuple(r) for r in got] == plain(rows, 2)


def test_empty_table_and_random_access(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert bt.read_tokens(bt.write_tokens(docs, Scratch(spark))).count() == 0
    rng = np.random.default_rng(0)
    for bits in (1, 7, 16, 17, 31):
        ids = rng.integers(0, 1 << bits, 20_000).astype(np.uint32)
        ends = np.array([0, 5, 5, 9000, 20_000])
        seg = bt.Segment(bt.write_segment(ids, ends, bits, block=128))
        assert (seg.ids() == ids).all() and (seg.document(3) == ids[5:9000]).all() and not len(seg.document(0))
        for a, b in ((0, 1), (127, 129), (19_999, 20_000), (300, 300)):
            assert (seg.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        bt.write_segment(np.array([8], np.uint32), np.array([1]), 3)
    with pytest.raises(ValueError):
        bt.Segment(b"XXXX" + bytes(40))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert [tuple(r) for r in queries.op5_binary_tokens(spark, d).orderBy("start").collect()] == plain(rows, 2)

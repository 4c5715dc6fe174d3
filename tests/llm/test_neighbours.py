import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparknorm.llm import neighbours, partitions, queries
from sparknorm.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<double>, label int, cid string, part int, hits double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", 1, 0.5) for i, v in rows], SCHEMA)


def cosine(a, b):
    top = max(map(abs, a)), max(map(abs, b))
    a, b = [x / top[0] for x in a], [x / top[1] for x in b]
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b))


def brute(rows, k=5):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(fine):
        if i % 50 == 0:
            near = sorted((-round(cosine(v, w), 12), j) for m, (j, w) in enumerate(fine) if m != n and len(v) == len(w))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def answer(df):
    return sorted((*r[:3], round(r[3], 12)) for r in map(tuple, df.collect()))


def odd(rng):
    rows = [(int(i), rng.standard_normal(6).tolist()) for i in rng.permutation(300)]
    copy = rows[7][1]
    rows += [(1000 + i, copy) for i in range(120)] + [(2000, [2 * x for x in copy]), (2050, None), (2100, []), (2150, [0.0] * 6), (2200, [math.nan] + [1.0] * 5), (2250, [None] * 6), (2300, [math.inf] + [1.0] * 5), (None, copy)]
    rows += [(3000, [1.0, 2.0]), (3050, [2.0, 1.0]), (3001, [1.0, 1.5]), (4000, [7.0]), (5000, [1e200, 1e-200, 3e200, 0.0, 0.0, 1.0]), rows[3], rows[3], (-50, rows[5][1])]
    return rows


def test_full_visits_are_exact(spark):
    rows = odd(np.random.default_rng(1))
    got = neighbours.nearest(frame(spark, rows).repartition(5), F.col("vec_id") % 50 == 0, Scratch(spark), recall=1.0, block=600)
    assert answer(got) == brute(rows)


@pytest.mark.parametrize("kind", ["clustered", "even"])
def test_recall(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 24))
    if kind == "clustered":
        x = rng.standard_normal((60, 24))[rng.integers(0, 60, 6000)] + 0.3 * x
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    found = {}
    for q, _, j, _ in answer(neighbours.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, Scratch(spark), sample=3000)):
        found.setdefault(q, set()).add(j)
    u = partitions.unit(x)
    hits = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(found[q] & set(np.argsort(-s)[:5].tolist()))
        assert len(found[q]) == 5
    assert hits / (5 * 120) >= 0.9
    router = partitions.fit(u[:3000], 4, 0.93)
    assert router.visits < 16 and (kind == "even" or router.visits <= 4)


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(3)
    x = partitions.unit(rng.standard_normal((8, 16))[rng.integers(0, 8, 800)] + 0.1 * rng.standard_normal((800, 16)))
    links = partitions.nearest(x, x, 10, same=True)
    part = partitions.cut(links, 3, rng)
    assert np.ptp(np.bincount(part, minlength=8)) <= 8
    assert (part[links] == part[:, None]).mean() > 0.85 > 1 / 8


def test_the_query(spark, tmp_path):
    rows = odd(np.random.default_rng(4))
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_neighbours(spark, str(tmp_path))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    want = brute(rows)
    assert len(set(answer(got)) & set(want)) >= 0.9 * len(want)


def test_few_rows(spark):
    ask = F.col("vec_id") % 50 == 0
    assert neighbours.nearest(frame(spark, []), ask, Scratch(spark)).count() == 0
    assert neighbours.nearest(frame(spark, [(50, [1.0, 0.0])]), ask, Scratch(spark)).count() == 0
    assert answer(neighbours.nearest(frame(spark, [(50, [1.0, 0.0]), (7, [1.0, 1.0])]), ask, Scratch(spark))) == [(50, 1, 7, round(math.sqrt(0.5), 12))]

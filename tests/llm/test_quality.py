import numpy as np
from pyspark.sql import functions as F

from sparknorm.llm import quality as ql
from sparknorm.llm.common import Scratch

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, host string, site string, deep string, p double, n long, evidence double"


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1.0
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_auc(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = ql.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = ql.score(docs, model, Scratch(spark), F.col("source"), F.col("lang")).join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("x")), "doc_id").toPandas()
    assert len(got) > 80
    assert auc(got["quality"].to_numpy(), got["y"].to_numpy()) > 0.75
    assert auc(got["toxic"].to_numpy(), got["x"].to_numpy()) > 0.7  # 35 toxic texts to learn from


def plain(rows, model, depth):
    """Rates and posteriors by plain NumPy, from the rows' evidence."""
    e = np.array([ql.evidence(model, [t or ""])[0][0] for _, t, *_ in rows])
    p = 1 / (1 + np.exp(-(e + np.log(model.prior / (1 - model.prior)))))
    rate, above = p.mean(), np.full(len(rows), p.mean())
    last = np.full(len(rows), rate)
    out = []
    for d in range(depth):
        names = [tuple(r[2 : 3 + d]) for r in rows]
        groups = {k: [i for i, x in enumerate(names) if x == k] for k in dict.fromkeys(names)}
        n, total = (np.array([f(groups[k]) for k in names], float) for f in (len, lambda at: p[at].sum()))
        one = [v[0] for v in groups.values()]
        within = max(rate * (1 - rate), 1e-6)
        q = (n[one] * (total[one] / n[one] - above[one]) ** 2).sum()
        between = (q - (len(one) - 1) * within) / max(len(rows) - (n[one] ** 2).sum() / len(rows), 1e-9)
        w = 10.0 if len(one) < 2 else min(max(within / max(between, 1e-9) - 1, 1.0), 1e4)
        last = (total - p + w * last) / (n - 1 + w)
        above = total / n
        out.append(last)
    odds = np.clip(last, 1e-6, 1 - 1e-6)
    return e, out[0], last, 1 / (1 + np.exp(-(e + np.log(odds / (1 - odds)))))


def test_posteriors_equal_plain_numpy(spark):
    rng = np.random.default_rng(2)
    texts = ["good plain words here, and more.", "BAD $$$ ### 123", "the the the the", "", None, "long " * 200_000]
    rows = [(i, texts[int(k)], ["a", "b", None, ""][int(h)], str(int(s)), None if x else "z") for i, (k, h, s, x) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 4, 300), rng.integers(0, 3, 300), rng.integers(0, 2, 300), strict=True))]
    rows += [(400, None, "a", None, None), (401, texts[5], "b", "0", "z"), rows[0], rows[0], *((1000 + i, texts[0], "hot", "0", "z") for i in range(1300))]
    docs = spark.createDataFrame([(*r, 0.0, 1, 0.0) for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(t == texts[0]), 0) for i, t, *_ in rows[:200]] + [(0, 1, 1), (0, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = ql.fit(docs, labels)
    for path, depth in ((F.col("site"), 2), ([F.col("site"), F.col("deep")], 3)):
        got = ql.score(docs, model, Scratch(spark), F.col("host"), path).collect()
        e, host, last, quality = plain(rows, model, depth)
        key = lambda r: tuple(round(x, 7) for x in r)
        want = sorted(key((i, *v)) for i, v in zip([r[0] for r in rows], zip(e, host, last, quality, strict=True), strict=True))
        assert np.allclose(sorted(key((r["doc_id"], r["evidence"], r["host_rate"], r["path_rate"], r["quality"])) for r in got), want, atol=1e-6)


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "h", "s", "d", 0.0, 1, 0.0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = ql.fit(docs, none)
    (row,) = ql.score(docs, model, Scratch(spark), F.col("host"), F.col("site")).collect()
    assert row["evidence"] == 0 and row["quality"] == 0.5
    assert ql.score(docs.limit(0), model, Scratch(spark), F.col("host"), F.col("site")).count() == 0
    assert ql.fit(docs.limit(0), none.limit(0)).prior == 0.5


def test_evidence_without_marks_is_a_number():
    model = ql.Model(np.zeros(1 << ql.BITS), np.zeros(9), np.ones(9), np.zeros(10), 0.5, np.array([5], np.uint64), np.array([1.0]), 0.5)
    for texts in (["none of them"], [""], ["a", "b"]):
        assert [x.dtype for x in ql.evidence(model, texts)] == [np.float64, np.float64]

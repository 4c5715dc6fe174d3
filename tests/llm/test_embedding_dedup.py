import numpy as np

from sparknorm.llm import embedding_dedup as ed
from sparknorm.llm.common import Scratch


def brute(rows, t=0.98):
    ok = [l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= t:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[find(i)], rows[i][0] == low[find(i)]) for i in range(n))


def data():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((base + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.2, 0.3]), k % 3))
    rows = [(i + 10, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    return rows + [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 1), (4, [float("nan")] * 16, 1), (5, [None] * 16, 1), (6, rows[0][1], None), (7, rows[0][1][:8], rows[0][2])]


def test_equals_brute_force(spark):
    rows = data()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, cid int")
    for tile in (1024, 16):
        got = sorted(tuple(r) for r in ed.near_duplicates(docs, Scratch(spark), tile=tile).collect())
        assert got == brute(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ed.near_duplicates(docs, Scratch(spark)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 1500)) * rng.lognormal(0, 3, (200, 1500))
    q, s, r, e = ed.quantise(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    gap = np.abs(ed.products(q, q) * s[:, None] * s - unit @ unit.T)
    assert (gap <= r[:, None] * e + e[:, None] * r + e[:, None] * e + 1e-9).all()


def test_extremes_ties_and_hot_copies(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(64)
    rows = [(i, (base + rng.standard_normal(64) * 0.02 * (i % 9)).tolist(), 1) for i in range(300)]  # many pairs near the threshold
    rows += [(1000 + i, rows[0][1], 1) for i in range(1200)] + [(3000, (base * 1e200).tolist(), 1), (3001, (base * 1e-200).tolist(), 1), (3002, [2.0], 1), (3003, [-2.0], 1), (3004, [5.0], 1), (3005, (base * 1e200).tolist(), None)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, slab string, code int")
    got = {r["vec_id"]: tuple(r)[1:] for r in ed.near_duplicates(docs, Scratch(spark), tile=64).collect()}
    one = [(k, (np.array(v) / np.abs(v).max()).tolist(), label) for k, v, label in rows if not 1000 < k < 3000]
    for k, links, low, kept in brute(one):
        x = np.array(dict((r[0], r[1]) for r in one)[k])
        copies = 1199 if len(x) == 64 and dict((r[0], r[2]) for r in one)[k] == 1 and x @ np.array(one[0][1]) / np.linalg.norm(x) / np.linalg.norm(one[0][1]) >= 0.98 else 0
        assert got[k] == (links + copies, low, kept), k
    assert all(got[1000 + i] == got[1000] for i in range(1200)) and got[1000][1] == 0

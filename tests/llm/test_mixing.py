import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sparknorm.llm import mixing as mx
from sparknorm.llm import queries
from sparknorm.llm.common import Scratch

SCHEMA = "doc_id long, text string, source string, pattern string, size long, copies int"


def targets_of(sizes):
    """The contract's targets by plain Python."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, total = {}, sum(sizes.values())
    while len(out) < len(names):
        live = [s for s in names if s not in out]
        rest, w = total - sum(out.values()), sum(weight[s] for s in live)
        over = [s for s in live if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / w for s in live}
        out |= {s: 3.0 * sizes[s] for s in over}
    return out


def check(rows, docs, near=0.05):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets_of(sizes)
    taken = {}
    assert len(rows) == len(docs)
    text = {}
    for d, t, s in docs:
        text.setdefault(d, set()).add((size(t), s))
    for r in rows:
        (s,) = {s for n, s in text[r["doc_id"]] if n == r["size"] and sizes[s] == r["source_size"]} or {None}
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, near * want[s]), (s, taken[s], want[s])


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 60])), rng.choice(["a", "b", "b", "b", "c", None, ""])) for i in range(n)]


def test_targets_and_reruns(spark):
    docs = [*corpus(600), (1000, None, "a"), (1001, "long " * 1500, "b"), (None, "no id", "c"), (3, "twice", "d"), (3, "twice", "d")]
    df = spark.createDataFrame([(*r, "p", 1, 1) for r in docs], SCHEMA)
    out = []
    for table in (df.repartition(5), df.repartition(2, "text")):
        mixed = mx.mix(table, Scratch(spark))
        rows = mx.copies(mixed)
        table_ = mx.source_table(mixed).collect()
        size = {r["source"]: r for r in table_}
        got = [{"doc_id": r["doc_id"], "size": r["size"], "taken": r["copies"] * r["size"], "source_size": size[s]["source_size"], "target": size[s]["target"]} for r in rows.collect() for s in [None if r["pattern"][0] == mx.NULL else r["pattern"][0]]]
        check(got, docs)
        out.append(sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got))
        repeated = mx.repeat_rows(table, mixed)
        assert repeated.columns == table.columns and repeated.count() == rows.agg(F.sum("copies")).first()[0]
    assert out[0] == out[1]
    empty = mx.mix(df.limit(0), Scratch(spark))
    assert mx.copies(empty).count() == 0 and mx.repeat_rows(df.limit(0), empty).count() == 0
    with pytest.raises(ValueError):
        mx.mix(df, Scratch(spark), max_patterns=2)


def best_cost(capacity, targets, most):
    """The largest amount routed and its least cost, over all whole-number routings."""
    arcs = [(p, s) for p in capacity for s in p]
    best = (0, 0)
    for amounts in itertools.product(*[range(most * capacity[p] + 1) for p, _ in arcs]):
        used, got = {}, {}
        for (p, s), n in zip(arcs, amounts, strict=True):
            used[p] = used.get(p, 0) + n
            got[s] = got.get(s, 0) + n
        if any(n > most * capacity[p] for p, n in used.items()) or any(n > targets[s] for s, n in got.items()):
            continue
        cost = sum(sum(max(0, min(n - k * capacity[p], capacity[p])) * k for k in range(most)) for p, n in used.items())
        best = max(best, (sum(amounts), -cost))
    return best


def test_flow_is_cheapest():
    rng = random.Random(0)
    for _ in range(25):
        patterns = rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)
        capacity = {p: rng.randint(1, 2) for p in patterns}
        targets = {s: float(rng.randint(0, 4)) for s in {s for p in patterns for s in p}}
        if sum(map(len, patterns)) > 5:
            continue
        got = mx.flow(capacity, targets, 2)
        used = {p: sum(v.values()) for p, v in got.items()}
        for s, want in targets.items():
            assert sum(v.get(s, 0) for v in got.values()) <= want + 1e-6
        cost = sum(sum(max(0, min(n - k * capacity[p], capacity[p])) * k for k in range(2)) for p, n in used.items())
        assert (round(sum(used.values())), -round(cost)) == best_cost(capacity, targets, 2)


def test_overlapping_sources(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(["w"] * rng.choice([3, 10, 30])), rng.choice([["a"], ["a", "b"], ["b", "c"], ["c"], []])) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, sources array<string>")
    mixed = mx.mix(df, Scratch(spark), weight={"a": 1, "b": 6, "c": 1, mx.NULL: 1}, sources=F.col("sources"))
    taken = mx.copies(mixed)
    total = sum(mixed.targets.values())
    got = taken.agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert abs(got - total) < 0.02 * total and taken.agg(F.max("copies")).first()[0] <= 3
    by = {}
    for r in taken.join(mixed.routes, "pattern").where("copies > 0").groupBy("source").agg(F.count("*").alias("n")).collect():
        by[r["source"]] = r["n"]
    assert set(by) == {"a", "b", "c", mx.NULL}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    check([r.asDict() for r in queries.op9_mixing(spark, d).collect()], docs, 0.25)  # ten documents a source


def test_short_documents_stand_in_for_a_long_one(spark):
    """The source's target lies between its short documents and its long one, which does not fit: they are used as often as they may."""
    docs = [(0, "w " * 30_000, "a"), *[(i, "w " * (i % 7 + 1), "a") for i in range(1, 300)], *[(1000 + i, "w " * 50, s) for i in range(300) for s in ("b", "c")]]
    df = spark.createDataFrame([(*r, "p", 1, 1) for r in docs], SCHEMA)
    mixed = mx.mix(df, Scratch(spark), weight={"a": 1.0, "b": 3.0, "c": 3.0})
    got = {r["doc_id"]: (r["copies"], r["size"]) for r in mx.copies(mixed).collect()}
    short = sum(i % 7 + 1 for i in range(1, 300))
    assert 3 * short < mixed.targets["a"] < 30_000
    assert got[0][0] == 0 and sum(c * n for i, (c, n) in got.items() if 0 < i < 1000) == 3 * short
    again = mx.repeat_rows(df, mixed)
    assert again.where("source = 'a'").count() == 3 * 299
    # with enough of them the target is met, and none goes beyond the most
    docs += [(5000 + i, "w " * 9, "a") for i in range(200)]
    df = spark.createDataFrame([(*r, "p", 1, 1) for r in docs], SCHEMA)
    mixed = mx.mix(df, Scratch(spark), weight={"a": 0.5, "b": 3.0, "c": 3.0})
    rows = mx.copies(mixed).collect()
    taken = sum(r["copies"] * r["size"] for r in rows if r["pattern"] == ["a"])
    assert max(r["copies"] for r in rows) <= 3 and abs(taken - mixed.targets["a"]) <= 0.02 * mixed.targets["a"]
    assert mx.repeat_rows(df, mixed).where("source = 'a'").count() == sum(r["copies"] for r in rows if r["pattern"] == ["a"])

"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents are summed by membership
pattern; a flow routes pattern capacity to source targets, where the k-th use
of a pattern costs k - 1, so repetition is spread before it deepens. Within a
pattern every document is used as often as the flow uses the whole pattern,
and those before a cut in a seeded hash order once more. Where the cut stops at a
long document, shorter ones behind it follow up to a second cut, and so on; in
the end the largest of each octave of sizes fills what is left, where it fits. Where
more than ``NEAR`` of a pattern's words is left even so, since documents are longer
than that, those that do fit are used more often, up to the most. Only pattern
sums and cuts reach the driver; documents are decided where they lie, next to a
broadcast of rows a pattern, so that a hot pattern is never gathered.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

MAX_REPEATS = 3
ROUNDS = 2  # cuts of a pattern, each with shorter documents
NEAR = 0.01  # of the words that a pattern owes: what may be left without using shorter documents again
MAX_PATTERNS = 200_000  # membership patterns that the flow accepts; more raise ValueError
NULL = "\0null"  # the null source


class Mix(NamedTuple):
    rows: DataFrame  # doc_id, pattern, size, chars, place
    plan: DataFrame  # pattern, base, cuts (of documents of at most so many characters), extra, again (of documents of at most so many words)
    routes: DataFrame  # pattern, source, until: a document before the first cut it does not exceed counts for that source
    sizes: dict[str, int]
    targets: dict[str, float]
    most: int
    short: bool  # whether any pattern has an ``again``


def order(sources: list[str]) -> list[str]:
    """By code point, the null source last."""
    return sorted(s for s in sources if s != NULL) + [NULL] * (NULL in sources)


def weights(sources: list[str], cycle: tuple[float, ...] = (5, 2, 1)) -> dict[str, float]:
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(order(sources))}


def fill(sizes: dict[str, int], weight: dict[str, float], most: float = MAX_REPEATS, total: float | None = None) -> dict[str, float]:
    """Targets in proportion to weights, none above ``most`` times its source's size; what is cut off is shared anew."""
    total = float(sum(sizes.values())) if total is None else total
    out: dict[str, float] = {}
    open_ = {s for s in sizes if weight.get(s, 0) > 0}
    out |= dict.fromkeys(set(sizes) - open_, 0.0)
    while open_:
        rest, w = total - sum(out.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > most * sizes[s]}
        if not over:
            out |= {s: rest * weight[s] / w for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return out


def flow(capacity: dict[tuple[str, ...], int], targets: dict[str, float], most: int = MAX_REPEATS) -> dict[tuple[str, ...], dict[str, float]]:
    """Min-cost flow from patterns (their size for each use, the k-th use at cost k - 1) to source targets.

    Successive cheapest paths. As costs only stand on a pattern's uses, the
    cheapest path for a level of use is any path of residual arcs, so each
    level is a maximal flow that keeps what lower levels carry.
    """
    got: dict[tuple[str, ...], dict[str, float]] = {p: {} for p in capacity}
    need = dict(targets)
    tiny = 1e-9 * max(1.0, sum(targets.values()))
    users: dict[str, dict[tuple[str, ...], None]] = {}  # in order, so that reruns agree
    for level in range(1, most + 1):
        for p in sorted(capacity, key=lambda p: (len(p), p)):
            spare = float(level * capacity[p]) - sum(got[p].values())
            while spare > tiny:
                # breadth first from the pattern: over its sources, back over patterns that feed them, to a source in need
                back: dict[str, tuple[str | None, tuple[str, ...]]] = {s: (None, p) for s in p if s in need}
                queue = list(back)
                end = next((s for s in queue if need[s] > tiny), None)
                for s in queue:
                    if end is not None:
                        break
                    for q in users.get(s, ()):
                        if got[q].get(s, 0) <= tiny:
                            continue
                        for t in q:
                            if t in need and t not in back:
                                back[t] = (s, q)
                                queue.append(t)
                                if need[t] > tiny:
                                    end = t
                if end is None:
                    break
                amount, s = min(spare, need[end]), end
                while back[s][0] is not None:
                    amount, s = min(amount, got[back[s][1]][back[s][0]]), back[s][0]
                need[end] -= amount
                s = end
                while s is not None:
                    prev, q = back[s]
                    got[q][s] = got[q].get(s, 0) + amount
                    users.setdefault(s, {})[q] = None
                    if prev is not None:
                        got[q][prev] -= amount
                    s = prev
                spare -= amount
    return got


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def characters(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def place(id_col: str, text_col: str, seed: int) -> Column:
    """A row's place in the seeded order, in 0 .. 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)


def pattern(sources: Column) -> Column:
    """Of an array of sources: sorted and distinct, nulls named; no source at all is the null source."""
    named = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(s.cast("string"), F.lit(NULL)))))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(NULL)))


def _cuts(rows: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """(pattern, mark, cut): the largest place whose document ends within the first ``upto`` words of its pattern; -1 for none."""
    spark = rows.sparkSession
    bucket = F.shiftright("place", 63 - bits)
    sums = rows.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the bucket that holds the mark, and the last place before it otherwise
    held = sums.join(marks, "pattern").where("at <= upto")
    last = held.groupBy("pattern", "mark", "upto").agg(F.max(F.struct("bucket", "at")).alias("b")).select("pattern", "mark", "upto", "b.bucket", "b.at")
    inside = Window.partitionBy("pattern", "mark").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("bucket", bucket).join(F.broadcast(last), ["pattern", "bucket"])  # a row a mark; about 2000 documents a bucket
    near = near.withColumn("end", F.col("at") + F.sum("size").over(inside))
    cuts = near.groupBy("pattern", "mark").agg(F.max(F.when(F.col("end") <= F.col("upto"), F.col("place"))).alias("cut"), (F.shiftleft(F.max("bucket"), 63 - bits) - 1).alias("low"))
    found = cuts.select("pattern", "mark", F.coalesce("cut", "low").alias("cut")).collect()  # a row for each mark, at most patterns times sources
    return spark.createDataFrame([tuple(r) for r in found], "pattern array<string>, mark int, cut long")


def mix(docs: DataFrame, scratch: Scratch, weight: dict[str, float] | None = None, seed: int = 17, most: int = MAX_REPEATS, max_patterns: int = MAX_PATTERNS, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None) -> Mix:
    """Plans the mix. ``sources`` is an array column, by default the column ``source`` alone.

    A null text has size 0, and so has one without words; such documents are
    taken or not like others, at no cost. A null source is a source of its own.
    Rows equal in id and text have one place in the order and are decided
    alike, ties of other rows by chance of the hash. No rows: no plan rows. More
    than ``max_patterns`` patterns raise ValueError.
    """
    spark = docs.sparkSession
    member = pattern(F.array(F.col("source")) if sources is None else sources)
    rows = scratch.save(docs.select(F.col(id_col).alias("doc_id"), member.alias("pattern"), word_count(F.col(text_col)).alias("size"), characters(F.col(text_col)).alias("chars"), place(id_col, text_col, seed).alias("place")), "sizes")
    found = rows.groupBy("pattern").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {tuple(r["pattern"]): r["n"] for r in found}
    sizes: dict[str, int] = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = fill(sizes, weight or weights(list(sizes)), most, float(sum(capacity.values())))
    routed = flow(capacity, targets, most)
    bits = max(8, min(40, math.ceil(math.log2(max(1, sum(r["docs"] for r in found)) / 2000 + 1))))
    base, marks, names = [], [], []
    for p, n in capacity.items():
        used = sum(routed[p].values())
        copies = min(most, math.floor(used / n + 1e-9)) if n else 0
        base.append((list(p), copies))
        if copies < most and n:
            marks.append((list(p), 0, float(max(0.0, used - copies * n))))
        at = 0.0
        for i, (s, words) in enumerate(sorted(routed[p].items()), 1):
            if words > 0:
                at += words / used * n
                names.append((list(p), i, s))
                marks.append((list(p), i, at))
    cuts = _cuts(rows, spark.createDataFrame(marks, "pattern array<string>, mark int, upto double"), bits)
    state = {tuple(p): (-1, u) for p, m, u in marks if m == 0}  # the last cut, and words left
    chosen: dict[tuple[str, ...], list[tuple[int, int]]] = {p: [] for p in capacity}
    now = "pattern array<string>, cut long, left double"
    for turn in range(ROUNDS):
        if turn:  # so many characters hold no more words than are left
            at = spark.createDataFrame([(list(p), c, u) for p, (c, u) in state.items()], now)
            behind = rows.join(F.broadcast(at), "pattern").where("place > cut and chars < 2 * left").drop("cut", "left")
            found = _cuts(behind, spark.createDataFrame([(list(p), 0, u) for p, (_, u) in state.items()], "pattern array<string>, mark int, upto double"), bits)
        else:
            behind, found = rows, cuts.where("mark = 0")
        used = {tuple(r["pattern"]): (r["cut"], r["n"]) for r in behind.join(F.broadcast(found), "pattern").groupBy("pattern", "cut").agg(F.sum(F.when(F.col("place") <= F.col("cut"), F.col("size")).otherwise(0)).alias("n")).collect()}
        for p, (cut, n) in used.items():
            last, left = state[p]
            if cut > last:
                chosen[p].append((cut, math.ceil(2 * left) - 1 if turn else 2**62))
                state[p] = cut, left - n
    at = spark.createDataFrame([(list(p), c, u) for p, (c, u) in state.items()], now)
    fits = rows.where("size > 0").join(F.broadcast(at), "pattern").where("place > cut and size <= left")
    best: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for r in fits.groupBy("pattern", F.floor(F.log2("size")).alias("octave")).agg(F.max(F.struct("size", "place")).alias("b")).collect():  # under 64 rows a pattern
        best.setdefault(tuple(r["pattern"]), []).append((r["b"]["size"], r["b"]["place"]))
    filled, owed = [], {}
    for p, (_, n) in state.items():
        taken = []
        for size, at in sorted(best.get(p, []), reverse=True):
            if size <= n:
                n -= size
                taken.append(at)
        filled.append((list(p), taken))
        if n > NEAR * sum(routed[p].values()):
            owed[p] = n
    extra = spark.createDataFrame(filled, "pattern array<string>, extra array<long>")
    taken_cuts = spark.createDataFrame([(list(p), c) for p, c in chosen.items()], "pattern array<string>, cuts array<struct<cut: long, chars: long>>")
    plan = spark.createDataFrame(base, "pattern array<string>, base int").join(taken_cuts, "pattern", "left").join(extra, "pattern", "left")
    plan = plan.withColumn("extra", F.coalesce("extra", F.array().cast("array<long>")))
    repeats: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    kind = "pattern array<string>, again array<struct<size: long, cut: long>>"
    none = plan.withColumn("again", F.array().cast("array<struct<size: long, cut: long>>"))
    for _ in range(most):  # another use of the documents that fit: of all, or up to a cut, which ends it
        if not owed:
            break
        so_far = none.drop("again").join(spark.createDataFrame([(list(p), repeats.get(p, [])) for p in capacity], kind), "pattern")
        left = spark.createDataFrame([(list(p), float(n)) for p, n in owed.items()], "pattern array<string>, owed double")
        near = _counted(rows.join(F.broadcast(left), "pattern").where("size > 0 and size <= owed"), so_far, most).where(F.col("copies") < most)
        all_of = {tuple(r["pattern"]): r["n"] for r in near.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
        part = {p: n for p, n in owed.items() if p in all_of and all_of[p] > n}
        ends = {}
        if part:
            found = _cuts(near.drop("copies", "owed"), spark.createDataFrame([(list(p), 0, n) for p, n in part.items()], "pattern array<string>, mark int, upto double"), bits)
            ends = {tuple(r["pattern"]): r["cut"] for r in found.collect()}
        new = {}
        for p, n in owed.items():
            if p in all_of:
                repeats.setdefault(p, []).append((int(n), ends.get(p, -1) if p in part else 2**63 - 1))
                if p not in part and n - all_of[p] > NEAR * sum(routed[p].values()):
                    new[p] = n - all_of[p]
        owed = new
    plan = none.drop("again").join(spark.createDataFrame([(list(p), repeats.get(p, [])) for p in capacity], kind), "pattern")
    routes = spark.createDataFrame(names, "pattern array<string>, mark int, source string").join(cuts, ["pattern", "mark"]).select("pattern", "source", F.col("cut").alias("until"))
    return Mix(rows, plan, routes, sizes, targets, most, bool(repeats))


def _counted(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """Rows (pattern, size, chars, place) with the number of copies that a plan takes."""
    more = F.exists("cuts", lambda c: (F.col("place") <= c["cut"]) & (F.col("chars") <= c["chars"])) | F.array_contains("extra", F.col("place"))
    again = F.size(F.filter("again", lambda a: (F.col("size") > 0) & (F.col("size") <= a["size"]) & (F.col("place") <= a["cut"])))
    taken = F.least(F.col("base") + more.cast("int") + again, F.lit(most))
    # a row a pattern, at most max_patterns, with ROUNDS cuts, under 64 places and at most ``most`` repeats each
    return rows.join(F.broadcast(plan), "pattern", "left").withColumn("copies", F.coalesce(taken, F.lit(0))).drop("base", "cuts", "extra", "again")


def copies(mixed: Mix, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` (by default the planned ones; they need pattern, size, chars and place) with the number of copies to take."""
    return _counted(mixed.rows if rows is None else rows, mixed.plan, mixed.most)


def source_table(mixed: Mix) -> DataFrame:
    rows = [(None if s == NULL else s, int(n), float(mixed.targets[s])) for s, n in mixed.sizes.items()]
    return mixed.rows.sparkSession.createDataFrame(rows, "source string, source_size long, target double")


def repeat_rows(docs: DataFrame, mixed: Mix, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    names = docs.columns
    member = pattern(F.array(F.col("source")) if sources is None else sources)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"), member.alias("pattern"), characters(F.col(text_col)).alias("chars"), (word_count(F.col(text_col)) if mixed.short else F.lit(0).cast("long")).alias("size"), place(id_col, text_col, seed).alias("place"))
    taken = copies(mixed, whole).where("copies > 0")
    return taken.select("d", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("d.*")

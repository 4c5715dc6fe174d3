"""The prefix trie of conversations by partition refinement.

All conversations start in one class, the root. A wave splits the classes that
are still active by each of the next turns: two rolling hashes, carried from
the wave before, name a class, and one grouped count a wave finds the classes
of all its depths. A class of one conversation is retired: its tail is emitted
as a chain without looking at its turns again. Waves widen from ``FIRST`` turns
to ``WIDEST``, so long shared starts take few of them and what a wave looks at
beyond a retirement stays below what led there.

Sums over subtrees are folded back along representatives: a childless node and
a node's tokens are booked on the node's smallest member, and a node's sums are
those of its members from its depth on. No class is gathered; rows carry hashes
and numbers, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, spread_join

FIRST = 4  # turns of the first wave
WIDEST = 4096  # and of the widest
PIECE = 1 << 16  # characters of joined ids in a row
KEY = ["depth", "x1", "x2"]


def rebuild(turns: DataFrame, sizes: DataFrame, scratch: Scratch, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another's: turns (conv_id, depth, total, k1, k2, size) and conversations (conv_id, total).

    Conversation c takes the first h turns of c - c % family, all if there are
    fewer and none if it is absent, then its own behind its first h; h is
    crc32(c as text) % most. Remainders have the sign of c.
    """
    lent = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    plan = sizes.select("conv_id", "turns", lent.alias("h"), F.expr(f"conv_id - conv_id % {int(family)}").alias("base"))
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("held"))
    plan = plan.join(heads, "base", "left").withColumn("lent", F.least("h", F.coalesce("held", F.lit(0))))
    plan = scratch.save(plan.select("*", (F.col("lent") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("total")), "plan")
    own = spread_join(turns, plan.select("conv_id", "h", "lent", "total", "turns"), ["conv_id"], "turns").where("pos > h").withColumn("depth", F.expr("pos - h + lent"))
    taken = turns.where((F.col("pos") < most) & F.expr(f"conv_id % {int(family)} = 0")).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "h", "total"), "base").where("pos <= h").withColumn("depth", F.col("pos"))
    columns = ["conv_id", "depth", "total", "k1", "k2", "size"]
    return scratch.save(own.select(columns).union(taken.select(columns)), "turns"), plan.select("conv_id", "total")


def whole(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form that ``build`` takes."""
    return spread_join(turns, sizes.withColumn("total", F.col("turns")), ["conv_id"], "turns").withColumnRenamed("pos", "depth"), sizes.withColumnRenamed("turns", "total")


def _refine(turns: DataFrame, scratch: Scratch, first: int, widest: int) -> list[tuple[DataFrame, DataFrame, int]]:
    """Of each wave: the path of every active conversation, the classes on it, and the wave's last depth."""
    waves, done, width, active = [], 0, first, None
    inside = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        rows = turns.where(F.col("depth").between(done + 1, done + width))
        rows = rows.withColumns({"c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long")}) if active is None else rows.join(active, "conv_id")
        own = {"1": F.xxhash64("depth", "k1", "k2"), "2": F.xxhash64("k2", "k1", "depth")}
        rows = rows.select("conv_id", "depth", "total", "size", "c1", "c2", *[c.alias(f"o{i}") for i, c in own.items()])
        rows = rows.withColumns({f"x{i}": F.bit_xor(f"o{i}").over(inside).bitwiseXOR(F.col(f"c{i}")) for i in own})
        path = scratch.save(rows.select("conv_id", "depth", "total", "size", "x1", "x2", *[F.col(f"x{i}").bitwiseXOR(F.col(f"o{i}")).alias(f"p{i}") for i in own]), "path")
        ends = F.col("depth") == F.col("total")
        nodes = path.groupBy(*KEY).agg(F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("total").alias("total"), F.count_if(ends).alias("ends"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
        nodes = scratch.save(nodes, "nodes")
        done += width
        waves.append((path, nodes, done))
        left = path.where((F.col("depth") == done) & (F.col("total") > done)).select("conv_id", F.col("x1").alias("c1"), F.col("x2").alias("c2"))
        active = scratch.save(left.join(nodes.where("n = 1").select(F.col("low").alias("conv_id")), "conv_id", "left_anti"), "active")
        if active.isEmpty():
            return waves
        width = min(2 * width, widest)


def _join_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, block, conv_id) to pieces (key, first id, ids joined)."""
    key, ids, size = None, [], 0

    def piece() -> pa.RecordBatch:
        arrays = [*(pa.array([k], pa.int64()) for k in key[:3]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])]
        return pa.RecordBatch.from_arrays(arrays, [*KEY, "start", "ids"])

    for batch in batches:
        for *k, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if ids and (k != key or size > PIECE):
                yield piece()
                ids, size = [], 0
            key = k
            ids.append(c)
            size += len(str(c)) + 1
    if ids:
        yield piece()


def _digest_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to the digest of each key's ids; a digest's state is all that is held."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([state.hexdigest()])], [*KEY, "ends_sha256"])

    for batch in batches:
        for *k, _, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if k != key:
                if key is not None:
                    yield row()
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if key is not None:
        yield row()


def _ends(ended: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, ends_sha256) of the conversations that end at each node; a node's ids are joined block by block before one task sees them."""
    ended = scratch.save(ended, "ended")
    low, high, n = ended.agg(F.min("conv_id"), F.max("conv_id"), F.count(F.lit(1))).first()
    width = (high - low) // max(n, 1) * 1024 + 1024 if n else 1
    dealt = ended.withColumn("block", F.expr(f"floor(conv_id / {width})")).repartition(*KEY, "block").sortWithinPartitions(*KEY, "block", "conv_id")
    longs = ", ".join(f"{k} long" for k in KEY)
    pieces = dealt.select(*KEY, "block", "conv_id").mapInArrow(_join_ids, f"{longs}, start long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "start").mapInArrow(_digest_ids, f"{longs}, ends_sha256 string")


def build(turns: DataFrame, convs: DataFrame, scratch: Scratch, first: int = FIRST, widest: int = WIDEST) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, depth (from 1, without gaps), total (of its
    conversation), k1, k2 (identity of the turn) and size (its tokens);
    ``convs`` has conv_id and total, also of conversations without turns. No
    conversations, no nodes. Equal conversations share all nodes and end
    together. A node's saved tokens are its size times its members but one,
    summed over its subtree.
    """
    waves = _refine(turns, scratch, first, widest)
    found = waves[0][1]
    for _, nodes, _ in waves[1:]:
        found = found.union(nodes)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("total") == 0).alias("ends")).where("n > 0")
    root = root.select(*[zero.alias(k) for k in KEY], "low", "n", zero.alias("size"), zero.alias("total"), "ends", *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2")])
    tails = found.where("n = 1").groupBy("low").agg(F.min("depth").alias("depth"), F.min_by(F.struct("p1", "p2"), "depth").alias("p"), F.max("total").alias("total"))
    tails = scratch.save(tails.select("low", "depth", "total", "p.p1", "p.p2"), "tails")
    many = found.where("n > 1").unionByName(root)
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    children = many.where("depth > 0").select(*above).union(tails.select(*above)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    trunk = scratch.save(many.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trunk")

    leaves = scratch.save(tails.select(F.col("low").alias("conv_id")).union(trunk.where("n_children = 0").select("low")), "leaves")
    weights = scratch.save(trunk.select(F.col("low").alias("conv_id"), "depth", ((F.col("n") - 1) * F.col("size")).alias("w")).where("w > 0"), "weights")
    sums = None
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    beyond = F.lit(2**62)  # a depth behind all others
    begin = 0
    for path, _, end in waves:
        none = [F.lit(None).cast("long").alias(k) for k in ("x1", "x2")]
        rows = path.select("conv_id", "depth", "x1", "x2", zero.alias("w"), zero.alias("leaf"))
        rows = rows.union(weights.where(F.col("depth").between(begin + 1, end)).select("conv_id", "depth", *none, "w", zero))
        rows = rows.union(weights.where(F.col("depth") > end).groupBy("conv_id").agg(F.sum("w").alias("w")).select("conv_id", beyond, *none, "w", zero))
        rows = rows.union(leaves.select("conv_id", beyond, *none, zero, F.lit(1).cast("long")))
        rows = rows.withColumns({"saved": F.sum("w").over(down), "reached": F.max("leaf").over(down)}).where("x1 is not null and (saved > 0 or reached > 0)")
        part = scratch.save(rows.groupBy(*KEY).agg(F.sum("reached").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "sums")
        sums, begin = part if sums is None else sums.union(part), end
    total = leaves.agg(F.count(F.lit(1)).alias("n_leaves")).crossJoin(F.broadcast(weights.agg(F.coalesce(F.sum("w"), zero).alias("saved_tokens"))))  # one row each
    sums = sums.union(total.select(*[zero for _ in KEY], "n_leaves", "saved_tokens"))

    ended = convs.where("total = 0").select(*[zero.alias(k) for k in KEY], "conv_id")
    for path, _, _ in waves:
        ended = ended.union(path.where("depth = total").select(*KEY, "conv_id"))
    digests = _ends(ended.join(tails.select(F.col("low").alias("conv_id")), "conv_id", "left_anti").select(*KEY, "conv_id"), scratch)

    empty = hashlib.sha256(b"").hexdigest()
    full = trunk.join(sums, KEY, "left").join(digests, KEY, "left")
    full = full.select(*KEY, "low", "p1", "p2", "total", "n", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    nodes = scratch.save(full.unionByName(tails.select("low", "depth", "p1", "p2", "total", F.lit(1).cast("long").alias("n")), allowMissingColumns=True), "full")
    parents = trunk.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("low").alias("parent_conv_id"), "n_children").where("n_children > 0")
    placed = spread_join(nodes, parents.withColumnRenamed("n_children", "w"), ["depth", "p1", "p2"], "w", "left")
    shared = placed.where("n_children is not null").select(F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    # a chain is counted out in two steps, so that no array grows with its length
    chains = placed.where("n_children is null").withColumn("hop", F.explode(F.sequence(zero, F.expr(f"(total - depth) div {WIDEST}"))))
    start = F.col("depth") + F.col("hop") * WIDEST
    chains = chains.withColumn("at", F.explode(F.sequence(start, F.least(start + (WIDEST - 1), F.col("total")))))
    last = F.col("at") == F.col("total")
    one, parent = F.lit(1).cast("long"), F.when(F.col("at") == F.col("depth"), F.col("parent_conv_id")).otherwise(F.col("low"))
    single = chains.select(F.col("low").alias("conv_id"), F.col("at").alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("low").cast("string"), 256)).otherwise(empty).alias("ends_sha256"))
    return shared.unionByName(single)

"""The order of turns in conversations, without gathering a conversation.

Rows are dealt by ranges of conversation and order, so a conversation of any
length spreads over as many partitions as its rows ask for. Each partition is
numbered as it streams by; only a conversation that crosses a border of
partitions needs the counts of its earlier ones, and there are at most two of
these a partition, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LEAD = 64  # characters of a text that order turns of equal number and role


def hashes(*columns: str) -> list:
    """Two 64-bit hashes, together an identity of values."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("other"), *reversed(columns)).alias("k2")]


def runs(conv: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if len(conv) else np.empty(0, np.int64)


def _number(at: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(at).to_numpy()
            first = runs(conv)
            size = np.diff(np.append(first, len(conv)))
            pos = np.arange(1, len(conv) + 1) - np.repeat(first, size)
            if conv[0] == last:
                pos[: size[0]] += seen
            last, seen = conv[-1], pos[-1]
            columns = [*batch.columns, pa.array(pos.astype(np.int64)), pa.array(np.full(len(conv), part, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "pos", "part"])

    return run


def numbered(rows: DataFrame, order: Sequence[str], keep: Sequence[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, the columns to keep, pos from 1 in each conversation) and sizes (conv_id, turns). ``conv_id`` is a long without nulls."""
    sorted_ = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select("conv_id", *keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_.schema) + ", pos long, part int"
    local = scratch.save(sorted_.mapInArrow(_number(0), schema), "numbered")
    spans = scratch.save(local.groupBy("conv_id", "part").agg(F.max("pos").alias("n")), "spans")
    whole = spans.groupBy("conv_id").agg(F.sum("n").alias("turns"), F.collect_list(F.struct("part", "n")).alias("spans"))  # a span a partition
    earlier = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + F.when(x["part"] < F.col("span.part"), x["n"]).otherwise(0))
    borders = whole.where(F.size("spans") > 1).select("conv_id", F.explode("spans").alias("span"), "spans").select("conv_id", F.col("span.part").alias("part"), earlier.alias("before"))
    placed = local.join(F.broadcast(borders), ["conv_id", "part"], "left").withColumn("pos", F.col("pos") + F.coalesce("before", F.lit(0)))
    return placed.drop("part", "before"), whole.select("conv_id", "turns")


def by_turn(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, k1, k2, size, pos) and sizes (conv_id, turns); null role or text is empty, rows of a null conv_id are left out.

    Turns are ordered by number, null first; those of equal number by role, the
    text's first ``LEAD`` characters and its hash. k1 and k2 identify role and text.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    rows = rows.select("conv_id", "turn", "role", F.substring("text", 1, LEAD).alias("lead"), *hashes("role", "text"), F.length("text").cast("long").alias("size"))
    return numbered(rows, ["turn", "role", "lead", "k1"], ["k1", "k2", "size"], scratch)

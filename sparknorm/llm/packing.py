"""Mixture-controlled packing by deficit round-robin over source queues.

Every window of ``length`` tokens credits each source its target share. The
source with the largest deficit is served next, from its queue's head, until
its deficit is used up, or the document or the window ends, but with ``least``
tokens where they are there, so that documents are not cut to crumbs. So a
window's tokens of a source differ from the target by that much at most, for
each source still open; the difference stays as a deficit for the windows
behind. The token stream is dealt to blocks:
each source's queue is cut at the same fractions, so a block holds nearly the
target mixture. A block starts with the deficits that all blocks before it
leave, known from sums of tokens by block and source, and in the middle of
the window where the block before it ends, so only the last window is short.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices, trimmed
from .tokens import default_vocabulary, encoder

LEAST = 256  # tokens of a piece, unless its document or window ends
SALTS = 64  # parts of a source's queue whose lengths are summed apart
PIECES = "row long, start long, length long, sequence_id long, offset long"


def tokenise(docs: DataFrame, scratch: Scratch, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, n, ids) of every row, saved; ids little-endian unsigned 16 or 32 bit, the end id last.

    A null text is empty, so it has the end id alone. ``row`` is unique.
    """
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        short = enc.vocabulary_size() <= 1 << 16 and end_id < 1 << 16
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in slices(batch, "t"):
                flat, ends = enc.encode(texts)
                flat = np.insert(flat, ends, end_id).astype("<u2" if short else "<u4")
                ids = np.split(flat, (ends + np.arange(1, len(ends) + 1))[:-1])
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(range(row, row + len(ids)), pa.int64()),
                        "doc_id": part.column(0),
                        "source": part.column(1),
                        "n": pa.array([len(x) for x in ids], pa.int64()),
                        "wide": pa.array([not short] * len(ids), pa.bool_()),
                        "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
                    }
                )
                row += len(ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("t"))
    return scratch.save(rows.mapInArrow(trimmed(encode), "row long, doc_id long, source string, n long, wide boolean, ids binary"), "ids")


def schedule(queues: dict[str, list[tuple[int, int]]], given: Callable[[list[str], float], np.ndarray], had: dict[str, float], position: int, length: int, least: int = LEAST) -> list[tuple[int, int, int, int, int]]:
    """Deficit round-robin over queues of (row, tokens), from a position in the stream: (row, start, length, window, offset).

    ``given`` says what sources are due up to a position, ``had`` what they had before this one.
    A piece has at least ``least`` tokens, fewer where many sources are open: a
    window then still has room for a piece of each, and no source is further
    from its due than its share of a window and one such piece.
    """
    names = sorted(queues)
    due = given(names, position)
    deficit = (due - np.array([had[s] for s in names], float)).tolist()
    own, head, used = [queues[s] for s in names], [0] * len(names), [0] * len(names)
    live = [k for k in range(len(names)) if own[k]]
    left = sum(n for q in queues.values() for _, n in q)
    out = []
    while left:
        room = min(length - position % length, left)
        due, before = given(names, position + room), due
        deficit = [d + c for d, c in zip(deficit, (due - before).tolist(), strict=True)]
        window, offset, ahead = position // length, position % length, room
        order = [(-deficit[k], k) for k in live]
        heapq.heapify(order)
        smallest = max(1, min(least, max(64, length // max(1, len(live)))))
        while room:
            d, k = order[0]
            row, n = own[k][head[k]]
            take = min(room, n - used[k], max(smallest, math.ceil(-d)))
            out.append((row, used[k], take, window, offset))
            room, offset = room - take, offset + take
            deficit[k] -= take
            used[k] += take
            if used[k] == n:
                head[k], used[k] = head[k] + 1, 0
            if head[k] == len(own[k]):
                heapq.heappop(order)
                live.remove(k)
            else:
                heapq.heapreplace(order, (-deficit[k], k))
        position, left = position + ahead, left - ahead
    return out


class Fluid:
    """Where the stream stands if all sources flow at once, at their weights until they are used up.

    ``sizes`` are the tokens of the weighted sources, few as their weights are
    given; the others follow at their own shares, known by their sizes.
    """

    def __init__(self, sizes: dict[str, int], weight: dict[str, float], total: int):
        self.sizes, self.weight = sizes, {s: weight[s] for s in sizes}
        self.lead, self.total = sum(sizes.values()), total
        self.bends = []  # position, time, and weight of what flows until then
        at = time = 0.0
        for s in sorted(sizes, key=lambda s: (sizes[s] / weight[s], s)):
            live = sum(w for q, w in self.weight.items() if sizes[q] / w > time)
            if live and sizes[s] / weight[s] > time:
                self.bends.append((at, time, live))
                at, time = at + live * (sizes[s] / weight[s] - time), sizes[s] / weight[s]

    def position(self, s: str, at: str, size: str) -> Column:
        """Stream position of a place in a source's queue."""
        behind = self.lead + F.col(at) / F.col(size) * float(self.total - self.lead)
        if not self.weight:
            return behind
        time = F.col(at) / F.create_map(*[F.lit(x) for pair in self.weight.items() for x in pair])[F.col(s)]
        flowed = sum([F.least(F.lit(float(n)), self.weight[q] * time) for q, n in self.sizes.items()], F.lit(0.0))
        return F.when(F.col(s).isin(list(self.weight)), flowed).otherwise(behind)

    def given(self, names: list[str], sizes: np.ndarray, position: float) -> np.ndarray:
        """Tokens that each source has given when the stream stands at a position."""
        out = sizes * max(0.0, position - self.lead) / max(1, self.total - self.lead)
        bend = next((b for b in reversed(self.bends) if position >= b[0]), (0.0, 0.0, 1.0))
        time = bend[1] + (position - bend[0]) / bend[2]
        for i, s in enumerate(names if self.weight else ()):
            if s in self.weight:
                out[i] = min(float(sizes[i]), self.weight[s] * time)
        return out


def _before(cells: DataFrame, keys: list[str], n: str, name: str, wide: int = 4096) -> DataFrame:
    """Cells (keys, block, n) with the sum of all earlier blocks of the key, counted up by stretches of ``wide`` blocks, so that no task has all blocks of a key."""
    cells = cells.withColumn("stretch", F.floor(F.col("block") / wide))
    ahead = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = cells.groupBy(*keys, "stretch").agg(F.sum(n).alias("_n"))
    whole = whole.select(*keys, "stretch", F.coalesce(F.sum("_n").over(ahead("stretch", *keys)), F.lit(0)).alias("_at"))
    inside = cells.withColumn("_in", F.coalesce(F.sum(n).over(ahead("block", *keys, "stretch")), F.lit(0)))
    return inside.join(whole, [*keys, "stretch"]).withColumn(name, F.col("_at") + F.col("_in")).drop("stretch", "_at", "_in")


def pack(tokens: DataFrame, scratch: Scratch, length: int = 1024, targets: dict[str | None, float] | None = None, block_tokens: int = 1 << 20, least: int = LEAST) -> DataFrame:
    """Pieces of ``tokenise``'s rows: (row, start, length, sequence_id, offset).

    ``targets`` are weights by source, None for the null one. Their sources are
    used up at these proportions; one that runs out leaves its part to the
    others, and sources without a weight come behind them. By default all
    sources count as such, so that each has its own share of all tokens
    throughout and all end together. Every token lies in exactly one piece.
    Repeated rows are documents of their own. No rows: no pieces.
    """
    spark = tokens.sparkSession
    meta = tokens.select("row", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"), "n")
    total = meta.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, round(total / block_tokens))
    salts = max(SALTS, blocks)
    # a row's place in its source's queue: salted parts in order, then rows in order
    meta = meta.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    parts = meta.groupBy("s", "salt").agg(F.sum("n").alias("part_n"))
    before = Window.partitionBy("s").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("s", "salt", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("part_at"), F.sum("part_n").over(Window.partitionBy("s")).alias("source_n"))
    inside = Window.partitionBy("s", "salt").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = meta.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, ["s", "salt"]).select("row", "s", "n", (F.col("part_at") + F.col("inner")).alias("at"), "source_n")
    weight = {"" if k is None else f"={k}": float(v) for k, v in (targets or {}).items() if v > 0}
    sized = {r["s"]: r["n"] for r in meta.where(F.col("s").isin(list(weight))).groupBy("s").agg(F.sum("n").alias("n")).collect()} if weight else {}
    fluid = Fluid(sized, weight, total)
    placed = placed.withColumn("block", F.least(F.floor(fluid.position("s", "at", "source_n") / max(total, 1) * blocks), F.lit(blocks - 1)).cast("long"))
    placed = scratch.save(placed, "placed")
    # what stands before each block, over all sources and of each source
    cells = placed.groupBy("block", "s").agg(F.sum("n").alias("cell_n"))
    sizes = cells.groupBy("block").agg(F.sum("cell_n").alias("block_n"))
    starts = _before(sizes, [], "block_n", "block_at").select("block", "block_at")
    cells = _before(scratch.save(cells, "cells"), ["s"], "cell_n", "had").join(starts, "block").select("block", "s", "block_at", "had")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "at", "row"])
        first = pdf.drop_duplicates("s").set_index("s")
        queues = {s: list(zip(g["row"].tolist(), g["n"].tolist(), strict=True)) for s, g in pdf.groupby("s")}
        sizes = first["source_n"].sort_index().to_numpy(float)  # in the order of the schedule's names
        given = lambda names, at: fluid.given(names, sizes, at)
        found = schedule(queues, given, first["had"].to_dict(), int(pdf["block_at"].iloc[0]), length, least)
        return pd.DataFrame(found, columns=["row", "start", "length", "sequence_id", "offset"])

    return placed.join(cells, ["block", "s"]).select("block", "s", "row", "n", "at", "source_n", "had", "block_at").groupBy("block").applyInPandas(run, PIECES)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _crcs(ids: pd.Series, wide: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
    def each(b: bytes, w: bool, at: np.ndarray, n: np.ndarray) -> list[int]:
        data = b if w else np.frombuffer(b, "<u2").astype("<u4").tobytes()
        return [zlib.crc32(data[4 * s : 4 * (s + k)]) for s, k in zip(at.tolist(), n.tolist(), strict=True)]

    return pd.Series([each(*x) for x in zip(ids, wide, starts, lengths, strict=True)])


def with_checksums(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row a piece, with its document, the document's tokens and the crc32 of the piece's ids as unsigned 32-bit integers.

    ``pieces`` and ``tokens`` meet by row, so documents of one id, or of none, are told apart. No pieces: no rows.
    """
    by_row = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("p"))
    found = tokens.select("row", "doc_id", "n", "wide", "ids").join(by_row, "row")
    found = found.select("doc_id", "n", F.arrays_zip("p", _crcs("ids", "wide", F.col("p.start"), F.col("p.length")).alias("crc")).alias("z"))
    return found.select("doc_id", F.col("n").alias("doc_tokens"), F.explode("z").alias("z")).select(
        "doc_id", "z.p.start", "z.p.length", F.col("z.crc").alias("ids_crc32"), "doc_tokens", "z.p.sequence_id", "z.p.offset"
    )

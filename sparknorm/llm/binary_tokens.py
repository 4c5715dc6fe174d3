"""Fixed-width bit packing of token ids, with block offsets.

A segment is one self-contained binary value:

    4s  magic "FWB1"      u8  bits per id       3x
    u32 ids per block     u64 documents         u64 ids
    u64[blocks + 1]       byte offset of each block in the payload
    u64[documents]        end of each document, in ids of the segment
    payload               blocks of bit-packed ids, the last one filled with 0

Every block starts on a byte, so any range of ids is read by unpacking only
its blocks. A token file is a Parquet table with one segment a row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, slices
from .tokens import default_vocabulary, encoder

HEAD = struct.Struct("<4sB3xIQQ")
BLOCK = 4096  # ids; a multiple of 64, so that whole words hold a block
SEGMENT = 1 << 19  # ids after which a segment is closed, at a document's end
SEGMENTS = "part int, segment int, n_docs long, n_ids long, doc_ids binary, null_ids long, body binary"


def width(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the ids, ``bits`` each, lowest bits first; the count must be a multiple of 64."""
    rows = ids.reshape(-1, 64).astype(np.uint64)
    out = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").view(np.uint8).reshape(-1)


def unpack_bits(data: np.ndarray, bits: int) -> np.ndarray:
    rows = data.view("<u8").reshape(-1, bits).astype(np.uint64)
    out = np.empty((len(rows), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        v = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = v & mask
    return out.reshape(-1)


def write_segment(ids: np.ndarray, ends: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if block % 64:
        raise ValueError("a block holds a multiple of 64 ids")
    blocks = -(-len(ids) // block)
    full = np.zeros(-(-len(ids) // 64) * 64, np.uint32)
    full[: len(ids)] = ids
    body = pack_bits(full, bits)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<u8") * (block * bits // 8), len(body)).astype("<u8")
    return HEAD.pack(b"FWB1", bits, block, len(ends), len(ids)) + offsets.tobytes() + ends.astype("<u8").tobytes() + body.tobytes()


class Segment:
    """Reads a segment; ``ids(start, stop)`` unpacks only the blocks that hold the range."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, docs, self.n_ids = HEAD.unpack_from(data)
        if magic != b"FWB1":
            raise ValueError("not a token segment")
        blocks, at = -(-self.n_ids // self.block), HEAD.size
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at)
        self.ends = np.frombuffer(data, "<u8", docs, at + 8 * (blocks + 1)).astype(np.int64)
        self.payload = np.frombuffer(data, np.uint8, int(self.offsets[-1]), at + 8 * (blocks + 1 + docs))

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        part = unpack_bits(self.payload[int(self.offsets[first]) : int(self.offsets[last])].copy(), self.bits)
        return part[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def write_tokens(docs: DataFrame, scratch: Scratch, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token file of ``docs`` in ascending id order and returns its segments, read back.

    A null text is empty and still has its end id. Null ids come first; rows
    of one id are ordered by their text. Other columns are not read.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bits = width(max(enc.vocabulary_size(), end_id + 1))
        part, segment = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal held, keys, n, segment
            ids = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])
            nulls = sum(k is None for k in keys)  # they come first
            row = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "segment": pa.array([segment], pa.int32()),
                    "n_docs": pa.array([len(held)], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([np.array([k or 0 for k in keys], "<i8").tobytes()], pa.binary()),
                    "null_ids": pa.array([nulls], pa.int64()),
                    "body": pa.array([write_segment(ids, ends, bits)], pa.binary()),
                }
            )
            held, keys, n, segment = [], [], 0, segment + 1
            return row

        for batch in batches:
            for rows, texts in slices(batch, "t"):
                keys_here = rows.column(0).to_pylist()
                ids, ends = enc.encode(texts)
                ids = np.insert(ids, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                for key, i, j in zip(keys_here, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    held.append(ids[i:j])
                    keys.append(key)
                    n += j - i
                    if n >= SEGMENT:
                        yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "k").sortWithinPartitions("k", "t")
    return scratch.save(ordered.mapInArrow(encode, SEGMENTS), "tokens", codec="none")


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the file.

    ``start`` counts the ids of all documents before it. Segments are summed
    within a part and the parts' totals (a row for each) over the file; the
    packed bodies are never moved.
    """

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row["body"])
                ids = seg.ids().astype("<u4").tobytes()
                ends = seg.ends.tolist()
                starts = [0, *ends[:-1]]
                keys = np.frombuffer(row["doc_ids"], "<i8")
                none = np.arange(len(keys)) < row["null_ids"]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * len(keys), pa.int32()),
                        "segment": pa.array([row["segment"]] * len(keys), pa.int32()),
                        "doc_id": pa.array(keys, pa.int64(), mask=none),
                        "at": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)], pa.int64()),
                    }
                )

    docs = segments.select("part", "segment", "doc_ids", "null_ids", "body").mapInArrow(parse, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("outer")), "part")
        .select("part", "segment", (F.col("inner") + F.col("outer")).alias("base"))
    )
    return docs.join(base, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

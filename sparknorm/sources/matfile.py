"""Metadata of MAT files (level 5), from whole files in a binary column.

The tag tree is walked element by element; numeric data but scalars and short
rows is skipped, also inside compressed elements, which are inflated piece by
piece and never as a whole. A file that cannot be walked gives a row with its
error beside what was found before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Data types and array classes of the format
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, PACKED = 14, 15
CLASSES = {1: "cell", 2: "struct", 3: "object", 4: "char", 5: "sparse", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}
SHORT = 16  # numbers that are spelled out
LONGEST = 1 << 20  # bytes of a text that are read
ROWS = "path string, name string, class string, dims array<long>, text string, numbers array<double>, error string"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.float64()), pa.string()]


class Source:
    """Bytes that are read or skipped in order; of compressed ones, only a piece is held."""

    def __init__(self, data: bytes | memoryview, packed: bool = False):
        self.data, self.at = memoryview(data), 0
        self.inflate, self.held = (zlib.decompressobj(), b"") if packed else (None, b"")

    def read(self, n: int, keep: bool = True) -> bytes:
        if self.inflate is None:
            part = self.data[self.at : self.at + n]
            self.at += n
            if len(part) < n:
                raise ValueError(f"{n - len(part)} bytes are missing")
            return bytes(part) if keep else b""
        out = []
        while n:
            if not self.held:
                feed = self.inflate.unconsumed_tail or self.data[self.at : self.at + (1 << 16)]
                if not self.inflate.unconsumed_tail:
                    self.at += len(feed)
                self.held = self.inflate.decompress(feed, 1 << 16)
                if not self.held and not len(feed):
                    raise ValueError(f"{n} bytes are missing")
                continue
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                out.append(part)
        return b"".join(out)

    def skip(self, n: int) -> None:
        self.read(n, keep=False)


class Walker:
    def __init__(self, order: str):
        self.order = order

    def tag(self, s: Source) -> tuple[int, int, int]:
        """Type and length of an element, and the padding behind it; a small element has its four bytes in the tag."""
        head = s.read(8)
        kind, size = struct.unpack(self.order + "II", head)
        if kind >> 16:  # small: length and type share four bytes
            size, kind = kind >> 16, kind & 0xFFFF
            if size > 4:
                raise ValueError(f"a small element of {size} bytes")
            self.small = head[4:]
            return kind, size, -1
        return kind, size, -size % 8

    def bytes_of(self, s: Source, most: int | None = None) -> tuple[int, bytes]:
        """Type and content of an element, cut to ``most`` bytes."""
        kind, size, pad = self.tag(s)
        if pad < 0:
            return kind, self.small[:size]
        take = size if most is None else min(size, most)
        data = s.read(take)
        s.skip(size - take + pad)
        return kind, data

    def numbers(self, kind: int, data: bytes) -> np.ndarray:
        if kind not in NUMBERS:
            raise ValueError(f"numbers of type {kind}")
        item = np.dtype(self.order + NUMBERS[kind])
        return np.frombuffer(data[: len(data) // item.itemsize * item.itemsize], item)

    def matrix(self, s: Source, name: str | None, depth: int = 0) -> Iterator[tuple]:
        """(name, class, dims, text, numbers) of a matrix and what it holds, from behind its tag."""
        if depth > 64:
            raise ValueError("nested too deeply")
        flags = self.numbers(*self.bytes_of(s))
        dims = self.numbers(*self.bytes_of(s)).astype(np.int64).tolist()
        own = self.bytes_of(s)[1].decode("latin-1").rstrip("\0")
        name = own if name is None else name
        kind = CLASSES.get(int(flags[0]) & 0xFF)
        if kind is None:
            raise ValueError(f"a matrix of class {int(flags[0]) & 0xFF}")
        count = prod(dims)
        if kind == "cell":
            yield name, kind, dims, None, None
            for i in range(count):
                yield from self.inner(s, f"{name}{{{i}}}", depth)
        elif kind in ("struct", "object"):
            if kind == "object":
                self.bytes_of(s)  # its class
            width = int(self.numbers(*self.bytes_of(s))[0])
            raw = self.bytes_of(s)[1]
            fields = [raw[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(raw), width)] if width else []
            yield name, kind, dims, None, None
            for i in range(count):
                for f in fields:
                    yield from self.inner(s, f"{name}.{f}" if count == 1 else f"{name}[{i}].{f}", depth)
        elif kind == "char":
            what, data = self.bytes_of(s, LONGEST)
            if what in TEXTS:
                text = data.decode(TEXTS[what] + ("" if what == 16 else "-le" if self.order == "<" else "-be"), "replace")
            else:
                text = "".join(map(chr, self.numbers(what, data).tolist()))
            if len(dims) == 2 and dims[0] > 1:  # columns first
                rows = dims[0]
                text = "\n".join(text[r::rows].rstrip() for r in range(rows))
            yield name, kind, dims, text, None
        else:
            parts = 3 if kind == "sparse" else 1
            for _ in range(parts - 1):
                self.bytes_of(s, 0)
            short = kind != "sparse" and count <= SHORT
            what, data = self.bytes_of(s, None if short else 0)
            if int(flags[0]) & 0x800:  # complex
                self.bytes_of(s, 0)
            yield name, kind, dims, None, self.numbers(what, data).astype(float).tolist() if short else None

    def inner(self, s: Source, name: str, depth: int) -> Iterator[tuple]:
        kind, size, _ = self.tag(s)
        if kind != MATRIX:
            raise ValueError(f"an element of type {kind} where a matrix should be")
        if size:
            yield from self.matrix(s, name, depth + 1)
        else:
            yield name, "double", [0, 0], None, []


def walk(data: bytes) -> Iterator[tuple]:
    """(name, class, dims, text, numbers) of every variable, field and cell; names are like EEG.chanlocs[0].labels."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("no MAT file of level 5")
    walker = Walker("<" if data[126:128] == b"IM" else ">")
    at = 128
    while at < len(data):
        s = Source(memoryview(data)[at:])
        kind, size, pad = walker.tag(s)
        if pad < 0:
            at += 8
            continue
        if size > len(data) - at - 8:
            raise ValueError(f"an element of {size} bytes, {len(data) - at - 8} are left")
        if kind == PACKED:
            inside = Source(memoryview(data)[at + 8 : at + 8 + size], packed=True)
            if walker.tag(inside)[0] == MATRIX:
                yield from walker.matrix(inside, None)
            at += 8 + size  # compressed elements are not padded
        else:
            if kind == MATRIX and size:
                yield from walker.matrix(s, None)
            at += 8 + size + pad


def metadata(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """A row for each variable, field and cell of each file (``ROWS``), and one with an error where a file breaks off. A null content has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: list[tuple] = []
                try:
                    for row in walk(data) if data is not None else ():
                        held.append((name, *row, None))
                except (ValueError, IndexError, struct.error, zlib.error) as e:
                    held.append((name, *[None] * 5, str(e)))
                for k in range(0, len(held), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held[k : k + 4096], strict=True), _TYPES, strict=True)], names)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, ROWS)


def channel_labels(rows: DataFrame, variable: str = "EEG") -> DataFrame:
    """(path, ch_idx, channel): the labels of a recording's channel table, whether it has one channel or many."""
    at = F.regexp_extract("name", rf"^{variable}\.chanlocs(?:\[(\d+)\])?\.labels$", 1)
    found = rows.where(F.col("name").rlike(rf"^{variable}\.chanlocs(\[\d+\])?\.labels$") & F.col("text").isNotNull())
    return found.select("path", F.coalesce(F.when(at != "", at).cast("int"), F.lit(0)).alias("ch_idx"), F.trim("text").alias("channel"))

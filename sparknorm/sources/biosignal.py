"""EDF, BDF and GDF recordings as a Spark data source.

``spark.read.format("biosignal").load(path)``, after ``register``: a file is
split by ranges of its data records, each range a partition that reads its own
bytes, so a recording of any length spreads over the cluster. Files are opened
through pyarrow's file systems, so a path may be that of any store they know.
Channels may be chosen by option or by a filter on ``channel``; others are
neither converted nor returned. A file that ends before its header's last record,
or whose records have gaps in time, raises ValueError with its name.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, channel string, ch_idx int, sfreq double, unit string, n long, start long, samples array<double>"
SUFFIXES = ("*.edf", "*.bdf", "*.gdf", "*.rec")
# Widths of the text fields of a channel in EDF and BDF, in the order of the file
TEXT_FIELDS = {"label": 16, "transducer": 80, "unit": 8, "pmin": 8, "pmax": 8, "dmin": 8, "dmax": 8, "filter": 80, "samples": 8, "reserved": 32}
# Offsets of the fields of n channels in GDF 2, in bytes a channel, with their types
GDF_FIELDS = {"label": (0, "S16"), "unit": (96, "S6"), "pmin": (104, "<f8"), "pmax": (112, "<f8"), "dmin": (120, "<f8"), "dmax": (128, "<f8"), "samples": (216, "<u4"), "type": (220, "<u4")}
# Sample types of GDF
GDF_TYPES = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<i8", 8: "<u8", 16: "<f4", 17: "<f8", 279: "i24", 535: "u24"}


@dataclass(frozen=True)
class Channel:
    label: str
    unit: str
    samples: int  # of a record
    kind: str  # NumPy's name of the type, or i24, u24
    at: int  # bytes into a record
    scale: float
    shift: float

    @property
    def width(self) -> int:
        return 3 if self.kind.endswith("24") else np.dtype(self.kind).itemsize

    def decode(self, records: np.ndarray) -> np.ndarray:
        """Physical values from the bytes of records, one a row."""
        raw = np.ascontiguousarray(records[:, self.at : self.at + self.samples * self.width])
        if self.kind.endswith("24"):
            b = raw.reshape(-1, 3).astype(np.int32)
            value = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
            value = np.where(value >= 1 << 23, value - (1 << 24), value) if self.kind == "i24" else value
        else:
            value = raw.view(self.kind).ravel()
        return value.astype(float) * self.scale + self.shift


@dataclass(frozen=True)
class Header:
    offset: int  # of the first record
    records: int
    size: int  # of a record
    seconds: float  # of a record
    channels: tuple[Channel, ...]


def _number(text: bytes, name: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise ValueError(f"{name}: {text!r} in the header is no number") from None


def _edf(head: bytes, read, length: int, name: str) -> Header:
    offset, count, seconds, n = (_number(head[a:b], name) for a, b in ((184, 192), (236, 244), (244, 252), (252, 256)))
    n, offset, wide = int(n), int(offset), head[0] == 255
    if head[192:236].startswith((b"EDF+D", b"BDF+D")):
        raise ValueError(f"{name}: records have gaps in time")
    if n < 1 or offset != 256 * (n + 1):
        raise ValueError(f"{name}: the header's length does not fit its channels")
    body, fields, at = read(256, 256 * n), {}, 0
    for field, width in TEXT_FIELDS.items():
        fields[field] = [body[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += n * width
    kinds = ["i24" if wide else "<i2"] * n
    numbers = [[_number(v.encode("latin-1"), name) for v in fields[f]] for f in ("pmin", "pmax", "dmin", "dmax", "samples")]
    return _layout(offset, int(count), seconds, fields["label"], fields["unit"], *numbers, kinds, length, name)


def _gdf(head: bytes, read, length: int, name: str) -> Header:
    if not head[4:8].strip().startswith(b"2"):
        raise ValueError(f"{name}: GDF {head[4:8].decode('latin-1').strip()} is not read, only 2")
    offset, n = int(np.frombuffer(head, "<u2", 1, 184)[0]) * 256, int(np.frombuffer(head, "<u2", 1, 252)[0])
    count = int(np.frombuffer(head, "<i8", 1, 236)[0])
    above, below = np.frombuffer(head, "<u4", 2, 244).tolist()
    if n < 1 or offset < 256 * (n + 1) or not below:
        raise ValueError(f"{name}: the header's length does not fit its channels")
    body = read(256, 256 * n)
    fields = {f: np.frombuffer(body, kind, n, at * n).tolist() for f, (at, kind) in GDF_FIELDS.items()}
    if unknown := set(fields["type"]) - set(GDF_TYPES):
        raise ValueError(f"{name}: unknown sample types {sorted(unknown)}")
    text = lambda f: [v.split(b"\0")[0].decode("latin-1").strip() for v in fields[f]]
    return _layout(offset, count, above / below, text("label"), text("unit"), *(fields[f] for f in ("pmin", "pmax", "dmin", "dmax", "samples")), [GDF_TYPES[t] for t in fields["type"]], length, name)


def _layout(offset: int, count: int, seconds: float, labels: list, units: list, pmin: list, pmax: list, dmin: list, dmax: list, samples: list, kinds: list, length: int, name: str) -> Header:
    channels, at = [], 0
    for label, unit, p0, p1, d0, d1, k, kind in zip(labels, units, pmin, pmax, dmin, dmax, samples, kinds, strict=True):
        if k < 0 or d1 <= d0:
            raise ValueError(f"{name}: channel {label!r} has no range of values")
        scale = (p1 - p0) / (d1 - d0)
        channels.append(Channel(label, unit, int(k), kind, at, scale, p0 - d0 * scale))
        at += int(k) * channels[-1].width
    if not at or seconds <= 0:
        raise ValueError(f"{name}: records are empty")
    if count < 0:  # not closed by its writer
        count = (length - offset) // at
    if length < offset + count * at:
        raise ValueError(f"{name}: {length} bytes, its header asks for {offset + count * at}")
    return Header(offset, count, at, seconds, tuple(channels))


def header(read, length: int, name: str) -> Header:
    """From ``read(position, bytes)`` of a file of a known length."""
    head = read(0, 256)
    if len(head) == 256 and (head[:8] == b"0       " or head[:8] == b"\xffBIOSEMI"):
        return _edf(head, read, length, name)
    if len(head) == 256 and head[:3] == b"GDF":
        return _gdf(head, read, length, name)
    raise ValueError(f"{name}: neither EDF, BDF nor GDF")


def wanted(h: Header, chosen: Sequence[str] | None) -> list[tuple[int, Channel]]:
    """Channels by place in the file; annotations are no channel, and a name is compared without case."""
    names = {c.strip().upper() for c in chosen} if chosen is not None else None
    return [(i, c) for i, c in enumerate(h.channels) if c.samples and "ANNOTATIONS" not in c.label.upper() and (names is None or c.label.upper() in names)]


def decoded(h: Header, path: str, data: bytes, first: int, chosen: Sequence[str] | None) -> list[tuple]:
    """Rows of ``SCHEMA`` from the bytes of whole records, the first of which has a number."""
    records = np.frombuffer(data, np.uint8).reshape(-1, h.size)
    return [(path, c.label, i, c.samples / h.seconds, c.unit, h.records * c.samples, first * c.samples, c.decode(records)) for i, c in wanted(h, chosen)]


@dataclass
class Records(InputPartition):
    path: str
    first: int
    count: int


class BiosignalReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path = options["path"]
        self.per_part = max(1, int(options.get("recordsperpartition", "600")))
        self.per_row = max(1, int(options.get("recordsperrow", "60")))
        named = options.get("channels")
        self.channels = [c for c in named.split(",") if c.strip()] if named is not None else None

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        folder, _, pattern = base.rpartition("/")
        if any(c in pattern for c in "*?["):
            found = store.get_file_info(fs.FileSelector(folder))
            return store, sorted(i.path for i in found if i.is_file and fnmatch.fnmatch(posixpath.basename(i.path), pattern))
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.is_file:
            return store, [base]
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        return store, sorted(i.path for i in found if i.is_file and any(fnmatch.fnmatch(i.path.lower(), s) for s in SUFFIXES))

    @staticmethod
    def _header(store: fs.FileSystem, path: str) -> Header:
        with store.open_input_file(path) as f:
            return header(lambda at, n: f.read_at(n, at), f.size(), path)

    def partitions(self) -> list[Records]:
        store, files = self._files()
        with ThreadPoolExecutor(32) as pool:  # a few hundred bytes a file
            heads = list(pool.map(lambda p: self._header(store, p), files))
        return [Records(p, k, min(self.per_part, h.records - k)) for p, h in zip(files, heads, strict=True) for k in range(0, h.records, self.per_part)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        h = self._header(store, partition.path)
        with store.open_input_file(partition.path) as f:
            for first in range(partition.first, partition.first + partition.count, self.per_row):
                count = min(self.per_row, partition.first + partition.count - first)
                rows = decoded(h, partition.path, f.read_at(count * h.size, h.offset + first * h.size), first, self.channels)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class PushingReader(BiosignalReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names of channels are used to skip others; Spark still applies the filter, since names are compared without case here."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("channel",):
                names = [f.value] if isinstance(f, EqualTo) else list(f.value)
                names = [n for n in names if n is not None]
                self.channels = names if self.channels is None else [c for c in self.channels if c.strip().upper() in {n.strip().upper() for n in names}]
            yield f


class BiosignalSource(DataSource):
    """Options: path (a file, a folder or a pattern in one), channels (names, comma-joined), recordsPerPartition, recordsPerRow, pushdown.

    Spark refuses a reader that takes filters where
    spark.sql.python.filterPushdown.enabled is not set, so the option says so.
    """

    @classmethod
    def name(cls) -> str:
        return "biosignal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (PushingReader if options.get("pushdown") == "true" else BiosignalReader)(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BiosignalSource)


def recordings(spark: SparkSession, path: str, channels: Sequence[str] | None = None, records_per_partition: int = 600, records_per_row: int = 60) -> DataFrame:
    """Samples in physical units: path, channel, ch_idx (place in the file), sfreq, unit, n (of the channel), start (of the row) and samples."""
    register(spark)
    options = {"recordsPerPartition": str(records_per_partition), "recordsPerRow": str(records_per_row), "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | ({"channels": ",".join(channels)} if channels is not None else {})
    return spark.read.format("biosignal").options(**options).load(path)


def from_content(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """The same rows from whole files in a binary column, as Spark's binaryFile source gives them; meant for short recordings. A null content has none."""

    def run(batches):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None:
                    continue
                h = header(lambda at, n, data=data: data[at : at + n], len(data), name)
                rows = decoded(h, name, data[h.offset : h.offset + h.records * h.size], 0, None)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, SCHEMA)


def blocks_of(rows: DataFrame, subject, run, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Blocks and runs as ``operators.recordings`` takes them, from rows of ``recordings``; ``scale`` brings samples to volts.

    A run whose channels differ in rate or length gets an error; so does one
    where a channel's name stands twice.
    """
    named = rows.select(subject.alias("subject"), run.alias("run"), "channel", "ch_idx", "sfreq", "n", "start", F.transform("samples", lambda v: v * scale).alias("samples"))
    heads = named.where("start = 0").groupBy("subject", "run").agg(F.min("n").alias("n"), F.max("n").alias("longest"), F.min("sfreq").alias("sfreq"), F.max("sfreq").alias("most"), F.count("channel").alias("channels"), F.count_distinct("channel").alias("names"))
    error = F.when(F.col("n") != F.col("longest"), "channels differ in length").when(F.col("sfreq") != F.col("most"), "channels differ in rate").when(F.col("names") < F.col("channels"), "a channel stands twice")
    return named.drop("channel", "n"), heads.select("subject", "run", "n", "sfreq", error.alias("error"))


def edf_bytes(x: np.ndarray, sfreq: float, names: Sequence[str], low: float, high: float, unit: str = "uV", per_record: int | None = None) -> bytes:
    """An EDF file of rows of x, each clipped to a range and stored in 16 bits; the last record is filled up with zeros."""
    per = per_record or max(1, round(sfreq))
    count = -(-x.shape[1] // per)
    text = lambda v, n: str(v)[:n].ljust(n).encode("latin-1")
    values = {"label": list(names), "transducer": [""] * len(x), "unit": [unit] * len(x), "pmin": [f"{low:g}"] * len(x), "pmax": [f"{high:g}"] * len(x), "dmin": [-32768] * len(x), "dmax": [32767] * len(x), "filter": [""] * len(x), "samples": [per] * len(x), "reserved": [""] * len(x)}
    head = text("0", 8) + text("", 160) + text("01.01.0000.00.00", 16) + text(256 * (len(x) + 1), 8) + text("", 44) + text(count, 8) + text(f"{per / sfreq:.8g}", 8) + text(len(x), 4)
    body = b"".join(text(v, width) for field, width in TEXT_FIELDS.items() for v in values[field])
    full = np.zeros((len(x), count * per))
    full[:, : x.shape[1]] = x
    code = np.floor((np.clip(full, low, high) - low) / (high - low) * 65535 + 0.5) - 32768
    return head + body + code.astype("<i2").reshape(len(x), count, per).transpose(1, 0, 2).tobytes()

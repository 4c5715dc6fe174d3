"""Shared pieces: the scratch folder, row streaming and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparknorm.operators.joins import spread_join

__all__ = ["Scratch", "bound_batches", "components", "documents", "per_slice", "shuffle_partitions", "slices", "spread_join", "trimmed"]
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from here on: whole texts and shingle sets may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Scratch:
    """Named tables below the shared folder of spark.checkpoint.dir.

    Where that setting is absent, a local session (tests, a laptop) gets a folder
    of its own; on a cluster, where executors do not see each other's folders,
    it is an error. A saved table cuts the lineage and survives the loss of executors.
    Folders go when the driver ends, or earlier by ``free``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bound_batches(spark)
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="sparknorm-")
        self.path = f"{base.rstrip('/')}/sparknorm-{uuid.uuid4().hex}"
        self.collected = time.monotonic()
        atexit.register(self._drop, self.path)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        to = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", codec).parquet(to)
        if time.monotonic() - self.collected > 5:
            # Spark's cleaner drops the shuffle files of finished steps once the JVM has collected their plans
            self.spark.sparkContext._jvm.System.gc()
            self.collected = time.monotonic()
        return self.spark.read.schema(df.schema).parquet(to)

    def free(self, df: DataFrame) -> None:
        """Deletes a saved table that no later step reads."""
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._drop(name)

    def _drop(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: the folder is left to the cluster's own clean-up
            pass


def trimmed(fn: Callable) -> Callable:
    """A mapInArrow function after which the worker, kept for later tasks, gives freed memory back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return run


def slices(batch: pa.RecordBatch, text_col: str, chars: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about ``chars`` characters, with their texts (null: empty)."""
    texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def per_slice(fn: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch | None], text_col: str, chars: int = 1 << 18) -> Callable:
    """A mapInArrow function that calls ``fn`` on slices of bounded text size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col, chars):
                out = fn(part, texts)
                if out is not None and out.num_rows:
                    yield out

    return trimmed(run)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``.

    Returns (node, root) for each node that has an edge; root is the smallest
    node of its component. Alternating large-star and small-star steps, each a
    grouped minimum and a join, until the edges are a star forest. Every round
    is saved, so the lineage stays short.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = scratch.save(e, "edges")
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u hang below u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours hang below the smallest of them
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(low2, "b")
            .select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .where("a <> b")
            .distinct()
        )
        new = scratch.save(small, "edges")
        changed = new.join(e, ["a", "b"], "left_anti").limit(1).count() or e.join(new, ["a", "b"], "left_anti").limit(1).count()
        scratch.free(e)
        e = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    heads = e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return spark.createDataFrame([], "node long, root long").union(roots).union(heads)

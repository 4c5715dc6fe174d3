"""Saved tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Named tables below the shared folder of spark.checkpoint.dir.

    Where that setting is absent, a local session (tests, a laptop) gets a folder
    of its own; on a cluster, where executors do not see each other's folders,
    it is an error. Folders go when the driver ends, or earlier by ``free``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="sparknorm-")
        self.path = f"{base.rstrip('/')}/sparknorm-{uuid.uuid4().hex}"
        atexit.register(self._drop, self.path)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        to = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", codec).parquet(to)
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


_of: dict[str, Scratch] = {}


def scratch_of(spark: SparkSession) -> Scratch:
    """The application's scratch folder for operators that are given none."""
    app = spark.sparkContext.applicationId
    if app not in _of:
        _of[app] = Scratch(spark)
    return _of[app]

"""Structured Streaming: a frozen model over new rows, and windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparknorm.functions.contract import FEATURES
from sparknorm.operators import validate
from sparknorm.operators.normative import Model


def rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def scored(stream: DataFrame, model: Model, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Validated rows with distances; rejected ones keep null distances. Stateless, so it needs no watermark."""
    checked = validate.validate_rows(stream, features)
    ok = F.col("status") == "PASS"
    out = model.score(checked)
    return out.withColumns({c: F.when(ok, F.col(c)) for c in [*(f"D_{b}" for b in model.blocks), "composite"]})


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there, once, with exactly-once files."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, value: str, length: str = "10 minutes", step: str = "5 minutes", late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sliding means over event time; windows close when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(*keys, F.window(time, length, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("start"), "n", "mean")

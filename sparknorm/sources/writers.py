"""Sinks: tables, keep-last upserts, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def keep_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows with one row a key: the new table's where it has one. Among equals of a table the one with the largest columns."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c).desc() for c in old.columns if c not in keys]
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch"), *rest))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_batch")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def row_at(df: DataFrame, order: list[str], position: int) -> DataFrame:
    """The row at a place in an order, from 0; IndexError beyond the end."""
    found = df.orderBy(*order).offset(position).limit(1)
    if not 0 <= position or found.isEmpty():
        raise IndexError(f"no row {position}")
    return found


def upsert(df: DataFrame, old_path: str, new_path: str, keys: list[str]) -> DataFrame:
    """Writes the merged table as a new version; the old one stays readable meanwhile."""
    merged = keep_last(df.sparkSession.read.parquet(old_path), df, keys)
    merged.write.parquet(new_path)
    return df.sparkSession.read.schema(merged.schema).parquet(new_path)


def pending(todo: DataFrame, done: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """What is left to do: keys that do not yet have all their parts."""
    full = done.groupBy(*keys).agg(F.count_distinct("band").alias("n")).where(F.col("n") >= parts)
    return todo.join(full, keys, "left_anti")


def json_rows(reports: DataFrame, path: str, partition_by: str | None = None) -> None:
    """One JSON document a line, by default; with ``partition_by`` a folder for each value."""
    writer = reports.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path)


def subject_reports(reports: DataFrame, path: str, key: str = "participant_id") -> dict[str, int]:
    """A folder with one JSON document for each subject, and how many passed or were rejected."""
    reports.write.partitionBy(key).mode("overwrite").text(path) if reports.columns == [key, "report"] else json_rows(reports, path, key)
    status = F.get_json_object("report", "$.status")
    counts = {r["status"]: r["count"] for r in reports.groupBy(status.alias("status")).count().collect()}
    return {"PASS": counts.get("PASS", 0), "REJECT": counts.get("REJECT", 0)}


def summary_json(df: DataFrame, path: str) -> None:
    """A table of a row or few as JSON documents in one file."""
    df.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)

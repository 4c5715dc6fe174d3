"""Sources: delimited text, JSON, file discovery, header text, model folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparknorm.functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header. Blanks are null; NaN in double columns becomes null. A missing file raises."""
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, nullValue="", nanValue="NaN", enforceSchema=False)
    return df.select(*[C.clean(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def participants(spark: SparkSession, root: str) -> DataFrame:
    return delimited(spark, f"{root}/participants.tsv", "participant_id string, age double, sex string, group string", "\t")


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def files(spark: SparkSession, root: str, pattern: str = "*_eeg.bdf") -> DataFrame:
    """Recordings below a folder: path, size, subject and run. File contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select("path", "length", "modificationTime").select("path", "length", C.subject_token(F.col("path")).alias("subject"), C.run_token(F.col("path")).alias("run"))


def subjects_of(found: DataFrame) -> DataFrame:
    return found.select("subject").distinct()


def header_numbers(header: Column, key: str) -> Column:
    """All numbers that stand after a key in a header text."""
    return F.transform(F.regexp_extract_all(header, F.lit(rf"(?i){key}\s*[:=]?\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"), F.lit(1)), lambda x: x.try_cast("double"))


def header_labels(header: Column) -> Column:
    return F.regexp_extract_all(header, F.lit(r"(?i)label\s*[:=]\s*([A-Za-z0-9]+)"), F.lit(1))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of several paths that exists, in any file system Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(f"none of {paths}")


def long_signals(signals: DataFrame) -> DataFrame:
    """One row a sample: subject, run, channel, t, v."""
    return signals.select("subject", "run", "channel", F.posexplode("samples").alias("t", "v"))

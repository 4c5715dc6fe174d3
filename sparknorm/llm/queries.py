"""The queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.scan(documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    scratch = Scratch(spark)
    tokens = packing.tokenise(documents(spark, sf_dir), scratch, end_id=0)
    return packing.with_checksums(packing.pack(tokens, scratch, length=1024), tokens)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.near_duplicates(documents(spark, sf_dir), Scratch(spark)).drop("key", "head")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = documents(spark, sf_dir)
    return language.identify(docs, language.fit(docs))


def op5_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import binary_tokens

    return binary_tokens.read_tokens(binary_tokens.write_tokens(documents(spark, sf_dir), Scratch(spark), end_id=2))


def op6_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentence_dedup

    cleaned = sentence_dedup.remove_repeats(documents(spark, sf_dir), Scratch(spark))
    return cleaned.select("doc_id", "n_sentences", "n_removed", "removed", F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup

    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source, the path its language there."""
    from . import quality

    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, Scratch(spark), F.col("source"), F.col("lang"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    mixed = mixing.mix(documents(spark, sf_dir), Scratch(spark))
    taken = mixing.copies(mixed)
    source = F.when(F.col("pattern")[0] != mixing.NULL, F.col("pattern")[0])
    table = mixing.source_table(mixed).withColumnRenamed("source", "s")
    return taken.withColumn("s0", source).join(table, F.col("s0").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import matroska

    return matroska.describe(matroska.store(documents(spark, sf_dir), Scratch(spark)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie, turns

    scratch = Scratch(spark)
    rebuilt = prefix_trie.rebuild(*turns.by_turn(spark.read.parquet(f"{sf_dir}/conversations.parquet"), scratch), scratch)
    return prefix_trie.build(*rebuilt, scratch)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversation_repair as repair

    rows, scratch = spark.read.parquet(f"{sf_dir}/conversations.parquet"), Scratch(spark)
    found = repair.summaries(*repair.repair(repair.damage(rows), scratch))
    zero, digest = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    numbers = ["gaps", *repair.COUNTS, "cost"]
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct().join(found, "conv_id", "left")
    return every.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", digest).alias("repaired_sha256"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neighbours

    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, Scratch(spark))


QUERIES = {f.__name__: f for f in (op1_pii, op2_packing, op3_jaccard_join, op4_language, op5_binary_tokens, op6_sentence_dedup, op7_embedding_dedup, op8_quality, op9_mixing, op10_matroska, op11_prefix_trie, op12_conversation_repair, op13_neighbours)}
ORACLES: dict[str, str] = {}

"""The corpus pipeline: language ID, near duplicates, PII, source mixing, packing.

Each stage takes all that its predecessor kept and, but for the last, returns
the columns it was given, whatever their names. Null ids, languages and sources
are allowed throughout; an empty table stays empty; texts of any length are
taken whole. Stages say what they do with null texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparknorm.llm import jaccard_join, language, mixing, packing, pii
from sparknorm.llm.common import Scratch, documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter, and those with few n-grams of the learned language that fits best; null languages become that one.

    Where a labelled language, or all, taught nothing, a letter is enough.
    Repeated rows are decided alike; of equally good languages the first counts.
    """
    return language.known(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, of several that of the smallest id. Rows equal in id and text count once; null texts and those without words stay."""
    return jaccard_join.one_of_each(docs, Scratch(spark))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span; n_chars, where there is one, follows the new text. A null text stays null; every row stays."""
    masked = docs.withColumn("text", pii.masked(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come to their targets. A null text has size 0; rows equal in id and text are decided alike."""
    return mixing.repeat_rows(docs, mixing.mix(docs, Scratch(spark)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document in a sequence of at most 1024 tokens. A null text is its end id alone; repeated rows are documents of their own."""
    scratch = Scratch(spark)
    tokens = packing.tokenise(docs, scratch)
    return packing.with_checksums(packing.pack(tokens, scratch), tokens)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # SQL expresses neither the language model nor the tokenizer; tests compare each stage with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each saved and read again as the next one's input."""
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage gets the documents that its predecessor kept, and its decisions take effect.  ``run`` passes
frames on; a driver may as well write each stage's result as Parquet and read it as the next one's input.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontamination, nearcopies, quality, substring
from tallyloom.llm.common import materialize
from tallyloom.llm.queries import table, word_vocabulary
from tallyloom.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage(f: Stage) -> Stage:
    """A stage with the package at hand in all Python workers."""
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    return quality.passing(docs.select(*COLUMNS))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id."""
    return nearcopies.representatives(docs.select(*COLUMNS))


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated sentence runs; a document emptied by that goes."""
    done = substring.trimmed(docs.select(*COLUMNS))
    gone = (F.col("__removed_runs") > 0) & (F.trim("text") == "")
    return done.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs, word_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: SQL can express neither the fingerprints nor the vocabulary's merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

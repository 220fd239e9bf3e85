"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Stages are called in order, each once the result of the one before it is written: a stage removes what
the stages before it have left in the shared folder for their own use.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, language_id, mixing, simhash, token_output
from lodestone.llm.common import clean, shared_dir, table, written


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(f)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clean(spark, _left)
        _left.clear()
        written()  # what other operators have left isn't the pipeline's
        out = f(spark, docs, sf_dir)
        _left.extend(written())
        return out

    return run_


#: What the last stage has left for its own use; its result still reads it.
_left: list[str] = []


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; those without a letter, and uncertain ones, go."""
    return language_id.keep_languages(docs, language_id.fit(docs))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that each source gets its target weight, in shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and tells what they hold."""
    return token_output.tokenize_and_read(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_output", tokens),
]

#: Learned languages, fingerprints' components and token ids can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; of the folders it writes, its result and the token files stay."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, step in STAGES:
        step(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        clean(spark, [before] if before else [])
        before = f"{base}/{name}"
    clean(spark, _left)
    _left.clear()
    return docs

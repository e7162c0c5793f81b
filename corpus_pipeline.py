"""From raw documents to packed training sequences.

Documents whose language is known, one of each group of near-duplicates, without
benchmark questions and personal data, packed. Each stage takes what its
predecessor kept and returns the columns of documents; the last one the pieces.

Defined results: documents with a null or empty text, or one without a letter,
have no language and go in the first stage. Rows without doc_id stay in all
stages, as do further columns, whatever their names; a table without n_chars gets
none. Of near copies the row with the smallest id is left by the second stage, and
of rows that share an id one, any of them. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failtriage.llm import decontam, langid, ngrams, packing, pii
from failtriage.llm.common import read, ship, store


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is recognised; texts without a letter go."""
    return langid.identified(docs, langid.sample(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by shingles."""
    return ngrams.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question, or a re-parameterised one."""
    return decontam.without(docs, store(decontam.contaminated(docs, read(spark, sf_dir, "benchmark"), literal=True), "contaminated"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind, and n_chars, if there is one, to match."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    """The stage, once the workers have its code."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language", _shipped(known_language)),
    ("near_copies", _shipped(without_near_copies)),
    ("benchmark", _shipped(without_benchmark)),
    ("personal_data", _shipped(without_personal_data)),
    ("packing", _shipped(packed)),
]

#: SQL cannot express the learned stages; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every result but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

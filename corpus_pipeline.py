"""The corpus pipeline: documents in, token blocks out. Part of the optional subpackage.

Toxic documents go, one document of each near-duplicate class stays, documents that hold a benchmark item go, sources
are mixed to their target weights (documents repeat as often as they are drawn), and what is left is written as
range-coded token blocks, of which the last stage returns one row for each document: its place and checksum.

Defined results: stages take any columns beside doc_id, text and source and return them unchanged; rows are judged by their own text, so rows
without an id are scored, de-duplicated (one of equal sets stays, unless a document with an id stands for it), decontaminated, mixed and
stored (first) like others. Null and empty texts are clean, link with nothing, leak nothing, and are drawn at the rate of their source. Of rows that repeat an id and a text one stays. Empty tables give empty tables; without labels or benchmark items nothing is rejected for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.llm import decontaminate, near_join, source_mixing, token_store, toxicity
from loomery.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.emit(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("source_mixing", mix_sources),
    ("token_store", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a trained model and the last a tokenizer; the tests hold every stage against a plain version.
ORACLE_SQL = None

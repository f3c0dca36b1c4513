"""Corpus cleaning: four text operators one after the other, each on all that the last kept.

Defined results, stage by stage: rows with a null or empty text, or without a letter, go with the
language stage. Rows with a null id keep all their lines, are no near copies and are packed. Of
equal or nearly equal texts under different ids that of the smallest id stays whole; rows that
share an id are one document to the middle stages, so they stay or go together. Ties are decided
by id and line number. An empty table gives an empty table. Other columns are passed through;
their names may be anything but those that packing adds.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import drop_tables, save, scratch_scope, table
from tidemark.llm.langid import keep_identified
from tidemark.llm.line_dedup import SHORT_SPAN, dedup_documents
from tidemark.llm.ngram_join import keep_one
from tidemark.llm.packing import pack


#: Scratch tables behind the last stage that this thread ran; pipelines in other threads have their own.
_held = threading.local()


def stage(f: Callable) -> Callable:
    """A stage's input has been written, so the scratch tables behind it are dropped first: the
    disk holds those of one stage at a time. An input that still reads them keeps them."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        done = _held.__dict__.setdefault("done", [])
        read = docs.inputFiles()
        if not any(f"/{path.rsplit('/', 1)[1]}/" in file for path in done for file in read):
            drop_tables(spark, done)
        with scratch_scope() as paths:
            out = f(spark, docs, sf_dir)
        done.extend(paths)
        return out

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return keep_identified(docs)


@stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with one line of each group of near-equal lines; documents left without a line go."""
    return dedup_documents(docs, SHORT_SPAN)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_one(docs)


@stage
def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("packing", pack_documents),
]

#: No SQL: a trained classifier, MinHash union-find and dynamic programming.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = save(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

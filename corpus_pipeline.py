"""Corpus preparation over ``documents``: language, near copies, passages, mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; what a stage decides shows in its rows:

* ``language_id``: documents whose language the model rejects go; a missing
  ``lang`` becomes the predicted one.
* ``near_duplicates``: of rows linked by shingle overlap one stays; unlike texts stay,
  also under one id.
* ``substring_dedup``: passages that occur earlier are cut out of the texts.
* ``source_mix``: documents come as often as their source's target says.
* ``packing``: tokenised pieces, their ids and their places in windows.

Null texts are rejected by the first stage; an empty table stays empty throughout;
further columns of ``documents`` are carried along.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import jaccard, langid, mixing, packing, substrings
from spanlake.llm.queries import packing_tokenizer
from spanlake.llm.shared import release, stored, table
from spanlake.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(configure(spark), docs, sf_dir)

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substrings.cut(docs))


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mixed(docs))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing_tokenizer(), keep_ids=True)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Models and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stored(step(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark)
    return docs

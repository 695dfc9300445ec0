"""A corpus from raw documents to token files: stages that are written and read again one by one."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontaminate, language, mixing, near_copies, token_records
from trackloom.llm.common import new_folder, remove, scratch, small_batches, table
from trackloom.llm.queries import MIX_ROUNDS, MIX_SEED, MIX_TARGETS, tokenizer_path, with_topic


#: The columns that stages read; language_id replaces lang.
READ = ("doc_id", "text", "lang", "source")


def beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs after work, whatever names work gives to columns of its own: a caller's keep their values."""
    names = [c if c in READ else f"own_{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the language of their text as lang, which the mix goes by.

    Those without text (null, empty) or letter, and those that two languages fit almost alike, go. lang is
    replaced, all other columns stay. Rows are judged each by its own text: repeated rows, and rows
    without an id, stay or go like any other. Without any labelled row no language is known, and all go.
    """
    small_batches(spark)

    def named(rows: DataFrame) -> DataFrame:
        found = language.identify(rows, language.fit(rows)).where("lang_pred <> 'und' AND NOT lang_ambiguous")
        return found.withColumn("lang", F.col("lang_pred"))

    return beside(docs, named)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id, with all its columns.

    A document is what bears one id: its rows, repeated or not, stay or go together. Rows without an id
    can't be told from one another and stay, as do null, empty and blank texts, which are copies of nothing.
    """
    copies = near_copies.near_copies(docs).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, with all their columns.

    Each row is judged by its own text, with or without an id; null and empty texts stay, and an empty
    benchmark, or items without text, take nothing.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    return beside(docs, lambda rows: decontaminate.flag(rows, benchmark).where("NOT contaminated"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target mix of sources, languages and forms, with all columns as they were.

    Rows of one id share their fate if they are of one cell; null ids are drawn like one id. Null and empty
    texts have no tokens; a null source or language is one that no target names.
    """
    return beside(docs, lambda rows: mixing.mix(with_topic(rows), MIX_TARGETS, MIX_SEED, MIX_ROUNDS).where("kept"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id record files, and the index that was read back from them: doc_id, start, n_tokens, ids_crc32, offset.

    A row per document row, in ascending order of ids; a null or empty text has its end id alone. Other
    columns aren't written. The files are the product and stay in the shared folder.
    """
    return token_records.token_files(docs, tokenizer_path()).drop("path")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_output", token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table, and what the stage wrote for itself, go when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        with contextlib.nullcontext() if stage is token_output else scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs

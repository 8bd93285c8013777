"""The corpus pipeline: from raw documents to the order in which they are trained on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import documents, free_name, written
from lattica.llm.decontamination import find_leaks
from lattica.llm.exact_dedup import deduplicated
from lattica.llm.language_id import keep_identified, learn
from lattica.llm.mixing import mixed_documents
from lattica.llm.simhash import near_duplicates


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in the one column of ``gone``."""
    key = free_name(docs, "gone_doc_id")
    gone = gone.select(F.col(gone.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; dictionaries are cut from the labelled rows of ``docs``.

    Null, empty and letterless texts have no language and go, and so does every
    row where no row is labelled. Rows are judged one by one: repeated ones stay
    or go together, ties between languages go. An empty table stays empty.
    Columns are passed on whatever their names.
    """
    return keep_identified(docs, learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest, then the one with the smallest identifier.

    Null counts as empty text. Of rows that repeat identifier and text one
    stays; rows that share an identifier only, or have none, are judged by
    their texts. An empty table stays empty. Columns are passed on whatever
    their names.
    """
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the smallest identifier.

    Null and empty texts are alike. Rows without an identifier stay; rows that
    share one are one document and stay or go together. An empty table stays
    empty. Columns are passed on whatever their names.
    """
    return without(docs, near_duplicates(docs).where("node <> component").select("node"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, copied or paraphrased.

    Null and empty texts hold no item, and rows without an identifier stay;
    rows that share one stay or go together. An empty table stays empty, and an
    empty benchmark takes nothing away. Columns are passed on whatever their
    names.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, find_leaks(docs, benchmark).select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order in which they are trained on, with copy, words and position.

    Texts without words are never read and go. A null source is a source of its
    own. Repeated rows are documents of their own, ordered by identifier, then
    by a hash of the text. An empty table stays empty. Added columns get
    underscores before their names where ``docs`` has the names.
    """
    return mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: The language and near-duplicate stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``; each stage is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five stages: quality, lines, near duplicates, benchmark passages, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, lines, mixing, neardup, quality
from corpusloom.session import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the quality cut go.

    Null and empty texts are scored like others; equal texts score the same, so repeated rows stay or go together. A score at
    the cut stays. Labels that are null, repeated or of unknown ids don't count. An empty table stays empty.
    """
    return quality.keep_quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which nothing is left.

    Of a group of like lines the one of the smallest doc_id, then place, stays. Null and empty texts and lines without letters
    or digits stay, and so do rows without a doc_id; rows that repeat a doc_id lose the same places. Whatever further columns are called, they are carried along.
    """
    return lines.drop_duplicate_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id.

    Texts without words, null ones included, are in no group and stay, and so do rows without a doc_id. Of rows that repeat a
    doc_id and text one stays. Very long texts are compared whole.
    """
    return neardup.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go.

    Documents of exactly half passages stay. Null and empty texts stay as they are, repeated rows are cut each on its own, and
    items that are null, empty or repeated add nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document.

    Null and empty texts have size 0 and none taken; a null source is a source of its own, the last; repeated rows are mixed each
    on its own; ties in the seeded order go by doc_id, then size.
    """
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("benchmark", benchmark_stage), ("mix", mix_stage)]

#: The stages learn weights and link groups, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs

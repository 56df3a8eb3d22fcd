"""The corpus pipeline: quality rules, quality classifier, near-duplicate removal, decontamination, source mix.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read again as the next one's ``docs``. The first
four return the columns of ``documents``; the mix adds ``mix_copy`` and
``mix_finish`` and holds a row for every copy taken. Every stage works on all rows
its predecessor kept and treats null and empty texts, repeated rows, empty tables
and further columns as its operator's docstring says.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import decontaminate, mixing, ngram_join, quality_fm, quality_rules
from tablescope.llm.common import load, prepare, written

#: A classifier and benchmark statistics cannot be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality_rules.filter_rows(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    It learns from all labelled documents: those that the rules kept are nearly all of label 1.
    """
    prepare(spark)
    everything = load(spark, sf_dir, "documents")
    metadata = tuple(c for c in ("n_chars",) if c in docs.columns and c in everything.columns)
    return quality_fm.filter_rows(docs, load(spark, sf_dir, "labels"), metadata=metadata, learn=everything)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return decontaminate.clean_rows(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the source mix takes, in the order of the mix."""
    prepare(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mix", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

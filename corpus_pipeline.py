"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, folder) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; the last writes the mix to the shared folder and returns a
row per document with the number and a hash of the words of it that the mix holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import decontaminate, mixing, quality_gam, secret_scan, simhash
from shelfline.llm.common import table
from shelfline.sources.storage import materialise


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_gam.keep_good(docs, table(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, folder, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Values of live-looking credentials are masked; every document stays."""
    return secret_scan.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """What the written mix holds of each document: ``taken`` words, and their hash."""
    return mixing.mixture(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("secret_scan", secrets),
    ("source_mixing", mix),
]

#: Several stages have no SQL form; the pipeline is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)

"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, langid, linededup, mixing, simhash
from lodestar.llm.textops import shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no learned language, go; lang is the identified language from here on."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier line go from the text; n_chars follows. Every document stays."""
    return linededup.dedup(docs, threshold=0.8).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: SimHash words in BK-trees by shard, and the pairs beyond their radius; sets of five words decide (0.8 or more)."""
    return simhash.one_of_each_group(docs, shingle=5, similarity=0.8, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a part of a benchmark item's template windows, or a long run of its words, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: a row for each time a document is taken, sorted by its position; documents that the mix takes nothing of go."""
    return mixing.in_order(mixing.mix(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: SQL cannot train the classifier or compare the fingerprints; tests hold the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written under the shared checkpoint folder."""
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if k:  # what the stage before wrote has been read
            remove(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

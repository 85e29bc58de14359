"""A training corpus from the documents table: five stages, each a written table.

A stage takes what its predecessor kept. All but the last return the columns of
documents; packing returns pieces of sequences.

Defined results: a document without text has no language and goes in the first stage;
rows that repeat doc_id and text are one exact group, of which one row stays; a null
doc_id is the largest of its group, and its row is packed like any other; ties go to the
smallest doc_id; texts are whole, however long; without documents there are no pieces,
without test items nothing goes for contamination; other columns, of any name, are kept
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontamination, exact_dedup, language, ngram_join, packing
from lattica.llm.common import Scratch, documents, scratch_scope


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay."""
    return language.drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that link, directly or through others, the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a test item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4,096 tokens, with their ids."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express language scores, string tiling and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_scope():  # what a stage wrote on its way goes once its result is written
            kept = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

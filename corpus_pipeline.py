"""A training-corpus pipeline out of the operators in gridloom.llm.

STAGES are applied in order, each to what the one before has kept of `documents`. All but the last return the columns
of documents; the last returns the packed pieces. Rows with a null doc_id are judged by their texts like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, numbered
from gridloom.llm.decontamination import without_leaks
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.near_dedup import near_dedup
from gridloom.llm.packing import pack_documents
from gridloom.llm.toxicity import THRESHOLD, scorer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def only(docs: DataFrame, decide) -> DataFrame:
    """The rows of docs that decide() returns. It gets the columns id and text, and ids that are one for each row and in the order of doc_id."""
    rows = numbered(docs, "pipeline-rows", **{c: F.col(c) for c in COLUMNS})
    kept = decide(rows.select(F.struct("doc_id", "row").alias("id"), "text"))
    return rows.join(kept.select("doc_id.row"), "row", "left_semi").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    score = scorer(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score("text") < THRESHOLD).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return only(docs, lambda rows: exact_dedup(rows, "id").where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word similarities of 0.8 or more, the one with the smallest doc_id."""
    return only(docs, lambda rows: near_dedup(rows, "id").where("doc_id = component_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Scores, fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: toxic texts out, near copies out, benchmark text out, personal
data replaced, the rest packed into training sequences.

Every stage takes the documents its predecessor kept and, but for the last, returns rows
with the columns of documents. Nulls in any column, empty and very long texts, repeated
rows and empty tables pass through every stage; each says what becomes of them. The
stages' tables stay in the shared folder until whoever runs the pipeline removes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.durable import shared_folder
from sitelens.llm.common import table
from sitelens.llm.decontaminate import decontaminate
from sitelens.llm.packing import pack_documents
from sitelens.llm.pii import with_surrogates
from sitelens.llm.simhash import deduplicate
from sitelens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows scored toxic go. Null and empty texts have the score of no words, and stay unless that is toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one row of each group of near copies stays, that of the smallest id; texts without words are one group."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rows of which 5 % or more of the words are benchmark text go; rows without words stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data in texts is replaced and n_chars is that of the new text; all rows stay, null texts as they are."""
    changed = with_surrogates(docs)
    return changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one row for each piece of a document, with its ids and its place in a sequence; a text without tokens is its end id."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("packing", packing),
]

#: Classifier, components and packing have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written as Parquet and read as the next one's."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""From documents to token ids: toxic documents, repeated lines, near-duplicates and benchmark leaks go, the rest is encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from porescreen.llm import bpe, decontaminate, documents, lines, simhash, toxicity
from porescreen.llm.common import table
from porescreen.session import shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; the model learns from the labels of documents that are not held out."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go from the texts; all documents stay, some without text."""
    return lines.without_repeats(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links, as in op1, stays; documents without words are one group.

    Most pairs of similarity between 0.8 and 0.95 differ in more than four bits, so groups of five-word Jaccard similarity
    0.8 or more among the documents that are left follow.
    """
    return documents.kept_documents(simhash.kept_documents(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document; ids are decimals joined by spaces."""
    return bpe.encode(docs, with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity_stage), ("line_dedup", line_stage), ("simhash", simhash_stage),
    ("decontamination", decontamination_stage), ("byte_bpe", encoding_stage),
]

#: The stages learn, hash and encode, which SQL can't express; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

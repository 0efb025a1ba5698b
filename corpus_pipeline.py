"""A corpus in five stages: toxic documents go, then near copies, then documents that hold benchmark items; personal data
is masked, and what is left is packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from communis.llm import decontaminate, packing, pii, simhash, toxicity
from communis.llm.common import Tables, table


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null, empty and repeated rows are judged like any other; columns stay."""
    return toxicity.drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (by op6's fingerprints and anchors, or by shingles) the document of least id stays. Null, empty and blank texts are one group; columns stay."""
    return simhash.deduplicate(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts stay; columns stay."""
    return decontaminate.drop_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, and n_chars follows. Null and empty texts stay as they are; columns stay."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and its place there. Null and empty texts are an end id alone."""
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", clean_toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", mask_pii),
    ("packing", pack),
]
#: Models, components and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages leave of documents. Each stage's output is a table that the next one reads.

    Empty tables give no rows; rows of null ids, repeated rows and extra columns go through all stages; very long texts
    are read whole."""
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = tables.put(docs)
    return docs

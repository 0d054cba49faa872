"""Corpus pipeline: low quality goes, repeated lines go, one document of each near-duplicate group stays, the rest is packed.

Defined results, stage by stage: null and empty texts are scored, deduplicated and packed as empty; very long texts are
read whole; rows without doc_id pass the first three stages by their text and are not packed, as a piece needs an id; rows
that repeat a doc_id are judged each by their own text, but count as one document for lines; an empty table gives an empty
result; without labels nothing is rejected; further columns keep their names and values, but for n_chars, which follows a
text that lost lines. What the operators' docstrings state of ties holds here too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import common, line_dedup, packing, quality, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others stay as they are."""
    return quality.reject(docs, common.table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the largest doc_id that holds them. No document goes, even if no line is left."""
    return line_dedup.without_repeats(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links reach, the smallest doc_id stays, as it is."""
    return simhash.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_deduplication), ("simhash_near_dedup", near_deduplication), ("best_fit_packing", best_fit_packing)]

#: The classifier is no SQL; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over `documents`: language, near copies, benchmark passages, personal data, bins.

Every stage reads all that the stage before it kept, as a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pericope.llm import decontaminate, jaccard, langid, packing, pii
from pericope.llm.shared import cut, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, with or without a label: those that the byte network doesn't reject, unchanged.

    Null and empty texts are in no language and go. Texts of any length are read
    whole; repeated rows and equal texts share their fate; null ids, labels and
    other columns don't matter, whatever their names. An empty table stays empty.
    Without any label the network still tells texts from noise.
    """
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group that similar pairs connect.

    Rows with a null id, and texts that are null, empty or without a word, stay,
    as they are like nothing. Texts of any length are compared whole. Rows are
    told apart by id alone, so repeated rows of one id stay or go together. Ties
    can't occur among ids. Other columns don't matter, whatever their names. An
    empty table stays empty.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows with a null id, and null and empty texts, stay, as nothing is found in
    them. Texts of any length are searched whole; all rows of an id go as soon
    as one holds an item. Other columns don't matter, whatever their names. An
    empty table stays empty, and without items nothing goes.
    """
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by their kind, and n_chars made right where the text changed.

    Null and empty texts stay as they are; texts of any length are read whole;
    repeated rows stay equal; null ids and other columns, whatever their names,
    aren't touched. An empty table stays empty.
    """
    return pii.redacted(docs, pii.train())


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in bins of one capacity.

    Null and empty texts have no piece; a text of any length is cut into pieces
    and packed whole; rows with a null id and repeated rows are packed each.
    Pieces of one id and length tie and can change places. Other columns don't
    matter, whatever their names. An empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", private_data),
    ("packing", bins),
]

#: The language and the PII stage are trained networks and fields, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        # a table of this run is deleted as soon as the next one is written, the last with the process
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        release(before)
    return docs

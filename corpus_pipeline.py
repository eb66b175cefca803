"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of documents.  run() writes each stage's rows to the shared folder and
reads them again, so that a lost executor never recomputes an earlier stage.

Defined results of every stage: columns besides those of documents go through, whatever their names, up to the packing stage; an empty
table gives no rows; very long texts are read whole; what else is odd is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.common import cut, read_table
from spanveil.llm.exact_dedup import distinct_documents
from spanveil.llm.mixing import mixed
from spanveil.llm.near_dedup import one_of_each_group
from spanveil.llm.packing import pack
from spanveil.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold.

    Null and empty texts are scored as empty and stay; repeated rows, and rows of a null doc_id, are each judged by their text.
    """
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the one with the least doc_id.

    Null texts equal empty ones; of repeated rows (and ties of doc_id) one stays; a null doc_id is above all others.
    """
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id.

    Texts without words are near to none and stay.
    """
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says: rare languages are repeated, and of the others some are left out.

    Texts without words have the prior as posteriors; rows of one doc_id share its rate.
    """
    return mixed(docs, read_table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row: its place in a sequence of at most 2048 ids.

    Null and empty texts are the id 1 alone; rows of one doc_id, which mixing makes, are packed each on its own.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Learned lexicons and fitted rates can't be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs

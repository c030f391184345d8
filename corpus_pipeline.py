"""From documents to packed training windows, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents, whatever extra columns there are and however they are
called. Rows are judged by themselves: repeated rows and rows without a doc_id
count as documents of their own, but for near duplicates. Texts are read whole,
however long. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veracast.llm import mixing, near_dedup, packing, quality, toxicity
from veracast.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go, by their own failures and their host's
    verdict. Null, empty and blank texts fail; documents without a source are
    one host, and a rate on a limit is taken as within it."""
    return quality.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxic model prefers go, by more than the threshold. Null and empty
    texts, and texts without words, stay; without labels of both classes all do."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id. Rows without
    a doc_id or without words all stay; of rows with one doc_id that have words, the one of the least
    text hash does."""
    return near_dedup.keep_one(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources meet their weights. Null and empty
    texts are drawn at their source's rate; a source without characters supplies nothing; ties
    in a source's order go by the text's hash, and rows that are alike are interchangeable."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the training windows. Texts that are null or
    have no token have none; a text longer than a window has several pieces; documents of
    one length go by bucket and id."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("mixing", source_mixture),
    ("packing", pack),
]

#: The toxicity models and the similarity join have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents table. Stages' tables go to
    the shared folder (see spark.checkpoint.dir) and are left there, as the result is read from the last."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name.replace(' ', '-')}.parquet"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs

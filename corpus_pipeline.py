"""A training corpus out of `documents`: quality filter, exact and near dedup, mixing and packing, stage by stage.

All stages but the last keep whole rows, with all columns. Null texts count as empty. Rows are decided one by one, also
where their ids are null or repeated; of rows equal in text one stays (exact dedup). An empty table passes every stage
as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm.exact_dedup import drop_copies
from attestry.llm.mixing import mixed_docs
from attestry.llm.ngram_join import keep_representatives
from attestry.llm.packing import pack
from attestry.llm.quality import keep_good
from attestry.llm.shared import spool, table


#: A domain's target in the mixing stage is at most so many times its tokens.
EPOCHS = 1.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by a Jaccard similarity of 0.8."""
    return keep_representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate towards the target weights says.

    After the quality stage there is next to no junk, so its share of the weights is out of reach; it gets EPOCHS times
    what there is.
    """
    return mixed_docs(docs, table(spark, sf_dir, "labels"), epochs=EPOCHS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

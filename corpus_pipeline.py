"""A corpus pipeline of five stages, each calling one operator of tidelake.llm on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import exact_dedup, mixing, packing, quality, simhash
from tidelake.llm.common import discard, settled
from tidelake.llm.queries import PACKING_VOCABULARY, table, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier, trained on the table labels, accepts; columns as they were.

    Null and empty texts have the score of a text without words; each repeated row is decided like the first. Columns
    score and predicted of docs, if there, come through unread. No documents, none kept.
    """
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    kept = quality.scored(docs.select("text", F.struct("*").alias("row")), model).filter("predicted = 1")
    return kept.select("row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts (white space aside); null and empty texts are one group."""
    return exact_dedup.distinct_texts(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more; texts without words are
    one group."""
    return simhash.near_kept(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it; rows that share a doc_id are drawn each for itself."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, one row a piece; a text of nothing has one token, its end."""
    return packing.packed(docs, vocabulary(PACKING_VOCABULARY))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_distinct),
    ("simhash near-dedup", keep_one_of_near),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the classifier, the near copies by similarity and the tokens; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted when its own table is there, and that after the
    next; the last stage's tables stay, as its rows are still to be read.

    Null and empty texts, repeated rows, null ids and an empty table go through: see each stage's operator.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir))
        discard(before)

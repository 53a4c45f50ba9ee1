"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, token-ID files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``, whatever else they
hold: no name of an extra column clashes. Empty tables give empty results with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huepoint.llm import jaccard, mixing, tokenids, toxicity, winnowing
from huepoint.llm._store import stash, table
from huepoint.llm.entries import vocabulary


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 and more go; equal texts go or stay together.

    A null or empty text scores like a text without hits. Rows that repeat an id are scored each. Texts are
    scored as a whole, however long. Without labels of both kinds all documents have the share of toxic ones.
    """
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle similarity 0.75 stays, that with the smallest id.

    Null and empty texts are linked with nothing and stay. Rows that repeat an id are one document: all of
    them stay or go. A null id counts as larger than all others. Whole texts are compared, however long.
    """
    return jaccard.keep_one_of_each(docs, k=5, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 10 words in a row with a benchmark item (or a whole shorter item) go.

    Null, empty and wordless texts share nothing and stay; rows that repeat an id are judged each by its text.
    """
    return winnowing.uncontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, 3 times at most.

    A null source is one, the last. A null or empty text has no words; its copies cost nothing. Rows that
    repeat an id draw alike. A source without words isn't taken.
    """
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each copy, read from the files.

    In ascending order of id, null last, rows of equal id in the order of their texts. Null and empty texts
    have the end id alone. An empty table gives no rows.
    """
    return tokenids.write_and_read(docs, vocabulary(), end_id=1)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_files", token_files),
]

ORACLE_SQL = None  # scores of a fitted model and a tokenizer's ids are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs

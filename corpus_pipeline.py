"""A corpus pipeline of five stages; each works on what the one before it left."""

from __future__ import annotations

from meshweave.llm.common import checkpointed, documents
from meshweave.llm.langid import in_a_language
from meshweave.llm.mixing import mixed_documents
from meshweave.llm.near_dedup import drop_near_duplicates
from meshweave.llm.packing import pack_documents
from meshweave.llm.suffix_dedup import without_repeats
from pyspark.sql import DataFrame, SparkSession


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language; those without letters, or of too many languages, go.

    Null and empty texts go; repeated rows are judged alike; an empty table gives an empty one.
    """
    return in_a_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates.

    Rows without id or without words stay, of repeated rows one stays; an empty table gives an empty one.
    """
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 100 bytes and more that occur earlier.

    Every row stays, a null text null; rows that share an id share its places; an empty table gives an empty one.
    """
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some more than once, so that sources have their target shares.

    Null sources are a source of their own, a null or empty text has no words; repeated rows share their copies; an empty table gives an empty one.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into windows, each of the mix's proportions.

    A null or empty text is its end alone, repeated rows are documents of their own; an empty table gives no pieces.
    """
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mix", mix), ("pack", pack)]

#: SQL cannot express learning or a tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them.  Extra columns of any names are kept."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs

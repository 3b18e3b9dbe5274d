"""Training-data pipeline: quality, near duplicates, passages, mixing, tokens.

Every stage takes documents with any columns besides doc_id, text and source, clashing names
included, and leaves the columns as they are (the last one gives tokens).  An empty table gives
an empty one at every stage.  Texts are worked on whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import bpe_tree, line_crf, ngram_join, poisson_mix, suffix_dedup
from webstrata.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject.

    A null or empty text is one empty line and is scored as such; repeated rows are scored alike;
    with no usable labels every score is 0.5, which is accepted.
    """
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Of rows that repeat an id and text one stays, a null id is the largest of all; texts without
    words (null, empty, white space) are nobody's duplicates and all stay.
    """
    return ngram_join.drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document holds.

    Documents are ordered by doc_id, nulls last, then by their texts, so that repeated and null ids
    keep a passage once too; a document of which no word is left goes, texts without words stay.
    """
    return suffix_dedup.cut_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their target weights, in shuffled order.

    A null source is a source of its own; documents of a source without characters go; rows with one
    id (null included) are repeated equally often.
    """
    return poisson_mix.mix_sources(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text, one row a copy; null and empty texts have no tokens."""
    return bpe_tree.bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: A conditional random field, MinHash and BPE aren't SQL; ``tests/llm/test_pipeline.py`` holds run() against a plain chain of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between two stages is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs

"""The training-data pipeline: filter, deduplicate, mix and encode documents.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``.  Any column may be
null, texts may be empty or very long, rows may be repeated, extra columns may
have any name and pass through, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmura.llm import byte_bpe, importance, langid, mixing, ngram_join
from murmura.scratch import materialize

#: Near-duplicates: shingles of five words, a Jaccard similarity of 0.8 or more.
NEAR = ngram_join.Rule(width=5, num=80, den=100, lower=True)

#: The stages use hash-seeded models and trees of numbers that SQL can't express.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good labelled text keeps.

    Null and empty texts, and those without a token, go.  Rows of one id share a
    draw; ties at the cut go to the larger id as text.
    """
    return importance.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier knows.

    Null texts and those without a letter go.  A null language teaches nothing;
    without any language nothing is known and all go.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Texts without a word are alike with nothing and stay, as do rows with a null
    id.  Of rows equal in id and text one stays; rows of one id with different
    texts stay if the id does.
    """
    return ngram_join.representatives(docs, NEAR)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights.

    A null source is a source of its own, null text counts no words, rows of one
    id are taken equally often.
    """
    return mixing.emit(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, one row for each document; null text is empty."""
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i + 1}")
    return docs

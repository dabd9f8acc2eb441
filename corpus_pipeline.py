"""A corpus pipeline: each stage works on all that its predecessor kept.

Quality rules drop bad documents, MinHash near-dedup keeps one document of each group (five-word shingles, similarity
0.8), substring dedup takes out repeated passages of 20 words or more, mixing takes blocks of each source
up to its target, and SentencePiece encodes what is left. A document may come out of the mixture once, twice or in
parts, so ids repeat from there on.

Defined cases: documents with a null or empty text, or without words, fail the quality rules and go first; a null id is linked with
nothing, counts as the largest id for repeats, and keeps its documents; repeated rows stay repeated until mixing, which takes each
by its own quota; very long texts go through whole; columns besides those of documents, whatever their names, come along up to the
last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import mixing, near_dups, pieces, quality_rules, substring_dups
from loomspark.llm.common import table, written
from loomspark.llm.queries import vocabulary
from loomspark.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dups.keep(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier."""
    return substring_dups.remove(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target proportions."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and of decoded text."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix),
    ("SentencePiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs

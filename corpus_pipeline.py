"""A corpus pipeline: toxic documents go, similar lines and near copies are dropped, sources
are mixed to target weights, and what is left is packed into sequences.

Each stage reads what the one before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.llm import lines, mixing, packing, simhash, toxicity
from ledgerfold.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, learned from their labels, doesn't reject."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.accepted(docs, labels)


def drop_similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that another line before them resembles; documents of which no
    line is left go."""
    return lines.cleaned(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each round that takes (part of) a document."""
    return mixing.mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: which piece of which document stands where in which bin."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_similar_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Neither a trained network nor union-find can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is written to the shared
    folder and read again."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return docs

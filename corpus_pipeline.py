"""From raw documents to packed training sequences.

Toxic documents go, then documents of low quality, then all but one of each class of
near duplicates; what is left is packed into sequences. Models are fitted to the labels
beside the documents, in samples of bounded size; every stage decides about all that
its predecessor kept.

Every stage takes documents with nulls in any column, empty and very long texts, repeated
rows, shared or null ids, other columns of any name, and no rows at all: what it makes of
these is said at the operator that it calls. A null text counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import near_dups, packing, rule_quality, toxicity
from siftwell.llm._shared import materialize
from siftwell.llm.queries import BYTE_BPE, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    return rule_quality.drop_low_quality(docs, rule_quality.fit_quality(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near duplicates."""
    return near_dups.drop_near_duplicates(docs, similar=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens: a row per piece."""
    return packing.pack(docs, BYTE_BPE, capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("packing", pack),
]
#: Fitted models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

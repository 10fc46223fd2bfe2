"""The registered queries of the text operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import fingerprints, line_crf, near_dups, ngram_join, packing, rule_quality, token_counts, token_files, toxicity, tree_bpe, turns, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=1024, end_id=2)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encode_and_decode(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels), threshold=0.3)


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge_lines(docs, line_crf.fit_lines(docs))


def op7_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rule_quality.score_quality(docs, rule_quality.fit_quality(docs, labels), threshold=0.3)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), similar=0.8).select("doc_id", "class_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), percent=90)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_conversations(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_pack": op1_pack,
    "op2_warc": op2_warc,
    "op3_tree_bpe": op3_tree_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_line_crf": op6_line_crf,
    "op7_rule_quality": op7_rule_quality,
    "op8_token_files": op8_token_files,
    "op9_token_counts": op9_token_counts,
    "op10_near_dups": op10_near_dups,
    "op11_whitening": op11_whitening,
    "op12_ngram_join": op12_ngram_join,
    "op13_turn_repair": op13_turn_repair,
    "pipeline": pipeline,
}
#: SQL for those that SQL can express; tokenizers, models and files are beyond it.
ORACLES: dict[str, str] = {}

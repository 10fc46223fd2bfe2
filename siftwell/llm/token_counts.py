"""Token counts without token ids.

Merges never cross a pre-token, so a document has as many tokens as its pre-tokens
have pieces. Documents' distinct pre-tokens go, with their frequencies, to a table; the
distinct ones of all documents are counted once each, by the executors, joined to it, and
summed. The pre-tokens that most documents have are joined from a table that all tasks
get, whose size is bounded; the others by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import id_and_text, id_type, join_to_one, materialize, small_batches
from siftwell.llm.bpe import byte_bpe

#: Pre-tokens of most documents that all tasks get for their join, and characters of one at most: what bounds that table.
FREQUENT, LONGEST = 100_000, 64


def frequencies(texts: DataFrame, tokenizer: str, kind: str) -> DataFrame:
    """doc_id, n_bytes, specials (special tokens in the text), pre_tokens (distinct ones) and times of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            specials, words, times = [], [], []
            for text in batch.column(1).to_pylist():
                found, n = bpe.pre_tokens(text)
                own = Counter(found)
                specials.append(n)
                words.append(list(own.keys()))
                times.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(specials, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "n_bytes", "specials", "pre_tokens", "times"])

    return texts.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, f"doc_id {kind}, n_bytes long, specials long, pre_tokens array<string>, times array<int>")


def vocabulary(counted: DataFrame, tokenizer: str) -> DataFrame:
    """pre_token, n (documents that have it) and pieces of each distinct pre-token, counted once."""

    @F.pandas_udf("int")
    def n_pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(tokenizer)
        for words in batches:
            yield words.map(bpe.n_pieces)

    distinct = counted.select(F.explode("pre_tokens").alias("pre_token")).groupBy("pre_token").agg(F.count(F.lit(1)).alias("n"))
    return distinct.withColumn("pieces", n_pieces("pre_token"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null or empty text has no bytes and no tokens. Texts of any length are taken whole. Rows that repeat,
    and ids that repeat or are null, are each counted and returned. No rows: no rows. Other columns are not
    read, so their names can't clash. ``frequent`` pre-tokens are joined without a shuffle; results don't
    depend on it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts, kind = id_and_text(docs, id_col, text_col), id_type(docs, id_col)
    counted = materialize(frequencies(texts, tokenizer, kind), "pre-tokens", compression="zstd")
    known = materialize(vocabulary(counted, tokenizer), "vocabulary")
    common = materialize(known.filter(F.length("pre_token") <= LONGEST).orderBy(F.desc("n"), "pre_token").limit(frequent), "common")
    # the rows are fixed in files now, so a row's number stays
    rows = counted.withColumn("row", F.monotonically_increasing_id())
    pairs = rows.select("row", F.explode(F.arrays_zip("pre_tokens", "times")).alias("x")).select("row", F.col("x.pre_tokens").alias("pre_token"), F.col("x.times").cast("long").alias("times"))
    pieces = F.sum(F.col("times") * F.col("pieces")).alias("n")
    near = pairs.join(F.broadcast(common.select("pre_token", "pieces")), "pre_token").groupBy("row").agg(pieces)
    # a pre-token that many documents have is dealt to several tasks
    rare = pairs.join(F.broadcast(common.select("pre_token")), "pre_token", "left_anti")
    far = join_to_one(rare, known.join(F.broadcast(common.select("pre_token")), "pre_token", "left_anti"), "pre_token", "n", ["row"]).groupBy("row").agg(pieces)
    sums = near.unionByName(far).groupBy("row").agg(F.sum("n").alias("n"))
    total = (F.col("specials") + F.coalesce("n", F.lit(0))).cast("long")
    return rows.select("row", "doc_id", "n_bytes", "specials").join(sums, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))

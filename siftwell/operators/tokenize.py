"""Byte-pair ids of documents, with the end id after each."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split before merges, and the id that ends a document. Fixed values of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256


@lru_cache(2)
def encoding(path: str):
    """The encoding of a file of ranks (base 64 and rank on each line); its special strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_ids(docs: DataFrame, path: str, end: int | None = END, most: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, len: the ids of each whole text (of its first ``most`` ids, if given) and the end id. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoding(path), np.array([] if end is None else [end], np.int32)
        for batch in batches:
            found = [np.append(own.encode_to_numpy(t, disallowed_special=()).astype(np.int32)[:most], last) for t in batch.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([*found, last[:0]]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes, pa.int64())], names=["doc_id", "ids", "len"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, len long")


def token_of(path: str, i: int) -> bytes:
    """The bytes of an id."""
    return encoding(path).decode_single_token_bytes(i)


def id_of(path: str, token: bytes) -> int:
    """The id of a token's bytes; raises KeyError if it is none."""
    return encoding(path).encode_single_token(token)

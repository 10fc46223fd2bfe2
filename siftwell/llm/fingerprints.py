"""Document fingerprints from content-defined chunks.

A gear hash of the last 16 bytes is compared with a strict mask before the normal
chunk size and a loose one after it, so chunk sizes gather around that size and
boundaries move with the text. A fingerprint is the set of chunk digests, each with
its chunk's length; how much of one text's length lies in chunks that the other
also has is its containment.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import id_and_text, id_type, small_batches

#: Chunk sizes in bytes, and the top bits of the hash that are zero at a boundary before and after the normal size.
LEAST, NORMAL, MOST, STRICT, LOOSE = 16, 40, 160, 6, 4
WINDOW = 16
#: A random 16-bit number for each byte.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256).astype(np.uint16)


def gear_hash(data: bytes) -> np.ndarray:
    """For each byte the hash of it and the 15 before it: each shifted by its distance, summed modulo 2**16."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            h[step:] += h[:-step].copy() << np.uint16(step)
    return h


def boundaries(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks of ``data`` from ``start``, which is 0 or a boundary."""
    first = max(0, start - WINDOW)
    h = gear_hash(data[first:] if first else data)
    loose = np.flatnonzero(h < 1 << 16 - LOOSE)
    strict = (loose[h[loose] < 1 << 16 - STRICT] + (first + 1)).tolist()
    loose = (loose + (first + 1)).tolist()
    n, ends, at, s, k = len(data), [], start, 0, 0
    strict.append(n + MOST)
    loose.append(n + MOST)
    while n - at > LEAST:
        s = bisect_left(strict, at + LEAST, s)
        end = strict[s]
        if end > at + NORMAL:
            k = bisect_left(loose, at + NORMAL, k)
            end = min(loose[k], at + MOST)
        if end >= n:
            break
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunk_set(data: bytes, ends: list[int], start: int = 0) -> dict[int, int]:
    """Digest of each chunk and its length."""
    digest = xxhash.xxh3_64_intdigest
    out: dict[int, int] = {}
    for end in ends:
        out[digest(data[start:end]) >> 16] = end - start
        start = end
    return out


def fingerprint(text: str) -> dict[int, int]:
    data = text.encode()
    return chunk_set(data, boundaries(data))


def written(chunks: dict[int, int]) -> str:
    """A fingerprint as text: 48 bits of digest and 8 of length for each chunk, sorted, in base 64."""
    if not chunks:
        return ""
    packed = np.array(sorted(d << 8 | n for d, n in chunks.items()), ">u8")
    return base64.b64encode(packed.view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()).decode()


def parsed(text: str) -> dict[int, int]:
    packed = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 7)
    values = np.zeros((len(packed), 8), np.uint8)
    values[:, 1:] = packed
    return {int(v) >> 8: int(v) & 255 for v in values.view(">u8").ravel()}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of ``a``'s chunk lengths whose chunks ``b`` has; two empty sets contain each other."""
    total = sum(a.values())
    if not total:
        return 1.0 if not b else 0.0
    return sum(map(a.__getitem__, a.keys() & b.keys())) / total


def edited_text(text: str, following: str) -> str:
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


class Chunked:
    """A text with its chunks."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text, self.data = doc_id, text, text.encode()
        self.ends = boundaries(self.data)
        self.chunks = chunk_set(self.data, self.ends)

    def edited(self, following: str) -> tuple[bytes, dict[int, int]]:
        """The edited text and its chunks; those that end within the kept text are known already."""
        kept = len(self.text) - len(self.text) // 4
        kept_bytes = len(self.text[:kept].encode())
        data = self.data[:kept_bytes] + following[: len(self.text) - kept].encode()
        n = bisect_left(self.ends, kept_bytes + 1)
        while n and self.ends[n - 1] - (self.ends[n - 2] if n > 1 else 0) <= LEAST and self.ends[n - 1] == len(self.data):
            n -= 1
        known = self.ends[:n]
        start = known[-1] if known else 0
        chunks = chunk_set(self.data, known)
        chunks.update(chunk_set(data, boundaries(data, start), start))
        return data, chunks


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def row(this: Chunked, following: Chunked) -> tuple:
    data, edited = this.edited(following.text)
    return this.doc_id, len(this.text), hashlib.sha256(data).hexdigest(), written(this.chunks), written(edited), containment(this.chunks, edited), containment(this.chunks, following.chunks)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    near_edited and near_next are the containment of the text's fingerprint in that of its edited
    form (its last quarter replaced by the beginning of the next document) and in the next
    document's. Rows are in ascending id order (nulls first; equal ids by the hash of their text),
    and the last row's next is the first. A null text is empty; two empty texts contain each other.
    No rows: no rows. Other columns are not read, so their names can't clash.

    Texts are moved once, into ranges that are cut beforehand on ids and hashes alone. The first row of
    each range is also sent to the range before it, so that every row meets its next in one pass.
    """
    small_batches(docs.sparkSession)
    kind, spark = id_type(docs, id_col), docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    # one row for each range that has rows
    firsts = rows.select(key.alias("key")).repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key")).orderBy("key").collect()
    if not firsts:
        return spark.createDataFrame([], f"doc_id {kind}, {RESULT}")
    starts = spark.createDataFrame([(k, tuple(r.key)) for k, r in enumerate(firsts)], f"place int, start struct<known: boolean, doc_id: {kind}, tie: bigint>").coalesce(1)
    # the last start that isn't above the row: first among every width-th, then among those that follow it
    width = math.isqrt(len(firsts)) + 1
    listed = starts.agg(F.array_sort(F.collect_list("start")).alias("starts"))
    listed = F.broadcast(listed.select("starts", F.filter("starts", lambda x, i: i % width == 0).alias("coarse")))
    below = lambda c: F.size(F.filter(c, lambda x: x <= key))
    block = (below("coarse") - 1) * width
    place = block + below(F.slice("starts", block + 1, F.lit(width))) - 1
    # one row beside each
    placed = rows.join(listed).select(place.alias("place"), F.lit(0).alias("after"), "doc_id", "text", "tie")
    # rows that are equal in all of the key are equal texts, so any of them will do
    edges = rows.join(F.broadcast(starts), F.col("doc_id").eqNullSafe(F.col("start.doc_id")) & (F.col("tie") == F.col("start.tie"))).groupBy("place").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    following = edges.select(F.pmod(F.col("place") - 1, F.lit(len(firsts))).cast("int").alias("place"), F.lit(1).alias("after"), "doc_id", "text", "tie")
    ordered = placed.unionByName(following).repartitionById(parts, F.col("place")).sortWithinPartitions("place", "after", F.col("doc_id").isNotNull(), "doc_id", "tie")

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            found = []
            for number, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                this = Chunked(doc_id, text)
                if held is not None and number == at:
                    found.append(row(held, this))
                held, at = this, number
            if found:
                kinds = (batch.schema.field(1).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=NAMES)

    return ordered.select("place", "doc_id", "text").mapInArrow(pass_by, f"doc_id {kind}, {RESULT}")

"""Token ids in files of patched frame-of-reference blocks.

A file holds blocks of ``BLOCK`` ids (the last may be shorter), then where each
block starts, then the table of its documents, then a fixed footer. A block has its
minimum, the width that the given percentile of differences needs, all differences
packed at that width, and lists with the places and full differences of those that
don't fit. Any document is found from the table and the index alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm._shared import fresh_path, id_and_text, id_type, materialize, small_batches
from siftwell.llm.bpe import byte_bpe
from siftwell.llm.files import RolledFile, read_named

MAGIC = b"PFORIDS1"
#: Ids in a block; a place in it fits 16 bits.
BLOCK = 4096
#: Ids after which a writer begins another file.
FILE_IDS = 8 << 20
HEAD, FOOT = struct.Struct("<IHHB"), struct.Struct("<QQQQ8s")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros(n, np.uint32)
    for k in range(width):
        out |= bits[:, k].astype(np.uint32) << np.uint32(k)
    return out


def encode_block(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    low = ids.min()
    above = ids - low
    width = int(np.percentile(above, percentile, method="higher")).bit_length()
    odd = np.flatnonzero(above >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    return b"".join((HEAD.pack(int(low), len(ids), len(odd), width), pack_bits(above & np.uint32((1 << width) - 1), width), odd.astype("<u2").tobytes(), above[odd].astype("<u4").tobytes()))


def decode_block(data: memoryview) -> np.ndarray:
    low, n, n_odd, width = HEAD.unpack_from(data)
    packed = (n * width + 7) // 8
    if len(data) != HEAD.size + packed + 6 * n_odd:
        raise ValueError("a block's length doesn't agree with its header")
    out = unpack_bits(data[HEAD.size : HEAD.size + packed], n, width)
    if n_odd:
        at = HEAD.size + packed
        out[np.frombuffer(data, "<u2", n_odd, at)] = np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd)
    return out + np.uint32(low)


class TokenFileWriter:
    """Appends documents to one open file."""

    def __init__(self, out, id_kind: pa.DataType, percentile: float):
        self.out, self.id_kind, self.percentile = out, id_kind, percentile
        self.starts: list[int] = []
        self.doc_ids: list = []
        self.lengths: list[int] = []
        self.rest: list[np.ndarray] = []
        self.n_rest = self.n_ids = 0
        out.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.rest.append(ids)
        self.n_rest += len(ids)
        self.n_ids += len(ids)
        if self.n_rest >= BLOCK:
            flat = np.concatenate(self.rest)
            whole = len(flat) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self.block(flat[at : at + BLOCK])
            self.rest, self.n_rest = [flat[whole:]], len(flat) - whole

    def block(self, ids: np.ndarray) -> None:
        self.starts.append(self.out.size)
        self.out.write(encode_block(ids, self.percentile))

    def close(self) -> None:
        if self.n_rest:
            self.block(np.concatenate(self.rest))
        index = self.out.size
        self.out.write(np.array([*self.starts, index], "<u8").tobytes())
        table = pa.record_batch([pa.array(self.doc_ids, self.id_kind), pa.array(self.lengths, pa.int64())], names=["doc_id", "n_tokens"])
        with pa.ipc.new_stream(sink := pa.BufferOutputStream(), table.schema) as stream:
            stream.write_batch(table)
        documents = self.out.size
        self.out.write(sink.getvalue().to_pybytes())
        self.out.write(FOOT.pack(index, documents, self.n_ids, len(self.starts), MAGIC))
        self.out.close()


def read_documents(content: bytes) -> Iterator[tuple[object, int, np.ndarray]]:
    """(doc_id, place of its first id in the file, ids) of each document of a file."""
    view = memoryview(content).cast("B")
    index, documents, n_ids, n_blocks, magic = FOOT.unpack_from(view, len(view) - FOOT.size)
    if magic != MAGIC or bytes(view[:8]) != MAGIC:
        raise ValueError("not a token file")
    starts = np.frombuffer(view, "<u8", n_blocks + 1, index)
    table = pa.ipc.open_stream(view[documents : len(view) - FOOT.size]).read_all()
    if sum(lengths := table.column(1).to_pylist()) != n_ids:
        raise ValueError("the documents' lengths don't sum to the file's")
    at, block, held = 0, 0, np.zeros(0, np.uint32)
    for doc_id, n in zip(table.column(0).to_pylist(), lengths, strict=True):
        parts = [held]
        have = len(held)
        while have < n:
            parts.append(decode_block(view[starts[block] : starts[block + 1]]))
            block, have = block + 1, have + len(parts[-1])
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield doc_id, at, held[:n]
        held, at = held[n:], at + n


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, percentile: float = 90.0, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents in ascending id order into files under ``folder``; returns the manifest.

    Manifest: partition, seq (files are in the order of the two), file_name, n_docs, n_tokens.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made, writer = byte_bpe(tokenizer).encode, [], None

        def end() -> None:
            writer.close()
            made.append((writer.out.partition, len(made), writer.out.name, len(writer.lengths), writer.n_ids))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    writer = TokenFileWriter(RolledFile(folder, ".pfor"), batch.schema.field(0).type, percentile)
                writer.add(doc_id, np.append(encode(text), np.uint32(end_id)))
                if writer.n_ids >= file_ids:
                    end()
                    writer = None
        if writer is not None:
            end()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["partition", "seq", "file_name", "n_docs", "n_tokens"])

    small_batches(docs.sparkSession)
    # the text's hash splits an id that many rows have; tokens are made after the exchange, so sampling for it is cheap
    ordered = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialize(ordered.mapInArrow(write, "partition long, seq long, file_name string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, id_kind: str) -> DataFrame:
    """Per document of the files of ``manifest``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    order = Window.orderBy("partition", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file of millions of ids: the prefix sum is over few rows
    first = manifest.select("file_name", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long").alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = [(doc_id, base + at, len(ids), zlib.crc32(ids.astype("<u4"))) for doc_id, at, ids in read_documents(content.as_buffer())]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) if k == 0 else pa.array(c, pa.int64()) for k, c in enumerate(columns)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_named(spark, folder, first).select("content", "first").mapInArrow(read, f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids to token files and read them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone. Null ids come first; rows of equal id are in the
    order of their texts' hashes, each a document of its own. No rows: no files and no rows.
    Other columns are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, end_id, id_col=id_col, text_col=text_col)
    if manifest.isEmpty():
        return spark.createDataFrame([], f"doc_id {id_type(docs, id_col)}, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, manifest, id_type(docs, id_col))

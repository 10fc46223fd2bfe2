"""Flat token files: 16-bit ids by split and domain, with the documents' lengths beside them."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids after which a task begins another file, which bounds what one task reads back.
FILE_IDS = 8 << 20
#: Ids that a reader gives on at a time; a longer document is given alone.
READ_IDS = 1 << 20
MANIFEST = "split string, domain string, file_name string, n_docs long, n_tokens long, append string"


def domain_folder(domain: str | None) -> str:
    """A domain's name as a folder: slash to hyphen, space to underscore, no brackets; none for null."""
    return "none" if domain is None else domain.translate(str.maketrans({"/": "-", " ": "_", "(": None, ")": None}))


def append_tokens(docs: DataFrame, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Append documents (split, domain, doc_id, ids) to ``folder``; returns the manifest of the files that this call wrote.

    A file ``split/domain/<unique>.bin`` has little-endian 16-bit ids, and ``.len`` beside it the
    lengths of its documents as a numpy array. Documents of one file are in id order. Tasks name
    files after themselves, and readers take only what manifests name, so a task that runs twice
    harms nothing. No file is made where there are no documents. A null array has no ids; ids over
    65,535 raise. Manifests of all calls stay in ``folder``.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        made: list[tuple] = []
        at, held, n = None, [], 0

        def end() -> None:
            lengths = np.array([len(x) for x in held], np.int64)
            ids = np.concatenate(held)
            split, domain = at
            place = f"{split}/{domain_folder(domain)}"
            store.create_dir(f"{root}/{place}", recursive=True)
            name = f"{place}/{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{name}.bin", compression=None) as out:
                out.write(pa.py_buffer(ids))
            buffer = io.BytesIO()
            np.save(buffer, lengths)
            with store.open_output_stream(f"{root}/{name}.len", compression=None) as out:
                out.write(buffer.getvalue())
            made.append((split, domain, f"{name}.bin", len(held), len(ids)))

        for batch in batches:
            columns = [batch.column(c) for c in ("split", "domain", "ids")]
            for split, domain, ids in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], strict=True):
                own = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int64)
                if len(own) and not (own.min() >= 0 and own.max() <= 65535):
                    raise ValueError("an id doesn't fit 16 bits")
                if held and (at != (split, domain) or n >= file_ids):
                    end()
                    held, n = [], 0
                at = (split, domain)
                held.append(own.astype("<u2"))
                n += len(own)
        if held:
            end()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["split", "domain", "file_name", "n_docs", "n_tokens"])

    # sorted in ranges, so a large domain is dealt to several tasks
    ordered = docs.select("split", "domain", "doc_id", "ids").repartitionByRange("split", "domain", "doc_id").sortWithinPartitions("split", "domain", "doc_id")
    path = f"{folder}/_manifests"
    own = uuid.uuid4().hex
    written = ordered.select("split", "domain", "ids").mapInArrow(write, MANIFEST.removesuffix(", append string"))
    written.withColumn("append", F.lit(own)).write.mode("append").parquet(path)
    return read_manifest(spark, folder).filter(F.col("append") == own).drop("append")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifests")


def portions(sizes: np.ndarray, most: int = READ_IDS) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of documents of at most ``most`` ids in all, or of one longer document."""
    ends, at = sizes.cumsum(), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def read_tokens(spark: SparkSession, folder: str, domains: list[str] | None = None) -> DataFrame:
    """split, domain, file_name, place, ids of each document that manifests name (of some domains only, if given); place is from 0 in its file.

    Tasks open the files that the manifests deal to them, one at a time, and give on some documents at a time; writers roll files to bound that.
    """
    manifest = read_manifest(spark, folder)
    if domains is not None:
        manifest = manifest.filter(F.col("domain").isin(domains))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def content(name: str) -> bytes:
            with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                return f.read()

        for batch in batches:
            for s, d, name, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, ids = np.load(io.BytesIO(content(f"{name.removesuffix('.bin')}.len"))), np.frombuffer(content(name), "<u2")
                if sizes.sum() != len(ids) or len(ids) != n:
                    raise ValueError(f"{name} has {len(ids)} ids; its lengths sum to {sizes.sum()} and its manifest says {n}")
                starts = np.concatenate([[0], sizes.cumsum()])
                for a, b in portions(sizes):
                    lists = pa.ListArray.from_arrays(pa.array(starts[a : b + 1] - starts[a], pa.int32()), pa.array(ids[starts[a] : starts[b]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([x] * (b - a), pa.string()) for x in (s, d, name)] + [pa.array(np.arange(a, b)), lists], names=["split", "domain", "file_name", "place", "ids"])

    named = manifest.select("split", "domain", "file_name", "n_tokens").repartition("file_name")
    return named.mapInArrow(read, "split string, domain string, file_name string, place long, ids array<int>")

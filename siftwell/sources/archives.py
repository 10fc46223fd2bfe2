"""Tar shards of samples as a Spark data source, and how executors write them.

A sample is a run of members whose names agree up to the first point after the folder; the rest of a
name says which part it is (``00017.jpg``, ``00017.json``). A shard is dealt to tasks by byte ranges: a
sample belongs to the range in which its first header stands. Tar files can't be entered anywhere, so
an index beside a shard (``.index``: places of headers, some bytes apart) tells a task where to begin;
without one it goes from header to header from the start, and skips what is between.
"""

from __future__ import annotations

import gzip
import io
import os.path
import tarfile
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a shard that one task reads, of a batch, and between the places that an index has.
RANGE_BYTES, BATCH_BYTES, INDEX_BYTES = 64 << 20, 8 << 20, 1 << 20
#: Bytes after which a task begins another shard.
SHARD_BYTES = 256 << 20
SCHEMA = "file string, key string, position long, parts map<string,binary>, error string"
ARROW = pa.schema([("file", pa.string()), ("key", pa.string()), ("position", pa.int64()), ("parts", pa.map_(pa.string(), pa.binary())), ("error", pa.string())])


def split_name(name: str) -> tuple[str, str]:
    """(key, part) of a member's name: the folder stays with the key, and the part begins after the first point of the rest."""
    folder, _, base = name.rpartition("/")
    stem, _, part = base.partition(".")
    return (f"{folder}/{stem}" if folder else stem), part.lower()


@dataclass
class TarRange(InputPartition):
    file: str
    start: int
    end: int


def headers(stream, start: int) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """The archive's files from the header at ``start`` on, by headers alone: contents are skipped unless they are read."""
    stream.seek(start)
    tar = tarfile.open(fileobj=stream, mode="r:")
    while (member := tar.next()) is not None:
        tar.members = []  # it would keep all
        if member.isfile():
            yield tar, member


def begin_of(store: fs.FileSystem, path: str, start: int) -> int:
    """The last place in the shard's index before ``start``; 0 if there is no index."""
    index = f"{path}.index"
    if not start or store.get_file_info(index).type == fs.FileType.NotFound:
        return 0
    with store.open_input_stream(index, compression=None) as f:
        places = np.frombuffer(f.read(), "<i8").tolist()
    at = bisect_left(places, start) - 1
    return places[at] if at >= 0 else 0


class TarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[TarRange]:
        """Names and sizes only are listed; contents are read by tasks."""
        store, root = fs.FileSystem.from_uri(self.path)
        files = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and x.size and x.path.endswith(".tar"))
        return [TarRange(p, a, min(a + self.range_bytes, size)) for p, size in files for a in range(0, size, self.range_bytes)] or [TarRange("", 0, 0)]

    def read(self, partition: TarRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, root = fs.FileSystem.from_uri(self.path)
        name, held, size = os.path.relpath(partition.file, root), [], 0
        with store.open_input_file(partition.file) as stream:
            for row in self.samples(stream, begin_of(store, partition.file, partition.start), partition):
                held.append((name, *row))
                size += sum(len(x) for _, x in row[2] or ())
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)

    def samples(self, stream, begin: int, own: TarRange) -> Iterator[tuple]:
        """(key, position, parts, error) of the samples whose first header is in the range."""
        key, position, parts, before = None, 0, {}, None
        try:
            for tar, member in headers(stream, begin):
                this, part = split_name(member.name)
                if this != before:
                    if parts:
                        yield key, position, list(parts.items()), None
                    parts = {}
                    if member.offset >= own.end:
                        return
                    # of a sample that begins before the range only names are looked at
                    key, position = (this, member.offset) if member.offset >= own.start else (None, 0)
                before = this
                if key is not None:
                    data = tar.extractfile(member).read()
                    if len(data) != member.size:
                        raise tarfile.ReadError("unexpected end of data")
                    parts[part] = data
        except tarfile.TarError as e:
            if key is not None or begin >= own.start:
                yield key, position, None, str(e)
            return
        if parts:
            yield key, position, list(parts.items()), None


class TarSamples(DataSource):
    """Samples of all ``.tar`` files under a folder: file, key, position (of its first header), parts (name -> bytes), error.

    Options: path, and rangeBytes (bytes that one task reads). A shard that is cut or damaged gives the samples
    before the fault, and one row with error and no parts; an empty file has no samples. Of members with one
    name within a sample the last counts. Folders and links are no members.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(dict(self.options))


def read_samples(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(TarSamples)
    return spark.read.format("tar_samples").option("rangeBytes", range_bytes).load(folder)


class ShardWriter:
    """A shard and its index, under a name of the task's attempt."""

    def __init__(self, folder: str, index: bool):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)
        self.name, self.places, self.size = f"{uuid.uuid4().hex}.tar", [] if index else None, 0
        self.stream = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.tar = tarfile.open(fileobj=self.stream, mode="w|", format=tarfile.PAX_FORMAT, bufsize=tarfile.RECORDSIZE)

    def add(self, name: str, data: bytes) -> None:
        if self.places is not None and (not self.places or self.tar.offset - self.places[-1] >= INDEX_BYTES):
            self.places.append(self.tar.offset)
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.tar.addfile(info, io.BytesIO(data))
        self.size = self.tar.offset

    def close(self) -> str:
        self.tar.close()
        self.stream.close()
        if self.places is not None:
            with self.store.open_output_stream(f"{self.root}/{self.name}.index", compression=None) as out:
                out.write(np.array(self.places, "<i8").tobytes())
        return self.name


def write_samples(samples: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, index: bool = True) -> DataFrame:
    """Write ``samples`` (key, parts: map of name to bytes) to tar shards; returns (file_name, samples, bytes) of each shard.

    The result is lazy: who reads it writes. A task's file has a name of its own attempt, so a task that
    runs twice leaves a file more, which the returned rows don't name. Rows without a key or parts are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, done = None, 0, []

        def end() -> None:
            nonlocal shard, n
            if shard:
                done.append((shard.close(), n, shard.size))
            shard, n = None, 0

        for batch in batches:
            for key, parts in zip(batch.column(0), batch.column(1), strict=True):
                if not key.is_valid or not parts.is_valid:
                    continue
                shard = shard or ShardWriter(folder, index)
                for part, data in parts.as_py():
                    shard.add(f"{key.as_py()}.{part}", data or b"")
                n += 1
                if shard.size >= shard_bytes:
                    end()
        end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file_name", "samples", "bytes"])

    return samples.select("key", "parts").mapInArrow(write, "file_name string, samples long, bytes long")


#: Bytes that a compressed file may have within, and archives within each other.
MOST_BYTES, MOST_NESTED = 1 << 28, 4


def nested(name: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, bytes | None]]:
    """(name, content) of the files in compressed files and archives, however these are nested; content is null where one is damaged, too large or too deep."""
    if depth > MOST_NESTED:
        yield name, None
    elif data[:2] == b"\x1f\x8b":
        try:
            with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
                inner = f.read(MOST_BYTES + 1)
        except (OSError, EOFError, zlib.error):
            inner = None
        if inner is None or len(inner) > MOST_BYTES:
            yield name, None
        else:
            yield from nested(name.removesuffix(".gz"), inner, depth + 1)
    elif data[257:262] == b"ustar":
        try:
            for tar, member in headers(io.BytesIO(data), 0):
                content = tar.extractfile(member).read()
                if len(content) != member.size:
                    raise tarfile.ReadError("unexpected end of data")
                yield from nested(f"{name}/{member.name}", content, depth + 1)
        except tarfile.TarError:
            yield name, None
    else:
        yield name, data


def text_part(parts: Column, name: str) -> Column:
    """A part as text; null if the sample hasn't it."""
    return F.decode(F.try_element_at(parts, F.lit(name)), "UTF-8")


def caption(json: Column, text: Column) -> Column:
    """A sample's caption: the first of the list that its record has, or the record's string; without either, its text."""
    listed = F.from_json(json, "caption array<string>")["caption"]
    return F.coalesce(F.when(listed.isNotNull(), F.try_element_at(listed, F.lit(1))).otherwise(F.get_json_object(json, "$.caption")), text)


def expand(samples: DataFrame, columns: list[str], unpack: Callable[[str, bytes], Iterator[tuple[str, bytes | None]]] = nested) -> DataFrame:
    """``columns`` of ``samples``, and member, content of each file within their parts, as ``unpack`` (name, bytes) yields them."""
    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, members, contents, size = [], [], [], 0
            for i, parts in enumerate(batch.column(len(columns))):
                for part, data in parts.as_py() or ():
                    for member, content in unpack(part, data):
                        at.append(i)
                        members.append(member)
                        contents.append(content)
                        size += len(content or b"")
                        if size >= BATCH_BYTES:
                            yield made(batch, at, members, contents)
                            at, members, contents, size = [], [], [], 0
            yield made(batch, at, members, contents)

    def made(batch: pa.RecordBatch, at: list, members: list, contents: list) -> pa.RecordBatch:
        own = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*[batch.column(i).take(own) for i in range(len(columns))], pa.array(members, pa.string()), pa.array(contents, pa.binary())], names=[*columns, "member", "content"])

    return samples.select(*columns, "parts").mapInArrow(run, f"{kinds}, member string, content binary")


def latex_texts(files: DataFrame, columns: list[str], most_chars: int = 16 << 20) -> DataFrame:
    """``columns`` of ``files`` (member, content), member, text (Markdown) and fault of each LaTeX source.

    A source that isn't UTF-8 is read as Latin-1. A malformed one has the text before its fault, a damaged file or
    one over ``most_chars`` characters no text; none of them stops a task.
    """
    from siftwell.functions.latex import to_markdown

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in columns)

    def read(content: bytes | None) -> tuple[str | None, str | None]:
        if content is None:
            return None, "the archive is damaged"
        try:
            source = content.decode()
        except UnicodeDecodeError:
            source = content.decode("latin-1")
        return to_markdown(source) if len(source) <= most_chars else (None, "the source is too long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x.as_py()) for x in batch.column(len(columns) + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns) + 1], pa.array([t for t, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())], names=[*columns, "member", "text", "fault"])

    return files.select(*columns, "member", "content").mapInArrow(run, f"{kinds}, member string, text string, fault string")


def latex_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """file, key, member, text, fault of all LaTeX sources (.tex, or files without a suffix) in the archives of ``folder``."""
    files = expand(read_samples(spark, folder), ["file", "key"])
    return latex_texts(files.filter(F.col("member").rlike(r"(\.tex|^[^.]*|/[^./]*)$") | F.col("content").isNull()), ["file", "key"])

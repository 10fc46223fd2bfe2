"""Logs of saved arrays, a file for each step, as a Spark data source."""

from __future__ import annotations

import io
import os.path
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.functions.ranking import global_rank
from siftwell.sources.storage import shared_folder

#: Bytes that one task reads, of one file or of several, and what opening one counts; names of files and the number in them.
RANGE_BYTES, OPEN_BYTES, PATTERN = 64 << 20, 1 << 20, r"iter_(\d+)\.npy"
SCHEMA = "step long, file string, row long, values array<double>, fault string"
ARROW = pa.schema([("step", pa.int64()), ("file", pa.string()), ("row", pa.int64()), ("values", pa.list_(pa.float64())), ("fault", pa.string())])


@dataclass
class ArrayRange:
    file: str
    step: int
    part: int
    parts: int


@dataclass
class ArrayRanges(InputPartition):
    ranges: list[ArrayRange]


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.range_bytes = options["path"], re.compile(options.get("pattern", PATTERN)), int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ArrayRanges]:
        """Files are listed by name and size; their headers are read by tasks. Small files are dealt to a task together."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = []
        for x in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = self.pattern.fullmatch(x.base_name)
            if x.type == fs.FileType.File and name:
                found.append((int(name.group(1)), x.path, x.size))
        dealt, room = [], 0
        for step, path, size in sorted(found):
            parts = max(1, -(-size // self.range_bytes))
            for k in range(parts):
                cost = size // parts + OPEN_BYTES
                if cost > room:
                    dealt.append(ArrayRanges([]))
                    room = self.range_bytes
                dealt[-1].ranges.append(ArrayRange(path, step, k, parts))
                room -= cost
        return dealt or [ArrayRanges([])]

    def read(self, partition: ArrayRanges) -> Iterator[pa.RecordBatch]:
        for own in partition.ranges:
            yield from self.read_range(own)

    def read_range(self, partition: ArrayRange) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.path)
        name = os.path.relpath(partition.file, root)
        with store.open_input_file(partition.file) as stream:
            try:
                version = np.lib.format.read_magic(stream)
                shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
                if by_column and len(shape) > 1 or kind.hasobject or kind.kind not in "fiub":
                    raise ValueError("not an array of numbers by rows")
                n, width, begin = (shape[0] if shape else 1), int(np.prod(shape[1:])) if shape else 1, stream.tell()
                if stream.size() < begin + n * width * kind.itemsize:
                    raise ValueError("the file is cut")
            except ValueError as e:
                if partition.part == 0:
                    yield pa.RecordBatch.from_pylist([{"step": partition.step, "file": name, "row": None, "values": None, "fault": str(e)}], schema=ARROW)
                return
            row, last = partition.part * n // partition.parts, (partition.part + 1) * n // partition.parts
            some = max(1, (1 << 20) // max(width, 1))
            while row < last:
                k = min(some, last - row)
                stream.seek(begin + row * width * kind.itemsize)
                data = np.frombuffer(stream.read(k * width * kind.itemsize), kind).astype(float)
                values = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * width, pa.int32()), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array([partition.step] * k, pa.int64()), pa.array([name] * k), pa.array(range(row, row + k), pa.int64()), values, pa.nulls(k, pa.string())], schema=ARROW)
                row += k


class ArrayLog(DataSource):
    """Rows of the ``.npy`` files under a folder whose names match: step, file, row, values, fault.

    Options: path, pattern (of the whole file name; its first group is the step), rangeBytes. Steps are numbers, so
    9 is before 10. Other files are left out. A file that is cut or holds no rows of numbers gives one row with its fault;
    an array of one dimension has a value a row.
    """

    @classmethod
    def name(cls) -> str:
        return "array_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))


def read_log(spark: SparkSession, folder: str, pattern: str = PATTERN, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArrayLog)
    return spark.read.format("array_log").option("pattern", pattern).option("rangeBytes", range_bytes).load(folder)


def step_places(log: DataFrame) -> DataFrame:
    """step, place (from 1, in the order of numbers) and gap (steps that are missing before it; 0 at the first)."""
    # the log is read once for its steps, which are ranked in several passes
    path = shared_folder(log.sparkSession, "steps")
    log.select("step").distinct().write.parquet(path)
    steps = global_rank(log.sparkSession.read.schema("step long").parquet(path), "step", ["step"], "place")
    before = steps.select((F.col("place") + 1).alias("place"), F.col("step").alias("before"))
    return steps.join(before, "place", "left").select("step", "place", F.coalesce(F.col("step") - F.col("before") - 1, F.lit(0).cast("long")).alias("gap"))


def write_log(rows: DataFrame, folder: str, dtype: str = "<f4") -> DataFrame:
    """Write ``rows`` (step, row, values) to a file for each step; returns (step, rows). The result is lazy: who reads it writes.

    A file is written under another name and then moved, so none is ever half there; a task that runs twice writes the
    same again. A step's rows are in the order of ``row``; one task writes a step.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        at, held, done = None, [], []

        def end() -> None:
            buffer = io.BytesIO()
            np.save(buffer, np.array(held, dtype))
            part = f"{root}/.{at}-{os.urandom(8).hex()}"
            with store.open_output_stream(part, compression=None) as out:
                out.write(buffer.getvalue())
            store.move(part, f"{root}/iter_{at}.npy")
            done.append((at, len(held)))

        for batch in batches:
            for step, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and step != at:
                    end()
                    held = []
                at = step
                held.append(values.values.to_numpy(zero_copy_only=False))
        if held:
            end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=["step", "rows"])

    return rows.repartition("step").sortWithinPartitions("step", "row").select("step", "values").mapInArrow(write, "step long, rows long")

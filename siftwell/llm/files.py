"""Binary files that executors write to shared storage and Spark reads back."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RolledFile:
    """A file that a task writes under a name of its own attempt, so that a task that runs twice harms nothing.

    Readers take only the files that a manifest names, and Spark commits the manifest.
    """

    def __init__(self, folder: str, suffix: str):
        context = TaskContext.get()
        self.partition = context.partitionId() if context else 0
        self.name = f"part-{self.partition:06d}-{uuid.uuid4().hex}{suffix}"
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.stream = self.store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def read_named(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The files of ``folder`` that ``manifest`` (column file_name) has: its columns and content.

    Spark reads them, so any store will do. A file is one row; writers roll files to bound that.
    """
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    # one row a file: small beside the content, but not bounded, so Spark chooses the join by its size
    return found.join(manifest, "file_name")

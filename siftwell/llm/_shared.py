"""Helpers that the text operators share: shared storage, batching, column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker; texts may be long, so both stay small.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: Rows of one key that one task joins, and keys of more rows at most.
HOT_ROWS, HOT_KEYS = 100_000, 10_000


def small_batches(spark: SparkSession) -> None:
    """Keep what one Arrow batch brings into a Python worker small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def workspace(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the cluster names none (local tests), a temporary folder is made and
    recorded in that setting of the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the workspace, removed when the JVM closes its file systems."""
    path = f"{workspace(spark)}/siftwell/{tag}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the workspace and read it again.

    Survives lost executors, since the files are in shared storage.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def join_to_one(rows: DataFrame, one: DataFrame, key: str, count: str, salt_by: list[str], most: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """``rows`` joined by ``key`` to ``one``, which has one row for each key, with ``count``: how many of ``rows`` have it.

    A key of more than ``most`` rows is dealt to several tasks by a hash of ``salt_by``, and its row
    of ``one`` goes to each of these. There are at most ``HOT_KEYS`` such keys, so all tasks get their table.
    ``total``: how many rows there are, if that is known; no key has more.
    """
    if total is None:
        total = one.agg(F.sum(count)).first()[0] or 0
    if total <= most:
        return rows.join(one.drop(count), key)
    most = max(most, total // HOT_KEYS)
    hot = one.filter(F.col(count) > most).select(F.col(key).alias("_hot"), F.ceil(F.col(count) / most).cast("int").alias("_parts"))
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*salt_by), F.col("_parts").cast("long")).cast("int"), F.lit(0))).drop("_hot", "_parts")
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(count) / most).cast("int"), F.lit(1)) - 1))).drop(count)
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def unused_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the columns ``doc_id`` and ``text`` (null: empty), whatever else ``df`` has."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()

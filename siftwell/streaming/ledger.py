"""A sink that takes each micro-batch of a stream once, however often it is sent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def append_once(rows: DataFrame, batch: int, folder: str) -> bool:
    """Write a micro-batch to ``folder`` unless the ledger has its number; whether it was written.

    Rows go to a place of the batch's own, which a batch that broke off before is taken from first; the ledger's
    mark is made last, by a move. So a batch is there whole, or not at all, and never twice.
    """
    spark = rows.sparkSession
    mark, store = hadoop_path(spark, f"{folder}/_ledger/{batch}")
    if store.exists(mark):
        return False
    rows.write.mode("overwrite").parquet(f"{folder}/batches/batch={batch}")
    part, _ = hadoop_path(spark, f"{folder}/_ledger/.{batch}")
    store.create(part, True).close()
    if not store.rename(part, mark):
        raise OSError(f"the ledger of {folder} can't be written")
    return True


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all batches that the ledger has, with batch; those of a batch that broke off aren't there."""
    place, store = hadoop_path(spark, f"{folder}/_ledger")
    marks = [x.getPath().getName() for x in store.listStatus(place)] if store.exists(place) else []
    # a number a batch: a stream's checkpoint lists them too
    done = sorted(int(m) for m in marks if m.isdigit())
    if not done:
        return spark.createDataFrame([], f"{schema}, batch long")
    found = spark.read.schema(f"{schema}, batch long").option("basePath", f"{folder}/batches").parquet(*[f"{folder}/batches/batch={k}" for k in done])
    return found


def run_once(stream: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Send all that ``stream`` has through ``make`` to the sink in ``folder``, each micro-batch once."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: append_once(make(rows), batch, folder) and None)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

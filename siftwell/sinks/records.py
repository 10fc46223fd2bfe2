"""Logs, projections and summaries that runs append to, as files that Spark reads back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def saved_at(step: Column, last: Column | int, every: int) -> Column:
    """The step at which a buffered row is written: the next multiple of ``every``, -1 if the run ends before."""
    at = (F.ceil(step / every) * every).cast("bigint")
    return F.when(at <= last, at).otherwise(F.lit(-1).cast("bigint"))


def append_dot_log(rows: DataFrame, path: str, every: int, step: str = "step") -> None:
    """Append rows to the dot-product log, in a folder for each save; what a run has left at its end is under iter_num=-1."""
    last = F.broadcast(rows.agg(F.max(step).alias("_last")))  # one row
    rows.join(last).withColumn("iter_num", saved_at(F.col(step), F.col("_last"), every)).drop("_last").write.mode("append").partitionBy("iter_num").parquet(path)


def read_dot_log(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """The log's rows; with ``first`` those of the first saves only (folders of others aren't read)."""
    log = spark.read.parquet(path)
    return log if first is None else log.filter((F.col("iter_num") >= 0) & (F.col("iter_num") <= first))


def validation_batch(log: DataFrame, size: int, id_col: str = "sample_id") -> DataFrame:
    """The saved validation batch; raises unless it has ``size`` rows."""
    n = F.broadcast(log.agg(F.assert_true(F.count(F.lit(1)) == size, F.lit(f"the validation batch doesn't have {size} rows")).alias("_checked")))
    return log.join(n, F.col("_checked").isNull()).drop("_checked").orderBy(id_col)


def save_projections(vectors: DataFrame, path: str, layers: list[dict], every: int = 1, step: str = "step") -> None:
    """Append projected gradients of every ``every``-th step; the layers' places are written once, beside them."""
    spark = vectors.sparkSession
    vectors.filter(F.col(step) % every == 0).write.mode("append").parquet(f"{path}/projections")
    meta = f"{path}/metadata"
    if not spark._jvm.org.apache.hadoop.fs.Path(meta).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(meta)):
        spark.createDataFrame([(json.dumps(x, sort_keys=True),) for x in layers], "value string").coalesce(1).write.text(meta)


def load_projections(spark: SparkSession, path: str, most_steps: int | None = None, step: str = "step") -> tuple[DataFrame, list[dict]]:
    """(vectors of the first ``most_steps`` steps saved, the layers' places)."""
    vectors = spark.read.parquet(f"{path}/projections")
    if most_steps is not None:
        # as many rows as steps are asked for
        vectors = vectors.join(F.broadcast(vectors.select(step).distinct().orderBy(step).limit(most_steps)), step)
    return vectors, sorted((json.loads(r.value) for r in spark.read.text(f"{path}/metadata").collect()), key=lambda x: x["slice_start"])


def append_json(rows: DataFrame, path: str) -> None:
    """Append run records as JSON lines."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append dynamics, data values or tokenized sets as Parquet; nothing is dropped, however fast rows come."""
    rows.write.mode("append").parquet(path)


def fragments(spark: SparkSession, path: str, order: str) -> DataFrame:
    """Statistics that were appended in parts, in order of ``order``; of one that was written twice one stays."""
    return spark.read.parquet(path).distinct().orderBy(order)


def table_row(cells: list[Column], style: str) -> Column:
    """A line of a LaTeX or plain table; nulls are dashes."""
    if style not in ("latex", "plain"):
        raise ValueError(f"no table style is named {style!r}; there are latex, plain")
    shown = [F.coalesce(c.cast("string"), F.lit("--")) for c in cells]
    return F.concat(F.concat_ws(" & ", *shown), F.lit(r" \\")) if style == "latex" else F.concat_ws(" | ", *[F.rpad(c, 12, " ") for c in shown])


def conversation_files(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, turn, role, text of files that hold lists of conversations; missing and broken files are skipped."""
    schema = "conv_id long, turns array<struct<role: string, text: string>>, _broken string"
    found = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("ignoreMissingFiles", "true").json(path)
    return found.filter("conv_id is not null").select("conv_id", F.posexplode("turns").alias("turn", "x")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "x.role", "x.text")

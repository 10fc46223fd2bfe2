"""Streams that keep their place: packing documents into windows, and filtered samples into batches.

Rows of a shard are numbered (``place``, from 0). The state takes them in that order however they come: a row
that comes early waits, and what doesn't fill a window or batch is kept. So the output is the same however the
input is cut into triggers, and wherever a stream is stopped and started again from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftwell.functions.ranking import running_sum
from siftwell.functions.tokens import checksum
from siftwell.operators.corpus import tokenized
from siftwell.plans.corpus_queries import table
from siftwell.plans.registry import query
from siftwell.sources.storage import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one Arrow batch that the state sees at once, and numbers of a shard's early rows that memory holds before the state does.
ROWS, HELD = 512, 4 << 20


def plain(values: pd.Series, kind: str) -> list:
    """A column's values: pandas makes floats of whole numbers with nulls, and NaN of nulls. Arrays are NumPy's."""
    if kind.startswith("array"):
        return [None if v is None else np.asarray(v, np.int32) for v in values]
    made = {"long": int, "double": float, "boolean": bool}[kind]
    return [None if v is None or v != v else made(v) for v in values.tolist()]


def to_state(value):
    """A value as the state takes it: lists for arrays, tuples for the rows that it gave (it can't pickle a Row within a list)."""
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, list):
        return [tuple(v) if isinstance(v, tuple) else v for v in value]
    return value


def weight(row: tuple) -> int:
    """How many numbers a row has, about."""
    return sum(len(v) if isinstance(v, np.ndarray) else 1 for v in row)


class InOrder(StatefulProcessor):
    """Takes a shard's rows by ``place``; those that come early wait, and a place that comes again is left out.

    Rows that are early among those of one trigger wait in memory, up to ``HELD`` numbers; the rest, and what is early at the trigger's end, in the state.
    """

    #: Columns that a row waits with, and those of the output.
    WAITING, OUT, REST = "", "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", f"next long, made long, early long, {self.REST}")
        self.early = handle.getMapState("early", "place long", self.WAITING)

    def take(self, made: int, rest, row: tuple) -> tuple[int, object, list[tuple]]:
        """(number made, what is kept, output rows) after one more row."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, made, waiting, rest = self.at.get() if self.at.exists() else (0, 0, 0, None)
        names, kinds = zip(*[c.split(" ") for c in self.WAITING.split(", ")], strict=True)
        held: dict[int, tuple] = {}
        size = 0

        def put_off() -> None:
            nonlocal waiting, size
            for place, row in held.items():
                self.early.updateValue((place,), tuple(map(to_state, row)))
            waiting, size = waiting + len(held), 0
            held.clear()

        for pdf in rows:
            out: list[tuple] = []
            pdf = pdf.sort_values("place", kind="stable")
            for place, *row in zip(pdf.place.tolist(), *[plain(pdf[c], k) for c, k in zip(names, kinds, strict=True)], strict=True):
                if place > following:
                    if place not in held and not (waiting and self.early.containsKey((place,))):
                        held[place] = tuple(row)
                        size += weight(held[place])
                        if size > HELD:
                            put_off()
                    continue
                if place < following:
                    continue
                made, rest, found = self.take(made, rest, tuple(row))
                out += found
                following += 1
                while following in held or waiting and self.early.containsKey((following,)):
                    if following in held:
                        early = held.pop(following)
                        size -= weight(early)
                    else:
                        early = tuple(self.early.getValue((following,)))
                        self.early.removeKey((following,))
                        waiting -= 1
                    made, rest, found = self.take(made, rest, early)
                    out += found
                    following += 1
            if out:
                yield pd.DataFrame([(*key, *r) for r in out], columns=[c.strip().split(" ")[0] for c in self.OUT.split(",")])
        put_off()
        self.at.update((following, made, waiting, to_state(rest)))

    def close(self) -> None:
        pass


class PackWindows(InOrder):
    """shard, n, ids: windows of ``size`` ids, numbered; the rest of a shard's ids is kept."""

    WAITING, OUT, REST = "ids array<int>", "shard bigint, n bigint, ids array<int>", "rest array<int>"

    def __init__(self, size: int):
        self.size = size

    def take(self, made: int, rest, row: tuple) -> tuple[int, object, list[tuple]]:
        flat = np.concatenate([np.asarray([] if rest is None else rest, np.int32), np.asarray([] if row[0] is None else row[0], np.int32)])
        full = len(flat) // self.size
        windows = [(made + k, w) for k, w in enumerate(flat[: full * self.size].reshape(full, self.size))]
        return made + full, flat[full * self.size :], windows


class Rebatch(InOrder):
    """shard, batch, slot, idx, metric: the samples whose metric reaches a threshold, in batches of ``size``.

    Samples that don't fill a batch are kept. A row with ``last`` ends the shard: what is left is a smaller batch,
    or nothing with ``drop_last``; what comes after it is left out. A sample without an index has -1. A metric that
    is null or no number doesn't reach the threshold.
    """

    WAITING, OUT, REST = "idx long, metric double, last boolean", "shard bigint, batch bigint, slot bigint, idx bigint, metric double", "rest array<struct<idx: long, metric: double>>"

    def __init__(self, size: int, threshold: float, drop_last: bool):
        self.size, self.threshold, self.drop_last = size, threshold, drop_last

    def take(self, made: int, rest, row: tuple) -> tuple[int, object, list[tuple]]:
        held, (idx, metric, last) = [] if rest is None else [tuple(r) for r in rest], row
        if made < 0:  # exhausted
            return made, [], []
        if last:
            return -1, [], [] if self.drop_last else self.batch(made, held)
        if metric is not None and metric >= self.threshold:
            held.append((-1 if idx is None or idx != idx else int(idx), float(metric)))
        return (made + 1, [], self.batch(made, held)) if len(held) >= self.size else (made, held, [])

    @staticmethod
    def batch(number: int, held: list[tuple]) -> list[tuple]:
        return [(number, slot, *s) for slot, s in enumerate(held)]


def in_order(rows: DataFrame, processor: InOrder) -> DataFrame:
    """The output of ``processor`` over a stream of ``rows`` (shard, place and what it takes)."""
    names = [c.split(" ")[0] for c in processor.WAITING.split(", ")]
    return rows.select("shard", "place", *names).groupBy("shard").transformWithStateInPandas(processor, processor.OUT, "append", "None")


def started(writer: DataStreamWriter, spark: SparkSession, checkpoint: str, layout: dict):
    """Start a stream whose state belongs to a layout (shards, sizes); one that was begun with another is refused.

    The state is kept by RocksDB, so it may be larger than memory; its settings are the stream's own.
    """
    place = f"{checkpoint}/layout.json"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path):
        had = json.loads("".join(r.value for r in spark.read.text(place).collect()))
        if had != layout:
            raise ValueError(f"the stream was begun as {had}, it can't go on as {layout}")
    else:
        out = store.create(path)
        out.write(bytearray(json.dumps(layout, sort_keys=True).encode()))
        out.close()
    parts = "spark.sql.shuffle.partitions"
    # every partition's state is committed in each trigger, by a worker of its own; the checkpoint keeps their number
    fewer = min(int(spark.conf.get(parts)), 2 * spark.sparkContext.defaultParallelism)
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS), parts: str(fewer)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        return writer.option("checkpointLocation", f"{checkpoint}/state").start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: What the streams read.
DOCUMENTS, SAMPLES = "shard bigint, place bigint, ids array<int>", "shard bigint, place bigint, idx bigint, metric double, last boolean"


def pack_stream(spark: SparkSession, source: str, folder: str, size: int, shard_rows: int, files: int = 8, triggers: int | None = None) -> DataFrame:
    """Windows of the documents in the Parquet files of ``source`` (shard, place, ids), packed by a stream; returns all that ``folder`` has.

    A trigger takes ``files`` files at most. With ``triggers`` the stream is stopped after so many; called again, it goes on.
    """
    docs = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files).parquet(source)
    writer = in_order(docs, PackWindows(size)).writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
    run_stream(started(writer if triggers else writer.trigger(availableNow=True), spark, folder, {"size": size, "shard_rows": shard_rows}), triggers)
    return spark.read.schema(PackWindows.OUT).parquet(f"{folder}/out")


def run_stream(stream, triggers: int | None = None) -> None:
    """Wait for the end of a stream, or stop it after some triggers."""
    if triggers is None:
        stream.awaitTermination()
        return
    while stream.isActive and sum(p["numInputRows"] > 0 for p in stream.recentProgress) < triggers:
        stream.awaitTermination(1)
    stream.stop()


def numbered(rows: DataFrame, id_col: str, shard_rows: int) -> DataFrame:
    """``rows`` with shard (a range of ``shard_rows`` ids) and place in it, in id order. Ids are whole numbers."""
    sharded = rows.withColumn("shard", F.floor(F.col(id_col) / shard_rows).cast("bigint"))
    return running_sum(sharded, F.col(id_col), [id_col], F.lit(1), "place", ["shard"])


#: Triggers that a query's stream takes at most, whatever its input: each costs a commit of every partition's state. Files of one at least.
TRIGGERS, FILES = 8, 8


def trigger_files(spark: SparkSession, source: str, schema: str) -> int:
    """How many files of ``source`` a trigger takes, so that there are ``TRIGGERS`` at most."""
    return max(FILES, -(-len(spark.read.schema(schema).parquet(source).inputFiles()) // TRIGGERS))


SHARD_ROWS = 2048
SHARDED = f"SELECT doc_id // {SHARD_ROWS} AS shard, id, row_number() OVER (PARTITION BY doc_id // {SHARD_ROWS} ORDER BY doc_id, k) - 1 AS pos FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS k FROM tok)"


def sharded_documents(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The documents' ids by shard, in files of some hundred documents: what a stream takes in triggers.

    A task writes its shards one after another, so files come in the order of places and few rows wait in the state.
    """
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", SHARD_ROWS)
    ordered = docs.repartition("shard").sortWithinPartitions("shard", "place")
    ids = tokenized(ordered.select(F.struct("shard", "place").alias("doc_id"), "text")).select("doc_id.*", "ids")
    ids.write.option("maxRecordsPerFile", 512).parquet(f"{folder}/docs")
    return f"{folder}/docs"


def register() -> None:
    from siftwell.plans.corpus_queries import FLAT

    @query("stream_pack", f"WITH {FLAT}, s AS ({SHARDED}) SELECT shard, pos // 513 AS n, sum(id * (pos % 513 + 1))::BIGINT AS digest FROM s GROUP BY 1, 2 HAVING count(*) = 513")
    def stream_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All documents through the stream, some files a trigger; the windows that its sink has, with a digest of their ids."""
        folder = shared_folder(spark, "stream")
        source = sharded_documents(spark, sf_dir, folder)
        windows = pack_stream(spark, source, folder, 513, SHARD_ROWS, trigger_files(spark, source, DOCUMENTS))
        return windows.select("shard", "n", checksum(F.col("ids")).alias("digest"))

    @query("stream_replay", """WITH e AS (SELECT *, event_id // 4096 AS shard FROM events), k AS (SELECT shard, CASE WHEN event_type = 'error' THEN -1 ELSE event_id END AS idx, value, row_number() OVER (PARTITION BY shard ORDER BY event_id) - 1 AS r FROM e WHERE value >= 20)
SELECT shard, r // 32 AS batch, r % 32 AS slot, idx, round(value, 6) AS metric FROM k""")
    def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Events as logged samples: those of a metric of 20 or more in batches of 32 by a stream, errors without an index, the last batch smaller."""
        folder = shared_folder(spark, "replay")
        events = numbered(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id", 4096)
        samples = events.select("shard", "place", F.when(F.col("event_type") != "error", F.col("event_id")).alias("idx"), F.col("value").alias("metric"), F.lit(False).alias("last"))
        # the end of each shard, after its last row
        ends = events.groupBy("shard").agg((F.max("place") + 1).alias("place")).select("shard", "place", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("double").alias("metric"), F.lit(True).alias("last"))
        # rows are short, so files grow with the log
        most = max(1024, table(spark, sf_dir, "events").count() // (TRIGGERS * FILES))
        samples.unionByName(ends).repartition("shard").sortWithinPartitions("shard", "place").write.option("maxRecordsPerFile", most).parquet(f"{folder}/log")
        found = replay_stream(spark, f"{folder}/log", folder, 32, 20.0, False, trigger_files(spark, f"{folder}/log", SAMPLES))
        return found.withColumn("metric", F.round("metric", 6))


def replay_stream(spark: SparkSession, source: str, folder: str, size: int, threshold: float, drop_last: bool, files: int = 8, triggers: int | None = None) -> DataFrame:
    """Batches of the logged samples in the Parquet files of ``source`` (shard, place, idx, metric, last), by a stream; as ``pack_stream``."""
    log = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", files).parquet(source)
    writer = in_order(log, Rebatch(size, threshold, drop_last)).writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
    layout = {"size": size, "threshold": threshold, "drop_last": drop_last}
    run_stream(started(writer if triggers else writer.trigger(availableNow=True), spark, folder, layout), triggers)
    return spark.read.schema(Rebatch.OUT).parquet(f"{folder}/out")


register()

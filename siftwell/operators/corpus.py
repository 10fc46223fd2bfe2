"""Splits, offsets, packing and windows over token corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.hashing import hash_mod, hex_key
from siftwell.functions.ranking import global_rank, hash_bucket, running_sum
from siftwell.functions.tokens import END, checksum, n_char_ids


def random_split(df: DataFrame, share: float, seed: int = 2357, id_col: str = "doc_id") -> DataFrame:
    """``df`` and split: the first ceil(n * share) rows in hash order are "val", the rest "train"."""
    n = df.count()
    ranked = global_rank(df.withColumn("_key", hex_key(seed, id_col)), hash_bucket("_key"), ["_key", id_col], "_rn").drop("_key")
    most = -int(-n * share // 1)
    return ranked.withColumn("split", F.when(F.col("_rn") <= most, "val").otherwise("train")).drop("_rn")


def modulo_split(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df`` and split by place in id order modulo ten: 0-6 train, 7-8 val, 9 test."""
    ranked = global_rank(df, id_col, [id_col], "_rn")
    k = (F.col("_rn") - 1) % 10
    return ranked.withColumn("split", F.when(k <= 6, "train").when(k <= 8, "val").otherwise("test")).drop("_rn")


def positional_split(text: Column, share: float = 0.8) -> tuple[Column, Column]:
    """The text before and from the character at int(share * length)."""
    cut = F.floor(F.length(text) * share).cast("int")
    return F.substring(text, F.lit(1), cut), F.substring(text, cut + 1, F.length(text))


def char_lists(texts: pa.Array, end: int | None) -> pa.ListArray:
    """The character ids of all texts of a batch, each followed by ``end``: from the bytes, as all characters that have an id are ASCII."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    kept = (data == 10) | ((data >= 32) & (data <= 126))
    before = np.concatenate([[0], np.cumsum(kept)])
    counts = np.diff(before[offsets - offsets[0]])
    sizes = counts + (end is not None)
    out = np.full(sizes.sum(), -1 if end is None else end, np.int32)
    found = data[kept]
    out[np.arange(len(found)) + (np.repeat(np.arange(n), counts) if end is not None else 0)] = np.where(found == 10, 0, found.astype(np.int32) - 31)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), pa.array(out))


#: Bytes of text that are made into ids at a time, which takes some twenty times as many; one longer text is taken alone.
TEXT_BYTES = 1 << 19
#: Bytes of rows that Spark sends to a Python worker at a time; the worker holds some such batches at once, whatever its partition's size.
BATCH_BYTES = 4 << 20


def text_slices(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch's rows in slices of at most so many bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (most or TEXT_BYTES), "right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def tokenized(docs: DataFrame, end: int = END, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (characters and the end id), len and the columns ``keep``. A null text is empty."""
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, len(kept)):
                ids = char_lists(part.column(len(kept)), end)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], ids, ids.value_lengths().cast(pa.int64())], names=[*kept, "ids", "len"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(*kept, "text").mapInArrow(run, f"{kinds}, ids array<int>, len bigint")


def document_starts(lengths: DataFrame, id_col: str = "doc_id", len_col: str = "len") -> DataFrame:
    """``lengths`` and start: ids of all documents before, in id order."""
    return running_sum(lengths, id_col, [id_col], F.col(len_col), "start")


def pack_windows(docs: DataFrame, size: int, stride: int) -> DataFrame:
    """window, ids: windows of ``size`` ids at each multiple of ``stride`` of the concatenated corpus.

    Documents give whole slices to the windows that they reach into, so rows are slices, not
    tokens. Only full windows are returned. ``size`` - ``stride`` ids overlap (0 or 1 commonly).
    """
    starts = document_starts(tokenized(docs))
    first = F.greatest(F.lit(0), F.floor((F.col("start") - size) / stride) + 1).cast("bigint")
    last = F.floor((F.col("start") + F.col("len") - 1) / stride).cast("bigint")
    places = F.transform(F.sequence(first, last), lambda w: F.struct(w.alias("window"), F.greatest(w * stride, F.col("start")).alias("low"), F.least(w * stride + size, F.col("start") + F.col("len")).alias("high")))
    # slices are cut before rows are made, so no row but the document's has all of its ids
    cut = F.transform(F.filter(places, lambda p: p["high"] > p["low"]), lambda p: F.struct(p["window"].alias("window"), F.slice("ids", (p["low"] - F.col("start") + 1).cast("int"), (p["high"] - p["low"]).cast("int")).alias("piece")))
    pieces = starts.select("start", F.explode(cut).alias("x")).select("x.window", "start", "x.piece")
    whole = pieces.groupBy("window").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda s: s["piece"])).alias("ids"))
    return whole.filter(F.size("ids") == size)


def window_digest(windows: DataFrame) -> DataFrame:
    """window, first, last, digest of each window's ids."""
    return windows.select("window", F.element_at("ids", 1).cast("bigint").alias("first"), F.element_at("ids", -1).cast("bigint").alias("last"), checksum(F.col("ids")).alias("digest"))


def document_chunks(docs: DataFrame, need: int, seed: int) -> DataFrame:
    """doc_id, at: where a chunk of ``need`` ids begins: at the document, or near the corpus's end at a hashed place."""
    starts = document_starts(docs.select("doc_id", (n_char_ids(F.col("text")) + 1).alias("len")))
    total = starts.agg(F.sum("len").alias("total"))
    room = F.col("total") - need
    at = F.when(F.col("start") <= room, F.col("start")).when(room >= 0, hash_mod(seed, F.greatest(room, F.lit(0)) + 1, "doc_id"))
    # one row, so its size is known
    return starts.join(F.broadcast(total)).select("doc_id", at.cast("bigint").alias("at")).filter(F.col("at").isNotNull())


def batches(df: DataFrame, size: int, order: list, bucket: Column, drop_last: bool = False) -> DataFrame:
    """``df`` and batch, slot in the order; the last batch may be short, or is dropped."""
    ranked = global_rank(df, bucket, order, "_rn").withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("bigint")).withColumn("slot", ((F.col("_rn") - 1) % size).cast("bigint"))
    if drop_last:
        full = df.count() // size
        ranked = ranked.filter(F.col("batch") < full)
    return ranked.drop("_rn")


def task_quota(df: DataFrame, n: int, seed: int, task_col: str, id_col: str) -> DataFrame:
    """At most max(1, n // tasks) rows of each task, in hash order, with their rank; no task at all raises."""
    tasks = df.select(task_col).distinct().count()
    if not tasks:
        raise ValueError("no task has any document")
    quota = max(1, n // tasks)
    order = Window.partitionBy(task_col).orderBy("_key", id_col)
    ranked = df.withColumn("_key", hex_key(seed, id_col)).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= quota).drop("_key")


def largest_remainder(counts: DataFrame, budget: int, key: str, size: str) -> DataFrame:
    """key, tokens: the budget shared in proportion to size, capped by it; what flooring leaves goes to the largest remainders.

    There is a row for each domain, so windows without a partition are over few rows.
    """
    every = Window.partitionBy()
    exact = F.col(size) * F.lit(float(budget)) / F.sum(size).over(every)
    floored = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("bigint")).withColumn("_rest", F.round(F.col("_exact") - F.col("_floor"), 9))
    ranked = floored.withColumn("_rank", F.row_number().over(every.orderBy(F.desc("_rest"), key))).withColumn("_left", F.lit(budget) - F.sum("_floor").over(every))
    tokens = F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
    return ranked.select(key, F.least(tokens, F.col(size)).cast("bigint").alias("tokens"))


def budget_cut(df: DataFrame, budget: int, batch: int, id_col: str, len_col: str) -> DataFrame:
    """Rows in id order until the batch that reaches the budget, that batch included."""
    ranked = global_rank(df, id_col, [id_col], "_rn").withColumn("batch", F.floor((F.col("_rn") - 1) / batch).cast("bigint"))
    totals = ranked.groupBy("batch").agg(F.sum(len_col).alias("_len"))
    before = running_sum(totals, F.floor(F.col("batch") / 65536).cast("bigint"), ["batch"], F.col("_len"), "_before").select("batch", "_before")
    return ranked.join(before, "batch").filter(F.col("_before") < budget).drop("_rn", "_before")


#: Where the generators of the splits begin, from a seed.
SPLIT_SEEDS = {"train": 0, "val": 1, "test": 2}


def split_seed(seed: int, split: str) -> int:
    """Each split draws from a generator of its own."""
    if split not in SPLIT_SEEDS:
        raise ValueError(f"no split is named {split!r}; there are {', '.join(SPLIT_SEEDS)}")
    return seed + SPLIT_SEEDS[split]


def sample_documents(df: DataFrame, n: int, seed: int, id_col: str = "doc_id", replace: bool | None = None) -> DataFrame:
    """draw and the columns of ``df``: ``n`` rows, with replacement if asked for or, unless that is given, if there are fewer rows than that; none of no rows."""
    rows = df.count()
    if replace is False and n > rows:
        raise ValueError(f"{n} rows can't be drawn from {rows} without replacement")
    if n <= rows and not replace:
        ranked = global_rank(df.withColumn("_key", hex_key(seed, id_col)), hash_bucket("_key"), ["_key", id_col], "_rn").filter(F.col("_rn") <= n)
        return ranked.withColumn("draw", (F.col("_rn") - 1).cast("bigint")).drop("_key", "_rn")
    if not rows:
        return df.withColumn("draw", F.lit(0).cast("bigint"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_at", hash_mod(seed, rows, "draw") + 1)
    return draws.join(global_rank(df, id_col, [id_col], "_rn"), F.col("_at") == F.col("_rn")).drop("_at", "_rn")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """A corpus's text column; raises if there is none, or it isn't text."""
    if column not in df.columns or df.schema[column].dataType.simpleString() != "string":
        raise ValueError(f"the corpus has no text column {column!r}; its columns are {', '.join(df.columns)}")
    return F.col(column)


def image_crop(width: Column, height: Column, size: int, draw: Column) -> Column:
    """(new_width, new_height, left, top): an image's short side is made ``size``, and a square cut out of the long one.

    ``draw``: a whole random number. Null for images with a side under ``size``.
    """
    longer = lambda long, short: F.ceil(F.lit(float(size)) / short * long)
    side = F.lit(size).cast("bigint")
    new_width, new_height = F.when(width >= height, longer(width, height)).otherwise(side), F.when(width >= height, side).otherwise(longer(height, width))
    place = lambda long: F.pmod(draw, long - size + 1)
    return F.when(F.least(width, height) >= size, F.struct(new_width.alias("new_width"), new_height.alias("new_height"), place(new_width).alias("left"), place(new_height).alias("top")))


def pixel_value(x: Column) -> Column:
    """A byte of a pixel, from -1 to 1."""
    return x / 255.0 * 2 - 1


def common_divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor of two whole numbers above 0, by Euclid's steps."""
    # 48 steps are enough for 32-bit numbers
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("bigint")).otherwise(F.pmod(s["a"], F.greatest(s["b"], F.lit(1).cast("bigint")))).alias("b")))
    return steps["a"]


def chunk_size(batch: Column, asked: Column) -> Column:
    """The largest divisor of a batch that is no larger than asked for; 1 where less than one is asked for."""
    found = F.filter(F.sequence(F.lit(1).cast("bigint"), F.greatest(asked.cast("bigint"), F.lit(1).cast("bigint"))), lambda d: batch % d == 0)
    return F.array_max(found)


def breakdown(rows: DataFrame, kind: Column, name: str) -> DataFrame:
    """``name``, n, place (the most common first, ties by name) and percent of all: a row for each kind."""
    counts = rows.groupBy(kind.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), name)).cast("bigint")  # a row for each kind
    return counts.withColumn("place", place).withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))

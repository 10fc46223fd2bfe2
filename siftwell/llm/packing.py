"""Best-fit packing of documents into sequences by minimum bin slack.

Only the lengths of pieces decide how sequences are filled, and there are at
most ``capacity`` of them, so the plan is made on the counts of lengths: for each
sequence the largest open length is placed and a subset-sum over the remaining
lengths, kept as the bits of one integer per length, finds the fullest feasible
combination. A combination is used as often as the counts allow before the next
one is sought, so the plan has few patterns however many pieces there are.
Pieces then find their sequence from their rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import id_and_text, id_type, materialize, small_batches
from siftwell.llm.bpe import byte_bpe

#: Pieces of one length that are ranked in one task; longer lists are split by a hash.
RANKED_TOGETHER = 50_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths that fills ``room`` best, larger lengths preferred.

    Bit k of ``reach`` is set if some lengths sum to k. Lengths go in from small to
    large, copies by doubling; the way back takes as many of the largest as it can.
    """
    lengths = sorted(n for n in counts if n <= room and counts[n] > 0)
    full, reach, before = (1 << room + 1) - 1, 1, []
    for n in lengths:
        before.append(reach)
        left, step = min(counts[n], room // n), 1
        while left > 0:
            take = min(step, left)
            reach |= reach << n * take & full
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for n, under in zip(reversed(lengths[: len(before)]), reversed(before), strict=True):
        most = min(counts[n], at // n)
        k = next(k for k in range(most, -1, -1) if under >> at - k * n & 1)
        if k:
            found[n], at = k, at - k * n
    return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, copies of each length in one) until no piece is left."""
    open_, out = {n: c for n, c in counts.items() if c > 0}, []
    while open_:
        largest = max(open_)
        rest = dict(open_)
        rest[largest] -= 1
        use = fullest(rest, capacity - largest)
        use[largest] = use.get(largest, 0) + 1
        times = min(open_[n] // k for n, k in use.items())
        out.append((times, use))
        for n, k in use.items():
            open_[n] -= k * times
            if not open_[n]:
                del open_[n]
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple]:
    """For each length: first ranks, first sequences, copies and offsets of the patterns that hold it."""
    found: dict[int, list[list[int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for times, use in patterns:
        offset = 0
        for n in sorted(use, reverse=True):
            rows = found.setdefault(n, [[], [], [], []])
            for row, value in zip(rows, (ranks.get(n, 0), first, use[n], offset), strict=True):
                row.append(value)
            ranks[n] = ranks.get(n, 0) + use[n] * times
            offset += n * use[n]
        first += times
    return {n: tuple(rows) for n, rows in found.items()}


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; only the first piece is shorter than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer).encode
        for batch in batches:
            rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                for piece, end in enumerate(ends):
                    start = max(0, end - capacity) if piece else 0
                    for column, value in zip(rows.values(), (doc_id, piece, start, end - start, zlib.crc32(ids[start:end])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, batch.schema.field(0).type if k == "doc_id" else pa.int32() if k == "piece" else pa.int64()) for k, v in rows.items()], names=list(rows))

    small_batches(docs.sparkSession)
    kind = id_type(docs, id_col)
    return id_and_text(docs, id_col, text_col).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as minimum bin slack needs.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of ``end_id`` alone. Rows that repeat, ids that repeat or
    are null are each packed as a document of its own. No rows: no pieces. Other columns are
    not read, so their names can't clash.

    The plan needs the counts of at most ``capacity`` lengths; nothing else reaches the driver.
    Ranks within a length are made in hashed groups of about ``RANKED_TOGETHER`` pieces, so a
    length that most pieces have (``capacity`` itself) is spread over many tasks.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most capacity rows
    table = places(plan(counts, capacity))
    if not table:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = {n: c // RANKED_TOGETHER + 1 for n, c in counts.items()}
    parts_of = F.element_at(F.create_map(*[F.lit(x) for n, p in parts.items() if p > 1 for x in (n, p)]), F.col("length").cast("int")) if max(parts.values()) > 1 else F.lit(1)
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce(parts_of, F.lit(1)).cast("long")))
    # (length, part) pairs: at most capacity plus one for each RANKED_TOGETHER pieces
    sizes = keyed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("length", "part", F.expr("sum(n) over (partition by length order by part) - n").alias("base"))

    def place(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[int, int], int] = {}
        for batch in groups:
            sequence, offset = [], []
            for n, part, base in zip(*(batch.column(c).to_pylist() for c in ("length", "part", "base")), strict=True):
                k = at.get((n, part), 0)
                at[n, part] = k + 1
                first_rank, first_sequence, copies, first_offset = table[n]
                p = bisect_right(first_rank, base + k) - 1
                row, slot = divmod(base + k - first_rank[p], copies[p])
                sequence.append(first_sequence[p] + row)
                offset.append(first_offset[p] + slot * n)
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept.schema.names, "sequence_id", "offset"])

    ranked = keyed.join(F.broadcast(bases) if sum(parts.values()) < 100_000 else bases, ["length", "part"])
    # a hashed group meets in one task; sorted, so that a task that runs again ranks alike
    ranked = ranked.repartition("length", "part").sortWithinPartitions("length", "part", "doc_id", "piece", "ids_crc32")
    kind = id_type(pieces, "doc_id")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "part", "base").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

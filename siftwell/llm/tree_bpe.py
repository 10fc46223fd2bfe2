"""BPE encoding and decoding of whole texts by tree concatenation.

Short texts are encoded where they are. A longer text is cut into halves, and halves of
these, wherever that may be, and many tasks encode the leaves. Neighbours are then
joined pair by pair: the text around the join is encoded anew, in a window that grows
until its first word is the one that the left side has there and its last the one that
the right side has. Long words are encoded in the same way, by windows of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import id_and_text, id_type, small_batches
from siftwell.llm.bpe import WordBpe, split_specials, word_bpe

#: Texts of more characters are encoded by more than one task, in leaves of a quarter of that at most.
PART_CHARS = 32_768
PARTS = "digest binary, part int, stretch int, kind string, shown string"


def halves(text: str, most: int) -> list[str]:
    """The leaves, left to right, of cutting in halves until none has more than ``most`` characters."""
    if len(text) <= most:
        return [text]
    half = len(text) // 2
    return halves(text[:half], most) + halves(text[half:], most)


def parts_of(bpe: WordBpe, text: str, most: int) -> list[tuple[int, str, str]]:
    """(stretch, kind, shown) in order: leaves of each stretch of text, and the special strings between stretches."""
    out = []
    for k, part in enumerate(split_specials(text, bpe.finder)):
        if k % 2:
            out.append((k, "special", part))
        elif part:
            out += [(k, "leaf", x) for x in halves(bpe.normalised(part), max(most // 4, 1))]
    return out


def encode_part(bpe: WordBpe, kind: str, shown: str) -> bytes:
    if kind == "special":
        return bpe.packed([bpe.added[shown]])[0]
    return b"".join([bpe.encode_word(shown[a:b])[0] for a, b in bpe.spans(shown)])


@dataclass
class Piece:
    """A normalised text with its words and their ids; ``cuts`` are the places between the ids of words."""

    text: str
    words: list[tuple[int, int]]
    ids: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, bpe: WordBpe, text: str, ids: bytes) -> Piece:
        own = np.frombuffer(ids, "<u4")
        return cls(text, bpe.spans(text), own, np.append(0, np.flatnonzero(bpe.ends[own]) + 1))


def join_pieces(bpe: WordBpe, left: Piece, right: Piece) -> Piece:
    """The piece of both texts together, exact if both are exact.

    The words of a text are found one from the end of the other. So the left side's words are right
    but for the last ones, and once a word is found where the right side has one, all after it are
    the right side's: a window that agrees with both sides in its outer words is all that changes.
    """
    width = 4
    while True:
        n_left, n_right = max(len(left.words) - width, 0), min(width, len(right.words))
        a = left.words[n_left][0] if len(left.words) >= width else 0
        b = right.words[n_right - 1][1] if len(right.words) >= width else len(right.text)
        window, shift = left.text[a:] + right.text[:b], len(left.text) - a
        words = bpe.spans(window)
        agree_left = not a or bool(words) and words[0] == (0, left.words[n_left][1] - a)
        agree_right = b == len(right.text) or bool(words) and words[-1] == (right.words[n_right - 1][0] + shift, b + shift)
        if agree_left and agree_right:
            break
        width *= 2
    middle = [np.frombuffer(bpe.encode_word(window[x:y])[0], "<u4") for x, y in words]
    before, after, cut = left.ids[: left.cuts[n_left]], right.ids[right.cuts[n_right] :], len(left.text)
    ids = np.concatenate([before, *middle, after])
    cuts = np.concatenate([left.cuts[: n_left + 1], left.cuts[n_left] + np.cumsum([len(x) for x in middle], dtype=np.int64), right.cuts[n_right + 1 :] - right.cuts[n_right] + len(ids) - len(after)])
    return Piece(left.text + right.text, left.words[:n_left] + [(x + a, y + a) for x, y in words] + [(x + cut, y + cut) for x, y in right.words[n_right:]], ids, cuts)


def joined(bpe: WordBpe, pieces: list[Piece]) -> Piece:
    """Join leaves as the tree that ``halves`` made: neighbours first, then their joins."""
    while len(pieces) > 1:
        pieces = [join_pieces(bpe, pieces[k], pieces[k + 1]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


def merge_parts(bpe: WordBpe, rows: list[tuple[int, str, str, bytes]]) -> bytes:
    """All ids of a text from (stretch, kind, shown, ids) of its parts in order."""
    out: list[bytes] = []
    for _, group in groupby(rows, key=lambda r: r[0]):
        own = list(group)
        out.append(own[0][3] if own[0][1] == "special" else joined(bpe, [Piece.of(bpe, shown, ids) for _, _, shown, ids in own]).ids.tobytes())
    return b"".join(out)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_and_decode(docs: DataFrame, tokenizer: str, part_chars: int = PART_CHARS, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` ids and decoded.

    A null or empty text has no ids and decodes to the empty text. Rows that repeat, and ids that
    repeat or are null, are each returned; equal long texts are encoded once. No rows: no rows.
    Other columns are not read, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    texts, kind = id_and_text(docs, id_col, text_col), id_type(docs, id_col)
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids

    def results(found: list[tuple[bytes, str]]) -> list[pa.Array]:
        arrays = [pa.array([len(i) // 4 for i, _ in found], pa.int64()), pa.array([sha256(i) for i, _ in found], pa.string()), pa.array([sha256(d.encode()) for _, d in found], pa.string())]
        if keep_ids:
            arrays += [pa.array([memoryview(i).cast("I").tolist() for i, _ in found], pa.list_(pa.int64())), pa.array([d for _, d in found], pa.string())]
        return arrays

    names = [c.split()[0] for c in out.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *results([bpe.encode(t) for t in batch.column(1).to_pylist()])], names=["doc_id", *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(digest, n, *part) for n, part in enumerate(parts_of(bpe, text, part_chars))]
                rows = rows or [(digest, 0, 0, "leaf", "")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["digest", "part", "stretch", "kind", "shown"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            ids = [encode_part(bpe, k, s) for k, s in zip(batch.column("kind").to_pylist(), batch.column("shown").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bpe, pdf = word_bpe(tokenizer), pdf.sort_values("part")
        ids = merge_parts(bpe, list(zip(pdf.stretch, pdf.kind, pdf.shown, pdf.ids, strict=True)))
        decoded = " ".join([bpe.token[i] for i in memoryview(ids).cast("I")])
        return pd.DataFrame(dict(zip(["digest", *names], [[pdf.digest.iloc[0]], *(a.to_pylist() for a in results([(ids, decoded)]))], strict=True)))

    is_long = F.length("text") > part_chars
    short = texts.filter(~is_long).mapInArrow(whole, f"doc_id {kind}, {out}")
    long = texts.filter(is_long).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # equal texts leave equal parts; dropping those also deals the parts of one text to many tasks
    parts = long.select("digest", "text").mapInArrow(cut, PARTS).dropDuplicates(["digest", "part"])
    ids = parts.mapInArrow(encode, f"{PARTS}, ids binary")
    # a group is one text and its ids: as large as that text
    merged = ids.groupBy("digest").applyInPandas(merge, f"digest binary, {out}")
    return short.unionByName(long.select("doc_id", "digest").join(merged, "digest").select("doc_id", *names))

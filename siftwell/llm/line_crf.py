"""Quality rules by labelling lines as content or boilerplate.

A linear-chain conditional random field over line features is fitted to a sample of
texts of which only plain cases are labelled beforehand (by seeds); other lines may be
either, and their probability is summed over both. Viterbi decoding then labels all
lines of a text, and the share of its characters that content lines have decides.
Counts that fail a text by themselves are computed alongside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import id_and_text, id_type, small_batches

# Fixed values of the counts.
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Words of legal notices and page furniture. Fixed values.
FURNITURE = re.compile(r"\b(rights reserved|licen[sc]ed? under|released under|mit license|apache license|public license|cc[ -]by|copyright|privacy policy|terms of (use|service)|cookies?|subscribe|newsletter|sign (in|up)|log ?in|click here|read more|home page|site ?map|all contents?)\b|©")
CONTENT, BOILERPLATE = 0, 1
#: Texts that the field is fitted to at most, and the content share that a kept text has at least.
SAMPLE, LEAST_CONTENT = 2_000, 0.5

#: Bounds between the buckets of each number.
WORDS_AT, SHARE_AT, SYMBOL_AT, DISTINCT_AT, LENGTH_AT = (1, 2, 4, 8, 16, 32), (0.02, 0.1, 0.3, 0.6), (0.01, 0.03, 0.08), (0.3, 0.5, 0.7), (3.0, 7.5, 10.0)


def bucket(x: float, bounds: tuple[float, ...]) -> int:
    k = 0
    for b in bounds:
        if x < b:
            break
        k += 1
    return k


#: How many values each feature of a line has.
SIZES = (7, 5, 5, 5, 4, 2, 2, 4, 2, 2, 4, 3)
STARTS = tuple(int(x) for x in np.cumsum((0, *SIZES)))
N_FEATURES = STARTS[-1]


def line_numbers(line: str) -> tuple[int, float, float, float, float, bool, bool, float, bool, float]:
    words = line.split()
    n, chars = len(words), max(len(line), 1)
    symbols = sum(map(line.count, SYMBOLS)) / chars
    bars = words.count("|") / max(n, 1)
    upper = sum(map(str.isupper, line)) / chars if not line.islower() else 0.0
    digits = sum(map(line.count, "0123456789")) / chars
    last = line.rstrip()[-1:]
    return n, bars, upper, digits, symbols, last in ".!?:;\"'”»", line.lstrip()[:1].isupper(), len(set(words)) / max(n, 1), bool(FURNITURE.search(line.lower())), sum(map(len, words)) / max(n, 1)


def describe(lines: list[str]) -> tuple[list[list[int]], list[int]]:
    """Feature numbers and seed labels (-1: either) of the lines of a text."""
    seen: set[str] = set()
    found, seeds = [], []
    for i, line in enumerate(lines):
        n, bars, upper, digits, symbols, ended, capital, distinct, furniture, length = line_numbers(line)
        again = line in seen and n > 0
        seen.add(line)
        place = 0 if i == 0 else 2 if i == len(lines) - 1 else 1
        values = (bucket(n, WORDS_AT), bucket(bars, SHARE_AT), bucket(upper, SHARE_AT), bucket(digits, SHARE_AT), bucket(symbols, SYMBOL_AT), int(ended), int(capital), bucket(distinct, DISTINCT_AT), int(again), int(furniture), bucket(length, LENGTH_AT), place)
        found.append([s + v for s, v in zip(STARTS, values, strict=False)])
        odd = bars >= 0.1 or symbols >= 0.05 or upper >= 0.6 and n >= 3 or distinct < 0.4 and n >= 8 or furniture or again
        seeds.append(BOILERPLATE if odd else CONTENT if ended and n >= 4 and symbols < 0.01 and distinct >= 0.5 else -1)
    return found, seeds


@dataclass
class LineField:
    """Weights of line features for the two labels, and of pairs of neighbouring labels."""

    lines: np.ndarray
    pairs: np.ndarray

    def emissions(self, found: list[list[int]]) -> np.ndarray:
        return self.lines[np.array(found)].sum(axis=1)

    def decode(self, found: list[list[int]]) -> list[int]:
        """The most probable labels (Viterbi)."""
        (cc, cb), (bc, bb) = self.pairs.tolist()
        back, c, b = [], 0.0, 0.0
        for i, (ec, eb) in enumerate(self.emissions(found).tolist()):
            if i:
                to_c, to_b = c + cc >= b + bc, c + cb >= b + bb
                c, b = (c + cc if to_c else b + bc), (c + cb if to_b else b + bb)
                back.append((CONTENT if to_c else BOILERPLATE, CONTENT if to_b else BOILERPLATE))
            c, b = c + ec, b + eb
        out = [CONTENT if c >= b else BOILERPLATE]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def content_share(self, text: str) -> float:
        """Of the characters of lines with a word, how many stand in content lines; 0 if there are none."""
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        if not lines:
            return 0.0
        labels = self.decode(describe(lines)[0])
        return sum(len(x) for x, y in zip(lines, labels, strict=True) if y == CONTENT) / sum(map(len, lines))


def expectations(scores: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels and of pairs of neighbouring labels (forward and backward sums)."""
    n = len(scores)
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    forward[0] = scores[0]
    for i in range(1, n):
        forward[i] = scores[i] + np.logaddexp(forward[i - 1, 0] + pairs[0], forward[i - 1, 1] + pairs[1])
    for i in range(n - 2, -1, -1):
        step = pairs + scores[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(step[:, 0], step[:, 1])
    total = np.logaddexp(*forward[-1])
    labels = np.exp(forward + backward - total)
    both = np.exp(forward[:-1, :, None] + pairs + (scores[1:] + backward[1:])[:, None, :] - total).sum(axis=0) if n > 1 else np.zeros((2, 2))
    return labels, both


def fit(texts: list[str], epochs: int = 4, rate: float = 0.3, ridge: float = 1e-4) -> LineField:
    """Maximise the probability of the seeds by stochastic gradient steps; without texts all weights are 0 but the seeds' own."""
    field = LineField(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    docs = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        for at in range(0, len(lines), 200):
            docs.append(describe(lines[at : at + 200]))
    rng = np.random.default_rng(11)
    for epoch in range(epochs):
        for d in rng.permutation(len(docs)):
            found, seeds = np.array(docs[d][0]), np.array(docs[d][1])
            scores = field.emissions(found)
            bound = scores.copy()
            bound[seeds == CONTENT, BOILERPLATE] = -1e4
            bound[seeds == BOILERPLATE, CONTENT] = -1e4
            (want, want_pairs), (have, have_pairs) = expectations(bound, field.pairs), expectations(scores, field.pairs)
            step = rate / (1 + epoch) / len(found) ** 0.5
            change = np.repeat((want - have) * step / found.shape[1], found.shape[1], axis=0)
            np.add.at(field.lines, found.ravel(), change - ridge * step * field.lines[found.ravel()])
            field.pairs += step * ((want_pairs - have_pairs) / len(found) - ridge * field.pairs)
    return field


def fit_lines(docs: DataFrame, most: int = SAMPLE, text_col: str = "text") -> LineField:
    """A field fitted to ``most`` texts at most: those of the least hashes, so they don't depend on partitions.

    Equal texts are chosen once. A null text is empty; no texts give a field without weights.
    """
    n = docs.select(F.lit(1)).count()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    chosen = docs.select(text.alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.2 * (most + 100) / max(n, 1))) + 1)
    # equal texts are chosen together, so a large group of copies counts once
    return fit(sorted(r.text for r in chosen.distinct().orderBy(F.pmod(F.xxhash64("text"), F.lit(1_000_000)), F.xxhash64("text")).limit(most).collect()))


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()  # bytes are split at ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        times = Counter(windows)
        if len(times) < len(windows):
            covered = 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 3 - max(covered, i)
                    covered = i + 3
    return n, word_chars, symbols, dup, repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


OUT = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()))


def judge_lines(docs: DataFrame, field: LineField, least_content: float = LEAST_CONTENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    A null or empty text, and one of white space alone, has no words and fails. Rows that repeat
    are each judged. No rows: no rows. Other columns are not read, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                c = counts(text)
                failed, share = base_failed(c[0], c[4]), own.content_share(text)
                rows.append((*c, failed, not failed and share >= least_content, share))
            columns = zip(*rows, strict=True) if rows else [[]] * len(OUT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, (_, t) in zip(columns, OUT, strict=True)]], names=["doc_id", *[n for n, _ in OUT]])

    schema = f"doc_id {id_type(docs, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return id_and_text(docs, id_col, text_col).mapInArrow(judge, schema)

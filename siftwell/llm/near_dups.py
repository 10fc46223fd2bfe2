"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of shingles of five words: 1 + ln(tf) times a smooth inverse
document frequency. Samples that agree with a probability equal to the weighted Jaccard
similarity are banded; texts that share a band meet in the group of that band's leader
and are verified there by their exact weighted Jaccard similarity. Links become classes
by alternating large and small stars.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm._shared import id_and_text, id_type, join_to_one, materialize, small_batches, unused_name

#: Words in a shingle, least similarity, bands and rows: at 0.8 one link in about 100,000 shares no band.
WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 3
#: Document frequencies are counted in hashed buckets: a table of fixed size, in chunks.
BUCKETS, CHUNKS, SALTS = 1 << 20, 16, 32
#: Shingles of a group that one task links; larger groups are split around LEADERS of their texts first.
GROUP, LEADERS = 4_000_000, 16
POOL, SAMPLED_TOGETHER, HASHED_TOGETHER, PORTION = 1 << 12, 8_192, 1 << 16, 50_000


def _quantiles(draw, n: int = POOL, each: int = 256) -> np.ndarray:
    """``n`` evenly spaced quantiles of a distribution, from many draws."""
    return np.sort(draw(n * each))[each // 2 :: each].astype(np.float32)


_rng = np.random.default_rng(1234567)
#: Pools of the random numbers of the sampling: gamma(2, 1), 8 less the ln of gamma(2, 1), uniform; hashes choose from them.
GAMMA = _quantiles(lambda n: _rng.gamma(2.0, 1.0, n))
ABOVE_LOG_C = np.float32(8) - np.log(_quantiles(lambda n: _rng.gamma(2.0, 1.0, n)))
BETA, PER_GAMMA = ((np.arange(POOL) + 0.5) / POOL).astype(np.float32), 1 / GAMMA
MULTIPLIERS = _rng.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WORDS + 1)], np.uint64)


#: Words end at what ``str.split`` takes for white space; beyond ASCII it is replaced first. Fixed values.
OTHER_SPACE, SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"), b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
IS_SPACE = np.isin(np.arange(256), list(SPACES))
#: A random number for each byte; the powers of an odd number weigh a byte's place, and their inverses move a word to place 0.
BYTES, ODD = _rng.integers(1 << 62, 1 << 63, 256, dtype=np.uint64), 0xD1342543DE82EF95
PLACES, BACK = (np.array([1, *[x] * (HASHED_TOGETHER - 1)], np.uint64).cumprod(dtype=np.uint64) for x in (ODD, pow(ODD, -1, 1 << 64)))


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (lower case, between white space) of several texts, and how many there are of each."""
    coded = [(t if t.isascii() else OTHER_SPACE.sub(" ", t)).lower().encode() for t in texts]
    data = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    space = IS_SPACE[data]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    turns = turns if len(data) == 0 or space[0] else np.concatenate(([0], turns))
    starts, ends = turns[::2], turns[1::2]
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        last = int(np.searchsorted(ends, base + HASHED_TOGETHER, "right"))
        if last == at:  # a longer word
            out[at] = xxhash.xxh3_64_intdigest(data[base : ends[at]].tobytes())
            at += 1
            continue
        first, values = starts[at:last] - base, BYTES[data[base : ends[last - 1]]]
        values *= PLACES[: len(values)]
        cuts = np.stack([first, ends[at:last] - base], 1).ravel()[:-1]
        out[at:last] = np.add.reduceat(values, cuts)[::2] * BACK[first]
        at = last
    return mixed(out), np.diff(np.searchsorted(starts, np.cumsum([0, *[len(c) + 1 for c in coded]])))


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several runs, one after another."""
    return np.repeat(starts - sizes.cumsum() + sizes, sizes) + np.arange(sizes.sum())


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For several texts, one after another: distinct hashes, in order, of the runs of five words (of all words,
    if fewer), how often each occurs, and how many there are of each text. Words are lower case, between white space."""
    h, n = hashed_words(texts)
    at = n.cumsum() - n
    whole = h * POWERS[0]
    for j in range(1, WORDS):
        whole[:-j] += h[j:] * POWERS[j]
    for i in np.flatnonzero((n > 0) & (n < WORDS)):
        whole[at[i]] = (h[at[i] : at[i] + n[i]] * POWERS[: n[i]]).sum()
    sizes = np.minimum(np.maximum(n - WORDS + 1, 1), n)
    z = mixed(whole[runs(at, sizes)])
    begins = sizes.cumsum() - sizes
    for b, k in zip(begins.tolist(), sizes.tolist(), strict=True):
        z[b : b + k].sort()
    new = np.ones(len(z), bool)
    np.not_equal(z[1:], z[:-1], out=new[1:])
    new[begins[sizes > 0]] = True
    first = np.flatnonzero(new)
    return z[first], np.diff(np.append(first, len(z))), np.diff(np.searchsorted(first, np.append(begins, len(z))))


def in_portions(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of few enough characters for a processor's cache (a longer text alone)."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > PORTION:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def buckets(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(44)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents a shingle of each bucket occurs, and how many documents there are.

    Tasks send compressed partial counts of the whole table, which are summed in two rounds of
    ``CHUNKS`` times ``SALTS`` and ``CHUNKS`` keys; the driver gets one row for each chunk.
    """
    size = BUCKETS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(BUCKETS, np.uint32), 0
        for batch in batches:
            for texts in in_portions(batch.column(0).to_pylist()):
                keys, _, sizes = shingle_sets(texts)
                b = buckets(keys)
                # shingles are in order, so those of one bucket and text are neighbours
                new = np.diff(b, prepend=-1) != 0
                new[(sizes.cumsum() - sizes)[sizes > 0]] = True
                np.add.at(table, b[new], 1)
                n += len(texts)
        salt = TaskContext.get().partitionId() % SALTS
        if n:
            yield packed({(c, salt): table[c * size : (c + 1) * size] for c in range(CHUNKS)}, n)

    def packed(sums: dict[tuple[int, int], np.ndarray], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in sums], pa.int32()), pa.array([s for _, s in sums], pa.int32()), pa.array([n if c == 0 else 0 for c, _ in sums], pa.int64()), pa.array([zlib.compress(v.astype("<u8").tobytes(), 1) for v in sums.values()], pa.binary())],
            names=["chunk", "salt", "n", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for c, k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), "<u8")
                sums[c] = sums[c] + part if c in sums else part
                n += k
        if sums:
            yield packed({(c, 0): v for c, v in sorted(sums.items())}, n)

    schema = "chunk int, salt int, n long, counts binary"
    partial = texts.select("text").mapInArrow(count, schema)
    rows = partial.repartition("chunk", "salt").mapInArrow(add, schema).repartition("chunk").mapInArrow(add, schema).collect()
    table, n = np.zeros(BUCKETS, np.uint64), 0
    for r in rows:
        table[r.chunk * size : (r.chunk + 1) * size] += np.frombuffer(zlib.decompress(bytes(r.counts)), "<u8")
        n += r.n
    return table, n


def bucket_weights(table: np.ndarray, n: int) -> np.ndarray:
    """The smooth inverse document frequency of each bucket: 1 for a shingle of all documents, more the rarer it is.

    It is scaled by a constant, so it is alike at every size. A bucket is as frequent as all its
    shingles together, which bounds it: it hardly passes 1.6.
    """
    return (1 + np.log((1.0 + n) / (1.0 + table.astype(np.float64))) / math.log(BUCKETS)).astype(np.float32)


def weighted_sets(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of several texts, one after another, their TF-IDF weights, and how many there are of each text."""
    keys, times, sizes = shingle_sets(texts)
    w = weights[buckets(keys)]
    if len(times) and times.max() > 1:
        w *= (1 + np.log(times)).astype(np.float32)
    return keys, w, sizes


def weighted(text: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a text and their TF-IDF weights."""
    return weighted_sets([text], weights)[:2]


def samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The consistent weighted samples (columns) of the sets that begin at ``starts``, 32 bits each.

    A shingle of weight w has r, c (both gamma(2, 1)) and b (uniform), and the level t = floor(ln w / r + b). The
    shingle of the least ln c - r (t - b + 1) is sampled, with its level; here that number is negated and moved above 0,
    where floats are in the order of their bits, and its shingle's place is put behind it.
    """
    log_w, places = np.log(weights), np.arange(len(keys), dtype=np.uint64)
    out = np.empty((len(starts), len(MULTIPLIERS)), np.uint32)
    z, index = np.empty_like(keys), np.empty_like(keys)
    which = index.view(np.int64)
    r, t, b, y = (np.empty(len(keys), np.float32) for _ in range(4))
    mask, low = np.uint64(POOL - 1), np.uint64(0xFFFFFFFF)
    for j, m in enumerate(MULTIPLIERS):
        np.multiply(keys, m, out=z)
        np.right_shift(z, np.uint64(32), out=index)
        z ^= index
        z *= np.uint64(0x9FB21C651E98DF25)
        np.right_shift(z, np.uint64(52), out=index)
        np.take(GAMMA, which, out=r, mode="clip")
        np.take(PER_GAMMA, which, out=t, mode="clip")
        np.right_shift(z, np.uint64(40), out=index)
        index &= mask
        np.take(ABOVE_LOG_C, which, out=y, mode="clip")
        np.right_shift(z, np.uint64(28), out=index)
        index &= mask
        np.take(BETA, which, out=b, mode="clip")
        t *= log_w
        t += b
        np.floor(t, out=t)
        np.subtract(t, b, out=b)
        b += np.float32(1)
        r *= b
        y += r
        z[:] = y.view(np.uint32)
        z <<= np.uint64(32)
        z |= places
        best = (np.maximum.reduceat(z, starts) & low).view(np.int64)
        out[:, j] = keys[best].astype(np.uint32) ^ (t[best].astype(np.int32).view(np.uint32) * np.uint32(2654435761))
    return out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    """A 64-bit key for each set and band."""
    x = sampled.reshape(len(sampled), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), x.shape[:2]).copy()
    for r in range(ROWS):
        h ^= x[:, :, r]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(30)
    return h.view(np.int64)


class Group:
    """Exact links among the texts of a group, as its connected components.

    Texts are rows of shingle numbers and weights. Shingles are in order of their frequency in the
    group, rare ones first. Two sets that are similar share a shingle that is among the first of both:
    among those of the heavier one that make up the part of its weight that it may differ in, and among
    those of the lighter one that make up the part that it may lack, as both have a share of
    2 s / (1 + s) of the lighter one's weight at least. So heavier texts look for lighter ones, heaviest
    first, and texts that are alike but under the threshold, as pages of one template, don't meet. Pairs
    within a component are not tried. 1 - similarity is a metric: where a text has many candidates
    it is compared with all, and those so near to it that no text beyond the threshold can be
    similar to them leave with it.
    """

    def __init__(self, texts: list[tuple[bytes, str]], weights: np.ndarray, similar: float):
        self.names, self.similar = [name for name, _ in texts], similar
        keys, w, sizes = zip(*(weighted_sets(part, weights) for part in in_portions([t for _, t in texts])), strict=True)
        self.sizes, n = np.concatenate(sizes), len(texts)
        self.starts = np.concatenate(([0], self.sizes.cumsum()))
        keys, self.cols = np.unique(np.concatenate(keys), return_inverse=True)
        self.weights = np.concatenate(w).astype(np.float64)
        rows = np.repeat(np.arange(n), self.sizes)
        self.totals = np.bincount(rows, self.weights, n)
        frequency = np.bincount(self.cols, minlength=len(keys))
        order = np.lexsort((self.cols, frequency[self.cols], rows))
        w = self.weights[order]
        before = np.cumsum(w) - w
        before -= np.repeat(before[self.starts[:-1][self.sizes > 0]], self.sizes[self.sizes > 0])
        rest = self.totals[rows] - before
        kept = order[rest >= similar * self.totals[rows] - 1e-6]
        #: The first shingles of each text as the heavier one of a pair, and for each shingle the texts that have it among their first as the lighter one.
        self.first_cols = self.cols[kept]
        self.first_starts = np.searchsorted(rows[kept], np.arange(n + 1))
        indexed = order[rest >= 2 * similar / (1 + similar) * self.totals[rows] - 1e-6]
        by_col = indexed[np.argsort(self.cols[indexed], kind="stable")]
        self.holders, self.holder_starts = rows[by_col], np.searchsorted(self.cols[by_col], np.arange(len(keys) + 1))
        self.dense = np.zeros(len(keys))
        self.label = np.arange(n)

    def distances(self, x: int, others: np.ndarray) -> np.ndarray:
        own = slice(self.starts[x], self.starts[x + 1])
        self.dense[self.cols[own]] = self.weights[own]
        sizes = self.sizes[others]
        at = runs(self.starts[others], sizes)
        common = np.add.reduceat(np.minimum(self.weights[at], self.dense[self.cols[at]]), np.concatenate(([0], sizes.cumsum()[:-1])))
        self.dense[self.cols[own]] = 0
        return 1 - common / (self.totals[x] + self.totals[others] - common)

    def candidates(self, x: int, open_: np.ndarray) -> np.ndarray:
        first = self.first_cols[self.first_starts[x] : self.first_starts[x + 1]]
        starts = self.holder_starts[first]
        found = np.unique(self.holders[runs(starts, self.holder_starts[first + 1] - starts)])
        ratio = (self.totals[found] >= (self.similar - 1e-9) * self.totals[x]) & (self.totals[found] <= self.totals[x])
        return found[open_[found] & ratio & (self.label[found] != self.label[x])]

    def unite(self, x: int, others: np.ndarray) -> None:
        if len(others):
            labels = np.unique(self.label[np.append(others, x)])
            self.label[np.isin(self.label, labels)] = labels[0]

    def link(self) -> list[tuple[bytes, bytes]]:
        """(text, the first text of its component) of all texts that have links."""
        far, open_ = 1 - self.similar + 1e-9, self.sizes > 0
        for x in np.argsort(-self.totals, kind="stable").tolist():
            if not open_[x]:
                continue
            open_[x] = False
            near = self.candidates(x, open_)
            if len(near) > 32 and 2 * len(near) > open_.sum():
                rest = np.flatnonzero(open_)
                away = self.distances(x, rest)
                self.unite(x, rest[away <= far])
                beyond = away[away > far]
                open_[rest[(away <= far) & (away < (beyond.min() if len(beyond) else np.inf) - far)]] = False
            elif len(near):
                self.unite(x, near[self.distances(x, near) <= far])
        return [(self.names[x], self.names[r]) for x, r in enumerate(self.label.tolist()) if r != x]


def similarities(text: str, others: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> list[float]:
    """Weighted Jaccard similarity of a text to weighted sets."""
    keys, w = weighted(text, weights)
    w, out = w.astype(np.float64), []
    for k, v in others:
        at = np.searchsorted(keys, k)
        at[at == len(keys)] = 0
        both = keys[at] == k if len(keys) else np.zeros(len(k), bool)
        common = np.minimum(w[at[both]], v[both].astype(np.float64)).sum()
        out.append(common / (w.sum() + v.sum(dtype=np.float64) - common) if common else 0.0)
    return out


def link_groups(rows: DataFrame, weights, similar: float) -> DataFrame:
    """Links (a, b) within each group of ``rows`` (leader, node, text)."""

    def linked(group: list[tuple[bytes, str]]) -> list[tuple[bytes, bytes]]:
        return Group(group, weights.value, similar).link() if len(group) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, group = None, []
        for batch in batches:
            found = []
            for own, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != leader:
                    found += linked(group)
                    leader, group = own, []
                group.append((node, text))
            if found:
                yield edges(found)
        if found := linked(group):
            yield edges(found)

    def edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

    return rows.repartition("leader").sortWithinPartitions("leader", "node").select("leader", "node", "text").mapInArrow(run, "a binary, b binary")


def with_candidates(rows: DataFrame, weights, similar: float) -> DataFrame:
    """The ``rows`` (leader, node, text, size) that can be similar to another of their group: that share one of their first shingles.

    As ``Group`` finds candidates, but with the order of the whole corpus and the shingles dealt over tasks: texts
    of a large group that are alike, but under the threshold, leave it here.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, indexed = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                keys, w = weighted(text, weights.value)
                w = w.astype(np.float64)
                order = np.lexsort((keys, -weights.value[buckets(keys)]))
                rest = w.sum() - (np.cumsum(w[order]) - w[order])
                k = int((rest >= similar * w.sum() - 1e-6).sum())
                at.append(np.full(k, i))
                found.append(keys[order[:k]].view(np.int64))
                indexed.append(rest[:k] >= 2 * similar / (1 + similar) * w.sum() - 1e-6)
            own = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(np.concatenate(found)), pa.array(np.concatenate(indexed))], names=["leader", "node", "shingle", "indexed"])

    tokens = rows.select("leader", "node", "text").mapInArrow(first, "leader binary, node binary, shingle long, indexed boolean")
    shared = tokens.groupBy("leader", "shingle").agg(F.count(F.lit(1)).alias("n"), F.count_if("indexed").alias("i")).filter("n > 1 and i > 0")
    key = F.struct("leader", "shingle")
    met = join_to_one(tokens.select(key.alias("key"), "node"), materialize(shared.select(key.alias("key"), "n"), "first-shingles"), "key", "n", ["node"])
    kept = met.select("key.leader", "node").distinct()
    return rows.join(kept, ["leader", "node"], "left_semi")


def shrink_groups(rows: DataFrame, weights, similar: float, count: int) -> tuple[DataFrame, DataFrame]:
    """Take each large group of ``rows`` (leader, node, text, size) apart around ``count`` of its texts: (links, what is left).

    All texts of a group are compared with these, in hashed parts, and linked to those that they are
    similar to. A text leaves if one of these is so near that, by the triangle inequality, all that
    can be similar to the text is similar to that one too. The others go on as a group.
    """
    parts, far = 64, 1 - similar + 1e-9
    # Spark keeps the first rows of a group before it deals them out, so no group meets in one task
    place = F.row_number().over(Window.partitionBy("leader").orderBy(F.xxhash64("node"), "node"))
    chosen = rows.withColumn("place", place).filter(F.col("place") <= count)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    dealt = chosen.select("leader", everywhere, F.col("place"), "node", "text", "size").unionByName(rows.select("leader", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"), F.lit(count + 1).alias("place"), "node", "text", "size"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []
        for batch in batches:
            found = []
            for leader, part, number, node, text, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (leader, part):
                    at, nodes, sets = (leader, part), [], []
                if number <= count:
                    nodes.append(node)
                    sets.append(weighted(text, weights.value))
                else:
                    # a chosen text is done, as all are compared with it
                    away = [-1.0 if n == node else 1 - x for n, x in zip(nodes, similarities(text, sets, weights.value), strict=True)]
                    found.append((leader, part, node, text, size, away, [n for n, x in zip(nodes, away, strict=True) if 0 <= x <= far]))
            if found:
                kinds = (pa.binary(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["leader", "part", "node", "text", "size", "away", "linked"])

    dealt = dealt.repartition("leader", "part").sortWithinPartitions("leader", "part", "place", "node").select("leader", "part", "place", "node", "text", "size")
    measured = materialize(dealt.mapInArrow(measure, "leader binary, part int, node binary, text string, size long, away array<double>, linked array<binary>"), "measured")
    links = measured.select(F.col("node").alias("a"), F.explode("linked").alias("b"))
    nearest = measured.select("leader", F.posexplode("away").alias("place", "away")).groupBy("leader", "place").agg(F.min(F.when(F.col("away") > far, F.col("away"))).alias("nearest"))
    nearest = nearest.groupBy("leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("nearest", F.lit(9.0)).alias("x")))), lambda s: s["x"]).alias("nearest"))
    leaves = F.exists(F.zip_with("away", "nearest", lambda a, n: (a <= far) & (a < n - far)), lambda x: x)
    left = measured.join(nearest.select("leader", "nearest", everywhere), ["leader", "part"]).filter(~leaves)
    return links, left.select("leader", "node", "text", "size")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (a, b) but roots; a root is the least node of its component."""
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    while not edges.isEmpty():
        # large star: neighbours above a node move to the least of its neighbourhood
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: neighbours below a node, and the node, move to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).filter("v != u").distinct()
        edges = materialize(small, "stars")
        # done when all are stars: no node is above one and below another, and none is below two
        if edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and edges.groupBy("v").count().filter("count > 1").isEmpty():
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("node", F.unhex(F.md5(F.encode("text", "utf-8"))))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (the least id of its class), node (the text's digest) and
    root (the least node of its class). Only root is a key of classes: class_id is null or shared where ids are.

    Two texts are linked if their weighted Jaccard similarity is ``similar`` or more; classes are
    connected components. Equal texts, empty ones too, are of one class. Texts of fewer than five
    words have one shingle of all of them; a null text is empty. Null ids count only where a class
    has no other. No rows: no rows. Other columns are not read, so their names can't clash.

    A group of more than ``group`` shingles isn't linked by one task: texts that no other can be similar to
    leave it, and the rest is taken apart.
    """
    spark, kind = docs.sparkSession, id_type(docs, id_col)
    small_batches(spark)
    rows = _rows(docs, id_col, text_col)
    table, n = document_frequencies(rows)
    weights = spark.sparkContext.broadcast(bucket_weights(table, n))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes: list[int] = []
            out: list[list[int] | None] = []
            for texts in in_portions(batch.column(2).to_pylist()):
                keys, w, own = weighted_sets(texts, weights.value)
                sizes += own.tolist()
                ends, first = own.cumsum(), 0
                while first < len(own):
                    # some thousand shingles at a time
                    begin = ends[first] - own[first]
                    last = max(first + 1, int(np.searchsorted(ends, begin + SAMPLED_TOGETHER, "right")))
                    full = own[first:last] > 0
                    found = iter(band_keys(samples(keys[begin : ends[last - 1]], w[begin : ends[last - 1]], (ends - own)[first:last][full] - begin)).tolist() if full.any() else [])
                    out += [next(found) if f else None for f in full.tolist()]
                    first = last
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "node", "size", "bands"])

    signed = materialize(rows.select("doc_id", "node", "text").mapInArrow(banded, f"doc_id {kind}, node binary, size long, bands array<long>"), "bands")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "size", "bands")).alias("x")
    nodes = materialize(signed.groupBy("node").agg(first, F.count(F.lit(1)).alias("copies")).select("node", F.col("x.doc_id").alias("rep"), F.col("x.size").alias("size"), F.col("x.bands").alias("bands"), "copies"), "nodes")
    exploded = nodes.select("node", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).filter("n > 1")
    members = materialize(join_to_one(exploded, shared, "band", "n", ["node"]).select("leader", "node").distinct(), "members")
    links = []
    if not members.isEmpty():
        wanted = members.groupBy("node").agg(F.collect_set("leader").alias("leaders")).join(nodes.select("node", "rep", "size"), "node")  # a set has as many leaders as bands at most
        texts = rows.join(wanted.withColumnRenamed("node", "wanted"), (F.col("node") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("rep")))
        grouped = texts.select(F.explode("leaders").alias("leader"), "node", "text", "size")
        sizes = wanted.select(F.explode("leaders").alias("leader"), "size").groupBy("leader").agg(F.sum("size").alias("total"))
        large = sizes.filter(F.col("total") > group).select("leader")
        if large.isEmpty():
            links.append(link_groups(grouped.dropDuplicates(["leader", "node"]), weights, similar))
        else:
            all_rows = materialize(grouped.dropDuplicates(["leader", "node"]), "grouped")
            links.append(link_groups(all_rows.join(large, "leader", "left_anti"), weights, similar))
            left = materialize(with_candidates(all_rows.join(large, "leader", "left_semi"), weights, similar), "large")
            while not left.isEmpty():
                large = left.groupBy("leader").agg(F.sum("size").alias("total")).filter(F.col("total") > group).select("leader")
                links.append(link_groups(left.join(large, "leader", "left_anti"), weights, similar))
                found, rest = shrink_groups(left.join(large, "leader", "left_semi"), weights, similar, LEADERS)
                links.append(found)
                left = materialize(rest, "rest")
    if links:
        all_links = links[0]
        for more in links[1:]:
            all_links = all_links.union(more)
        roots = components(all_links)
        named = nodes.select("node", "rep", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        classes = named.groupBy("root").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("texts"))
        named = join_to_one(named, classes, "root", "texts", ["node"]).select("node", "copies", "class_id", "root")
    else:
        named = nodes.select("node", "copies", F.col("rep").alias("class_id"), F.col("node").alias("root"))
    return join_to_one(signed.select("doc_id", "node"), named, "node", "copies", ["doc_id"]).select("doc_id", "class_id", "node", "root")


def drop_near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near duplicates: the one of the least id (null last), then of the least digest.

    Of rows that repeat in id and text any one stays. A null text is empty; all empty texts are one
    class. Null or shared ids make no class. No rows: no rows. All columns stay, whatever their names.
    """
    found = near_duplicates(docs, similar, id_col=id_col, text_col=text_col)
    node, kept_id, kept_node = unused_name(docs, "_node"), unused_name(docs, "_kept_id"), unused_name(docs, "_kept_node")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "node")).alias("x")).select(F.col("x.doc_id").alias(kept_id), F.col("x.node").alias(kept_node))
    numbered = docs.withColumn(node, F.unhex(F.md5(F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "utf-8"))))
    out = numbered.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(kept_id)) & (F.col(node) == F.col(kept_node)), "left_semi")
    return out.dropDuplicates([node, id_col]).drop(node)

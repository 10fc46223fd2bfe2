"""A toxicity classifier with counterfactual regularisation.

A text is as toxic as its most toxic sentence: a logistic model of the distinct words
and beginnings of words of a sentence, fitted to labelled texts by turns of choosing each toxic text's
sentence and fitting the weights. Sentences that mention a group of people are paired
with copies that mention another group instead, and the squared difference of the
scores of a pair is part of the loss, so that a group's name alone doesn't count.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import id_and_text, materialize, small_batches, unused_name

# Terms for groups of people; those of one line can stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "hispanic", "african", "arab", "european"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "turkish", "polish"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
)
SENTENCE, WORD = re.compile(r"[.!?\n]+"), re.compile(r"[^\W\d_]+")

#: Labelled texts that a model is fitted to at most, texts that a word must be in (and a thousandth of all), and copies of a sentence that mentions a group.
SAMPLE, LEAST_TEXTS, SWAPS = 8_000, 2, 3
#: Least lift of a word that may count, and the part of a toxic text's highest sentence score that its other toxic sentences have.
LEAST_LIFT, NEAR_BEST = 2.0, 0.6
#: Texts of the mean share of label 1 that each word is thought to have besides its own, at first.
PRIOR = 10.0
#: Lengths of the beginnings of words that are features beside the words.
STEMS = (5, 6, 7)
THRESHOLD = 0.3


def features(words) -> set[str]:
    """Words, and the beginnings of longer ones (with a star), which words of one stem share."""
    out = set(words)
    for w in words:
        for k in STEMS:
            if len(w) > k:
                out.add(w[:k] + "*")
    return out


@dataclass
class ToxicityModel:
    """Weights of words, and the scale from the highest sentence score to a probability."""

    words: dict[str, float]
    bias: float
    slope: float
    offset: float

    def __post_init__(self):
        self.known: dict[str, tuple[tuple[str, float], ...]] = {}

    def weight(self, word: str) -> tuple[tuple[str, float], ...]:
        """The features of a word that have a weight."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[word] = tuple((f, self.words[f]) for f in features((word,)) if f in self.words)
        return found

    def raw(self, text: str) -> float:
        get, most = self.weight, 0.0
        for sentence in SENTENCE.split(text.lower()):
            total, seen = 0.0, set()
            for w in set(WORD.findall(sentence)):
                for f, x in get(w):
                    if f not in seen:
                        seen.add(f)
                        total += x
            if total > most:
                most = total
        return self.bias + most

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.raw(text) + self.offset))))


def swapped(words: frozenset[str], sets: dict[str, tuple[str, ...]], most: int = SWAPS) -> list[frozenset[str]]:
    """Copies of a sentence's words in which the k-th other term of the line replaces each identity term."""
    mentioned = [w for w in words if w in sets]
    if not mentioned:
        return []
    out = []
    for k in range(1, most + 1):
        to = {w: sets[w][(sets[w].index(w) + k) % len(sets[w])] for w in mentioned}
        out.append(frozenset(to.get(w, w) for w in words))
    return [s for s in out if s != words]


def sentences_of(text: str) -> set[frozenset[str]]:
    """The distinct word sets of a text's sentences."""
    return {frozenset(WORD.findall(s)) for s in SENTENCE.split(text.lower())}


def coded(words, vocabulary: dict[str, int]) -> tuple[int, ...]:
    """The numbers of the features of a sentence that the vocabulary has, in order."""
    return tuple(sorted(vocabulary[f] for f in features(words) if f in vocabulary))


def choose(counted: list[tuple[str, int, int, int]], n: int, n_toxic: int) -> tuple[dict[str, int], np.ndarray]:
    """Number the features that may count, and give the weight that each begins with.

    ``counted``: feature, texts that have it, toxic ones among them, and a number that two features
    share if the same texts have them. Of a stem's features that the same texts have, the shortest
    stands for all. Names of groups are always among the features.
    """
    share, names = n_toxic / n, {w for line in IDENTITY_TERMS for w in line}
    # how much more often than a text a feature's texts are toxic, drawn to 1 where it has few texts
    lift = {w: (t + PRIOR * share) / (c + PRIOR) / share for w, c, t, _ in counted}
    distinct: dict[tuple, str] = {}
    for w, _, _, support in sorted(counted, key=lambda x: (-len(x[0]), x[0])):
        if lift[w] >= LEAST_LIFT:
            distinct[w[: STEMS[0]].rstrip("*"), support] = w
    vocabulary = {w: k for k, w in enumerate(sorted(set(distinct.values()) | (names & lift.keys())))}
    return vocabulary, np.array([max(0.0, math.log(lift[w])) for w in vocabulary])


class Sparse:
    """Rows of feature numbers, each with a weight."""

    def __init__(self, rows: list[tuple[int, ...]], weights: list[int]):
        self.n, self.weights = len(rows), np.array(weights, float)
        self.rows = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.cols = np.array([k for r in rows for k in r], np.int64)

    def sums(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, theta[self.cols], self.n)

    def back(self, errors: np.ndarray, m: int) -> np.ndarray:
        return np.bincount(self.cols, errors[self.rows], m)


def learn(clean: dict[tuple, int], toxic: list[dict[tuple, int]], pairs: dict[tuple, int], theta: np.ndarray, penalty: float = 1.0, ridge: float = 1.0, turns: int = 3, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias. ``clean`` and each text of ``toxic``: sentences by their feature numbers, with how many
    there are; ``pairs``: (a sentence's, its swapped copy's) feature numbers, with how many there are."""
    rows, times, owner = list(clean), list(clean.values()), [-1] * len(clean)
    for d, own_rows in enumerate(toxic):
        rows += own_rows
        times += own_rows.values()
        owner += [d] * len(own_rows)
    x, own = Sparse(rows, times), np.array(owner)
    first, second = (Sparse([p[k] for p in pairs], list(pairs.values())) for k in (0, 1))
    m, theta, bias, bad = len(theta), theta.copy(), -4.0, own >= 0
    fixed = ridge + penalty * (first.back(first.weights, m) + second.back(second.weights, m)) if pairs else ridge
    for _ in range(turns):
        z = x.sums(theta)
        best = np.full(len(toxic) + 1, -np.inf)
        np.maximum.at(best, own[bad], z[bad])
        chosen = bad & (z >= NEAR_BEST * best[own] - 1e-12)
        # a toxic text's other sentences may be either; all sentences of other texts are clean
        used = np.where(chosen | ~bad, x.weights, 0.0)
        target = chosen.astype(float)
        per_word = 0.25 * x.back(used, m) + fixed
        speed, bias_speed = np.zeros(m), 0.0
        for _ in range(steps):
            error = (1 / (1 + np.exp(-np.clip(x.sums(theta) + bias, -30, 30))) - target) * used
            g = x.back(error, m) + ridge * theta
            if pairs:
                gap = (first.sums(theta) - second.sums(theta)) * 2 * penalty * first.weights
                g += first.back(gap, m) - second.back(gap, m)
            # each word's step is scaled by a bound of its curvature, and damped as a sentence has several words
            speed = 0.8 * speed - 0.15 * g / per_word
            bias_speed = 0.8 * bias_speed - 0.15 * error.sum() / (0.25 * used.sum())
            theta += speed
            bias += bias_speed
    return theta, bias


def constant(n: int, n_toxic: int) -> ToxicityModel:
    """Without a text of either label: the smoothed share of label 1."""
    share = (n_toxic + 0.5) / (n + 1)
    return ToxicityModel({}, 0.0, 1.0, math.log(share / (1 - share)))


def described(text: str, vocabulary: dict[str, int]) -> tuple[Counter, dict[frozenset, list[tuple[tuple, tuple]]]]:
    """A text's sentences by their feature numbers, and by each sentence that names a group its (own, copy's) feature numbers."""
    lines = {w: line for line in IDENTITY_TERMS for w in line}
    own = sentences_of(text)
    pairs = {s: [(coded(s, vocabulary), coded(c, vocabulary)) for c in swapped(s, lines)] for s in own if not lines.keys().isdisjoint(s)}
    return Counter(coded(s, vocabulary) for s in own), pairs


def least_texts(n: int) -> int:
    return max(LEAST_TEXTS, n // 1000)


def finished(vocabulary: dict[str, int], theta: np.ndarray, bias: float) -> ToxicityModel:
    return ToxicityModel({w: float(theta[k]) for w, k in vocabulary.items() if abs(theta[k]) > 0.02}, float(bias), 1.0, 0.0)


def fit(texts: list[str], labels: list[int], penalty: float = 1.0) -> ToxicityModel:
    """Fit a model to texts in memory; texts that repeat count once, with the label that most of their rows have.

    Without a text of either label the score is that of the share of label 1. ``fit_toxicity``
    makes the same model of tables.
    """
    votes: dict[str, list[int]] = {}
    for t, y in zip(texts, labels, strict=True):
        votes.setdefault(t, []).append(y)
    items = sorted((t, int(2 * sum(v) > len(v))) for t, v in votes.items())
    n, n_toxic = len(items), sum(y for _, y in items)
    if n_toxic in (0, n):
        return constant(n, n_toxic)
    support: dict[str, list[int]] = {}
    for d, (t, _) in enumerate(items):
        for f in features(set(WORD.findall(t.lower()))):
            support.setdefault(f, []).append(d)
    counted = [(f, len(ds), sum(items[d][1] for d in ds), hash(tuple(ds))) for f, ds in support.items() if len(ds) >= least_texts(n)]
    vocabulary, theta = choose(counted, n, n_toxic)
    clean, toxic, pairs, seen = Counter(), [], Counter(), set()
    for t, y in items:
        rows, more = described(t, vocabulary)
        toxic.append(rows) if y else clean.update(rows)
        for s in more.keys() - seen:
            pairs.update(more[s])
        seen |= more.keys()
    model = finished(vocabulary, *learn(clean, toxic, pairs, theta, penalty))
    model.slope, model.offset = platt(np.array([model.raw(t) for t, _ in items]), np.array([y for _, y in items], float))
    return model


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic curve of labels over scores, by Newton's method."""
    center, scale = raw.mean(), raw.std() or 1.0
    x = (raw - center) / scale
    a, b = 1.0, math.log(y.mean() / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        ga, gb = ((p - y) * x).sum() + 0.01 * a, (p - y).sum()
        haa, hab, hbb = (w * x * x).sum() + 0.01, (w * x).sum(), w.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-2, min(2, da)), b - max(-2, min(2, db))
    a = max(a, 1e-3)
    return a / scale, b - a * center / scale


def held_out(id_col: str, modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``most`` labelled rows that aren't held out: digest, text, y. Those of the least hashes of
    doc_id (then of the text) are chosen, so the sample doesn't depend on partitions.

    Rows without id or label aren't chosen; of an id that has several labels the largest counts. A null text is empty.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    place = F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(1 << 40))
    n = known.count()
    # labels are small beside texts, but grow with them: only some more than are wanted are joined
    some = known.withColumn("place", place).filter(F.col("place") < int((1 << 40) * min(1.0, 1.2 * (most + 100) / max(n, 1))) + 1)
    found = id_and_text(docs, id_col, text_col).join(F.broadcast(some), "doc_id").withColumn("digest", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)))
    return found.orderBy("place", "digest").limit(most).select("digest", "text", "y")


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, penalty: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model of ``labels.toxic``, fitted to at most ``most`` labelled rows whose crc32(doc_id) mod 4 is not 2.

    Texts stay on the executors: they are counted, described by feature numbers and scored there. The
    driver gets the features that enough texts have, and the distinct sentences as feature numbers.
    Texts that repeat count once, with the label that most of their rows have (0 in a tie). Rows with
    a null id or label aren't used; a null text is empty. With no row, or one label only, every score
    is the smoothed share of label 1. Other columns are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_sample(docs, labels, "toxic", 4, 2, most, id_col, text_col)
    items = materialize(sample.groupBy("digest").agg(F.first("text").alias("text"), (2 * F.sum("y") > F.count(F.lit(1))).alias("bad")), "labelled")
    n, n_toxic = items.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if n_toxic in (0, n):
        return constant(n, n_toxic)

    def own_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(set(WORD.findall(t.lower())))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("bad"), pa.array(found, pa.list_(pa.string()))], names=["digest", "bad", "features"])

    has = items.select("digest", "bad", "text").mapInArrow(own_features, "digest binary, bad boolean, features array<string>").select("digest", "bad", F.explode("features").alias("feature"))
    # which texts have a feature: as a number that doesn't depend on their order
    support = F.bit_xor(F.xxhash64("digest"))
    counted = has.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), support.alias("support"))
    names = F.col("feature").isin(sorted({w for line in IDENTITY_TERMS for w in line}))
    lift = (F.col("n_bad") + PRIOR * n_toxic / n) / (F.col("n") + PRIOR) / (n_toxic / n)
    vocabulary, theta = choose([tuple(r) for r in counted.filter((F.col("n") >= least_texts(n)) & ((lift > LEAST_LIFT - 1e-6) | names)).collect()], n, n_toxic)
    shared = spark.sparkContext.broadcast(vocabulary)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
        for batch in batches:
            rows = []
            for digest, bad, text in zip(*(batch.column(c).to_pylist() for c in ("digest", "bad", "text")), strict=True):
                own, pairs = described(text, shared.value)
                rows += [(digest if bad else None, list(s), None, k) for s, k in own.items()]
                # a sentence is known by the hash of its words, as it counts once among all texts
                rows += [(hashlib.md5(" ".join(sorted(s)).encode()).digest(), list(a), list(b), i) for s, copies in pairs.items() for i, (a, b) in enumerate(copies)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["owner", "own", "copy", "n"])

    found = materialize(items.select("digest", "bad", "text").mapInArrow(describe, "owner binary, own array<int>, copy array<int>, n long"), "sentences")
    clean, toxic, pairs = {}, {}, {}
    for r in found.filter("copy is null").groupBy("owner", "own").agg(F.sum("n").alias("n")).toLocalIterator():
        (clean if r.owner is None else toxic.setdefault(bytes(r.owner), {}))[tuple(r.own)] = r.n
    for r in found.filter("copy is not null").distinct().groupBy("own", "copy").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        pairs[tuple(r.own), tuple(r["copy"])] = r.n
    order = lambda x: dict(sorted(x.items()))
    model = finished(vocabulary, *learn(order(clean), [order(toxic[d]) for d in sorted(toxic)], order(pairs), theta, penalty))
    own = spark.sparkContext.broadcast(model)
    raw = F.pandas_udf(lambda texts: texts.map(own.value.raw).astype(float), "double")
    scored = sorted(map(tuple, items.select(raw("text"), F.col("bad").cast("double")).collect()))
    model.slope, model.offset = platt(np.array([r for r, _ in scored]), np.array([y for _, y in scored]))
    return model


def score_column(docs: DataFrame, model: ToxicityModel, text_col: str = "text"):
    """The score of each row's text as a column; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield texts.map(own.score).astype(float)

    return score(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    An empty or null text has the score of a text without any weighted word. Null ids aren't held
    out. Rows that repeat are each scored, with equal scores. No rows: no rows. Other columns are
    not read, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    scored = rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), score_column(rows, model).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text's score reaches ``threshold``; all columns stay, whatever their names.

    A null or empty text has the score of a text without any weighted word. Rows that repeat have
    equal scores, so all or none of them stay; ids aren't read. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    name = unused_name(docs, "_score")
    return docs.withColumn(name, score_column(docs, model, text_col)).filter(F.col(name) < threshold).drop(name)

"""Near duplicates among pages of one template, and token counts through their join."""

import time

import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import near_dups, token_counts
from siftwell.llm.bpe import byte_bpe
from siftwell.llm.queries import BYTE_BPE

WORDS = [f"w{k}" for k in range(40)]


def template(serial):
    return " ".join([*WORDS[:20], f"serial{serial}", *WORDS[21:]])


def group_of(texts, weights=None):
    weights = np.ones(near_dups.BUCKETS, np.float32) if weights is None else weights
    return near_dups.Group([(str(k).encode(), t) for k, t in enumerate(texts)], weights, 0.8)


def all_pairs(texts):
    """Text -> the least text of its component, by every pair."""
    sets = [dict(zip(*(v.tolist() for v in near_dups.weighted(t, np.ones(near_dups.BUCKETS, np.float32))), strict=True)) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            common = sum(min(w, y.get(k, 0)) for k, w in x.items())
            if common >= 0.8 * (sum(x.values()) + sum(y.values()) - common) - 1e-9:
                i, j = sorted((find(a), find(b)))
                root[j] = i
    return [find(k) for k in range(len(texts))]


def test_pages_of_a_template_do_not_meet():
    """One differing word of 40: similarity 0.76. No work grows with the square of the pages."""
    took = []
    for n in (5_000, 20_000):
        group = group_of([template(k) for k in range(n)])
        assert len(group.holders) <= 5 * n
        began = time.process_time()
        assert group.link() == []
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_links_of_a_group_by_all_pairs():
    rng = np.random.default_rng(6)
    texts = []
    for k in range(300):
        words = list(WORDS[: rng.integers(30, 41)])
        for _ in range(rng.integers(0, 3)):
            words[rng.integers(len(words))] = f"x{rng.integers(30)}"
        texts.append(" ".join(words[rng.integers(0, 3) :]))
    texts += [template(k) for k in range(100)]
    found = dict(group_of(texts).link())
    roots = all_pairs(texts)
    label = [found.get(str(k).encode(), str(k).encode()) for k in range(len(texts))]
    assert len(set(roots)) > 50
    assert len(set(zip(roots, label, strict=True))) == len(set(roots)) == len(set(label))


def test_large_groups_lose_what_no_other_is_similar_to(spark):
    rows = [(b"g", str(k).encode(), template(k), 36) for k in range(400)]
    rows += [(b"g", f"c{k}".encode(), template(7) + f" tail{k}", 37) for k in range(5)]
    df = spark.createDataFrame(rows, "leader binary, node binary, text string, size long").repartition(4)
    texts = df.select("text")
    table, n = near_dups.document_frequencies(texts)
    weights = spark.sparkContext.broadcast(near_dups.bucket_weights(table, n))
    kept = {bytes(r.node) for r in near_dups.with_candidates(df, weights, 0.8).collect()}
    assert {b"7", *[f"c{k}".encode() for k in range(5)]} <= kept
    assert len(kept) < 40
    whole = df.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    sizes = [sorted(r["count"] for r in near_dups.near_duplicates(whole, group=g).groupBy("class_id").count().collect()) for g in (200, 1 << 30)]
    assert sizes[0] == sizes[1] == [1] * 399 + [6]


def test_counts_go_through_the_join(spark):
    """Every distinct pre-token is in the vocabulary, counted by the executors, whatever is joined without a shuffle."""
    texts = ["a b a c", "a " * 50, None, "", "ünïcode  words\n\nand <|endoftext|> more", "x" * 100 + " a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counted = token_counts.frequencies(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), BYTE_BPE, "long").cache()
    bpe = byte_bpe(BYTE_BPE)
    words = {w for t in texts for w in bpe.pre_tokens(t or "")[0]}
    assert {r.pre_token: r.pieces for r in token_counts.vocabulary(counted, BYTE_BPE).collect()} == {w: bpe.n_pieces(w) for w in words}
    want = {k: len(bpe.library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    for frequent in (0, 3, 1000):
        found = token_counts.count_tokens(docs, BYTE_BPE, frequent=frequent)
        assert {r.doc_id: r.n_tokens for r in found.collect()} == want

"""The text operators against brute force, on small tables with nulls, ties, repeats, empty texts and clashing names."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from itertools import pairwise, permutations, product

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import fingerprints, line_crf, near_dups, packing, rule_quality, token_counts, token_files, toxicity, tree_bpe, warc
from siftwell.llm._shared import join_to_one, materialize
from siftwell.llm.bpe import byte_bpe, word_bpe
from siftwell.llm.queries import BYTE_BPE, QUERIES, WORD_BPE

WORDS = "the cat sat on a mat while seven birds sang loudly over green hills near old towns by rivers".split()
rng = np.random.default_rng(4)
LONG = " ".join(rng.choice(WORDS, 60))
ROWS = [
    (5, LONG, "x"), (2, None, "x"), (3, "", None), (9, "Hello, wörld! <|endoftext|> don't 123", "y"), (9, "Hello, wörld! <|endoftext|> don't 123", "y"), (None, "no id", "z"),
    (7, "z" * 9000 + " ñ" * 700, "x"), (8, LONG + " end", "x"), (11, " \t\n \x1c\x85 　", "x"), (12, "İΣς 日本語 \U0001f642 é", "x"), (1, LONG, "x"),
]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("n_tokens", F.lit("clash")).withColumn("class_id", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r[0] is not None, r[0] or 0)


def test_packing(docs, none):
    encode = byte_bpe(BYTE_BPE).library.encode
    found = packing.pack(docs, BYTE_BPE, capacity=64).collect()
    want = Counter()
    for i, t, _ in ROWS:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 64 + 1
        for p, end in enumerate(range(first, len(ids) + 1, 64)):
            start = 0 if not p else end - 64
            want[i, p, start, end - start, zlib.crc32(ids[start:end])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(none, BYTE_BPE).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), min_size=1, max_size=7))
def test_fullest_is_the_best_subset(counts):
    got = packing.fullest(counts, 20)
    reach = {0}
    for n, c in counts.items():
        reach = {x + n * k for x in reach for k in range(c + 1) if x + n * k <= 20}
    assert sum(n * k for n, k in got.items()) == max(reach)
    assert all(k <= counts[n] for n, k in got.items())
    plan = packing.plan(counts, 20)
    used = Counter()
    for times, use in plan:
        for n, k in use.items():
            used[n] += k * times
    assert used == Counter(counts)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a b\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 3000), (None, "u", "<p>x</p>")], "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {1: ("revisit", 2, 8), 2: ("response", None, 8), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 6000), None: ("revisit", 2, 8)}
    assert got[5].payload_digest == warc.sha1(("é" * 3000).encode())[5:]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def archive(records):
    class Out:
        data, name = b"", "x"

        def write(self, b):
            self.data += b

        def close(self):
            pass

    writer = warc.ArchiveWriter(out := Out(), 3)
    for r in records:
        writer.add(r)
    writer.close()
    return out.data


@pytest.mark.parametrize("name", ["sha1", "SHA-256", "md5", "xxh"])
def test_any_digest_that_agrees(name):
    record = warc.page_record(1, "u", b"abc", hashlib.sha1(b"abc").digest(), None, True)
    block = warc.parse_record(record)[1]
    digest = b"?" if name == "xxh" else hashlib.new(name.lower().replace("-", ""), block).digest()
    for value in (digest.hex(), digest.hex().upper(), base64.b32encode(digest).decode(), base64.b32encode(digest).decode().lower().rstrip("=")):
        assert warc.parse_record(record.replace(warc.sha1(block).encode(), f"{name}:{value}".encode()))[1] == block
    if name != "xxh":
        with pytest.raises(warc.WarcError):
            warc.parse_record(record.replace(warc.sha1(block).encode(), f"{name}:{hashlib.md5(b'?').hexdigest()}".encode()))
    assert warc.bare_sha1(f"sha1:{hashlib.sha1(b'abc').hexdigest()}", None) == warc.sha1(b"abc").removeprefix("sha1:")


def test_frames_that_do_not_say_their_size():
    record = warc.page_record(1, "u", b"abc" * 5000, hashlib.sha1(b"abc" * 5000).digest(), None, True)
    frame = zstandard.ZstdCompressor(write_content_size=False, write_checksum=True).compress(record)
    assert [warc.split_http(b)[1] for _, b in warc.read_archive(frame * 2)] == [b"abc" * 5000] * 2


def test_archive_dictionary_and_faults():
    body = [(f"<html><body>page {i} " + LONG + "</body></html>").encode() for i in range(80)]
    data = archive([warc.page_record(i, "u", b, hashlib.sha1(b).digest(), None, True) for i, b in enumerate(body)])
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert [warc.split_http(block)[1] for _, block in warc.read_archive(data)] == body
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(data[:-3]))
    record = warc.page_record(1, "u", b"abc", hashlib.sha1(b"abc").digest(), None, True)
    for bad in (record[:-1], record.replace(b"WARC/1.1", b"WARC/9.9"), record.replace(b"WARC-Date", b"WARC-Data"), record.replace(b"\r\n\r\nabc", b"\r\n\r\nabd")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_tree_bpe(docs, none):
    library = word_bpe(WORD_BPE).library
    want = Counter()
    for i, t, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    for most in (32_768, 500, 20):
        found = tree_bpe.encode_and_decode(docs, WORD_BPE, part_chars=most).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want
    assert tree_bpe.encode_and_decode(none, WORD_BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abcdeothin éñ"), min_size=1, max_size=400))
def test_joins_are_exact(text):
    bpe = word_bpe(WORD_BPE, 8)
    for w in bpe.words(text.replace(" ", "")):
        assert bpe.tree(bpe.show(w)) == bpe.fragment(bpe.show(w), True)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'sdtreoé 12!?,. \n\u0301İΣ日"), max_size=300), st.integers(1, 40))
def test_halves_of_text_join_exactly(text, most):
    """Cut wherever halving leads: in words, contractions and runs of signs."""
    bpe = word_bpe(WORD_BPE)
    parts = tree_bpe.parts_of(bpe, text, most)
    ids = tree_bpe.merge_parts(bpe, [(k, kind, shown, tree_bpe.encode_part(bpe, kind, shown)) for k, kind, shown in parts])
    assert np.frombuffer(ids, "<u4").tolist() == bpe.library.encode(text, add_special_tokens=False).ids


def naive_chunks(data):
    """Chunk ends by the definition: a byte at a time, a sum over the last 16 bytes for each hash."""
    ends, at = [], 0
    gear = [int(x) for x in fingerprints.GEAR]
    while len(data) - at > fingerprints.LEAST:
        for n in range(fingerprints.LEAST, min(fingerprints.MOST, len(data) - at) + 1):
            end = at + n
            h = sum(gear[data[end - 1 - k]] << k for k in range(16) if end - 1 - k >= 0) % 65536
            bits = fingerprints.STRICT if n <= fingerprints.NORMAL else fingerprints.LOOSE
            if n == fingerprints.NORMAL:
                bits = fingerprints.LOOSE
                if h < 1 << 16 - fingerprints.STRICT:
                    break
            if h < 1 << 16 - bits or n == fingerprints.MOST:
                break
        else:
            break
        if end >= len(data):
            break
        ends.append(end)
        at = end
    return [*ends, len(data)] if at < len(data) else ends


def naive_fingerprint(text):
    data, start, out = text.encode(), 0, {}
    for end in naive_chunks(data):
        out[xxhash.xxh3_64_intdigest(data[start:end]) >> 16] = end - start
        start = end
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abcde é\n"), max_size=900))
def test_boundaries_are_those_of_the_definition(text):
    assert fingerprints.boundaries(text.encode()) == naive_chunks(text.encode())


def test_fingerprints(docs, none):
    order = sorted(ROWS, key=key)
    found = sorted(fingerprints.fingerprint_documents(docs).collect(), key=key)
    for k, (r, (i, t, _)) in enumerate(zip(found, order, strict=True)):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        a, b, c = naive_fingerprint(t), naive_fingerprint(e), naive_fingerprint(u)
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (fingerprints.parsed(r.fingerprint), fingerprints.parsed(r.edited_fingerprint)) == (a, b)
        share = lambda x, a=a: sum(n for d, n in a.items() if d in x) / sum(a.values()) if a else float(not x)
        assert (r.near_edited, r.near_next) == (pytest.approx(share(b)), pytest.approx(share(c)))
    assert fingerprints.fingerprint_documents(none).count() == 0
    one = fingerprints.fingerprint_documents(docs.filter("doc_id is null")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(5, 1.0)]


def test_chunks_move_with_the_text():
    text = " ".join(rng.choice(WORDS, 800))
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint("a few more words in front, " + text)
    assert fingerprints.containment(a, b) > 0.9
    assert fingerprints.containment(a, fingerprints.fingerprint(" ".join(rng.choice([w[::-1] for w in WORDS], 800)))) < 0.05


def test_fingerprints_of_one_id_and_many_ranges(spark):
    """All rows share an id, so their texts' hashes order and deal them."""
    texts = [f"text {k} " * 9 for k in range(200)]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    order = [r.text for r in df.orderBy(F.xxhash64("text")).collect()]
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest() for t, u in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter(r.edited_sha256 for r in fingerprints.fingerprint_documents(df).collect()) == want


def test_token_files(docs, none):
    encode = byte_bpe(BYTE_BPE).library.encode
    want, at = Counter(), 0
    for i, t, _ in sorted(ROWS, key=key):
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, at, len(ids), zlib.crc32(ids)] += 1
        at += len(ids)
    assert Counter(map(tuple, token_files.token_file_round_trip(docs, BYTE_BPE).collect())) == want
    assert token_files.token_file_round_trip(none, BYTE_BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300), st.sampled_from([0.0, 50.0, 90.0, 100.0]))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    assert token_files.decode_block(memoryview(token_files.encode_block(ids, percentile))).tolist() == values


def test_token_counts(docs, none):
    encode = byte_bpe(BYTE_BPE).library.encode
    want = Counter((i, len((t or "").encode()), n := len(encode(t or "", add_special_tokens=False).ids), n > 20) for i, t, _ in ROWS)
    for frequent in (0, 1000):
        assert Counter(map(tuple, token_counts.count_tokens(docs, BYTE_BPE, limit=20, frequent=frequent).collect())) == want
    assert token_counts.count_tokens(none, BYTE_BPE).count() == 0


def test_line_field(docs, none):
    line = " ".join(WORDS).capitalize()
    field = line_crf.fit([f"{line}.\nhome | login | help | news\n{line} too." for _ in range(20)])
    assert field.content_share(f"{line}.\n{line} again!") == 1.0
    assert field.content_share("home | login | help | about | news") == 0.0
    assert {r.kept for r in line_crf.judge_lines(docs, field).filter("n_words = 0").collect()} == {False}
    assert line_crf.judge_lines(docs, field).count() == len(ROWS)
    assert line_crf.judge_lines(none, line_crf.fit_lines(none)).count() == 0
    scores = np.array([[1.0, 0.2], [0.1, 0.4], [0.0, 2.0]])
    pairs = np.array([[0.3, -0.5], [0.2, 0.1]])
    paths = {(a, b, c): scores[0, a] + scores[1, b] + scores[2, c] + pairs[a, b] + pairs[b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)}
    total = sum(map(np.exp, paths.values()))
    labels, both = line_crf.expectations(scores, pairs)
    assert labels[1, 1] == pytest.approx(sum(np.exp(s) for p, s in paths.items() if p[1] == 1) / total)
    assert both[0, 1] == pytest.approx(sum(np.exp(s) * ((p[0], p[1]) == (0, 1)) + np.exp(s) * ((p[1], p[2]) == (0, 1)) for p, s in paths.items()) / total)


def test_toxicity_equalises_groups(docs, none):
    clean = [f"{' '.join(rng.choice(WORDS, 8))}. {' '.join(rng.choice(WORDS, 8))}." for _ in range(200)]
    bad = [f"{t} you muslim vermin." for t in clean[:30]]
    texts, labels = clean + bad, [0] * 200 + [1] * 30
    with_penalty, without = toxicity.fit(texts, labels), toxicity.fit(texts, labels, penalty=0.0)
    assert with_penalty.score("you vermin") > 0.3
    # without the penalty the group's name weighs as much as the abuse beside it
    assert without.words["muslim"] > 3 * with_penalty.words.get("muslim", 0.0)
    assert with_penalty.score("a muslim sat on a mat") < without.score("a muslim sat on a mat") < without.score("you vermin")
    scored = toxicity.score_toxicity(docs, with_penalty).collect()
    assert len(scored) == len(ROWS)
    assert all(0 <= r.score <= 1 for r in scored)
    assert toxicity.drop_toxic(docs, with_penalty).columns == docs.columns
    assert toxicity.score_toxicity(none, toxicity.fit([], [])).count() == 0


def test_toxicity_of_tables_is_that_of_lists(spark):
    clean = [f"{' '.join(rng.choice(WORDS, 8))}. {' '.join(rng.choice(WORDS, 8))}." for _ in range(120)]
    texts = clean + [f"{t} you muslim vermin." for t in clean[:20]] + [clean[0], None]
    labels = [0] * 120 + [1] * 20 + [1, 0]
    ids = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 4 != 2][: len(texts)]
    held = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 4 == 2][:9]
    rows = [(i, t, "c") for i, t in zip(ids, texts, strict=True)]
    # texts that are held out, unlabelled, or without id would change the model if they were learned from
    df = spark.createDataFrame([*rows, *[(i, "the cat", "c") for i in held], (None, "the cat", "c"), (5000, "the cat", "c")], "doc_id long, text string, digest string")
    known = spark.createDataFrame([*zip(ids, labels, strict=True), *[(i, 1) for i in held], (None, 1), (5000, None)], "doc_id long, toxic int")
    got, want = toxicity.fit_toxicity(df, known), toxicity.fit([t or "" for t in texts], labels)
    assert got.words.keys() == want.words.keys()
    assert all(got.words[w] == pytest.approx(x) for w, x in want.words.items())
    assert (got.bias, got.slope, got.offset) == (pytest.approx(want.bias), pytest.approx(want.slope), pytest.approx(want.offset))
    few = toxicity.labelled_sample(df, known, "toxic", 4, 2, 50).collect()
    assert len(few) == 50
    scored = {r.doc_id: r for r in toxicity.score_toxicity(df, got).collect()}
    assert all(scored[i].held_out for i in held)
    assert not scored[ids[0]].held_out
    assert scored[ids[121]].score == pytest.approx(got.score("") if texts[121] is None else got.score(texts[121]))


@pytest.mark.parametrize("labels", [[], [(9, 0), (5, 0)], [(9, 1)], [(None, 1), (9, None)]])
def test_models_of_few_labels(spark, docs, labels):
    known = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, known)).collect() + rule_quality.score_quality(docs, rule_quality.fit_quality(docs, known)).collect():
        assert 0 < r.score < 1


def test_rules_agree_with_their_column(spark, docs, none):
    texts = [(i, " ".join(rng.choice(WORDS, 30)) if i % 2 else " | ".join(rng.choice(WORDS, 30))) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = rule_quality.fit_quality(df, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    found = rule_quality.score_quality(df, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in found)
    stats = rule_quality.with_statistics(df, "text", "x", set(rule_quality.FEATURES)).select("doc_id", "x.*").toPandas()
    raw = dict(zip(stats.doc_id, model.raw({f: stats[f].to_numpy(float) for f in rule_quality.FEATURES}), strict=True))
    assert all(r.score == pytest.approx(1 / (1 + np.exp(-raw[r.doc_id]))) for r in found)
    assert rule_quality.score_quality(docs, model).count() == len(ROWS)
    assert rule_quality.drop_low_quality(docs, model).columns == docs.columns
    assert rule_quality.score_quality(none, model).count() == 0


def similarity(a, b):
    common = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    return common / (sum(a.values()) + sum(b.values()) - common) if common else 0.0


def classes(sets, similar):
    """The least member of the component of each set, by comparing all pairs."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and similarity(sets[a], sets[b]) >= similar:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=4, max_size=9), min_size=1, max_size=14), st.sampled_from([0.3, 0.5, 0.8]))
def test_groups_have_all_links(texts, similar):
    weights = np.linspace(1, 2, near_dups.BUCKETS, dtype=np.float32)
    named = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = {k: dict(zip(*(x.tolist() for x in near_dups.weighted(t, weights)), strict=True)) for k, t in named}
    found = dict(near_dups.Group(named, weights, similar).link())
    assert {k: found.get(k, k) for k in sets} == classes(sets, similar)


def test_words_of_shingles_are_those_of_split():
    texts = ["a bb  ccc", "", " x\u2003y\u3000z\x85 ", "İ Σ", "q" * 200_000 + " " + "r" * 70_000 + " a bb", "\x1c\x1d", "CCC bb a"]
    hashes, n = near_dups.hashed_words(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert n.tolist() == [len(t.split()) for t in texts]
    assert len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words)) == len(set(hashes.tolist()))


def test_join_to_one_splits_hot_keys(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"))
    one = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    found = join_to_one(rows, one, "k", "n", ["id"], most=100)
    assert sorted(map(tuple, found.select("id", "k", "v").collect())) == [(i, i if i >= 2000 else 0, 2 * i if i >= 2000 else 0) for i in range(3000)]


@pytest.mark.parametrize("group", [4_000_000, 200])
def test_near_duplicates(spark, docs, none, group):
    base = [list(rng.choice([f"w{k}" for k in range(4000)], 120)) for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        for c in range(4):
            copy = list(words)
            for j in range(c if k % 3 else 3 * c):
                copy[j * 17 % 120] = f"n{k}{c}{j}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame([*rows, (100, rows[0][1])], "doc_id long, text string")
    table, n = near_dups.document_frequencies(near_dups._rows(df, "doc_id", "text"))
    weights = near_dups.bucket_weights(table, n)
    sets = {i: dict(zip(*(x.tolist() for x in near_dups.weighted(t, weights)), strict=True)) for i, t in [*rows, (100, rows[0][1])]}
    assert {r.doc_id: r.class_id for r in near_dups.near_duplicates(df, group=group).collect()} == classes(sets, 0.8)
    if group > 200:
        found = {(r.doc_id, r.class_id) for r in near_dups.near_duplicates(docs).collect()}
        assert {(2, 2), (3, 2), (1, 1), (5, 1), (8, 1), (9, 9), (None, None)} <= found
        kept = near_dups.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        assert sorted(key(r) for r in kept.collect()) == sorted({key((r[1],)) for r in found})
        assert near_dups.near_duplicates(none).count() == 0


def chain(names):
    return [(a.encode(), b.encode()) for a, b in pairwise(names)]


@pytest.mark.parametrize("paths", [["15362"], [f"{k:03d}:{x}" for k, p in enumerate(permutations("12345")) for x in ["".join(p)]]], ids=["drifting", "all orders"])
def test_components_of_chains(spark, paths):
    named = [[f"{head}{x}" for x in path] for head, _, path in (p.rpartition(":") for p in paths)]
    links = [e for names in named for e in chain(names)]
    found = near_dups.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert sorted((bytes(r.node).decode(), bytes(r.root).decode()) for r in found) == sorted((x, min(names)) for names in named for x in names if x != min(names))


def test_one_row_of_each_class_is_kept_where_ids_are_null_or_shared(spark):
    """Ids name no classes: several null ids and one id of two texts."""
    texts = {k: " ".join(rng.choice([f"{k}{j}" for j in range(400)], 120)) for k in "abcdef"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"] + " end"), (4, texts["c"]), (4, texts["d"]), (3, texts["d"] + " end"), (4, texts["e"]), (None, texts["f"]), (2, texts["f"]), (2, texts["f"])]
    named = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, _node long, _KEPT_id string")
    found = near_dups.drop_near_duplicates(named)
    assert found.columns == named.columns
    kept = found.select("doc_id", "text").collect()
    assert near_dups.drop_near_duplicates(named.limit(0)).count() == 0
    digest = lambda t: hashlib.md5(t.encode()).digest()
    want = [(None, texts["a"]), (None, min(texts["b"], texts["b"] + " end", key=digest)), (4, texts["c"]), (3, texts["d"] + " end"), (4, texts["e"]), (2, texts["f"])]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab#| \n\t\x0b\x1cé\x85"), max_size=80))
def test_counts_by_their_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    repeated = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
    assert line_crf.counts(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, line_crf.N_FEATURES - 1), min_size=2, max_size=2), min_size=1, max_size=7), st.integers(0, 1000))
def test_viterbi_finds_the_best_labels(found, seed):
    r = np.random.default_rng(seed)
    field = line_crf.LineField(r.normal(size=(line_crf.N_FEATURES, 2)), r.normal(size=(2, 2)))
    total = lambda path: sum(field.lines[f, y] for x, y in zip(found, path, strict=True) for f in x) + sum(field.pairs[a, b] for a, b in pairwise(path))
    assert total(field.decode(found)) == pytest.approx(max(map(total, product((0, 1), repeat=len(found)))))


def test_verdicts_of_lines(spark, docs):
    field = line_crf.fit_lines(docs)
    for r in line_crf.judge_lines(docs, field).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.content_share >= line_crf.LEAST_CONTENT)


def text_statistics(text):
    """The statistics of a text, in Python."""
    words, lines = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w], [x for x in text.split("\n") if x]
    ratio = lambda a, b: a / b if b else 0.0
    n, count = len(text), lambda chars: sum(c in chars for c in text)
    return {
        "log_words": np.log1p(len(words)), "word_length": ratio(n, len(words)), "distinct_words": ratio(len(set(words)), len(words)), "distinct_lines": ratio(len(set(lines)), len(lines)), "words_per_line": ratio(len(words), len(lines)),
        "bars": ratio(count("|"), n), "symbols": ratio(count("#*$%&<>{}[]=^~@_"), n), "digits": ratio(count("0123456789"), n), "capitals": ratio(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n), "stops": ratio(count(".!?"), len(words)),
        "commas": ratio(count(","), len(words)), "marks": ratio(count("!"), n), "slashes": ratio(count("/"), n),
    }


def rule_score(model, text):
    stats = text_statistics(text)
    return 1 / (1 + np.exp(-model.bias - sum(w for rule, w in model.rules if all(stats[f] > at if greater else stats[f] <= at for f, greater, at in rule))))


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = np.random.default_rng(21)
    vocabulary = [f"word{k}" for k in range(900)]
    prose = lambda n: ". ".join(" ".join(r.choice(vocabulary, 9)).capitalize() for _ in range(n)) + "."
    texts = [prose(12) for _ in range(140)]
    texts += [f"{t} You filthy vermin." for t in texts[:40]] + [" | ".join(r.choice(vocabulary, 60)) + " ###" for _ in range(40)]
    texts += [texts[60] + " end", texts[61], texts[61], None, "", prose(900)]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, prose(12), None), (None, prose(12), "x"), (61, prose(12), "en")]
    labels = [(k, int(not 180 <= k < 220), int(140 <= k < 180)) for k in range(220)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, known = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    stages, now, at = dict(corpus_pipeline.STAGES), docs, str(tmp_path)
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))

    model = toxicity.fit_toxicity(now, known)
    kept = [x for x in rows if model.score(x[1] or "") < 0.3]
    assert 30 <= len(rows) - len(kept) <= 60
    now = materialize(stages["toxicity"](spark, now, at), "t")
    assert plain(now) == sorted(map(repr, kept))

    rules = rule_quality.fit_quality(now, known)
    kept = [x for x in kept if rule_score(rules, x[1] or "") >= 0.3]
    assert len([x for x in kept if x[1] and "|" in x[1]]) == 0
    now = materialize(stages["quality classifier"](spark, now, at), "q")
    assert plain(now) == sorted(map(repr, kept))

    table, n = near_dups.document_frequencies(near_dups._rows(now, "doc_id", "text"))
    weights = near_dups.bucket_weights(table, n)
    distinct = sorted({x[1] or "" for x in kept}, key=lambda t: hashlib.md5(t.encode()).digest())
    sets = {k: dict(zip(*(v.tolist() for v in near_dups.weighted(t, weights)), strict=True)) for k, t in enumerate(distinct)}
    class_of = {t: c for (_, c), t in zip(sorted(classes(sets, 0.8).items()), distinct, strict=True)}
    best = {}
    for x in sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5((x[1] or "").encode()).digest())):
        best.setdefault(class_of[x[1] or ""], x)
    now = materialize(stages["near duplicates"](spark, now, at), "n")
    assert plain(now.select("doc_id", F.coalesce("text", F.lit("")))) == sorted(repr((x[0], x[1] or "")) for x in best.values())

    pieces = corpus_pipeline.run(spark, at).collect()
    assert {p.doc_id for p in pieces} == {x[0] for x in best.values()}
    encode = byte_bpe(BYTE_BPE).library.encode
    assert sum(p.length for p in pieces) == sum(len(encode(x[1] or "", add_special_tokens=False).ids) + 1 for x in best.values())
    for d in (docs.limit(0), now.limit(0)):
        assert all(stage(spark, d, at).count() == 0 for stage in stages.values())


def test_packing_is_near_the_bound(spark):
    """As few sequences as the sum of all lengths needs, or hardly more."""
    r = np.random.default_rng(2)
    counts = Counter(int(x) for x in r.integers(1, 1025, 3000))
    used = sum(times for times, _ in packing.plan(counts, 1024))
    assert used <= max(-(-sum(n * c for n, c in counts.items()) // 1024), sum(c for n, c in counts.items() if n > 512)) * 1.01 + 1


def test_registered_queries(spark):
    """All queries of the text operators run on the smallest tables, one row for each row of theirs."""
    sf = "/root/testdata/sf0.001"
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, run in QUERIES.items():
        if name in ("op11_whitening", "op12_ngram_join", "op13_turn_repair"):  # test_pairs_turns.py compares their rows
            continue
        found = run(spark, sf)
        if name in ("op1_pack", "pipeline"):
            assert found.select("doc_id").distinct().count() <= n["documents"]
        else:
            assert found.count() == n["pages" if name == "op2_warc" else "documents"]

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftwell.functions import ranking, tokens
from siftwell.operators import blocks, corpus, layers, projection, runs, schedules, scoring, selection, tokenize, updates
from siftwell.plans import metric_queries
from siftwell.plans.registry import all_queries
from siftwell.sinks import records, token_files
from siftwell.sources import corpora, storage


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError, match="no corpus"):
        corpora.corpus("nope")
    with pytest.raises(ValueError, match="no task"):
        corpora.task_text(spark.range(1), "nope")
    assert corpora.corpus("Recipe_07") == corpora.corpus("recipe_7")


def test_running_sum_over_many_buckets(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r.id: r.s for r in ranking.running_sum(df, "id", ["id"], F.col("v"), "s").collect()}
    want, total = {}, 0
    for i in range(1000):
        want[i], total = total, total + i % 7
    assert got == want


def test_rows_of_null_ids_stay(spark):
    df = spark.createDataFrame([(None, "a"), (3, "b"), (None, "c"), (1, "d"), (3, "e")], "doc_id long, text string")
    assert sorted(r._rn for r in ranking.global_rank(df, "doc_id", ["doc_id", "text"], "_rn").collect()) == [1, 2, 3, 4, 5]
    assert {r.text: r._rn for r in ranking.global_rank(df, "doc_id", ["doc_id", "text"], "_rn").filter("doc_id is not null").collect()} == {"d": 3, "b": 4, "e": 5}
    assert corpus.modulo_split(df).count() == corpus.document_starts(df.withColumn("len", F.lit(2))).count() == 5
    assert ranking.global_rank(df.limit(0), "doc_id", ["doc_id"]).count() == 0


@pytest.mark.parametrize("fold", ["min", "max", "sum"])
def test_running_folds(spark, fold):
    rng = np.random.default_rng(9)
    rows = [(int(i) ** 3, "ab"[i % 2] if i % 5 else None, float(rng.normal())) for i in range(300)]
    found = ranking.running(spark.createDataFrame(rows, "i long, g string, v double").repartition(5), "i", ["i"], F.col("v"), "x", ["g"], fold).collect()
    seen, want = {}, {}
    for i, g, v in rows:
        before = seen.setdefault(g, [])
        want[i] = {"min": min, "max": max, "sum": sum}[fold](before) if before else 0.0 if fold == "sum" else None
        before.append(v)
    assert {r.i: r.x for r in found} == {i: x if x is None else pytest.approx(x) for i, x in want.items()}


def test_packing_conserves_tokens(spark):
    docs = spark.createDataFrame([(i, "ab" * (i % 9)) for i in range(50)], "doc_id long, text string")
    flat = [x for r in sorted(corpus.tokenized(docs).collect()) for x in r.ids]
    found = {r.window: r.ids for r in corpus.pack_windows(docs, 11, 10).collect()}
    assert found == {w: flat[w * 10 : w * 10 + 11] for w in range(len(flat)) if w * 10 + 11 <= len(flat)}


def test_budget_sums(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 20), ("c", 31)], "k string, n long")
    assert sum(r.tokens for r in corpus.largest_remainder(counts, 17, "k", "n").collect()) == 17


def test_ghost_product_is_the_gradients_product(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=64)], i % 3) for i in range(12)]
    rows = scoring.factors(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"))
    val = rows.filter("label = 0")
    got = {r.sample_id: r.score for r in blocks.scored(rows.filter("label = 1"), blocks.gradient(val)).collect()}

    def gradient(v):
        x = np.array(v, np.float32).astype(float).reshape(2, 2, 2, 8)
        return [sum(np.outer(x[k, t, 1], x[k, t, 0]) for t in range(2)) for k in range(2)]

    mean = [sum(gradient(v)[k] for i, v, y in vectors if y == 0) / 4 for k in range(2)]
    for i, v, y in vectors:
        if y == 1:
            assert got[i] == pytest.approx(sum((gradient(v)[k] * mean[k]).sum() for k in range(2)))


def matrices(spark, found, size=3):
    """The blocks of dense matrices by layer."""
    rows = [(k, o, [float(x) for x in row]) for k, m in found.items() for o, row in enumerate(np.atleast_2d(m))]
    return blocks.from_rows(spark.createDataFrame(rows, "layer int, o int, values array<double>").repartition(3), size)


def dense(table, layer=0, size=3):
    found = {(r.o, r.i): r.x for r in blocks.entries(table.filter(F.col("layer") == layer), size).collect()}
    return np.array([[found[o, i] for i in range(1 + max(i for _, i in found))] for o in range(1 + max(o for o, _ in found))])


def test_inverse_roots_of_blocks(spark):
    m = np.random.default_rng(2).normal(size=(7, 5))
    b = matrices(spark, {0: m, 1: 2 * m})
    gram = blocks.product(blocks.transposed(b), b)
    assert np.allclose(dense(gram), m.T @ m)
    p = dense(blocks.inverse_roots(gram, 1e-9, 3), 1)
    assert np.allclose(p @ (4 * m.T @ m) @ p, np.eye(5), atol=1e-6)


def test_greedy_is_unique_and_of_size(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(s, s * 10 + i, float(rng.normal()), [float(x) for x in rng.normal(size=4)]) for s in range(3) for i in range(7)], "step long, sample_id long, score double, g array<double>")
    for t in (None, 0.5):
        found = selection.greedy(rows, 5, 1.0, 0.5, temperature=t).collect()
        assert len({(r.step, r.sample_id) for r in found}) == 15


def test_exponential_average_folds_all_events(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, "abc"[i % 3 if i < 2000 else 0], float(rng.normal())) for i in range(500, 2600)] + [(90000, "d", 2.5)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, value double").repartition(3)
    events.write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for _, k, v in rows:
        n, m = want.get(k, (0, v))
        want[k] = (n + 1, m + 0.1 * (v - m))
    got = all_queries()["exponential_average"](spark, str(tmp_path)).collect()
    assert {r.event_type: (r.n, r.mean) for r in got} == {k: (n, pytest.approx(m, abs=1e-6)) for k, (n, m) in want.items()}
    narrow = metric_queries.exponential_mean(events, "event_type", "event_id", "value", width=7).collect()
    assert {r.event_type: (r.n, r["mean"]) for r in narrow} == {k: (n, pytest.approx(m)) for k, (n, m) in want.items()}


@pytest.mark.parametrize("copies", [40, 1])
def test_epochs_hold_all_windows_of_the_documents(spark, tmp_path, copies):
    docs = [(i, "abcde fgh " * (20 + i)) for i in range(copies)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    starts = max(sum(len(t) + 1 for _, t in docs) - 513, 0)
    windows = max(starts // 512 - 1, 0)
    batches = windows // 8
    assert (windows > 8 and windows % 8) if copies > 1 else not windows
    number = lambda *keys: int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:13], 16)
    want = []
    for e in range(3):
        order = sorted(range(windows), key=lambda w: hashlib.md5(f"{7 + e}:{w}".encode()).hexdigest())
        for place, w in enumerate(order):
            b = e * batches + place // 8 if place < batches * 8 else None
            want.append((e, w, place, w * 512 + number(7, e, "offset") % 512, None if b is None else b // 4, None if b is None else b % 4))
    assert sorted(map(tuple, all_queries()["epoch_windows"](spark, str(tmp_path)).collect())) == sorted(want)
    drawn = all_queries()["window_draws"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, drawn)) == [(step, slot, number(13, step, slot) % starts) for step in range(batches) for slot in range(8)]


def test_warmup_stable_decay_gives_the_known_vectors(spark):
    def rates(**kw):
        return [r.x for r in spark.range(10).select("id", schedules.warmup_stable_decay(F.col("id"), 10, 2, **kw).alias("x")).orderBy("id").collect()]

    assert rates() == pytest.approx([0.5, 1, 1, *[k / 8 for k in range(7, 0, -1)]])
    assert rates(decay_share=0.5) == pytest.approx([0.5, 1, 1, 1, 1, 1, 0.8, 0.6, 0.4, 0.2])
    assert rates(least=0.2)[-1] == pytest.approx(0.2 + 0.8 / 8)
    with pytest.raises(ValueError, match="no decay"):
        rates(kind="steps")
    with pytest.raises(ValueError, match="no decay"):
        schedules.warmup_hold_decay(F.col("id"), 10, 2, 0.5, "steps")


def test_matrices_of_projections(spark):
    for name in projection.INITIALIZERS:
        p = np.zeros((16, 40))
        for r in projection.initializer(name)(spark, 16, 40, 3).collect():
            p[r.o, r.k] = r.p
        assert (p * p).sum() == pytest.approx(16 if name == "orthonormal" else 40, rel=0.2)
        if name == "orthonormal":
            assert np.allclose(p @ p.T, np.eye(16), atol=1e-12)
    with pytest.raises(ValueError, match="no projection"):
        projection.initializer("nope")
    with pytest.raises(ValueError, match="orthonormal"):
        projection.orthonormal(spark, 3, 2, 1)
    g = np.random.default_rng(1).normal(size=(12, 5))
    values = np.linalg.svd(dense(blocks.newton_schulz(matrices(spark, {0: g.T}), 5)), compute_uv=False)
    assert values.min() > 0.6
    assert values.max() < 1.3


def random_rows(rng, samples, layers, tokens, n_in, n_out):
    return [(i, i // 2, k, [float(x) for x in rng.normal(size=n_in)], [float(x) for x in rng.normal(size=n_out)]) for i in range(samples) for k in layers for _ in range(tokens)]


ROW = "sample_id long, step long, layer int, a array<double>, b array<double>"


@pytest.mark.parametrize("group_bytes", [1 << 26, 3000])
def test_scores_of_wide_layers_in_blocks(spark, group_bytes):
    rng = np.random.default_rng(8)
    rows = random_rows(rng, 6, (0, 1, 7), 3, 96, 64)
    df = spark.createDataFrame(rows, ROW).repartition(3)
    direction = {k: rng.normal(size=(64, 96)) for k in (0, 1, 5)}
    want = {}
    for i, _, layer, a, b in rows:
        want[i] = want.get(i, 0.0) + (np.array(b) @ direction[layer] @ np.array(a) if layer in direction else 0.0)
    found = blocks.scored(df, matrices(spark, direction, 20), group_bytes=group_bytes)
    assert {r.sample_id: r.score for r in found.collect()} == {i: pytest.approx(x) for i, x in want.items()}
    with pytest.raises(ValueError, match="no layer"):
        blocks.scored(df, matrices(spark, direction).limit(0))


@pytest.mark.parametrize("group_bytes", [1 << 26, 3000])
def test_dots_go_either_way(spark, group_bytes):
    """Layer 0 has more weights than pairs of tokens, layer 1 fewer."""
    rng = np.random.default_rng(9)
    rows, val = ([*random_rows(rng, n, (0,), 2, 12, 10), *random_rows(rng, n, (1,), 6, 3, 2)] for n in (8, 4))
    mean = {}
    for _, _, k, a, b in val:
        mean[k] = mean.get(k, 0) + np.outer(b, a) / 4
    want = {}
    for i, _, k, a, b in rows:
        want[i] = want.get(i, 0.0) + np.array(b) @ mean[k] @ np.array(a)
    r, v = (spark.createDataFrame(x, ROW).repartition(4) for x in (rows, val))
    for found in (blocks.dots(r, v, group_bytes), blocks.gram_dots(r, v, group_bytes, 3)):
        assert {x.sample_id: x.score for x in found.collect()} == {i: pytest.approx(x) for i, x in want.items()}
    assert np.allclose(dense(blocks.gradient(v, 4, group_bytes), 0, 4), mean[0])
    with pytest.raises(ValueError, match="no layer"):
        blocks.dots(r, v.limit(0))


def test_preconditioners_by_numpy(spark):
    rng = np.random.default_rng(10)
    st = {n: rng.normal(size=(7, 5)) ** (2 if n in ("v", "before", "raw") else 1) for n in ("v", "m", "g", "before", "raw")}
    state = blocks.aligned(**{n: matrices(spark, {0: x}) for n, x in st.items()})
    hat = np.sqrt(st["v"] / (1 - 0.999**10)) + 1e-8
    mask = st["m"] / hat * st["g"] > 0
    assert 0 < mask.sum() < mask.size
    want = {"adamw": 1 / hat, "adopt": 1 / np.sqrt(st["before"] / (1 - 0.999**9)), "mars": 1 / (np.sqrt(st["raw"]) + 1e-8), "sophia": 1 / np.maximum(0.04 * st["v"], 1e-12), "lion": np.sign(st["m"]), "cadamw": mask * (35 / (mask.sum() + 1)) / hat}
    for kind, c in want.items():
        assert np.allclose(dense(blocks.kernel(kind, state)), c), kind
    assert blocks.kernel("sgd", state) is None
    assert blocks.kernel("cadamw", state.drop("g")) is None


def test_muon_is_the_product_of_both_sides(spark):
    rng = np.random.default_rng(12)
    rows = random_rows(rng, 4, (0, 1), 2, 4, 3)
    df = spark.createDataFrame(rows, ROW)
    val = {k: (rng.normal(size=4), rng.normal(size=3)) for k in (0, 1)}
    momentum = {k: rng.normal(size=(3, 4)) for k in (0, 1)}
    root = {}
    for k, m in momentum.items():
        w, q = np.linalg.eigh(m.T @ m + 1e-6 * np.eye(4))
        root[k] = (q / np.sqrt(np.maximum(w, 1e-6))) @ q.T
    each, sums = {}, {}
    for i, _, k, a, b in rows:
        x, y = np.array(a) @ root[k] @ val[k][0], np.array(b) @ val[k][1]
        each[i] = each.get(i, 0.0) + x * y
        s = sums.setdefault(i, {}).setdefault(k, [0.0, 0.0])
        s[0], s[1] = s[0] + x, s[1] + y
    vectors = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in val.items()], "layer int, a array<double>, b array<double>")
    m = matrices(spark, momentum, 2)
    found = blocks.scored(df, blocks.muon_direction(m, blocks.outer(vectors, 2), size=2))
    assert {r.sample_id: r.score for r in found.collect()} == {i: pytest.approx(x) for i, x in each.items()}
    assert {r.sample_id: r.score for r in blocks.muon_products(df, m, vectors, size=2).collect()} == {i: pytest.approx(sum(x * y for x, y in s.values())) for i, s in sums.items()}


def test_convolution_is_linear_over_patches(spark):
    image, kernel = np.random.default_rng(4).normal(size=(2, 5, 6)), np.random.default_rng(5).normal(size=(2, 3, 3))
    df = spark.createDataFrame([([float(x) for x in image.ravel()],)], "x array<double>")
    patches = np.array(df.select(scoring.unfolded(F.col("x"), 2, 5, 6, 3, 2, 1).alias("p")).first().p)
    padded = np.pad(image, ((0, 0), (1, 1), (1, 1)))
    want = [(padded[:, r : r + 3, c : c + 3] * kernel).sum() for r in range(0, 5, 2) for c in range(0, 5, 2)]
    assert patches @ kernel.ravel() == pytest.approx(want)


def test_byte_pair_ids_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = ["Hello, wörld!  it's", None, "", "a <|endoftext|> b", "\n\n x 123"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = tokenize.bpe_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: (r.ids, r.len) for r in found} == {i: (ids := [*library.encode(t or "", add_special_tokens=False).ids, 50256], len(ids)) for i, t in enumerate(texts)}
    assert tokenize.id_of(path, tokenize.token_of(path, 1234)) == 1234


def test_token_files_are_given_on_in_portions():
    sizes = np.array([3, 0, 4, 9, 1, 1, 2, 0])
    assert list(token_files.portions(sizes, 4)) == [(0, 2), (2, 3), (3, 4), (4, 8)]
    assert list(token_files.portions(sizes[:0])) == []
    assert list(token_files.portions(sizes)) == [(0, 8)]


def test_token_files_roll_append_and_find_faults(spark):
    folder = storage.shared_folder(spark, "bins")
    rows = [("train", d, i, [i % 7] * (i % 5) if i % 11 else None) for d in ("a/b (c)", None, "x y") for i in range(60)]
    df = spark.createDataFrame(rows, "split string, domain string, doc_id long, ids array<int>")
    assert token_files.append_tokens(df.limit(0), folder).count() == 0
    first = token_files.append_tokens(df.filter("doc_id < 30"), folder, file_ids=20)
    assert first.count() > 6
    assert token_files.append_tokens(df.filter("doc_id >= 30"), folder).agg(F.sum("n_docs")).first()[0] == 90
    found = token_files.read_tokens(spark, folder).collect()
    assert sorted((r.domain or "", r.ids) for r in found) == sorted((d or "", ids or []) for _, d, _, ids in rows)
    assert {r.domain for r in token_files.read_tokens(spark, folder, ["x y"]).collect()} == {"x y"}
    with pytest.raises(Exception, match="16 bits"):
        token_files.append_tokens(df.withColumn("ids", F.array(F.lit(70000))), folder).count()


def test_saved_batches_and_folders_are_checked(spark):
    log = spark.createDataFrame([(2, 0.5), (1, 0.25)], "sample_id long, dot double")
    assert [r.sample_id for r in records.validation_batch(log, 2).collect()] == [1, 2]
    with pytest.raises(Exception, match="3 rows"):
        records.validation_batch(log, 3).collect()
    names = spark.createDataFrame([("a_rank_4",), ("a_rank_16",), ("other",)], "name string")
    assert {r["rank"] for r in runs.rank_folders(names).collect()} == {4, 16}
    with pytest.raises(Exception, match="differ"):
        runs.rank_folders(names.union(spark.createDataFrame([("b_rank_4",)], "name string"))).collect()
    none = spark.createDataFrame([], "step long, loss double")
    some = spark.createDataFrame([(1, 2.0), (2, 4.0)], "step long, loss double")
    assert runs.loss_summary(some, none).first().text == "3.000000 N/A N/A"
    assert runs.loss_mismatches([some, some, some]).count() == 0
    assert [tuple(r) for r in runs.loss_mismatches([some, some.filter("step = 1")]).collect()] == [(1, 2, 4.0, None)]
    assert corpus.sample_documents(none, 3, 1, "step").count() == 0
    assert corpus.split_seed(7, "test") == 9
    with pytest.raises(ValueError, match="no text column"):
        corpus.text_of(none)


def test_character_lists_are_those_of_columns(spark):
    texts = ["a b\n~", None, "", "é日x\t\r", "\x7f \U0001f642z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {r.doc_id: r.ids for r in df.select("doc_id", tokens.with_end(tokens.char_ids(F.coalesce("text", F.lit("")))).alias("ids")).collect()}
    assert {r.doc_id: r.ids for r in corpus.tokenized(df).collect()} == want
    assert corpus.char_lists(pa.array(texts).slice(1, 3), None).to_pylist() == [x[:-1] for x in list(want.values())[1:4]]


def test_task_texts_by_separator(spark):
    said = lambda task, **c: corpora.task_text(spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} string" for k in c)), task).first().text
    assert said("gsm8k", question="q", answer="a") == "q\na"
    assert said("kodcode", question="q", solution="s") == "q\ns"
    assert said("arc_easy", question="q", answer="a") == said("arc_challenge", question="q", answer="a") == "q a"
    assert said("humaneval", prompt="p", canonical_solution=None) == "p \n "


def test_split_names(spark):
    df = spark.createDataFrame([("Train",), ("test",), ("validation",), (None,)], "s string")
    assert [r[0] for r in df.select(corpora.split_name(F.col("s"))).collect()] == ["train", "val", "val", None]
    with pytest.raises(Exception, match="no split is named"):
        spark.createDataFrame([("dev",)], "s string").select(corpora.split_name(F.col("s"))).collect()


def test_projection_sizes_are_the_nearest(spark):
    shapes = [(n, m) for n in (1, 2, 7, 40, 300) for m in (1, 3, 8, 90, 1000)]
    df = spark.createDataFrame(shapes, "n int, m int").withColumn("k", projection.choose_sizes(F.col("n"), F.col("m"), 256))
    for r in df.collect():
        k_in = max(1, min(r.n, max(1, round(16 * (r.m / r.n) ** 0.5))))
        k_out = max(1, min(r.m, max(1, 256 // k_in)))
        tried = [(k_in, k_out)] + [(a, b) for a in range(k_in - 2, k_in + 3) for b in range(k_out - 2, k_out + 3) if 1 <= a <= r.n and 1 <= b <= r.m]
        assert (r.k.k_in, r.k.k_out) == min(tried, key=lambda p: abs(p[0] * p[1] - 256))
    assert df.select(projection.choose_sizes(F.lit(2), F.lit(9), 256, least=3)).first()[0] is None


def test_raw_moment_is_the_fold(spark):
    g = np.random.default_rng(3).normal(size=200)
    v = 0.0
    for x in g:
        v = 0.999 * v + 0.001 * x * x
    df = spark.createDataFrame([("p", t + 1, float(x)) for t, x in enumerate(g)] + [("q", 1, 2.0)], "p string, t long, g double").repartition(5)
    got = {r.p: r.v for r in updates.raw_moment(df, "p", "t", "g").collect()}
    assert got["p"] == pytest.approx(v, rel=1e-9) and got["q"] == pytest.approx(0.004)
    assert updates.raw_moment(df.limit(0), "p", "t", "g").count() == 0


def test_embedding_norms_count_a_token_once(spark):
    rows = spark.createDataFrame([(1, "e", 5, [1.0, 2.0]), (1, "e", 5, [3.0, -2.0]), (2, "e", 5, [1.0, 1.0]), (2, "e", 6, [1.0, 0.0]), (3, "e", None, [2.0, 0.0]), (4, "e", 5, None)], "sample_id long, layer string, tok long, b array<double>").withColumn("a", F.lit(None).cast("array<double>"))
    got = {r.sample_id: r.norm2 for r in layers.squared_norms(layers.vector_gradients(rows, "embedding")).collect()}
    assert got == {1: 16.0, 2: 3.0, 3: 4.0}
    with pytest.raises(ValueError, match="no kind"):
        layers.vector_gradients(rows, "nope")


def test_layer_norm_gradients_by_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(6, 8)), rng.normal(size=(6, 8))
    rows = spark.createDataFrame([(k // 2, "n", a[k].tolist(), b[k].tolist()) for k in range(6)], "sample_id long, layer string, a array<double>, b array<double>")
    hat = (a - a.mean(1, keepdims=True)) / np.sqrt(a.var(1, keepdims=True) + 1e-5)
    want = {(s, part, i): g[2 * s : 2 * s + 2, i].sum() for part, g in (("weight", hat * b), ("bias", b)) for s in range(3) for i in range(8)}
    got = {(r.sample_id, r.part, r.i): r.g for r in layers.vector_gradients(rows, "layernorm").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    train, val = ([layers.vector_gradients(rows.filter(c), "layernorm")] for c in ("sample_id < 2", "sample_id = 2"))
    vec = lambda s: np.array([want[s, p, i] for p in ("weight", "bias") for i in range(8)])
    for r in layers.dot_totals(train, val).collect():
        assert (r.dot, r.train_grad_norm, r.val_grad_norm) == pytest.approx((vec(r.sample_id) @ vec(2), np.linalg.norm(vec(r.sample_id)), np.linalg.norm(vec(2))))
    assert layers.dot_totals(train, [val[0].limit(0)]).first().dot == 0


def test_cosines_need_norms(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 4.0)], "dot double, train_grad_norm double, val_grad_norm double")
    assert rows.select(selection.replay_metric(rows, "cosine")).first()[0] == 0.125
    with pytest.raises(ValueError, match="train_grad_norm"):
        selection.replay_metric(rows.drop("val_grad_norm"), "cosine")


def test_layers_without_a_stored_rotation_are_scored_plainly(spark):
    rows = spark.createDataFrame([(1, 0, k, [1.0, 2.0], [3.0, 4.0]) for k in range(2)], ROW)
    a, b, va, vb = np.array([1.0, 2.0]), np.array([3.0, 4.0]), np.array([1.0, -1.0]), np.array([0.5, 2.0])
    turn, v = np.array([[0.6, 0.8], [-0.8, 0.6]]), np.array([[1.0, 2.0], [3.0, 4.0]])
    vectors = spark.createDataFrame([(k, va.tolist(), vb.tolist()) for k in range(2)], "layer int, a array<double>, b array<double>")
    # the basis is in the columns of ``turn``
    basis = blocks.transposed(matrices(spark, {0: turn}))
    direction = blocks.rotated_direction(blocks.rotated_kernel(matrices(spark, {0: v}), 3), blocks.outer(vectors), basis, basis)
    kernel = 1 / (np.sqrt(v / (1 - 0.999**3)) + 1e-8)
    one = (turn.T @ b) @ (kernel * np.outer(turn.T @ vb, turn.T @ va)) @ (turn.T @ a)
    assert blocks.scored(rows, direction).first().score == pytest.approx(one + (b @ vb) * (a @ va))


def test_crops_lie_inside(spark):
    df = spark.createDataFrame([(w, h, d) for w in (255, 256, 300, 1001) for h in (256, 257, 999) for d in (0, 10**12 + 7, -5)], "w long, h long, d long").select("w", "h", corpus.image_crop(F.col("w"), F.col("h"), 256, F.col("d")).alias("x"))
    for r in df.collect():
        assert (r.x is None) == (r.w < 256)
        if r.x:
            assert min(r.x.new_width, r.x.new_height) == 256 and 0 <= r.x.left <= r.x.new_width - 256 and 0 <= r.x.top <= r.x.new_height - 256


def test_weight_deltas_leave_out_new_parameters(spark):
    now = spark.createDataFrame([("layers.0.w", [3.0, 4.0]), ("layers.0.v", [1.0, 0.0]), ("head", [2.0]), ("layers.1.w", [1.0])], "name string, w array<double>")
    before = spark.createDataFrame([("layers.0.w", [0.0, 0.0]), ("layers.0.v", [1.0, 0.0]), ("head", [1.0])], "name string, w array<double>")
    got = {r.module: (r.n, r.magnitude, r.relative) for r in runs.weight_deltas(now, before).collect()}
    assert got == {"layers.0": (2, 2.5, pytest.approx(0.5)), "head": (1, 1.0, pytest.approx(0.5))}


def test_draws_with_replacement_from_more_rows_than_draws(spark, tmp_path):
    """The query's draws repeat documents though there are more of these than draws."""
    spark.range(20500).selectExpr("id as doc_id", "'x' as text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["sample_with_replacement"]).fetchall())
    found = entry.queries()["sample_with_replacement"](spark, str(tmp_path)).select("doc_id", "draw")
    assert sorted(tuple(r) for r in found.collect()) == want
    assert len({i for i, _ in want}) < len(want) == 20000


def test_ids_are_made_of_bounded_slices(spark, monkeypatch):
    texts = ["a" * 5, None, "é\nb" * 4, "", "x" * 90, "c", "d" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["z", *texts, "y"])], names=["doc_id", "text"]).slice(1, 7)
    parts = list(corpus.text_slices(batch, 1, 20))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    sizes = [sum(len((t or "").encode()) for t in p.column(1).to_pylist()) for p in parts]
    assert all(n <= 20 or p.num_rows == 1 for n, p in zip(sizes, parts, strict=True))
    monkeypatch.setattr(corpus, "TEXT_BYTES", 1)
    made = []
    monkeypatch.setattr(corpus, "char_lists", lambda t, end: made.append(len(t)) or pa.array([[1]] * len(t), pa.list_(pa.int32())))
    run = []
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: run.append(f) or self)
    corpus.tokenized(frame)
    assert sum(p.num_rows for p in run[0](iter([batch]))) == 7
    assert max(made) <= 3 and sum(made) == 7  # empty texts may go with another


def test_texts_come_in_small_batches(spark):
    """What a Python worker gets at a time is bounded by its bytes, not by its rows alone."""
    frame = spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 1 << 20).alias("text"))
    corpus.tokenized(frame)
    sizes = frame.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 40 and max(r.n for r in sizes) <= 6


@pytest.mark.parametrize("column", ["tokens", "sizes"])
def test_costly_columns_are_made_once(spark, column):
    """What a column is made from isn't written again for each of its parts."""
    made = runs.special_tokens(F.col("own")) if column == "tokens" else projection.choose_sizes(F.sqrt("own"), F.lit(7), 16)
    assert str(made).count("own") <= (1 if column == "tokens" else 40)


def test_groups_of_rows_are_arrays_that_meet_in_bounded_steps(spark, monkeypatch):
    """Scores by pairs of tokens and by the gradient: a task holds no Python numbers, and multiplies few rows at a time."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 90, 4))
    rows = [(k // 2, 0, "m" if k % 3 else "n", a[k].tolist(), b[k].tolist()) for k in range(90)]
    batch = pa.RecordBatch.from_pylist([{"layer": r[2], "x": r[3]} for r in sorted(rows, key=lambda r: r[2])])
    found = list(blocks.stretches(batch, ["layer"]))
    assert found == [(("m",), 0, 60), (("n",), 60, 30)]
    assert isinstance(m := blocks.numbers(batch, "x", 60, 30), np.ndarray) and m.shape == (30, 4)
    monkeypatch.setattr(blocks, "ROWS", 7)
    df = spark.createDataFrame(rows, "sample_id long, step long, layer string, a array<double>, b array<double>")
    train, val = df.filter("sample_id >= 15"), df.filter("sample_id < 15")
    want = {}
    for k in range(30, 90):
        same = [j for j in range(30) if rows[j][2] == rows[k][2]]
        want[k // 2] = want.get(k // 2, 0.0) + sum((a[k] @ a[j]) * (b[k] @ b[j]) for j in same) / 15
    for scores in (blocks.gram_dots(train, val, together=4), blocks.scored(train, blocks.kept(blocks.gradient(val, 3), "g"))):
        got = {r.sample_id: r.score for r in scores.collect()}
        assert got == pytest.approx(want)

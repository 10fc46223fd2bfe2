"""Whitening, the n-gram join and the repair of conversations against brute force."""

import hashlib
import re
import zlib
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import ngram_join, turns, whitening
from siftwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- whitening


def whole(vectors):
    return np.floor(256 * np.asarray(vectors, np.float64)).astype(np.int64) + 0


def check_whitening(found, rows, k=4):
    """``found`` rows of the operator, against NumPy on ``rows`` (id, vector) that are all valid."""
    x = whole([v for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums, d = len(fit), fit.sum(axis=0), x.shape[1]
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {}
    for (i, _), own in zip(rows, x, strict=True):
        for c in range(min(k, d)):
            want.setdefault((i, c + 1), []).append((int(((n * own - sums) ** 2).sum()), float((own - sums / n) @ vectors[:, c] / np.sqrt(values[c]))))
    got = {}
    for r in found:
        assert r.n == n
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
        got.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
    assert got.keys() == want.keys()
    for c in range(1, min(k, d) + 1):
        pairs = [(g, w) for key in want if key[1] == c for g, w in zip(sorted(got[key]), sorted(want[key]), strict=True)]
        assert [g[0] for g, _ in pairs] == [w[0] for _, w in pairs]
        a, b = np.array([g[1] for g, _ in pairs]), np.array([w[1] for _, w in pairs])
        sign = np.sign(a @ b)
        np.testing.assert_allclose(np.sort(a * sign) if len(rows) != len(set(i for i, _ in rows)) else a * sign, np.sort(b) if len(rows) != len(set(i for i, _ in rows)) else b, atol=1e-7)


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op11_whitening"](spark, SF).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=6).tolist()) for k in range(40)]
    good += [(3, good[0][1]), (None, good[1][1]), (77, good[2][1])]  # repeats
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] + [0.0] * 5), (103, [float("inf")] + [0.0] * 5), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumn("component", F.lit(1)).withColumn("x", F.lit("y")).repartition(4)
    found = whitening.whiten(df).collect()
    assert {r.vec_id for r in found} == {i for i, _ in good}
    check_whitening(found, good)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id > 99")).filter("vec_id < 105").count() == 0
    one = whitening.whiten(df.filter("vec_id = 5")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, None, 0.0) for c in range(1, 5)]


def test_basis_is_expanded_only_where_it_must(spark):
    rng = np.random.default_rng(2)
    steep = rng.normal(size=(300, 40)) @ np.diag([4.0**-k for k in range(40)]) @ np.linalg.qr(rng.normal(size=(40, 40)))[0] * 1000
    flat = rng.normal(size=(300, 40))
    for data, most in ((steep, 1 + whitening.PASSES), (flat, 2 + whitening.PASSES)):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(3)
        model = whitening.fit_components(whitening.whole_vectors(df, "embedding"))
        assert model.passes <= most if data is steep else model.passes == most
        x = np.unique(whole(data), axis=0)
        values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
        np.testing.assert_allclose(model.values, values[::-1][:4], rtol=1e-10)
        np.testing.assert_allclose(np.abs(np.diag(model.vectors.T @ vectors[:, ::-1][:, :4])), 1, atol=1e-9)
        if data is steep:
            assert model.passes < most


def test_deviations_are_exact():
    sums = [7, -3, 10**17]
    x = np.array([[2**62, -5, 1], [1, 2, 3]])
    want = [sum((3 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert whitening.deviations(x, 3, sums) == [v if v < 2**63 else None for v in want]
    assert whitening.deviations(np.array([[5, 6, 7]]), 9, [1, 2, 3]) == [44**2 + 52**2 + 60**2]


# --- n-gram join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def linked(rows, percent=90):
    """(id, text) -> (set size, component), by all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= percent * len(x | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def near_copies(rng, groups=14, most=9):
    rows = []
    for g in range(groups):
        words = [f"W{x}" for x in rng.integers(0, 300 if g % 3 else 40, rng.integers(1, 90))]
        for _ in range(rng.integers(1, most)):
            copy = list(words)
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(len(copy))] = f"x{rng.integers(9)}"
            if rng.random() < 0.4:
                copy = copy[: rng.integers(max(1, len(copy) - 8), len(copy) + 1)]
            rows.append((len(rows), (" " if rng.random() < 0.7 else "\n\t").join(copy)))
    return rows


ODD = [(None, "A b c d e"), (None, None), (900, "a B c d e"), (901, ""), (902, " \t\x0b"), (903, "one two"), (903, "ONE\ntwo"), (904, "two one"), (905, "é É\x1cx y"), (906, "É é\x1cx y"), (907, "é É\x1cX y"), (908, "q " * 9000), (909, "q " * 20000), (910, " ".join(map(str, range(21000)))), (911, " ".join(map(str, range(20500))))]


def all_linked(df, percent=90):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, percent).collect()), key=repr)


def test_ngram_join_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op12_ngram_join"](spark, SF).collect()), key=repr)
    assert got == linked(rows)


@pytest.mark.parametrize("pairs_a_row", [0, 2, 1000], ids=["through one member", "both", "all pairs"])
def test_ngram_join_by_all_pairs(spark, monkeypatch, pairs_a_row):
    monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", pairs_a_row)
    monkeypatch.setattr(ngram_join, "TOGETHER", 3)
    if pairs_a_row == 0:
        monkeypatch.setattr(ngram_join, "MOST_SENT", 1)
    rows = near_copies(np.random.default_rng(pairs_a_row)) + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("copies", F.lit("x")).repartition(5)
    assert all_linked(df) == linked(rows)


def test_ngram_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert all_linked(df) == []
    assert all_linked(spark.createDataFrame([(1, None), (2, "a")], df.schema)) == [(1, 0, 1), (2, 1, 2)]


def test_templated_texts_are_no_candidates(spark):
    """A page that differs by a serial number: alike, but under the threshold; no pair is tried."""
    words = [f"w{k}" for k in range(40)]
    texts = spark.createDataFrame([(k, " ".join([*words[:20], f"serial{k}", *words[21:]])) for k in range(3000)], "doc_id long, text string").withColumn("key", F.unhex(F.md5(F.encode("text", "utf-8"))))
    rows = ngram_join.signed(texts, ngram_join.frequency_levels(texts), 90, "long")
    nodes = rows.select(F.col("doc_id").alias("nid"), "size", "prefix")
    assert ngram_join.shared_rows(nodes, 90).count() < 300
    assert {r.component_id for r in ngram_join.ngram_components(texts.drop("key")).collect()} == set(range(3000))


def test_alike_texts_under_the_threshold_are_no_pairs(spark, monkeypatch):
    """One word of a page differs, so most pairs share all but 12 of 156 shingles and pass the filters of size and place: the pairs that groups give are little more than the links."""
    words, tried, plausible = [f"w{k}" for k in range(80)], [], ngram_join.plausible
    monkeypatch.setattr(ngram_join, "plausible", lambda pairs, nodes, percent, total: tried.append(total) or plausible(pairs, nodes, percent, total))
    rows = [(k, " ".join([*words[: 3 + k % 15 * 5], f"own{k}", *words[4 + k % 15 * 5 :]])) for k in range(300)]
    assert all_linked(spark.createDataFrame(rows, "doc_id long, text string")) == linked(rows)
    assert 0 < sum(tried) < 6000  # 2,850 links; 44,850 pairs


def test_rows_of_shingles_are_dealt_once(spark, monkeypatch):
    """One shuffle of the prefixes' rows, and two pairs for each member of a group of copies when all meet some."""
    plans = []
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    nodes = spark.createDataFrame([(k, 40, [100 + k // 2, k]) for k in range(20)], "nid long, size long, prefix array<long>")
    assert sorted(r.nid for r in ngram_join.shared_rows(nodes, 90).collect()) == list(range(20))
    assert [p.count("Exchange") for p in plans] == [1]
    rows = spark.createDataFrame([(t, k, 40, t, True, 40, k, 0) for t in range(8) for k in range(40)], "token long, nid long, size long, pos int, indexed boolean, n long, comp long, main long")
    assert 0 < ngram_join.star_pairs(rows, 90, 0).count() < 80


# --- conversations


def way_by_relaxation(rows):
    """(cost, audit, lines) of the cheapest edits of (role, text, fault): all ways of each layer, best first."""
    best = {"": (0, "", ())}

    def fits(letters):
        return re.fullmatch(r"(s?(ua)*u?)?", letters)

    def end(letters):
        return re.fullmatch(r"(s?(ua)+)?", letters)

    def state(letters):
        return letters[:1] + str(len(letters) % 2) if len(letters) < 3 else ("s" if letters[0] == "s" else "") + letters[-1]

    def keep_best(found):
        out = {}
        for letters, way in found:
            if fits(letters) and (state(letters) not in out or way[:2] < out[state(letters)][1][:2]):
                out[state(letters)] = (letters, way)
        return [x for x in out.values()]

    def inserted(found):
        for _ in range(3):
            found = keep_best(found + [(x + c, (w[0] + 3, w[1] + "I", (*w[2], f"{name}:"))) for x, w in found for c, name in (("u", "user"), ("a", "assistant"))])
        return found

    layer = inserted([("", best[""])])
    for role, text, fault in rows:
        after = []
        for x, (cost, audit, lines) in layer:
            after.append((x, (cost + 4, audit + "D", lines)))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in ("s", "u", "a"):
                    after.append((x + role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
                after += [(x + c, (cost + 3 + more, audit + "R", (*lines, f"{name}:{text}"))) for c, name in (("u", "user"), ("a", "assistant"))]
        layer = inserted(keep_best(after))
    return min((w for x, w in layer if end(x)), key=lambda w: w[:2])


def repair_by_hand(rows):
    """conv_id -> the contract's columns, for rows (conv_id, turn, role, text)."""
    shown = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, shown(r[2]), shown(r[3]))):
        kept = convs.setdefault(conv, [])
        kind, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        seen, faults = set(), []
        for _, role, text in kept:
            shown_chars = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not shown_chars else "duplicate" if (role, text) in seen else "truncated" if shown_chars[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(kept))
        cost, audit, lines = way_by_relaxation([(r, t, f) for (_, r, t), f in zip(kept, faults, strict=True)])
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df, **options):
    return {r[0]: tuple(r[1:]) for r in turns.repair_conversations(df, **options).collect()}


def test_turn_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op13_turn_repair"](spark, SF).collect()}
    assert got == repair_by_hand(rows)


def odd_conversations(seed, n=60, longest=9):
    r = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "u", "tool", "", None], ["Yes.", "No!", "why", "Why?  \n", " \t", "", None, "ü…", "a.b"]
    out = []
    for conv in range(n):
        for turn in range(r.integers(1, longest)):
            role = roles[turn % 2] if r.random() < 0.6 else roles[r.integers(len(roles))]
            text = f"Line {turn}." if r.random() < 0.5 else texts[r.integers(len(texts))]
            out.append((conv if conv else None, None if r.random() < 0.05 else int(turn + (r.random() < 0.1) * r.integers(0, 3)), role, text))
    return out + out[5:9]


@pytest.mark.parametrize("run", [1, 3, 512])
def test_repair_by_hand(spark, run):
    rows = odd_conversations(run)
    rows += [(5000, k, "user" if k % 3 else "assistant", f"Turn {k}" + "." * (k % 7 > 0)) for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit(1)).withColumn("copy", F.lit("x")).repartition(7)
    assert repaired(df, run=run) == repair_by_hand(rows)
    assert repaired(df.limit(0)) == {}


def test_repair_of_long_texts_and_text_ids(spark):
    rows = [("a", k, "user" if k % 2 == 0 else "assistant", "word " * 60000 + "end.") for k in range(4)] + [(None, 0, "user", "x."), (" ", 0, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert repaired(df) == repair_by_hand(rows)


ROLE = st.sampled_from(["user", "assistant", "system", "tool"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLE, st.sampled_from(["", "blank", "truncated", "duplicate"])), max_size=9), st.integers(1, 4))
def test_search_and_joined_runs_find_the_cheapest(found, size):
    conv = [turns.Turn(k, role, f"t{k}", fault) for k, (role, fault) in enumerate(found)]
    want = way_by_relaxation([(t.role, t.text, t.fault) for t in conv])
    way = next(iter(turns.cheapest(conv).values()))
    assert way == want[:2]
    assert tuple(turns.repaired(conv, way[1])[0]) == want[2]
    reached = {turns.START: (0, "")}
    for k in range(0, len(conv), size):
        reached, _ = turns.joined(reached, turns.ways(conv[k : k + size]))
    if conv:
        assert min(w for s, w in reached.items() if s in turns.ACCEPTING) == way

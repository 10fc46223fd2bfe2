"""Queries over gradient factors: scoring, selection, projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siftwell.functions import hashing, ranking
from siftwell.operators import blocks as B
from siftwell.operators import projection as P
from siftwell.operators import scoring as S
from siftwell.operators import selection as X
from siftwell.operators.corpus import batches
from siftwell.plans.corpus_queries import table
from siftwell.plans.registry import query

FL = """fl AS (SELECT vec_id AS sample_id, vec_id // 16 AS step, label, j // 32 AS layer, (j % 32) // 16 AS t, (j % 16) // 8 AS side, j % 8 AS i, embedding[j + 1]::DOUBLE AS x FROM embeddings, range(64) r(j)),
lm AS (SELECT label, layer, side, i, avg(x) AS m, avg(x * x) AS q FROM fl GROUP BY ALL), v1 AS (SELECT layer, side, i, m, q FROM lm WHERE label = 0), m1 AS (SELECT layer, side, i, m FROM lm WHERE label = 1),
lo AS (SELECT a.label, a.layer, b.i AS o, a.i, a.m * b.m AS m, a.q * b.q AS q FROM lm a JOIN lm b ON a.label = b.label AND a.layer = b.layer AND a.side = 0 AND b.side = 1),
st AS (SELECT x.layer, x.o, x.i, x.m AS d, x.q AS v, m.m AS mm, g.m AS g, p.q AS pv, w.q AS raw FROM lo x JOIN lo m ON m.label = 1 AND m.layer = x.layer AND m.o = x.o AND m.i = x.i JOIN lo g ON g.label = 2 AND g.layer = x.layer AND g.o = x.o AND g.i = x.i
JOIN lo p ON p.label = 3 AND p.layer = x.layer AND p.o = x.o AND p.i = x.i JOIN lo w ON w.label = 4 AND w.layer = x.layer AND w.o = x.o AND w.i = x.i WHERE x.label = 0)"""
SCORED = """SELECT a.sample_id, a.step, sum(b.x * d.w * a.x) AS score FROM fl a JOIN fl b ON a.sample_id = b.sample_id AND a.layer = b.layer AND a.t = b.t AND a.side = 0 AND b.side = 1 JOIN d ON d.layer = a.layer AND d.o = b.i AND d.i = a.i WHERE a.label <> 0 GROUP BY a.sample_id, a.step"""
CORRECTED = "sqrt(v / (1 - power(0.999, 10)))"
KINDS = {
    "sgd": "d", "adamw": f"d / ({CORRECTED} + 1e-8)", "adopt": "d / greatest(sqrt(pv / (1 - power(0.999, 9))), 1e-8)", "mars": "d / (sqrt(raw) + 1e-8)", "sophia": "d / greatest(0.04 * v, 1e-12)", "lion": "d * sign(mm)",
    "cadamw": f"CASE WHEN mm / ({CORRECTED} + 1e-8) * g > 0 THEN d * (64.0 / (sum(CASE WHEN mm / ({CORRECTED} + 1e-8) * g > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY layer) + 1)) / ({CORRECTED} + 1e-8) ELSE 0 END",
}
#: So that six decimals tell scores apart.
SCALE = {"sgd": 1e6, "adamw": 1e3, "adopt": 1e3, "mars": 1e4, "sophia": 1.0, "lion": 1e6, "cadamw": 1e3}


#: What a state is made of, as the tables hold no optimizer's: means of the factors of a label, or of their squares.
MADE = {"v": (0, 2), "m": (1, 1), "g": (2, 1), "before": (3, 2), "raw": (4, 2)}


def fixture(spark, sf_dir):
    """All samples' factors, the candidates among them, and the validation samples."""
    rows = S.factors(table(spark, sf_dir, "embeddings"))
    return rows, rows.filter("label <> 0"), rows.filter("label = 0")


def made(rows, name: str):
    label, power = MADE[name]
    return B.outer(B.layer_means(rows.filter(F.col("label") == label), power))


def scores_of(spark, sf_dir, kind: str):
    rows, candidates, proxy = fixture(spark, sf_dir)
    needed = B.NEEDED.get(kind, [])
    state = B.aligned(**{name: made(rows, name) for name in needed}) if needed else None
    return B.scored(candidates, B.kept(B.direction(kind, state, B.outer(B.layer_means(proxy))), "direction"))


def score_sql(kind: str) -> str:
    return f"{FL}, d AS (SELECT layer, o, i, {KINDS[kind]} AS w FROM st), s AS ({SCORED})"


def register_scores(kind: str) -> None:
    @query(f"score_{kind}", f"WITH {score_sql(kind)} SELECT sample_id, step, round(score * {SCALE[kind]}, 6) AS score FROM s")
    def run(spark, sf_dir):
        return scores_of(spark, sf_dir, kind).select("sample_id", "step", F.round(F.col("score") * SCALE[kind], 6).alias("score"))


for _kind in KINDS:
    register_scores(_kind)


def adam(spark, sf_dir):
    return scores_of(spark, sf_dir, "adamw").withColumn("score", F.col("score") * 1e3)


ADAM = f"{score_sql('adamw')}, a AS (SELECT sample_id, step, score * 1e3 AS score FROM s), p AS (SELECT *, exp(score - max(score) OVER (PARTITION BY step)) / sum(exp(score - m)) OVER (PARTITION BY step) AS prob FROM (SELECT *, max(score) OVER (PARTITION BY step) AS m FROM a))"
ADAM = ADAM.replace("exp(score - max(score) OVER (PARTITION BY step)) / ", "exp(score - m) / ")


@query("select_topk_adam", f"WITH {ADAM} SELECT step, sample_id, rank, round(score, 6) AS score, round(prob, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY round(score, 9) DESC, sample_id) AS rank FROM p) WHERE rank <= 8")
def select_topk_adam(spark, sf_dir):
    chosen = X.top_k(X.boltzmann(adam(spark, sf_dir), 1.0), 8, [F.desc(F.round("score", 9)), "sample_id"])
    return chosen.select("step", "sample_id", "rank", F.round("score", 6).alias("score"), F.round("prob", 6).alias("prob"))


@query("boltzmann_probs", f"WITH {ADAM} SELECT step, sample_id, round(prob, 6) AS prob FROM p")
def boltzmann_probs(spark, sf_dir):
    return X.boltzmann(adam(spark, sf_dir), 1.0).select("step", "sample_id", F.round("prob", 6).alias("prob"))


U = "(('0x' || substr(md5(concat_ws(':', '{0}', sample_id)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"


@query("gumbel_topk", f"WITH {ADAM} SELECT step, sample_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY round(score / 0.5 - ln(-ln({U.format(21)})), 9) DESC, sample_id) AS rank FROM a) WHERE rank <= 8")
def gumbel_topk(spark, sf_dir):
    keyed = adam(spark, sf_dir).withColumn("key", F.round(X.gumbel(F.col("score"), 0.5, 21, "sample_id"), 9))
    return X.top_k(keyed, 8, [F.desc("key"), "sample_id"]).select("step", "sample_id", "rank")


def flat_gradients(candidates):
    """Each sample's mean factors over tokens, of all layers, as one vector."""
    spread = candidates.select("sample_id", "layer", "t", F.concat("a", "b").alias("x"))
    return spread.groupBy("sample_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("layer", "t", "x"))), lambda s: s["x"])).alias("g"))


@query("greedy_argmax", f"""WITH RECURSIVE {ADAM}, vec AS (SELECT vec_id AS sample_id, embedding FROM embeddings WHERE label <> 0), c AS (SELECT a.step, a.sample_id, a.score, list_transform(v.embedding, lambda x: x::DOUBLE) AS g FROM a JOIN vec v USING (sample_id)),
g(step, n, chosen, total) AS (SELECT DISTINCT step, 0, []::BIGINT[], list_transform(range(64), lambda x: 0.0::DOUBLE) FROM c UNION ALL
SELECT step, n + 1, list_append(chosen, pick.id), list_transform(range(1, 65), lambda k: total[k] + pick.g[k]) FROM (SELECT g.step, g.n, g.chosen, g.total, arg_max({{'id': c.sample_id, 'g': c.g}}, [0.1 * c.score - CASE WHEN g.n = 0 THEN 0 ELSE 0.01 * 5.0 * list_dot_product(c.g, g.total) / g.n END, -c.sample_id::DOUBLE]) AS pick FROM g JOIN c ON c.step = g.step AND NOT list_contains(g.chosen, c.sample_id) WHERE g.n < 8 GROUP BY g.step, g.n, g.chosen, g.total))
SELECT step, chosen[n] AS sample_id, n::BIGINT AS rank FROM g WHERE n > 0""")
def greedy_argmax(spark, sf_dir):
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda v: v.cast("double")).alias("g"))
    return X.greedy(adam(spark, sf_dir).join(raw, "sample_id"), 8, 0.1, 5.0)


@query("greedy_boltzmann", f"""WITH RECURSIVE {ADAM}, vec AS (SELECT vec_id AS sample_id, embedding FROM embeddings WHERE label <> 0), c AS (SELECT a.step, a.sample_id, a.score, list_transform(v.embedding, lambda x: x::DOUBLE) AS g FROM a JOIN vec v USING (sample_id)),
g(step, n, chosen, total) AS (SELECT DISTINCT step, 0, []::BIGINT[], list_transform(range(64), lambda x: 0.0::DOUBLE) FROM c UNION ALL
SELECT step, n + 1, list_append(chosen, pick.id), list_transform(range(1, 65), lambda k: total[k] + pick.g[k]) FROM (SELECT step, n, chosen, total, arg_max({{'id': sample_id, 'g': g}}, [greatest((now - top) / 0.1, -50) + noise, -sample_id::DOUBLE]) AS pick FROM (SELECT *, max(now) OVER (PARTITION BY step) AS top FROM
(SELECT g.step, g.n, g.chosen, g.total, c.sample_id, c.g, 0.1 * c.score - CASE WHEN g.n = 0 THEN 0 ELSE 0.01 * 5.0 * list_dot_product(c.g, g.total) / g.n END AS now, -ln(-ln((('0x' || substr(md5(concat_ws(':', '3', c.step, g.n, c.sample_id)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS noise FROM g JOIN c ON c.step = g.step AND NOT list_contains(g.chosen, c.sample_id) WHERE g.n < 8)) GROUP BY step, n, chosen, total))
SELECT step, chosen[n] AS sample_id, n::BIGINT AS rank FROM g WHERE n > 0""")
def greedy_boltzmann(spark, sf_dir):
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda v: v.cast("double")).alias("g"))
    return X.greedy(adam(spark, sf_dir).join(raw, "sample_id"), 8, 0.1, 5.0, temperature=0.1, seed=3)


@query("selection_stats", f"WITH {ADAM} SELECT step, round(-sum(prob * ln(prob + 1e-10)), 6) AS entropy, round(avg(score), 6) AS mean_score, round(coalesce(stddev_samp(score), 0), 6) AS std_score FROM p GROUP BY step")
def selection_stats(spark, sf_dir):
    return X.selection_stats(X.boltzmann(adam(spark, sf_dir), 1.0)).select("step", *[F.round(c, 6).alias(c) for c in ("entropy", "mean_score", "std_score")])


@query("selection_summary", f"WITH {ADAM} SELECT round(avg(e), 6) AS entropy, round(avg(m), 6) AS mean_score, count(*)::BIGINT AS steps FROM (SELECT -sum(prob * ln(prob + 1e-10)) AS e, avg(score) AS m FROM p GROUP BY step)")
def selection_summary(spark, sf_dir):
    return X.selection_stats(X.boltzmann(adam(spark, sf_dir), 1.0)).agg(F.round(F.avg("entropy"), 6).alias("entropy"), F.round(F.avg("mean_score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("steps"))


@query("gather_selected", f"WITH {ADAM} SELECT p.step, rank, e.label, round(e.embedding[1]::DOUBLE, 6) AS first FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY round(score, 9) DESC, sample_id) AS rank FROM p) p JOIN embeddings e ON e.vec_id = p.sample_id WHERE rank <= least(8, 6)")
def gather_selected(spark, sf_dir):
    chosen = X.top_k(adam(spark, sf_dir), min(8, 6), [F.desc(F.round("score", 9)), "sample_id"])
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
    return chosen.join(vectors, "sample_id").select("step", "rank", "label", "first")


H = "h AS (SELECT o, i, CASE WHEN o = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 2.0 * (o + 1) * (i + 1) / 204.0 AS h FROM range(8) a(o), range(8) b(i))"


def rotated_sql(rank: int) -> str:
    return f"""WITH {FL}, {H}, rv AS (SELECT v1.layer, v1.side, h.o AS i, sum(h.h * v1.m) AS m FROM v1 JOIN h ON h.i = v1.i GROUP BY ALL), rf AS (SELECT sample_id, step, label, layer, t, side, h.o AS i, sum(h.h * x) AS x FROM fl JOIN h ON h.i = fl.i WHERE h.o < {rank} GROUP BY ALL),
d AS (SELECT st.layer, st.o, st.i, va.m * vb.m / ({CORRECTED} + 1e-8) AS w FROM st JOIN rv va ON va.layer = st.layer AND va.side = 0 AND va.i = st.i JOIN rv vb ON vb.layer = st.layer AND vb.side = 1 AND vb.i = st.o)
SELECT sample_id, step, round(score * 1e3, 6) AS score FROM ({SCORED.replace("fl a", "rf a").replace("fl b", "rf b")})"""


def rotated_scores(spark, sf_dir, left, right, rank: int):
    """Scores with the preconditioner in the coordinates of reflections of two vectors (layer, u), of their first ``rank`` rows."""
    rows, candidates, proxy = fixture(spark, sf_dir)
    u, w = (B.kept(B.from_rows(B.reflections(x, rank)), "basis") for x in (left, right))
    moments = B.layer_means(rows.filter("label = 0"), 2).select("layer", *[F.slice(c, 1, rank).alias(c) for c in ("a", "b")])
    direction = B.rotated_direction(B.rotated_kernel(B.outer(moments), S.STEP), B.kept(B.outer(B.layer_means(proxy)), "validation"), u, w)
    return B.scored(candidates, B.kept(direction, "direction")).select("sample_id", "step", F.round(F.col("score") * 1e3, 6).alias("score"))


def register_rotated(name: str, rank: int) -> None:
    @query(name, rotated_sql(rank))
    def run(spark, sf_dir):
        rows, _, _ = fixture(spark, sf_dir)
        # one reflection for all layers: of 1, 2, ...
        fixed = B.layer_means(rows).select("layer", F.transform("a", lambda _, i: (i + 1).cast("double")).alias("u"))
        return rotated_scores(spark, sf_dir, fixed, fixed, rank)


register_rotated("score_soap", 8)
register_rotated("score_galore", 4)


# M = b a', so M'M + eps I has one eigenvalue beside eps, whose vector is a
@query("score_muon", f"""WITH {FL}, z AS (SELECT layer, side, sum(m * m) AS s FROM m1 GROUP BY ALL), k AS (SELECT va.layer, sum(va.m * ma.m) AS am FROM v1 va JOIN m1 ma ON va.layer = ma.layer AND va.side = 0 AND ma.side = 0 AND va.i = ma.i GROUP BY ALL),
d AS (SELECT st.layer, st.o, st.i, vb.m * (va.m / sqrt(1e-6::DOUBLE) + ma.m * k.am / za.s * (1 / sqrt(za.s * zb.s + 1e-6::DOUBLE) - 1 / sqrt(1e-6::DOUBLE))) AS w FROM st JOIN v1 va ON va.layer = st.layer AND va.side = 0 AND va.i = st.i JOIN v1 vb ON vb.layer = st.layer AND vb.side = 1 AND vb.i = st.o JOIN m1 ma ON ma.layer = st.layer AND ma.side = 0 AND ma.i = st.i
JOIN z za ON za.layer = st.layer AND za.side = 0 JOIN z zb ON zb.layer = st.layer AND zb.side = 1 JOIN k ON k.layer = st.layer) SELECT sample_id, step, round(score * 1e-2, 6) AS score FROM ({SCORED})""")
def score_muon(spark, sf_dir):
    rows, candidates, proxy = fixture(spark, sf_dir)
    direction = B.muon_direction(B.kept(made(rows, "m"), "momentum"), B.outer(B.layer_means(proxy)))
    return B.scored(candidates, B.kept(direction, "direction")).select("sample_id", "step", F.round(F.col("score") * 1e-2, 6).alias("score"))


@query("newton_schulz", f"""WITH {FL}, m AS (SELECT layer, o, i, d + 0.01 * (CASE WHEN o = i THEN 1 ELSE 0 END) AS x FROM st), n AS (SELECT layer, sqrt(sum(x * x)) + 1e-7 AS n FROM m GROUP BY layer), x AS (SELECT m.layer, o, i, x / n AS x FROM m JOIN n ON m.layer = n.layer),
s AS (SELECT a.layer, a.o, b.o AS p, sum(a.x * b.x) AS x FROM x a JOIN x b ON a.layer = b.layer AND a.i = b.i GROUP BY ALL), q AS (SELECT a.layer, a.o, b.p, sum(a.x * b.x) AS x FROM s a JOIN s b ON a.layer = b.layer AND a.p = b.o GROUP BY ALL),
t AS (SELECT s.layer, s.o, s.p, -4.775 * s.x + 2.0315 * q.x AS x FROM s JOIN q ON s.layer = q.layer AND s.o = q.o AND s.p = q.p), y AS (SELECT t.layer, t.o, x.i, sum(t.x * x.x) AS y FROM t JOIN x ON t.layer = x.layer AND t.p = x.o GROUP BY ALL)
SELECT x.layer, x.o::BIGINT AS o, x.i::BIGINT AS i, round(3.4445 * x.x + y.y, 9) AS x FROM x JOIN y ON x.layer = y.layer AND x.o = y.o AND x.i = y.i""")
def newton_schulz(spark, sf_dir):
    """One step towards an orthogonal matrix from each layer's direction, with something on its diagonal."""
    _, _, proxy = fixture(spark, sf_dir)
    m = B.elementwise(B.outer(B.layer_means(proxy)), lambda d: d + 0.01 * np.eye(*d.shape), ["data"])
    return B.entries(B.newton_schulz(m, 1)).select(F.col("layer").cast("bigint").alias("layer"), "o", "i", F.round("x", 9).alias("x"))


@query("val_factors", f"WITH {FL} SELECT layer, i::BIGINT AS i, round(max(CASE WHEN side = 0 THEN m END), 9) AS a_mean, round(max(CASE WHEN side = 1 THEN m END), 9) AS b_mean FROM v1 GROUP BY layer, i")
def val_factors(spark, sf_dir):
    proxy = S.factors(table(spark, sf_dir, "embeddings")).filter("label = 0").select("layer", F.posexplode(F.arrays_zip("a", "b")).alias("i", "x"))
    return proxy.groupBy(F.col("layer").cast("bigint").alias("layer"), F.col("i").cast("bigint").alias("i")).agg(F.round(F.avg("x.a"), 9).alias("a_mean"), F.round(F.avg("x.b"), 9).alias("b_mean"))


GRAD = "SELECT a.layer, b.i AS o, a.i, sum(b.x * a.x) / (SELECT count(DISTINCT sample_id) FROM fl WHERE label = {0}) AS g FROM fl a JOIN fl b ON a.sample_id = b.sample_id AND a.layer = b.layer AND a.t = b.t AND a.side = 0 AND b.side = 1 WHERE a.label = {0} GROUP BY ALL"


@query("dot_linear", f"WITH {FL}, d AS (SELECT layer, o, i, g AS w FROM ({GRAD.format(0)})) SELECT sample_id, step, round(score * 1e3, 6) AS score FROM ({SCORED})")
def dot_linear(spark, sf_dir):
    _, candidates, proxy = fixture(spark, sf_dir)
    return B.scored(candidates, B.kept(B.gradient(proxy), "gradient")).select("sample_id", "step", F.round(F.col("score") * 1e3, 6).alias("score"))


@query("train_gradient", f"WITH {FL} SELECT layer, o::BIGINT AS o, i::BIGINT AS i, round(g, 9) AS g FROM ({GRAD.format(2)})")
def train_gradient(spark, sf_dir):
    g = B.entries(B.gradient(S.factors(table(spark, sf_dir, "embeddings")).filter("label = 2")))
    return g.select(*[F.col(c).cast("bigint").alias(c) for c in ("layer", "o", "i")], F.round("x", 9).alias("g"))


@query("dot_embedding", "WITH w AS (SELECT vec_id, label AS tok, k, embedding[k + 1]::DOUBLE AS x FROM embeddings, range(8) r(k)), v AS (SELECT tok, k, sum(x) AS g FROM w WHERE vec_id % 5 = 0 GROUP BY ALL) SELECT vec_id, round(sum(x * g), 6) AS dot, round(sum(x * x), 6) AS norm2 FROM w JOIN v USING (tok, k) WHERE vec_id % 5 <> 0 GROUP BY vec_id")
def dot_embedding(spark, sf_dir):
    w = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("tok"), F.posexplode(F.slice("embedding", 1, 8)).alias("k", "y")).withColumn("x", F.col("y").cast("double"))
    v = w.filter("vec_id % 5 = 0").groupBy("tok", "k").agg(F.sum("x").alias("g"))
    return w.filter("vec_id % 5 <> 0").join(v, ["tok", "k"]).groupBy("vec_id").agg(F.round(F.sum(F.col("x") * F.col("g")), 6).alias("dot"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("norm2"))


NORMED = "SELECT vec_id, k, {0} AS x FROM (SELECT vec_id, k, x, avg(x) OVER (PARTITION BY vec_id) AS mu, var_pop(x) OVER (PARTITION BY vec_id) AS var, avg(x * x) OVER (PARTITION BY vec_id) AS ms FROM (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS x FROM embeddings, range(64) r(k)))"


def register_norm(name: str, sql: str, rms: bool) -> None:
    @query(name, f"WITH n AS ({NORMED.format(sql)}), v AS (SELECT k, avg(x) AS m FROM n WHERE vec_id % 7 = 0 GROUP BY k) SELECT vec_id, round(sum(x * m), 6) AS dot FROM n JOIN v USING (k) WHERE vec_id % 7 <> 0 GROUP BY vec_id")
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
        total = lambda f: F.aggregate("x", F.lit(0.0), lambda s, x: s + f(x)) / 64
        stats = e.withColumn("mu", F.lit(0.0) if rms else total(lambda x: x)).withColumn("sq", total(lambda x: x * x))
        normed = stats.select("vec_id", F.transform("x", lambda x: (x - F.col("mu")) / F.sqrt(F.col("sq") - F.col("mu") ** 2 + 1e-5)).alias("n"))
        means = [r.m for r in normed.filter("vec_id % 7 = 0").select(F.posexplode("n").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()]
        return normed.filter("vec_id % 7 <> 0").select("vec_id", F.round(S.dot(F.col("n"), S.literal(np.array(means))), 6).alias("dot"))


register_norm("dot_layernorm", "(x - mu) / sqrt(var + 1e-5)", False)
register_norm("dot_rmsnorm", "x / sqrt(ms + 1e-5)", True)


@query("count_sketch", "SELECT vec_id, ('0x' || substr(md5(concat_ws(':', '9h', k)), 1, 13))::BIGINT % 16 AS bucket, round(sum(CASE WHEN ('0x' || substr(md5(concat_ws(':', '9s', k)), 1, 13))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END * embedding[k + 1]::DOUBLE), 6) AS value FROM embeddings, range(64) r(k) GROUP BY ALL")
def count_sketch(spark, sf_dir):
    return S.count_sketch(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 16, 9).withColumn("value", F.round("value", 6))


@query("sanitized_scores", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 WHEN event_id % 5 = 1 THEN 1e9 WHEN event_id % 5 = 2 THEN -1e9 ELSE round(value, 6) END AS score FROM events")
def sanitized_scores(spark, sf_dir):
    k = F.col("event_id") % 5
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.round("value", 6))
    return table(spark, sf_dir, "events").select("event_id", S.sanitized(x).alias("score"))


DOTS = f"WITH {FL}, d AS (SELECT layer, o, i, g AS w FROM ({GRAD.format(0)})), g AS ({SCORED}), n AS (SELECT sample_id, sqrt(sum(x * x)) AS nrm FROM fl GROUP BY sample_id), r AS (SELECT g.sample_id, g.step, score * 1e3 AS dot, nrm, round(score * 1e3 / greatest(nrm * 0.5, 1e-12), 9) AS cosine FROM g JOIN n USING (sample_id))"


def dot_log(spark, sf_dir):
    rows, candidates, proxy = fixture(spark, sf_dir)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    norms = rows.groupBy("sample_id").agg(F.sqrt(F.sum(square("a") + square("b"))).alias("nrm"))
    dots = B.scored(candidates, B.kept(B.gradient(proxy), "gradient")).withColumn("dot", F.col("score") * 1e3)
    return dots.join(norms, "sample_id").select("sample_id", "step", "dot", "nrm", F.round(X.cosine(F.col("dot"), F.col("nrm"), F.lit(0.5)), 9).alias("cosine"))


@query("replay_filter", f"{DOTS} SELECT sample_id, step, round(dot, 6) AS dot FROM r WHERE dot >= 0.5")
def replay_filter(spark, sf_dir):
    return dot_log(spark, sf_dir).filter("dot >= 0.5").select("sample_id", "step", F.round("dot", 6).alias("dot"))


@query("replay_cosine", f"{DOTS} SELECT sample_id, round(cosine, 6) AS cosine FROM r WHERE cosine >= 0.2")
def replay_cosine(spark, sf_dir):
    return dot_log(spark, sf_dir).filter("cosine >= 0.2").select("sample_id", F.round("cosine", 6).alias("cosine"))


@query("replay_batches", f"{DOTS}, f AS (SELECT sample_id, row_number() OVER (ORDER BY md5(concat_ws(':', '4', sample_id)), sample_id) - 1 AS k, count(*) OVER () AS n FROM r WHERE cosine >= 0.0) SELECT sample_id, k // 8 AS batch, k % 8 AS slot FROM f WHERE k // 8 < n // 8")
def replay_batches(spark, sf_dir):
    kept = dot_log(spark, sf_dir).filter("cosine >= 0").select("sample_id").withColumn("key", hashing.hex_key(4, "sample_id"))
    return batches(kept, 8, ["key", "sample_id"], ranking.hash_bucket("key"), drop_last=True).select("sample_id", "batch", "slot")


@query("replay_stats", f"{DOTS} SELECT count(*)::BIGINT AS seen, sum(CASE WHEN cosine >= 0.2 THEN 1 ELSE 0 END)::BIGINT AS kept, round(avg(cosine), 6) AS mean FROM r")
def replay_stats(spark, sf_dir):
    return dot_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("cosine") >= 0.2).alias("kept"), F.round(F.avg("cosine"), 6).alias("mean"))


SIGN = "CASE WHEN ('0x' || substr(md5(concat_ws(':', '{0}', o, k)), 1, 13))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END / sqrt({1}.0)"


def signs(spark, seed: int, rows: int, cols: int):
    """A random sign matrix of a seed: a table of rows * cols, whatever the data."""
    grid = spark.range(rows).withColumnRenamed("id", "o").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cols - 1).cast("bigint"))))
    return grid.withColumn("p", F.when(hashing.hash_long(seed, "o", "k") % 2 == 0, 1.0).otherwise(-1.0) / F.sqrt(F.lit(float(rows))))


def projected(spark, sf_dir, rank: int):
    spread = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    return spread.join(F.broadcast(signs(spark, 31, rank, 64)), "k").groupBy("vec_id", "o").agg(F.sum(F.col("x").cast("double") * F.col("p")).alias("y"))


PROJ = f"p AS (SELECT o, k, {SIGN.format(31, '{0}')} AS p FROM range({{0}}) a(o), range(64) b(k)), y AS (SELECT vec_id, o, sum(embedding[k + 1]::DOUBLE * p) AS y FROM embeddings, p GROUP BY vec_id, o)"


@query("rademacher_projection", f"WITH {PROJ.format(8)} SELECT vec_id, o, round(y, 6) AS y FROM y")
def rademacher_projection(spark, sf_dir):
    return projected(spark, sf_dir, 8).withColumn("y", F.round("y", 6))


@query("reference_dots", f"WITH {PROJ.format(8)} SELECT a.vec_id AS ref, b.vec_id, round(sum(a.y * b.y), 6) AS dot FROM y a JOIN y b ON a.o = b.o AND a.vec_id < 4 AND b.vec_id >= 4 GROUP BY ALL")
def reference_dots(spark, sf_dir):
    y = projected(spark, sf_dir, 8)
    first = y.filter("vec_id < 4").select(F.col("vec_id").alias("ref"), "o", F.col("y").alias("z"))
    return y.filter("vec_id >= 4").join(F.broadcast(first), "o").groupBy("ref", "vec_id").agg(F.round(F.sum(F.col("y") * F.col("z")), 6).alias("dot"))


RMSE = "(SELECT {0} AS rank, ref, sqrt(avg((d - e) * (d - e))) AS rmse FROM (SELECT a.vec_id AS ref, b.vec_id, sum(a.y * b.y) AS d FROM y{0} a JOIN y{0} b ON a.o = b.o AND a.vec_id < 4 AND b.vec_id >= 4 GROUP BY ALL) JOIN x USING (ref, vec_id) GROUP BY ref)"


def rmse_sql() -> str:
    parts = ", ".join(PROJ.format(r).replace("p AS", f"p{r} AS").replace(", y AS", f", y{r} AS").replace("embeddings, p ", f"embeddings, p{r} ") for r in (8, 32))
    exact = "x AS (SELECT a.vec_id AS ref, b.vec_id, sum(a.embedding[k + 1]::DOUBLE * b.embedding[k + 1]::DOUBLE) AS e FROM embeddings a, embeddings b, range(64) r(k) WHERE a.vec_id < 4 AND b.vec_id >= 4 GROUP BY ALL)"
    return f"WITH {parts}, {exact}, z AS (SELECT sqrt(avg(e * e)) AS z FROM x) SELECT rank::BIGINT AS rank, round(avg(rmse), 6) AS mean, round(stddev_pop(rmse), 6) AS std, round(CASE WHEN (SELECT z FROM z) > 0 THEN avg(rmse) / (SELECT z FROM z) ELSE 'inf'::DOUBLE END, 6) AS relative FROM ({RMSE.format(8)} UNION ALL {RMSE.format(32)}) GROUP BY rank"


@query("projection_error", rmse_sql())
def projection_error(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    exact = e.filter("vec_id >= 4").join(F.broadcast(e.filter("vec_id < 4").select(F.col("vec_id").alias("ref"), F.col("x").alias("z")))).select("ref", "vec_id", S.dot(F.col("x"), F.col("z")).alias("e"))
    out = None
    for rank in (8, 32):
        y = projected(spark, sf_dir, rank)
        first = y.filter("vec_id < 4").select(F.col("vec_id").alias("ref"), "o", F.col("y").alias("z"))
        dots = y.filter("vec_id >= 4").join(F.broadcast(first), "o").groupBy("ref", "vec_id").agg(F.sum(F.col("y") * F.col("z")).alias("d"))
        part = dots.join(exact, ["ref", "vec_id"]).groupBy(F.lit(rank).cast("bigint").alias("rank"), "ref").agg(F.sqrt(F.avg((F.col("d") - F.col("e")) ** 2)).alias("rmse"))
        out = part if out is None else out.unionByName(part)
    # one row
    size = F.broadcast(exact.agg(F.sqrt(F.avg(F.col("e") ** 2)).alias("z")))
    total = out.groupBy("rank").agg(F.avg("rmse").alias("mean"), F.stddev_pop("rmse").alias("std")).join(size)
    return total.select("rank", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.when(F.col("z") > 0, F.round(F.col("mean") / F.col("z"), 6)).otherwise(float("inf")).alias("relative"))


@query("layer_slices", "SELECT p_partkey, p_size, (sum(p_size) OVER (ORDER BY p_partkey) - p_size)::BIGINT AS slice_start, sum(p_size) OVER (ORDER BY p_partkey)::BIGINT AS slice_end FROM part WHERE contains(p_type, 'A') OR contains(p_type, 'E')")
def layer_slices(spark, sf_dir):
    kept = P.matching_layers(table(spark, sf_dir, "part"), ["A", "E"], "p_type").select("p_partkey", "p_size")
    placed = ranking.running_sum(kept, "p_partkey", ["p_partkey"], F.col("p_size"), "slice_start")
    return placed.withColumn("slice_end", F.col("slice_start") + F.col("p_size"))


@query("projection_sizes", """WITH b AS (SELECT p_partkey, p_size::BIGINT AS ni, 8 + p_partkey % 64 AS no, greatest(1, least(p_size, round(sqrt(256.0) * sqrt((8 + p_partkey % 64) / p_size::DOUBLE))::BIGINT)) AS ki FROM part), g AS (SELECT p_partkey, ni, no, ki + d AS ki, e FROM b, range(-2, 3) x(d), range(-2, 3) y(e)),
h AS (SELECT p_partkey, ni, no, ki, greatest(1, least(no, 256 // greatest(ki, 1) + e)) AS ko, e FROM g WHERE ki BETWEEN 1 AND ni) SELECT p_partkey, ni, no, min(abs(ki * ko - 256))::BIGINT AS error FROM h GROUP BY ALL""")
def projection_sizes(spark, sf_dir):
    """Parts as layers: how near to 256 numbers a projection's two sizes can come."""
    grid = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("ni"), (F.col("p_partkey") % 64 + 8).alias("no"))
    ki = F.greatest(F.lit(1).cast("bigint"), F.least(F.col("ni"), F.round(F.sqrt(F.lit(256.0)) * F.sqrt(F.col("no") / F.col("ni"))).cast("bigint")))
    near = lambda: F.explode(F.sequence(F.lit(-2).cast("bigint"), F.lit(2).cast("bigint")))
    tried = grid.withColumn("ki", ki).withColumn("d", near()).withColumn("e", near()).withColumn("ki", F.col("ki") + F.col("d")).filter("ki between 1 and ni")
    ko = F.greatest(F.lit(1).cast("bigint"), F.least(F.col("no"), F.expr("256 div ki") + F.col("e")))
    return tried.groupBy("p_partkey", "ni", "no").agg(F.min(F.abs(F.col("ki") * ko - 256)).alias("error"))


@query("dense_projection", f"WITH {FL}, p AS (SELECT o, k, {SIGN.format(41, 4)} AS p FROM range(4) a(o), range(8) b(k)), r AS (SELECT sample_id, layer, t, side, o, sum(p * x) AS y FROM fl JOIN p ON p.k = fl.i GROUP BY ALL) SELECT b.sample_id, b.layer, b.o AS ko, a.o AS ki, round(sum(b.y * a.y), 6) AS y FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.layer = b.layer AND a.t = b.t AND a.side = 0 AND b.side = 1 GROUP BY ALL")
def dense_projection(spark, sf_dir):
    p = np.array([[r.p for r in sorted(g, key=lambda r: r.k)] for g in _rows_by(signs(spark, 41, 4, 8).collect(), "o")])
    low = S.factors(table(spark, sf_dir, "embeddings")).select("sample_id", F.col("layer").cast("bigint").alias("layer"), S.times(p, F.col("a")).alias("a"), S.times(p, F.col("b")).alias("b"))
    spread = low.select("sample_id", "layer", F.posexplode("b").alias("ko", "y"), "a").select("sample_id", "layer", F.col("ko").cast("bigint").alias("ko"), "y", F.posexplode("a").alias("ki", "x"))
    return spread.groupBy("sample_id", "layer", "ko", F.col("ki").cast("bigint").alias("ki")).agg(F.round(F.sum(F.col("y") * F.col("x")), 6).alias("y"))


def _rows_by(rows, key):
    found: dict = {}
    for r in rows:
        found.setdefault(r[key], []).append(r)
    return [found[k] for k in sorted(found)]

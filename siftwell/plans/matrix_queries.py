"""Queries over block matrices, convolutions, similarities, step statistics and the stream of data values."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import blocks as B
from siftwell.operators import dynamics, similar
from siftwell.operators import projection as P
from siftwell.operators import scoring as S
from siftwell.plans.corpus_queries import table
from siftwell.plans.registry import query
from siftwell.plans.run_queries import hashed01
from siftwell.plans.scoring_queries import FL, GRAD, SCORED, fixture
from siftwell.sources.storage import shared_folder
from siftwell.streaming import ledger


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


# projections and similarities


def gram_schmidt(rows: int, cols: int, seed: int) -> str:
    """Orthonormal rows one after another, from the numbers that the projection is made of."""
    made = [f"g AS (SELECT o, k, sqrt(-2 * ln({hashed01(f'{seed}u', 'o', 'k')})) * cos(2 * pi() * {hashed01(f'{seed}v', 'o', 'k')}) AS x FROM range({rows}) a(o), range({cols}) b(k))"]
    for j in range(rows):
        less = "".join(f" - (SELECT sum(g.x * q{i}.q) FROM g JOIN q{i} USING (k) WHERE o = {j}) * q{i}.q" for i in range(j))
        made.append(f"v{j} AS (SELECT g.k, g.x{less} AS x FROM g{''.join(f' JOIN q{i} ON q{i}.k = g.k' for i in range(j))} WHERE g.o = {j})")
        made.append(f"q{j} AS (SELECT k, x / (SELECT sqrt(sum(x * x)) FROM v{j}) AS q FROM v{j})")
    return ", ".join([*made, "q AS (" + " UNION ALL ".join(f"SELECT {j} AS o, k, q FROM q{j}" for j in range(rows)) + ")"])


@query("orthonormal_projection", f"WITH {gram_schmidt(4, 64, 53)} SELECT vec_id, o::BIGINT AS o, round(sum(embedding[k + 1]::DOUBLE * q), 6) AS y FROM embeddings, q GROUP BY ALL")
def orthonormal_projection(spark, sf_dir):
    spread = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    matrix = P.initializer("orthonormal")(spark, 4, 64, 53)
    return spread.join(matrix, "k").groupBy("vec_id", "o").agg(F.round(F.sum(F.col("x").cast("double") * F.col("p")), 6).alias("y"))


@query("most_similar", "WITH d AS (SELECT a.vec_id AS id, b.vec_id AS other, list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) AS dot FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT id, rank, other, round(dot, 6) AS dot FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dot DESC, other) AS rank FROM d) WHERE rank <= 10")
def most_similar(spark, sf_dir):
    """The ten vectors nearest to each one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return similar.most_similar(e, e, 10, "vec_id", "x", apart=True).withColumn("dot", F.round("dot", 6))


# convolutions, and layers that hold their weights input by output

CONV = """e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), ca AS (SELECT vec_id, label, p, j AS i, e[(p // 6 + j // 3) * 8 + p % 6 + j % 3 + 1] AS a FROM e, range(36) r(p), range(9) q(j)), cb AS (SELECT vec_id, p, c AS o, e[c * 28 + p + 1] AS b FROM e, range(36) r(p), range(2) q(c)),
cg AS (SELECT ca.vec_id, label, o, i, sum(a * b) AS g FROM ca JOIN cb ON ca.vec_id = cb.vec_id AND ca.p = cb.p GROUP BY ALL)"""


def convolved(spark, sf_dir):
    """The vectors as images of 8 x 8 under a kernel of 3 x 3, with two output channels' gradients."""
    images = vectors(spark, sf_dir).select(F.col("vec_id").alias("sample_id"), F.expr("vec_id div 16").alias("step"), "label", F.lit("conv").alias("layer"), "x", F.array(F.slice("x", 1, 36), F.slice("x", 29, 36)).alias("g"))
    return B.conv_rows(images, 1, 8, 8, 3)


@query("conv2d_gradient", f"WITH {CONV} SELECT o::BIGINT AS o, i::BIGINT AS i, round(sum(g) / count(*), 9) AS g FROM cg WHERE label = 2 GROUP BY ALL")
def conv2d_gradient(spark, sf_dir):
    return B.entries(B.gradient(convolved(spark, sf_dir).filter("label = 2"))).select("o", "i", F.round("x", 9).alias("g"))


@query("conv2d_dot", f"WITH {CONV}, v AS (SELECT o, i, sum(g) / count(*) AS v FROM cg WHERE label = 0 GROUP BY ALL) SELECT vec_id AS sample_id, vec_id // 16 AS step, round(sum(g * v), 6) AS score FROM cg JOIN v USING (o, i) WHERE label <> 0 GROUP BY ALL")
def conv2d_dot(spark, sf_dir):
    """36 places of 18 weights: the gradient is cheaper than pairs of places."""
    rows = convolved(spark, sf_dir)
    return B.dots(rows.filter("label <> 0"), rows.filter("label = 0")).withColumn("score", F.round("score", 6))


@query("conv1d_dot", f"""WITH {FL}, d AS (SELECT layer, o, i, g AS w FROM ({GRAD.format(0)})), s AS ({SCORED}), tb AS (SELECT sample_id, label, layer, i, sum(x) AS x FROM fl WHERE side = 1 GROUP BY ALL), vb AS (SELECT layer, i, avg(x) AS v FROM tb WHERE label = 0 GROUP BY ALL),
b AS (SELECT sample_id, sum(x * v) AS score FROM tb JOIN vb USING (layer, i) WHERE label <> 0 GROUP BY sample_id) SELECT s.sample_id, s.step, round((s.score + b.score) * 1e2, 6) AS score FROM s JOIN b ON s.sample_id = b.sample_id""")
def conv1d_dot(spark, sf_dir):
    """Weights and bias; two tokens of 64 weights: pairs of tokens are cheaper than the gradient."""
    _, candidates, proxy = fixture(spark, sf_dir)
    return B.conv1d_dots(candidates, proxy).withColumn("score", F.round(F.col("score") * 1e2, 6))


# step statistics

PIECES = {"before": 1, "after": 13, "grad": 25, "fast": 37, "slow": 49}
STATS = ("norm", "grad_norm", "update_norm", "relative_update", "angular_update", "rms", "grad_rms", "update_rms", "fast_rms", "slow_rms", "fast_slow_ratio")


@query("step_statistics", """WITH x AS (SELECT vec_id // 100 AS step, label AS layer, vec_id % 100 AS neuron, label = 7 AS scalar, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
s AS (SELECT step, layer, neuron, scalar, 12 AS n, e[1:12] AS p, e[13:24] AS a, e[25:36] AS r, CASE WHEN layer <> 3 THEN e[37:48] END AS f, CASE WHEN layer <> 3 THEN e[49:60] END AS w FROM x),
t AS (SELECT *, list_dot_product(p, p) AS pp, list_dot_product(a, a) AS aa, list_dot_product(p, a) AS pa, list_dot_product(r, r) AS gg, list_sum(list_transform(f, lambda v: v * v)) AS ff, list_sum(list_transform(w, lambda v: v * v)) AS ss, list_sum(list_transform(range(1, 13), lambda k: (a[k] - p[k]) * (a[k] - p[k]))) AS dd FROM s),
g AS (SELECT step, layer, neuron, coalesce(scalar, false) AS scalar, grouping(neuron) AS gn, grouping(layer) AS gl, sum(n) AS n, sum(pp) AS pp, sum(aa) AS aa, sum(pa) AS pa, sum(gg) AS gg, sum(ff) AS ff, sum(ss) AS ss, sum(dd) AS dd FROM t GROUP BY GROUPING SETS ((step, layer, scalar, neuron), (step, layer, scalar), (step))),
h AS (SELECT *, CASE WHEN gl = 1 THEN 'step' WHEN gn = 1 THEN 'layer' ELSE 'neuron' END AS level FROM g)
SELECT level, step, layer, neuron, CASE WHEN NOT scalar THEN round(sqrt(pp), 6) END AS norm, CASE WHEN NOT scalar THEN round(sqrt(gg), 6) END AS grad_norm, CASE WHEN NOT scalar THEN round(sqrt(dd), 6) END AS update_norm, CASE WHEN NOT scalar THEN round((sqrt(dd) + 1e-8) / (sqrt(pp) + 1e-8), 6) END AS relative_update,
CASE WHEN NOT scalar THEN round(acos(greatest(least(pa / greatest(sqrt(pp) * sqrt(aa), 1e-8), 1), -1)), 6) END AS angular_update, round(sqrt(pp / n), 6) AS rms, round(sqrt(gg / n), 6) AS grad_rms, round(sqrt(dd / n), 6) AS update_rms, round(sqrt(ff / n), 6) AS fast_rms, round(sqrt(ss / n), 6) AS slow_rms, round(sqrt(ss / ff), 6) AS fast_slow_ratio FROM h WHERE NOT scalar OR level = 'layer'""")
def step_statistics(spark, sf_dir):
    """The vectors as neurons of layers by label: parameters before and after a step, gradients and two moments; one layer is of vectors, one has no moments."""
    v = vectors(spark, sf_dir)
    pieces = {name: F.slice("x", at, 12) for name, at in PIECES.items()}
    held = lambda name: F.when(F.col("label") != 3, pieces[name]).alias(name)
    rows = v.select(F.expr("vec_id div 100").alias("step"), F.col("label").alias("layer"), (F.col("vec_id") % 100).alias("neuron"), (F.col("label") == 7).alias("is_scalar"), *[pieces[n].alias(n) for n in ("before", "after", "grad")], held("fast"), held("slow"))
    return dynamics.step_statistics(rows).select("level", "step", "layer", "neuron", *[F.round(c, 6).alias(c) for c in STATS])


CURVE = "s AS (SELECT event_type, event_id // 10 AS step, event_id % 10 AS channel, value FROM events), c AS (SELECT * FROM s WHERE channel < 6)"


@query("shortened_curves", f"""WITH {CURVE}, b AS (SELECT event_type, step // 20 AS block, channel, avg(value) AS m, sqrt(avg(value * value)) AS r, arg_min(value, step) AS f FROM c GROUP BY ALL), w AS (SELECT event_type, step // 20 AS block, avg(value) AS m, sqrt(avg(value * value)) AS r FROM c GROUP BY ALL)
SELECT 'mean' AS reducer, event_type, block, channel, round(m, 6) AS value FROM b UNION ALL SELECT 'rms', event_type, block, channel, round(r, 6) FROM b UNION ALL SELECT 'first', event_type, block, channel, round(f, 6) FROM b UNION ALL SELECT 'global_mean', event_type, block, NULL, round(m, 6) FROM w UNION ALL SELECT 'global_rms', event_type, block, NULL, round(r, 6) FROM w""")
def shortened_curves(spark, sf_dir):
    """Events as curves of ten channels, of which six are kept, in blocks of 20 steps by each reducer."""
    s = table(spark, sf_dir, "events").select("event_type", F.expr("event_id div 10").alias("step"), (F.col("event_id") % 10).alias("channel"), "value")
    parts = [dynamics.shortened(s, ["event_type"], "step", "channel", "value", 20, r, most_channels=6).select(F.lit(r).alias("reducer"), "event_type", "block", "channel", F.round("value", 6).alias("value")) for r in dynamics.REDUCERS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# data values


@query("data_value_stream", "WITH v AS (SELECT k, avg(embedding[k + 1]::DOUBLE) AS m FROM embeddings, range(64) r(k) WHERE label = 0 GROUP BY k) SELECT vec_id AS index, round(0.1 * sum(embedding[k + 1]::DOUBLE * m), 6) AS value FROM embeddings JOIN v ON true WHERE label <> 0 GROUP BY vec_id")
def data_value_stream(spark, sf_dir):
    """First-order data values by a stream whose sink takes each micro-batch once; one that comes again adds nothing."""
    folder = shared_folder(spark, "value-stream")
    e = vectors(spark, sf_dir)
    # one row
    mean = F.broadcast(e.filter("label = 0").select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mean")))
    samples = e.filter("label <> 0").select("vec_id", "x")
    samples.write.option("maxRecordsPerFile", 20_000).parquet(f"{folder}/samples")
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/samples")
    ledger.run_once(stream, f"{folder}/values", lambda rows: rows.join(mean).select(F.col("vec_id").alias("index"), (0.1 * S.dot(F.col("x"), F.col("mean"))).alias("value")), f"{folder}/state")
    again = spark.createDataFrame([(-1, 0.0)], "index long, value double")
    ledger.append_once(again, 0, f"{folder}/values")
    return ledger.committed(spark, f"{folder}/values", "index long, value double").select("index", F.round("value", 6).alias("value"))

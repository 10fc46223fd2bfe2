"""Queries over optimizer state, gradients of vector parameters, tasks' texts, images and throughput."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import hashing, ranking
from siftwell.operators import corpus as C
from siftwell.operators import blocks, layers, projection, runs, scoring, selection, updates
from siftwell.plans.corpus_queries import table
from siftwell.plans.registry import query
from siftwell.plans.run_queries import hashed
from siftwell.plans.scoring_queries import CORRECTED, FL, GRAD, SCORED, rotated_scores
from siftwell.sources import corpora

# tasks, splits and images

#: The columns of ``part`` that stand for the first, second and third column of a task.
STAND_INS = ("p_name", "p_brand", "p_type")
JOINED = {"humaneval": "p_name || ' ' || chr(10) || ' ' || p_brand", "kodcode": "p_name || chr(10) || p_brand", "gsm8k": "p_name || chr(10) || p_brand", "logiqa": "p_name || ' ' || p_brand || ' ' || p_type", "sciq": "p_name || p_brand || p_type"}
SPACED = ("mathqa", "medqa", "arc_easy", "arc_challenge", "hellaswag", "piqa")


@query("task_templates", " UNION ALL ".join(f"SELECT p_partkey, '{t}' AS task, md5({JOINED.get(t, 'p_name || chr(32) || p_brand')}) AS digest FROM part" for t in (*JOINED, *SPACED)))
def task_templates(spark, sf_dir):
    """The text of every task, from the same three columns."""
    p = table(spark, sf_dir, "part").select("p_partkey", *STAND_INS)
    out = None
    for task, (columns, _) in corpora.TASKS.items():
        named = p.select("p_partkey", *[F.col(c).alias(k) for c, k in zip(STAND_INS, columns, strict=False)])
        one = corpora.task_text(named, task).select("p_partkey", F.lit(task).alias("task"), F.md5(F.col("text").cast("binary")).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


@query("split_names", "SELECT split, count(*)::BIGINT AS n FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'train' ELSE 'val' END AS split FROM part) GROUP BY split")
def split_names(spark, sf_dir):
    own = F.element_at(F.array(*[F.lit(x) for x in ("train", "test", "validation")]), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(corpora.split_name(own).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("image_crops", f"WITH e AS (SELECT event_id, 200 + event_id % 300 AS w, 220 + event_id % 170 AS h, {hashed('71', 'event_id')} AS draw FROM events), s AS (SELECT *, CASE WHEN w >= h THEN ceil(256::DOUBLE / h * w)::BIGINT ELSE 256 END AS nw, CASE WHEN w >= h THEN 256 ELSE ceil(256::DOUBLE / w * h)::BIGINT END AS nh FROM e WHERE least(w, h) >= 256) SELECT event_id, nw::BIGINT AS new_width, nh::BIGINT AS new_height, draw % (nw - 255) AS \"left\", draw % (nh - 255) AS top, round((event_id % 256) / 255.0::DOUBLE * 2 - 1, 9) AS pixel FROM s")
def image_crops(spark, sf_dir):
    """Events as images' sizes: what each is resized to and where the square is cut out."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 300 + 200).alias("w"), (F.col("event_id") % 170 + 220).alias("h"), hashing.hash_long(71, "event_id").alias("draw"))
    plan = e.select("event_id", C.image_crop(F.col("w"), F.col("h"), 256, F.col("draw")).alias("x")).filter("x is not null")
    return plan.select("event_id", "x.*", F.round(C.pixel_value(F.col("event_id") % 256), 9).alias("pixel"))


# runs

SECONDS = "SELECT event_type, event_id, value, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS s FROM events"


@query("throughput_metrics", f"SELECT event_type, event_id, round(8192 / (s * 4), 6) AS tps, round(100 * 6e9 * (8192 / (s * 4)) / 3.12e14, 6) AS mfu, round(6e9 * (8192 / (s * 4)) / 1e12, 6) AS tflops, round(100 * (abs(value) / 100) / s, 6) AS loading_share FROM ({SECONDS}) WHERE s > 0")
def throughput_metrics(spark, sf_dir):
    """Each event logs 8,192 tokens since the event of its type before, on ranks of which 4 share a model."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value", F.col("ts").cast("timestamp").cast("double").alias("at"))
    # times ascend, so the latest before a row is that of the row before it
    e = ranking.running(e, "at", ["at", "event_id"], F.col("at"), "before", ["event_type"], "max").withColumn("s", F.col("at") - F.col("before")).filter("s > 0")
    rates = runs.throughput(F.col("s"), F.lit(8192), F.abs("value") / 100, 6e9, 3.12e14, 4)
    return e.select("event_type", "event_id", *[F.round(c, 6).alias(k) for k, c in rates.items()])


@query("module_weight_deltas", "WITH x AS (SELECT 'layers.' || label AS module, vec_id, k, embedding[k + 1]::DOUBLE AS a, embedding[64 - k]::DOUBLE AS b FROM embeddings, range(64) r(k) WHERE vec_id % 3 <> 0), n AS (SELECT module, vec_id, sqrt(sum((a - b) * (a - b))) AS d, sqrt(sum(a * a)) AS n FROM x GROUP BY ALL) SELECT module, count(*)::BIGINT AS n, round(avg(d), 6) AS magnitude, round(avg(d / (n + 1e-8)), 6) AS relative FROM n GROUP BY module")
def module_weight_deltas(spark, sf_dir):
    """Vectors as parameters named by label and id; before, two thirds of them were there, the other way round."""
    now = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("layers."), F.col("label").cast("string"), F.lit(".w"), F.col("vec_id").cast("string")).alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("w"))
    found = runs.weight_deltas(now, now.filter("vec_id % 3 <> 0").withColumn("w", F.reverse("w")))
    return found.select("module", "n", F.round("magnitude", 6).alias("magnitude"), F.round("relative", 6).alias("relative"))


GUESS = "greatest(1, least(ni, round_even(16::DOUBLE * sqrt(no / ni::DOUBLE), 0)::BIGINT))"


@query("projection_choice", f"WITH l AS (SELECT p_partkey, p_size::BIGINT AS ni, 1 + p_partkey % 90 AS no FROM part), g AS (SELECT *, {GUESS} AS gi FROM l), h AS (SELECT *, greatest(1, least(no, greatest(1, 256 // gi))) AS go FROM g), c AS (SELECT p_partkey, ni, no, gi AS ki, go AS ko, 0 AS turn FROM h UNION ALL SELECT p_partkey, ni, no, gi + d, go + e, (d + 2) * 5 + e + 3 FROM h, range(-2, 3) a(d), range(-2, 3) b(e)) SELECT p_partkey, ki::BIGINT AS k_in, ko::BIGINT AS k_out FROM c WHERE ki BETWEEN 1 AND ni AND ko BETWEEN 1 AND no QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(ki * ko - 256), turn) = 1")
def projection_choice(spark, sf_dir):
    """Parts as layers: both sizes of a projection to 256 numbers."""
    p = table(spark, sf_dir, "part").select("p_partkey", projection.choose_sizes(F.col("p_size"), F.col("p_partkey") % 90 + 1, 256).alias("k"))
    return p.select("p_partkey", "k.*")


# optimizer state


@query("adopt_lagged", "WITH s AS (SELECT vec_id, label, embedding[1]::DOUBLE AS g, power(embedding[4]::DOUBLE, 2) + 0.01 AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t FROM embeddings), p AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY label ORDER BY t), v) AS pv FROM s) SELECT vec_id, t, round(g / greatest(sqrt(pv / (1 - power(0.999::DOUBLE, greatest(t - 1, 1)))), 1e-8), 6) AS scaled FROM p")
def adopt_lagged(spark, sf_dir):
    """Vectors as a parameter's states (by label), each scaled by the moment of the step before."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("g"), (F.col("embedding")[3].cast("double") ** 2 + 0.01).alias("v"))
    states = updates.with_previous(ranking.global_rank(e, "vec_id", ["vec_id"], "t", ["label"]), "label", "t")
    return states.select("vec_id", "t", F.round(F.col("g") * updates.adopt_kernel(F.col("previous"), F.col("t")), 6).alias("scaled"))


@query("mars_raw_moment", "WITH s AS (SELECT label, embedding[1]::DOUBLE AS g, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT label, round(sum(0.001 * power(0.999::DOUBLE, n - t) * g * g), 12) AS v FROM s GROUP BY label")
def mars_raw_moment(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("g"))
    moments = updates.raw_moment(ranking.global_rank(e, "vec_id", ["vec_id"], "t", ["label"]), "label", "t", "g")
    return moments.withColumn("v", F.round("v", 12))


def stored_sql(rank: int) -> str:
    """Scores in each layer's own basis: reflections of the means of label 1, or their first rows."""
    basis = "z AS (SELECT layer, side, sum(m * m) AS s FROM m1 GROUP BY ALL), h AS (SELECT x.layer, x.side, x.i AS o, y.i AS i, CASE WHEN x.i = y.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 2.0 * x.m * y.m / z.s AS h FROM m1 x JOIN m1 y ON x.layer = y.layer AND x.side = y.side JOIN z ON z.layer = x.layer AND z.side = x.side)"
    return f"""WITH {FL}, {basis}, rv AS (SELECT v1.layer, v1.side, h.o AS i, sum(h.h * v1.m) AS m FROM v1 JOIN h ON h.i = v1.i AND h.layer = v1.layer AND h.side = v1.side GROUP BY ALL), rf AS (SELECT sample_id, step, label, fl.layer, t, fl.side, h.o AS i, sum(h.h * x) AS x FROM fl JOIN h ON h.i = fl.i AND h.layer = fl.layer AND h.side = fl.side WHERE h.o < {rank} GROUP BY ALL),
d AS (SELECT st.layer, st.o, st.i, va.m * vb.m / ({CORRECTED} + 1e-8) AS w FROM st JOIN rv va ON va.layer = st.layer AND va.side = 0 AND va.i = st.i JOIN rv vb ON vb.layer = st.layer AND vb.side = 1 AND vb.i = st.o)
SELECT sample_id, step, round(score * 1e3, 6) AS score FROM ({SCORED.replace("fl a", "rf a").replace("fl b", "rf b")})"""


def register_stored(name: str, rank: int) -> None:
    @query(name, stored_sql(rank))
    def run(spark, sf_dir):
        # each layer's own basis: reflections of the means of label 1
        means = blocks.layer_means(scoring.factors(table(spark, sf_dir, "embeddings")).filter("label = 1"))
        return rotated_scores(spark, sf_dir, *[means.select("layer", F.col(c).alias("u")) for c in ("b", "a")], rank)


register_stored("score_soap_stored", 8)
register_stored("score_galore_stored", 4)


# vector parameters: a vector's halves as two tokens' input and gradient of 16 numbers

VECTORS = """x AS (SELECT vec_id AS sample_id, label, t, i, embedding[t * 16 + i + 1]::DOUBLE AS a, embedding[32 + t * 16 + i + 1]::DOUBLE AS b FROM embeddings, range(2) p(t), range(16) q(i)),
n AS (SELECT *, (a - avg(a) OVER w) / sqrt(var_pop(a) OVER w + 1e-5) AS h, a / sqrt(avg(a * a) OVER w + 1e-5) AS r FROM x WINDOW w AS (PARTITION BY sample_id, t)),
g AS (SELECT sample_id, label, 'norm' AS layer, 'weight' AS part, 0::BIGINT AS token, i, sum(b * h) AS g FROM n GROUP BY ALL UNION ALL SELECT sample_id, label, 'norm', 'bias', 0, i, sum(b) FROM n GROUP BY ALL UNION ALL SELECT sample_id, label, 'rms', 'weight', 0, i, sum(b * r) FROM n GROUP BY ALL UNION ALL SELECT sample_id, label, 'embed', 'weight', t * (label % 2) AS token, i, sum(b) FROM n GROUP BY ALL)"""
TOTALS = f"""WITH {VECTORS}, v AS (SELECT layer, part, token, i, sum(g) / (SELECT count(DISTINCT sample_id) FROM g WHERE sample_id % 7 = 0) AS v FROM g WHERE sample_id % 7 = 0 GROUP BY ALL),
s AS (SELECT sample_id, sum(g * coalesce(v, 0)) AS dot, sqrt(sum(g * g)) AS train_grad_norm, (SELECT sqrt(sum(v * v)) FROM v) AS val_grad_norm FROM g LEFT JOIN v USING (layer, part, token, i) WHERE sample_id % 7 <> 0 GROUP BY sample_id)"""


def vector_rows(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    halves = F.array(*[F.struct(F.slice(x, t * 16 + 1, 16).alias("a"), F.slice(x, 33 + t * 16, 16).alias("b"), (F.col("label") % 2 * t).cast("bigint").alias("tok")) for t in range(2)])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", F.explode(halves).alias("h")).select("sample_id", "label", "h.*")


def vector_gradients(rows):
    kinds = {"norm": "layernorm", "rms": "rmsnorm", "embed": "embedding"}
    return [layers.vector_gradients(rows.withColumn("layer", F.lit(k)), kind) for k, kind in kinds.items()]


@query("parameter_gradients", f"WITH {VECTORS} SELECT layer, part, token::BIGINT AS token, i::BIGINT AS i, round(sum(g) / (SELECT count(DISTINCT sample_id) FROM g WHERE label = 2), 9) AS g FROM g WHERE label = 2 GROUP BY layer, part, token, i")
def parameter_gradients(spark, sf_dir):
    parts = [layers.mean_gradients(g) for g in vector_gradients(vector_rows(spark, sf_dir).filter("label = 2"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("g", F.round("g", 9))


@query("conv1d_gradient", f"WITH {FL} SELECT layer, i::BIGINT AS o, o::BIGINT AS i, round(g, 9) AS g FROM ({GRAD.format(2)})")
def conv1d_gradient(spark, sf_dir):
    g = layers.conv1d_gradient(scoring.factors(table(spark, sf_dir, "embeddings")).filter("label = 2"))
    return g.select(*[F.col(c).cast("bigint").alias(c) for c in ("layer", "o", "i")], F.round("g", 9).alias("g"))


@query("embedding_norms", f"WITH {VECTORS} SELECT sample_id, round(sum(g * g), 6) AS norm2 FROM g WHERE layer = 'embed' GROUP BY sample_id")
def embedding_norms(spark, sf_dir):
    return layers.squared_norms(vector_gradients(vector_rows(spark, sf_dir))[2]).withColumn("norm2", F.round("norm2", 6))


def logged(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    return layers.dot_totals(vector_gradients(rows.filter("sample_id % 7 <> 0")), vector_gradients(rows.filter("sample_id % 7 = 0")))


@query("dot_totals", f"{TOTALS} SELECT sample_id, round(dot, 6) AS dot, round(train_grad_norm, 6) AS train_grad_norm, round(val_grad_norm, 6) AS val_grad_norm FROM s")
def dot_totals(spark, sf_dir):
    return logged(spark, sf_dir).select("sample_id", *[F.round(c, 6).alias(c) for c in ("dot", "train_grad_norm", "val_grad_norm")])


@query("replay_cosine_logged", f"{TOTALS} SELECT sample_id, round(c, 6) AS cosine FROM (SELECT sample_id, round(dot / greatest(train_grad_norm * val_grad_norm, 1e-12), 9) AS c FROM s) WHERE c >= 0.1")
def replay_cosine_logged(spark, sf_dir):
    rows = logged(spark, sf_dir)
    return rows.select("sample_id", F.round(selection.replay_metric(rows, "cosine"), 9).alias("c")).filter("c >= 0.1").select("sample_id", F.round("c", 6).alias("cosine"))

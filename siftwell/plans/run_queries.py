"""Queries over schedules, run logs, routing, projections, optimizer updates and what runs write to files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siftwell.functions import hashing, ranking, tokens
from siftwell.operators import corpus as C
from siftwell.operators import projection as P
from siftwell.operators import routing as R
from siftwell.operators import runs as RUN
from siftwell.operators import schedules as S
from siftwell.operators import blocks, scoring, updates
from siftwell.plans.corpus_queries import FLAT, IDS, KEPT, L, table
from siftwell.plans.metric_queries import LOGIT, SOFT, logits
from siftwell.plans.registry import query
from siftwell.plans.scoring_queries import FL
from siftwell.sinks import records, token_files
from siftwell.sources import corpora
from siftwell.sources.storage import shared_folder


def step():
    return F.col("event_id")


def hashed(seed: str, *keys: str) -> str:
    """DuckDB: the integer of 52 bits of a seed and keys."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT"


def hashed01(seed: str, *keys: str) -> str:
    return f"(({hashed(seed, *keys)}::DOUBLE + 0.5) / 4503599627370496.0)"


# schedules: each event is a step


@query("cos_inf_schedule", "SELECT event_id, round(CASE WHEN event_id < 100 THEN event_id / 100.0::DOUBLE + (1 - event_id / 100.0::DOUBLE) / 10 WHEN event_id < 600 THEN 0.01 + 0.495 * (1 + cos(pi() * (event_id - 100) / 500.0)) ELSE 0.01 END, 9) AS lr FROM events")
def cos_inf_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(S.cos_inf(step(), 800, 100, 10, 10, 200), 9).alias("lr"))


WSD_T = "greatest((event_id - 720) / 180.0::DOUBLE, 0)"
WSD = {
    "linear": f"0.1 + 0.9 * (1 - {WSD_T})", "exp": f"power(0.1::DOUBLE, {WSD_T})", "cosine": f"0.1 + 0.45 * (1 + cos(pi() * {WSD_T}))", "square": f"0.1 + 0.9 * (1 - power({WSD_T}, 2))", "sqrt": f"0.1 + 0.9 * (1 - sqrt({WSD_T}))",
    "mirror_cosine": f"2 * (0.1 + 0.9 * (1 - {WSD_T})) - (0.1 + 0.45 * (1 + cos(pi() * {WSD_T})))",
}


@query("wsd_schedule_all", f"SELECT event_id, kind, round(CASE WHEN event_id < 100 THEN event_id / 100.0::DOUBLE + (1 - event_id / 100.0::DOUBLE) / 100 WHEN event_id < 720 THEN 1 WHEN event_id >= 900 THEN 0.1 ELSE CASE kind {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {x}' for k, x in WSD.items())} END END, 9) AS lr FROM events, (SELECT unnest({list(WSD)}) AS kind)")
def wsd_schedule_all(spark, sf_dir):
    rates = F.array(*[F.struct(F.lit(k).alias("kind"), F.round(S.warmup_hold_decay(step(), 900, 100, 0.2, k, 0.1), 9).alias("lr")) for k in S.DECAYS])
    return table(spark, sf_dir, "events").select("event_id", F.explode(rates).alias("x")).select("event_id", "x.*")


@query("warmup_stable_decay", "SELECT event_id, round(CASE WHEN i < 100 THEN (i + 1) / 100.0::DOUBLE WHEN i < 501 THEN 1 ELSE 0.2 + 0.8 * (1 - (i + 1 - 501) / 500.0::DOUBLE) END, 9) AS lr FROM (SELECT event_id, event_id % 1000 AS i FROM events)")
def warmup_stable_decay(spark, sf_dir):
    """Events as steps of runs of 1000."""
    return table(spark, sf_dir, "events").select("event_id", F.round(S.warmup_stable_decay(step() % 1000, 1000, 100, 0.5, least=0.2), 9).alias("lr"))


@query("prodigy_rates", "SELECT event_id, round(value * 0.001 * sqrt(1 - power(0.999, event_id % 1000 + 1)) / (1 - power(0.9, event_id % 1000 + 1)), 9) AS lr FROM events")
def prodigy_rates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(S.prodigy_rate(F.col("value"), F.lit(0.001), F.col("event_id") % 1000), 9).alias("lr"))


@query("horizon_sweep", "WITH h AS (SELECT event_type, event_id // 500 AS horizon, avg(value) AS m FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY horizon DESC) AS back FROM h) SELECT event_type, back, round(avg(m) OVER (PARTITION BY event_type ORDER BY back), 6) AS mean FROM r WHERE back <= 5")
def horizon_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("horizon", F.expr("event_id div 500"))
    return S.horizon_means(rows, "event_type", "horizon", "value", 5).withColumn("mean", F.round("mean", 6))


@query("should_log", "SELECT event_id FROM events WHERE event_id = 1 OR event_id % 25 = 0")
def should_log(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(RUN.should_log(step(), 25)).select("event_id")


# logs and comparisons


def coloured(spark, sf_dir, part: int):
    line = F.concat(F.lit("\x1b[31m[rank0] step: "), F.expr("event_id div 2").cast("string"), F.lit(" \x1b[0m loss: "), F.format_string("%.4f", F.abs("value")), F.lit(" grad: 1.0\x1b[39m"))
    e = table(spark, sf_dir, "events").filter(F.col("event_id") % 3 == part)
    return e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 7 == 0, "no numbers here").otherwise(line).alias("line"))


def losses_sql(part: int) -> str:
    return f"(SELECT event_id // 2 AS step, arg_max(printf('%.4f', abs(value))::DOUBLE, event_id) AS loss FROM events WHERE event_id % 3 = {part} AND event_id % 7 <> 0 GROUP BY 1)"


@query("step_losses", f"SELECT step, loss FROM {losses_sql(0)}")
def step_losses(spark, sf_dir):
    return RUN.step_losses(coloured(spark, sf_dir, 0))


@query("loss_summary", f"SELECT round(a, 6) AS baseline, round(b, 6) AS test, round(b - a, 6) AS difference FROM (SELECT avg(loss) AS a FROM {losses_sql(0)}), (SELECT avg(loss) AS b FROM {losses_sql(1)})")
def loss_summary(spark, sf_dir):
    found = RUN.loss_summary(RUN.step_losses(coloured(spark, sf_dir, 0)), RUN.step_losses(coloured(spark, sf_dir, 1)))
    return found.select(*[F.round(c, 6).alias(c) for c in ("baseline", "test", "difference")])


@query("loss_mismatches", " UNION ALL ".join(f"SELECT {k} AS run, coalesce(a.step, b.step) AS step, a.loss AS first, b.loss AS other FROM {losses_sql(0)} a FULL JOIN {losses_sql(k)} b ON a.step = b.step WHERE a.loss IS DISTINCT FROM b.loss" for k in (1, 2)))
def loss_mismatches(spark, sf_dir):
    return RUN.loss_mismatches([RUN.step_losses(coloured(spark, sf_dir, k)) for k in range(3)])


@query("logprob_difference", "SELECT count(*)::BIGINT AS n, sum(CASE WHEN a <> b THEN 1 ELSE 0 END)::BIGINT AS n_different, round(max(abs(a::DOUBLE - b::DOUBLE)), 6) AS max_delta, round(avg(abs(a::DOUBLE - b::DOUBLE)), 6) AS avg_delta FROM (SELECT max(l_discount)::FLOAT AS a, max(l_tax)::FLOAT AS b FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def logprob_difference(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber"]
    sides = [table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max(c).alias("p")) for c in ("l_discount", "l_tax")]
    found = RUN.logprob_difference(*sides, keys, "p")
    return found.select("n", "n_different", F.round("max_delta", 6).alias("max_delta"), F.round("avg_delta", 6).alias("avg_delta"))


@query("reduce_ranks", 'SELECT l_orderkey, round(sum(l_quantity), 4) AS "sum", round(avg(l_quantity), 6) AS mean, max(l_quantity) AS "max" FROM lineitem GROUP BY 1')
def reduce_ranks(spark, sf_dir):
    return RUN.reduce_ranks(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), "max")


@query("run_tags", "SELECT 'full' AS scale, 0::BIGINT AS seed")
def run_tags(spark, sf_dir):
    """Scale and seed from the names that the logs of the events' runs have."""
    e = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("user_id") % 2 == 0, "selection_owt2").otherwise("standard_wiki"), F.lit("_full_"), "event_type", F.lit("_seed"), (F.col("user_id") % 3).cast("string"), F.lit(".log")).alias("name")).distinct()
    return RUN.tags(e, "owt2")


@query("experiment_names", """SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN 'my run' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'pre_' ELSE '' END || p_size || 'x4_model-' || CASE WHEN p_partkey % 4 = 0 THEN 'moe_' ELSE '' END || 'llama' || CASE WHEN p_partkey % 5 = 0 THEN '_EWA' ELSE '' END || '_opt-' || p_brand
|| CASE WHEN p_size = 1 AND p_size % 2 = 1 THEN '' ELSE '__' || concat_ws('_', CASE WHEN p_size % 2 = 0 THEN 'wd-None' END, CASE WHEN p_size <> 1 THEN 'n_layer-' || p_size END) END END AS name FROM part""")
def experiment_names(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    true = lambda c: F.when(c, "True").otherwise("False")
    given = {
        "experiment_name": F.when(key % 50 == 7, "my run"), "run_prefix": F.when(key % 3 == 0, "pre"), "model": F.lit("llama"), "moe": true(key % 4 == 0), "exponential_weight_average": true(key % 5 == 0), "opt": F.col("p_brand"), "batch_size": size, "acc_steps": F.lit("4"),
        "wd": F.when(F.col("p_size") % 2 == 1, "0.1"), "seed": key.cast("string"), "n_layer": size, "unknown": F.lit("x"),
    }
    args = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), v)])
    return table(spark, sf_dir, "part").select("p_partkey", RUN.experiment_name(args, {"n_layer": "1", "wd": "0.1", "seed": "0"}, ["model", "dataset", "opt"], ["seed"]).alias("name"))


@query("rank_folders", "SELECT DISTINCT 'proj_rank_' || p_size || '_s1' AS name, p_size::BIGINT AS rank FROM part")
def rank_folders(spark, sf_dir):
    return RUN.rank_folders(table(spark, sf_dir, "part").select(F.concat(F.lit("proj_rank_"), "p_size", F.lit("_s1")).alias("name")).distinct())


@query("special_tokens", "SELECT p_partkey, 'bos_token' AS key, NULL::BIGINT AS id, p_name AS content FROM part UNION ALL SELECT p_partkey, 'eos_token', NULL, p_brand FROM part UNION ALL SELECT p_partkey, 'added', p_size, p_type FROM part")
def special_tokens(spark, sf_dir):
    config = F.to_json(F.struct(F.col("p_name").alias("bos_token"), F.struct(F.col("p_brand").alias("content"), F.lit(True).alias("lstrip")).alias("eos_token"), F.create_map(F.col("p_size").cast("string"), F.struct(F.col("p_type").alias("content"))).alias("added_tokens_decoder")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(RUN.special_tokens(config)).alias("x")).select("p_partkey", "x.*")


@query("prompt_answers", "SELECT o_orderkey, 'Q: ' || o_orderpriority || ' A:' AS prompt, o_orderkey::VARCHAR AS answer FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 500 AND o_orderkey % 3 < 2")
def prompt_answers(spark, sf_dir):
    """The first 500 questions; those without an answer go after that."""
    from siftwell.plans.metric_queries import answers

    first = ranking.global_rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderkey"], "k").filter("k <= 500")
    return first.join(answers(spark, sf_dir).filter("answer is not null"), "o_orderkey").select("o_orderkey", F.concat(F.lit("Q: "), "o_orderpriority", F.lit(" A:")).alias("prompt"), "answer")


# documents


@query("sample_documents", "SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '23', doc_id)), doc_id) - 1 AS draw FROM documents QUALIFY draw < 150")
def sample_documents(spark, sf_dir):
    return C.sample_documents(table(spark, sf_dir, "documents").select("doc_id"), 150, 23)


@query("sample_with_replacement", f"WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents), g AS (SELECT r AS draw, {hashed('23', 'r')} % (SELECT count(*) FROM documents) AS pos FROM range(20000) t(r)) SELECT doc_id, draw FROM g JOIN d ON k = pos")
def sample_with_replacement(spark, sf_dir):
    return C.sample_documents(table(spark, sf_dir, "documents").select("doc_id"), 20000, 23, replace=True)


@query("split_generators", " UNION ALL ".join(f"SELECT doc_id, '{s}' AS split, {hashed(str(40 + k), 'doc_id')} % 1000 AS draw FROM documents" for k, s in enumerate(("train", "val", "test"))))
def split_generators(spark, sf_dir):
    draws = F.array(*[F.struct(F.lit(s).alias("split"), hashing.hash_mod(C.split_seed(40, s), 1000, "doc_id").alias("draw")) for s in C.SPLIT_SEEDS])
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(draws).alias("x")).select("doc_id", "x.*")


@query("text_accessor", "SELECT doc_id, md5(text) AS digest FROM documents")
def text_accessor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(C.text_of(docs).cast("binary")).alias("digest"))


@query("bpe_tokens")
def bpe_tokens(spark, sf_dir):
    """Byte-pair ids of all documents, each with its end id: how many, and their digest."""
    import public_tokenizers

    from siftwell.operators.tokenize import bpe_ids

    ids = bpe_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ids.select("doc_id", "len", tokens.checksum(F.col("ids")).alias("digest"))


# routing


@query("routing_weights", f"WITH {SOFT} SELECT tok, expert, true AS softmax_first, round(p, 6) AS weight FROM sm WHERE rk <= 2 UNION ALL SELECT tok, expert, false, round(p / sum(p) OVER (PARTITION BY tok), 6) FROM sm WHERE rk <= 2")
def routing_weights(spark, sf_dir):
    parts = [R.choose(logits(spark, sf_dir), 2, first).select("tok", "expert", F.lit(first).alias("softmax_first"), F.round("weight", 6).alias("weight")) for first in (True, False)]
    return parts[0].unionByName(parts[1])


BIASED = f"{LOGIT}, s AS (SELECT tok, expert, 1 / (1 + exp(-z)) AS p FROM lg), c AS (SELECT tok, expert, p FROM (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY p + expert * 0.01 DESC, expert) AS rk FROM s) WHERE rk <= 2)"


def biases(spark):
    return spark.range(8).select(F.col("id").alias("expert"), (F.col("id") * 0.01).alias("bias"))


@query("biased_routing", f"WITH {BIASED} SELECT tok, expert, round(p / (sum(p) OVER (PARTITION BY tok) + 1e-20) * 2.5, 6) AS weight FROM c")
def biased_routing(spark, sf_dir):
    return R.choose_with_bias(logits(spark, sf_dir), biases(spark), 2, scale=2.5).withColumn("weight", F.round("weight", 6))


@query("expert_biases", f"WITH {BIASED}, n AS (SELECT e AS expert, (SELECT count(*) FROM c WHERE c.expert = e) AS n FROM range(8) t(e)), m AS (SELECT *, 0.001 * sign(avg(n) OVER () - n) AS step FROM n) SELECT expert, n, round(expert * 0.01 + step - avg(step) OVER (), 6) AS bias FROM m")
def expert_biases(spark, sf_dir):
    return R.updated_biases(R.choose_with_bias(logits(spark, sf_dir), biases(spark), 2), biases(spark)).withColumn("bias", F.round("bias", 6))


# logits are stretched so far that some probabilities are below the smallest double
STRETCHED = LOGIT.replace("::DOUBLE AS z", "::DOUBLE * 4000 AS z")


@query("balance_losses", f"WITH {STRETCHED}, lp AS (SELECT tok, expert, z - (m + ln(sum(exp(z - m)) OVER (PARTITION BY tok))) AS lp FROM (SELECT *, max(z) OVER (PARTITION BY tok) AS m FROM lg)), lm AS (SELECT expert, max(t) + ln(sum(exp(lp - t))) - ln(count(*)) AS m FROM (SELECT *, max(lp) OVER (PARTITION BY expert) AS t FROM lp) GROUP BY expert), sm AS (SELECT tok, expert, exp(lp) AS p, row_number() OVER (PARTITION BY tok ORDER BY exp(lp) DESC, expert) AS rk FROM lp), e AS (SELECT expert, avg(CASE WHEN rk <= 2 THEN 1.0 ELSE 0.0 END) AS f, avg(p) AS m FROM sm GROUP BY expert) SELECT true AS log_space, round(avg(f * exp(lm.m)) * 8, 6) AS loss FROM e JOIN lm USING (expert) UNION ALL SELECT false, round(avg(f * m) * 8, 6) FROM e")
def balance_losses(spark, sf_dir):
    parts = [R.balance_loss(logits(spark, sf_dir).withColumn("z", F.col("z") * 4000), 2, x).select(F.lit(x).alias("log_space"), F.round("loss", 6).alias("loss")) for x in (True, False)]
    return parts[0].unionByName(parts[1])


@query("generated_tokens", f"WITH {LOGIT}, k AS (SELECT *, rank() OVER (PARTITION BY tok ORDER BY z DESC) AS r FROM lg), g AS (SELECT tok, expert, round(z / 0.7 - ln(-ln({hashed01('61', 'tok', 'expert')})), 9) AS y FROM k WHERE r <= 4) SELECT tok, expert AS choice FROM (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY y DESC, expert) AS n FROM g) WHERE n = 1")
def generated_tokens(spark, sf_dir):
    return R.generated(logits(spark, sf_dir), 61, 0.7, 4)


@query("logit_histogram", f"WITH {LOGIT} SELECT greatest(0, least(9, floor((z + 0.5) / 1.0 * 10)))::BIGINT AS bin, count(*)::BIGINT AS n FROM lg GROUP BY 1")
def logit_histogram(spark, sf_dir):
    return R.logit_histogram(logits(spark, sf_dir), -0.5, 0.5, 10)


# projections


GAUSS = "sqrt(-2 * ln({0})) * cos(2 * pi() * {1}) / sqrt({2}.0)".format(hashed01("51u", "o", "k"), hashed01("51v", "o", "k"), 8)


@query("gaussian_projection", f"WITH p AS (SELECT o, k, {GAUSS} AS p FROM range(8) a(o), range(64) b(k)) SELECT vec_id, o, round(sum(embedding[k + 1]::DOUBLE * p), 6) AS y FROM embeddings, p GROUP BY vec_id, o")
def gaussian_projection(spark, sf_dir):
    spread = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    return spread.join(F.broadcast(P.initializer("gaussian")(spark, 8, 64, 51)), "k").groupBy("vec_id", "o").agg(F.round(F.sum(F.col("x").cast("double") * F.col("p")), 6).alias("y"))


SIGNED = "SELECT o, k, CASE WHEN {0} % 2 = 0 THEN 1.0 ELSE -1.0 END / sqrt({1}.0) AS p FROM range({1}) a(o), range({2}) b(k)"


@query("naive_projection", f"WITH {FL}, p AS ({SIGNED.format(hashed('41', 'o', 'k'), 4, 8)}), g AS (SELECT a.sample_id, a.layer, b.i AS o, a.i, sum(b.x * a.x) AS g FROM fl a JOIN fl b ON a.sample_id = b.sample_id AND a.layer = b.layer AND a.t = b.t AND a.side = 0 AND b.side = 1 GROUP BY ALL) SELECT sample_id, layer, l.o AS ko, r.o AS ki, round(sum(l.p * g * r.p), 6) AS y FROM g JOIN p l ON l.k = g.o JOIN p r ON r.k = g.i GROUP BY ALL")
def naive_projection(spark, sf_dir):
    """As dense_projection, from whole gradients."""
    rows = scoring.factors(table(spark, sf_dir, "embeddings"))
    spread = rows.select("sample_id", F.col("layer").cast("bigint").alias("layer"), F.posexplode("b").alias("o", "y"), "a").select("sample_id", "layer", "o", "y", F.posexplode("a").alias("i", "x"))
    whole = spread.groupBy("sample_id", "layer", "o", "i").agg(F.sum(F.col("y") * F.col("x")).alias("g"))
    p = P.rademacher(spark, 4, 8, 41)
    return P.naive_projection(whole, p, p).withColumn("y", F.round("y", 6))


@query("embedding_projection", f"WITH pin AS ({SIGNED.format(hashed('43', 'o', 'k'), 4, 10)}), pout AS ({SIGNED.format(hashed('44', 'o', 'k'), 3, 8)}), t AS (SELECT vec_id // 2 AS sample_id, label AS tok, k, embedding[k + 1]::DOUBLE AS x FROM embeddings, range(8) r(k)) SELECT sample_id, b.o AS ko, a.o AS ki, round(sum(x * b.p * a.p), 6) AS y FROM t JOIN pout b ON b.k = t.k JOIN pin a ON a.k = t.tok GROUP BY ALL")
def embedding_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("sample_id"), F.col("vec_id").alias("t"), F.col("label").cast("bigint").alias("tok"), F.slice("embedding", 1, 8).alias("b"))
    return P.embedding_projection(rows, P.rademacher(spark, 4, 10, 43), P.rademacher(spark, 3, 8, 44)).withColumn("y", F.round("y", 6))


@query("side_branch", f"WITH p AS (SELECT o, k, CASE WHEN {hashed('45', 'o', 'k')} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / sqrt(4.0) * sqrt(64 / 4.0) AS p FROM range(4) a(o), range(64) b(k)) SELECT vec_id, o, round(sum(embedding[k + 1]::DOUBLE * p), 6) AS y FROM embeddings, p GROUP BY ALL")
def side_branch(spark, sf_dir):
    """The vectors through a side branch's matrix as it begins."""
    spread = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    matrix = P.side_branch(P.rademacher(spark, 4, 64, 45), 4, 64)
    return spread.join(F.broadcast(matrix), "k").groupBy("vec_id", "o").agg(F.round(F.sum(F.col("x").cast("double") * F.col("p")), 6).alias("y"))


@query("target_layers", "SELECT p_partkey, p_type FROM part WHERE p_size % 2 = 0 AND NOT contains(p_type, 'ECONOMY') AND p_retailprice <= 1200")
def target_layers(spark, sf_dir):
    layers = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.replace("p_type", F.lit("ECONOMY"), F.lit("lm_head")).alias("layer"), F.when(F.col("p_size") % 2 == 0, "Linear").otherwise("Embedding").alias("kind"), "p_retailprice")
    return P.target_layers(layers, out="p_retailprice", widest=1200).select("p_partkey", "p_type")


@query("restricted_layers", "SELECT vec_id, round(sum(embedding[i + 1]::DOUBLE), 4) AS total FROM embeddings, (SELECT unnest(range(16, 32) || range(48, 64)) AS i) GROUP BY vec_id")
def restricted_layers(spark, sf_dir):
    """Vectors as the gradients of four layers; two of these are kept."""
    slices = P.layer_slices(spark.createDataFrame([(f"layer{k}", 16) for k in range(4)], "layer string, size int"))
    kept = P.restricted(table(spark, sf_dir, "embeddings"), slices, ["layer3", "layer1"], "embedding")
    return kept.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("dot_gram", f"WITH {FL}, d AS (SELECT a.layer, b.i AS o, a.i, sum(b.x * a.x) / (SELECT count(DISTINCT sample_id) FROM fl WHERE label = 0) AS w FROM fl a JOIN fl b ON a.sample_id = b.sample_id AND a.layer = b.layer AND a.t = b.t AND a.side = 0 AND b.side = 1 WHERE a.label = 0 GROUP BY ALL) SELECT a.sample_id, a.step, round(sum(b.x * d.w * a.x) * 1e3, 6) AS score FROM fl a JOIN fl b ON a.sample_id = b.sample_id AND a.layer = b.layer AND a.t = b.t AND a.side = 0 AND b.side = 1 JOIN d ON d.layer = a.layer AND d.o = b.i AND d.i = a.i WHERE a.label <> 0 GROUP BY a.sample_id, a.step")
def dot_gram(spark, sf_dir):
    rows = scoring.factors(table(spark, sf_dir, "embeddings"))
    return blocks.gram_dots(rows.filter("label <> 0"), rows.filter("label = 0")).withColumn("score", F.round(F.col("score") * 1e3, 6))


@query("conv_patches", "SELECT vec_id, p::BIGINT AS p, round(sum(embedding[(p // 6 + i) * 8 + p % 6 + j + 1]::DOUBLE), 6) AS total FROM embeddings, range(36) a(p), range(3) b(i), range(3) c(j) GROUP BY vec_id, p")
def conv_patches(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    patches = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(scoring.unfolded(x, 1, 8, 8, 3)).alias("p", "patch"))
    return patches.select("vec_id", F.col("p").cast("bigint").alias("p"), F.round(F.aggregate("patch", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("rescaled_train_rows", "SELECT vec_id, round(embedding[1]::DOUBLE * 4.0 / 3.0, 6) AS b, round(power(embedding[2]::DOUBLE, 2) * 16, 6) AS norm2 FROM embeddings WHERE vec_id % 4 <> 0")
def rescaled_train_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 4 == 0).alias("is_val"), F.transform(F.slice("embedding", 1, 1), lambda v: v.cast("double")).alias("b"), (F.col("embedding")[1].cast("double") ** 2).alias("s"))
    return scoring.train_rows(e, "is_val", 3, 4).select("vec_id", F.round(F.col("b")[0], 6).alias("b"), F.round(scoring.scaled_norms(F.col("s"), 4.0), 6).alias("norm2"))


# optimizer updates: an embedding's numbers as gradient and state of one weight


def state(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("g", "m", "s", "w", "last"))]).withColumn("v", F.col("w") * F.col("w"))


ST = "st AS (SELECT vec_id, embedding[1]::DOUBLE AS g, embedding[2]::DOUBLE AS m, embedding[3]::DOUBLE AS s, embedding[4]::DOUBLE AS w, embedding[5]::DOUBLE AS last, embedding[4]::DOUBLE * embedding[4]::DOUBLE AS v FROM embeddings)"
MARS_C = "(g + 0.475 * (g - last)) / greatest(abs(g + 0.475 * (g - last)), 1)"


@query("update_laws", f"""WITH {ST} SELECT vec_id, round(((m * 0.9 + g * 0.1) / (1 - power(0.9, 3)) + 5 * (s * 0.9999 + g * 0.0001)) / (sqrt(v * 0.999 + g * g * 0.001) / sqrt(1 - power(0.999, 3)) + 1e-8), 6) AS ademamix, sign(m * 0.9 + g * 0.1)::DOUBLE AS lion, round(m * 0.9 + g / greatest(sqrt(v), 1e-6) * 0.1, 6) AS adopt,
round(m * 0.95 + {MARS_C} * 0.05, 6) AS mars, round(sign(m * 0.965 + g * 0.035) * least(abs(m * 0.965 + g * 0.035) / (0.04 * v + 1e-15), 1), 6) AS sophia, sign(m * 0.9 + g * 0.1)::DOUBLE AS signum, round(CASE WHEN abs(w) > 0 AND abs(m) > 0 THEN abs(w) / abs(m) ELSE 1 END, 6) AS trust FROM st""")
def update_laws(spark, sf_dir):
    g, m, s, w, last, v = (F.col(c) for c in ("g", "m", "s", "w", "last", "v"))
    laws = {"ademamix": updates.ademamix(g, m, s, v, F.lit(3.0))["update"], "lion": updates.lion(g, m)["update"], "adopt": updates.adopt(g, m, v)["update"], "mars": updates.mars(g, last, m, v)["m"], "sophia": updates.sophia(g, m, v)["update"], "signum": updates.signum(g, m)["update"], "trust": updates.trust_ratio(F.abs(w), F.abs(m))}
    return state(spark, sf_dir).select("vec_id", *[F.round(c, 6).alias(k) for k, c in laws.items()])


@query("gradient_cosines", "WITH d AS (SELECT a.vec_id, sum(g * w) AS gw, sum(g * g) AS gg, sum(w * w) AS ww, sum(g * m) AS gm, sum(m * m) AS mm FROM (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS g, embedding[(k + 16) % 64 + 1]::DOUBLE AS w FROM embeddings, range(64) r(k)) a LEFT JOIN (SELECT vec_id - 1 AS vec_id, k, embedding[k + 1]::DOUBLE AS m FROM embeddings, range(64) r(k) WHERE vec_id % 3 = 0) b USING (vec_id, k) GROUP BY 1) SELECT vec_id, round(gw / sqrt(gg * ww), 6) AS with_weight, round(coalesce(gm / sqrt(gg * mm), 0), 6) AS with_momentum, round(gw / ww, 6) AS on_weight FROM d")
def gradient_cosines(spark, sf_dir):
    dot = scoring.dot
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("g"))
    e = e.withColumn("w", F.concat(F.slice("g", 17, 48), F.slice("g", 1, 16)))
    m = e.filter("vec_id % 3 = 0").select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("m"))
    g, w, m_ = F.col("g"), F.col("w"), F.col("m")
    cosine = lambda a, b: dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return e.join(m, "vec_id", "left").select("vec_id", F.round(cosine(g, w), 6).alias("with_weight"), F.round(F.coalesce(cosine(g, m_), F.lit(0.0)), 6).alias("with_momentum"), F.round(dot(g, w) / dot(w, w), 6).alias("on_weight"))


@query("second_moments", "SELECT label, round(avg(v), 9) AS mean, round(stddev_samp(v) / avg(v), 6) AS spread, round(sqrt(sum(power(x / (sqrt(v) + 0.1), 2))), 6) AS scaled_norm FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(embedding)::DOUBLE * unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label")
def second_moments(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("y")).select("label", F.col("y").cast("double").alias("x")).withColumn("v", F.col("x") * F.col("x"))
    return x.groupBy("label").agg(F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_samp("v") / F.avg("v"), 6).alias("spread"), F.round(F.sqrt(F.sum((F.col("x") / (F.sqrt("v") + 0.1)) ** 2)), 6).alias("scaled_norm"))


# files


def char_docs(spark, sf_dir):
    split = F.when(F.col("doc_id") % 10 == 9, "val").otherwise("train")
    docs = table(spark, sf_dir, "documents").withColumn("split", split).withColumnRenamed("source", "domain")
    return C.tokenized(docs, keep=("split", "domain"))


@query("token_bins", f"WITH {FLAT} SELECT CASE WHEN doc_id % 10 = 9 THEN 'val' ELSE 'train' END AS split, source AS domain, count(*)::BIGINT AS docs, sum(len(ids))::BIGINT AS tokens, sum(list_sum(ids))::BIGINT AS total, sum(list_sum(list_transform(range(1, len(ids) + 1), lambda k: ids[k] * k)))::BIGINT AS digest FROM tok JOIN documents USING (doc_id) GROUP BY 1, 2")
def token_bins(spark, sf_dir):
    """All documents to flat 16-bit files by split and domain, in two appends, and back."""
    folder, docs = shared_folder(spark, "bins"), char_docs(spark, sf_dir)
    for part in (0, 1):
        token_files.append_tokens(docs.filter(F.col("doc_id") % 2 == part), folder)
    back = token_files.read_tokens(spark, folder)
    return back.groupBy("split", "domain").agg(F.count(F.lit(1)).alias("docs"), F.sum(L(F.size("ids"))).alias("tokens"), F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("total"), F.sum(tokens.checksum(F.col("ids"))).alias("digest"))


@query("dot_log", "SELECT vec_id, vec_id // 16 AS step, CASE WHEN ceil(vec_id // 16 / 4.0) * 4 <= (SELECT max(vec_id // 16) FROM embeddings) THEN (ceil(vec_id // 16 / 4.0) * 4)::BIGINT ELSE -1 END AS iter_num, round(embedding[1]::DOUBLE, 6) AS dot FROM embeddings")
def dot_log(spark, sf_dir):
    path = f"{shared_folder(spark, 'dots')}/log"
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 16").alias("step"), F.round(F.col("embedding")[0].cast("double"), 6).alias("dot"))
    records.append_dot_log(rows, path, 4)
    return records.read_dot_log(spark, path).select("vec_id", "step", F.col("iter_num").cast("bigint").alias("iter_num"), "dot")


@query("saved_projections", f"WITH p AS ({SIGNED.format(hashed('31', 'o', 'k'), 8, 64)}), y AS (SELECT vec_id, o, sum(embedding[k + 1]::DOUBLE * p)::FLOAT AS y FROM embeddings, p GROUP BY vec_id, o) SELECT vec_id, count(*)::BIGINT AS n, round(sum(y::DOUBLE * (o + 1)), 4) AS digest FROM y WHERE (vec_id // 16) % 2 = 0 AND vec_id // 16 <= 12 GROUP BY vec_id")
def saved_projections(spark, sf_dir):
    """Projections of every second step with the layers' places; those of the first seven steps saved are loaded."""
    path = shared_folder(spark, "projections")
    spread = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    blocks = spread.join(F.broadcast(P.rademacher(spark, 8, 64, 31)), "k").groupBy("vec_id", "o").agg(F.sum(F.col("x").cast("double") * F.col("p")).alias("y")).withColumn("layer", F.when(F.col("o") < 4, "a").otherwise("b"))
    vectors = P.concatenated(blocks, ["o"], sample="vec_id").withColumn("step", F.expr("vec_id div 16"))
    layers = [{"name": "a", "slice_start": 0, "slice_end": 4}, {"name": "b", "slice_start": 4, "slice_end": 8}]
    records.save_projections(vectors, path, layers, every=2)
    back, places = records.load_projections(spark, path, most_steps=7)
    n = places[-1]["slice_end"]
    return back.select("vec_id", F.lit(n).cast("bigint").alias("n"), F.round(F.aggregate(F.zip_with("proj", F.sequence(F.lit(1), F.lit(n)), lambda y, o: y.cast("double") * o), F.lit(0.0), lambda s, x: s + x), 4).alias("digest"))


@query("run_records", "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 4) AS loss FROM events GROUP BY event_type")
def run_records(spark, sf_dir):
    """A JSON record for each run, appended, and read back."""
    path = f"{shared_folder(spark, 'records')}/runs"
    runs = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("loss"))
    for part in (F.col("event_type") < "m", F.col("event_type") >= "m"):
        records.append_json(runs.filter(part), path)
    return spark.read.schema("event_type string, n bigint, loss double").json(path)


@query("latex_rows", r"SELECT event_type || ' & ' || round(avg(value), 2)::DECIMAL(18, 2) || ' & -- \\' AS line FROM events GROUP BY event_type")
def latex_rows(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 2).cast("decimal(18,2)").alias("m"))
    return m.select(records.table_row([F.col("event_type"), F.col("m"), F.lit(None)], "latex").alias("line"))


@query("dynamics_fragments", "SELECT event_type, event_id // 100 AS block, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def dynamics_fragments(spark, sf_dir):
    """Statistics appended in three parts, one of them twice, and put together again."""
    path = f"{shared_folder(spark, 'dynamics')}/stats"
    stats = table(spark, sf_dir, "events").groupBy("event_type", F.expr("event_id div 100").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    for part in (0, 1, 2, 1):
        records.append_rows(stats.filter(F.col("block") % 3 == part), path)
    return records.fragments(spark, path, "block")


@query("data_values", "WITH v AS (SELECT k, avg(embedding[k + 1]::DOUBLE) AS m FROM embeddings, range(64) r(k) WHERE label = 0 GROUP BY k) SELECT vec_id AS index, round(0.1 * sum(embedding[k + 1]::DOUBLE * m), 6) AS value FROM embeddings JOIN v ON true WHERE label <> 0 GROUP BY vec_id")
def data_values(spark, sf_dir):
    """First-order data values: the rate times each sample's inner product with the validation mean, appended and summed."""
    path = f"{shared_folder(spark, 'values')}/shapley"
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    mean = [r.m for r in e.filter("label = 0").select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()]
    values = e.filter("label <> 0").select(F.col("vec_id").alias("index"), (0.1 * scoring.dot(F.col("x"), scoring.literal(np.array(mean)))).alias("value"))
    for part in (0, 1):
        records.append_rows(values.filter(F.col("index") % 2 == part), path)
    return spark.read.parquet(path).groupBy("index").agg(F.round(F.sum("value"), 6).alias("value"))


@query("conversation_files", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, md5(text) AS digest FROM conversations")
def conversation_files(spark, sf_dir):
    """Conversations to files of JSON lists, with a broken file among them, and back."""
    path = f"{shared_folder(spark, 'conversations')}/files"
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text")))
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    # a file is one list of conversations, dealt by a hash
    files = lists.groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(16)).alias("file")).agg(F.to_json(F.collect_list(F.struct("conv_id", "turns"))).alias("value"))
    files.unionByName(spark.createDataFrame([(99, "[{")], "file bigint, value string")).repartition("file").write.partitionBy("file").text(path)
    back = records.conversation_files(spark, path)
    return back.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("tokenized_set", f"WITH t AS (SELECT doc_id, CASE WHEN length({KEPT}) = 0 THEN []::INT[] ELSE {IDS} END AS ids FROM documents) SELECT doc_id, len(ids)::BIGINT AS n, coalesce(list_sum(ids), 0)::BIGINT AS total FROM t")
def tokenized_set(spark, sf_dir):
    """A tokenized set, made once and read when it is there."""
    path = f"{shared_folder(spark, 'set')}/tokenized"
    made = table(spark, sf_dir, "documents").select("doc_id", tokens.char_ids(F.col("text")).alias("ids"))
    for _ in range(2):
        found = corpora.materialize_once(made, path)
    return found.select("doc_id", L(F.size("ids")).alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))

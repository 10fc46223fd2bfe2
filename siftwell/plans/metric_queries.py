"""Queries over runs, logs, schedules, routing and rewards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.functions import ranking
from siftwell.operators import routing as R
from siftwell.operators import runs as RUN
from siftwell.plans.corpus_queries import table
from siftwell.plans.registry import query



def n_rows():
    return F.count(F.lit(1))


EV = "ev AS (SELECT event_id, user_id, event_type AS opt, CASE WHEN user_id % 2 = 0 THEN 'standard' ELSE 'selection' END AS mode, value, user_id % 3 AS seed FROM events)"
LOGIT = "lg AS (SELECT vec_id AS tok, k AS expert, embedding[k + 1]::DOUBLE AS z FROM embeddings, range(8) r(k))"
SOFT = f"{LOGIT}, sm AS (SELECT tok, expert, z, exp(z) / sum(exp(z)) OVER (PARTITION BY tok) AS p, row_number() OVER (PARTITION BY tok ORDER BY z DESC, expert) AS rk FROM lg)"


def runs(spark, sf_dir):
    mode = F.when(F.col("user_id") % 2 == 0, "standard").otherwise("selection")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("opt"), mode.alias("mode"), "value", (F.col("user_id") % 3).alias("seed"))


def log_lines(spark, sf_dir):
    """Training log lines of each run (optimizer and mode), as files would have them."""
    line = F.when(F.col("event_id") % 5 == 0, F.format_string(">Eval: Iter=%d val_loss=%.3f val_pp=%.3f val_acc=%.5f", "event_id", "value", F.exp(F.col("value") / 100), F.col("value") / 1000)).otherwise(F.format_string("Train: Iter=%d train_loss=%.3f sel_entropy=%.4f", "event_id", "value", F.col("value") / 50))
    return runs(spark, sf_dir).select("opt", "mode", F.col("event_id").alias("line_no"), line.alias("line"))


def parsed_logs(lines):
    """Per run: the last evaluation's loss and accuracy, and the mean of all entropies."""
    number = lambda name: F.expr(f"try_cast(nullif(regexp_extract(line, '{name}=([0-9.]+)', 1), '') as double)")
    values = lines.select("opt", "mode", "line_no", number("val_loss").alias("loss"), number("val_acc").alias("acc"), number("sel_entropy").alias("ent"))
    last = lambda c: F.max_by(c, F.when(F.col("loss").isNotNull(), F.col("line_no")))
    return values.groupBy("opt", "mode").agg(last("loss").alias("loss"), last("acc").alias("acc"), F.avg("ent").alias("entropy"))


LOGS = f"{EV}, ll AS (SELECT opt, mode, event_id AS line_no, CASE WHEN event_id % 5 = 0 THEN printf('%.3f', value)::DOUBLE END AS loss, CASE WHEN event_id % 5 = 0 THEN printf('%.5f', value / 1000)::DOUBLE END AS acc, CASE WHEN event_id % 5 <> 0 THEN printf('%.4f', value / 50)::DOUBLE END AS ent FROM ev), lp AS (SELECT opt, mode, arg_max(loss, CASE WHEN loss IS NOT NULL THEN line_no END) AS loss, arg_max(acc, CASE WHEN loss IS NOT NULL THEN line_no END) AS acc, avg(ent) AS entropy FROM ll GROUP BY opt, mode)"


@query("parse_log", f"WITH {LOGS} SELECT opt, mode, round(loss, 3) AS loss, round(acc, 5) AS acc, round(entropy, 4) AS entropy FROM lp")
def parse_log(spark, sf_dir):
    return parsed_logs(log_lines(spark, sf_dir)).select("opt", "mode", F.round("loss", 3).alias("loss"), F.round("acc", 5).alias("acc"), F.round("entropy", 4).alias("entropy"))


@query("compare_modes", f"WITH {LOGS}, dim AS (SELECT * FROM (VALUES ('click', 1, 'Click'), ('view', 2, 'View'), ('purchase', 3, 'Purchase'), ('absent', 4, 'Absent')) t(opt, ord, shown)), w AS (SELECT opt, max(CASE WHEN mode = 'standard' THEN loss END) AS standard, max(CASE WHEN mode = 'selection' THEN loss END) AS selection, max(CASE WHEN mode = 'standard' THEN acc END) AS sa, max(CASE WHEN mode = 'selection' THEN acc END) AS xa FROM lp GROUP BY opt), j AS (SELECT * FROM dim LEFT JOIN w USING (opt)) SELECT ord, shown, round(standard, 3) AS standard, round(selection, 3) AS selection, round(selection - standard, 3) AS delta, round(100 * (xa - sa), 3) AS accuracy_delta, (SELECT count(standard) + count(selection) FROM j)::BIGINT AS found, (SELECT 2 * count(*) FROM j)::BIGINT AS expected FROM j")
def compare_modes(spark, sf_dir):
    """Both modes' last loss and accuracy by optimizer in a fixed order, what selection changes, and how many runs were found of those expected."""
    dim = spark.createDataFrame([("click", 1, "Click"), ("view", 2, "View"), ("purchase", 3, "Purchase"), ("absent", 4, "Absent")], "opt string, ord int, shown string")
    wide = parsed_logs(log_lines(spark, sf_dir)).groupBy("opt").pivot("mode", ["standard", "selection"]).agg(F.max("loss").alias("loss"), F.max("acc").alias("acc"))
    both = dim.join(wide, "opt", "left")
    n = F.broadcast(both.agg((F.count("standard_loss") + F.count("selection_loss")).alias("found"), (2 * n_rows()).alias("expected")))  # one row
    delta = lambda c: F.col(f"selection_{c}") - F.col(f"standard_{c}")
    return both.join(n).select("ord", "shown", F.round("standard_loss", 3).alias("standard"), F.round("selection_loss", 3).alias("selection"), F.round(delta("loss"), 3).alias("delta"), F.round(100 * delta("acc"), 3).alias("accuracy_delta"), "found", "expected")


@query("best_of", f"WITH {EV}, m AS (SELECT opt, round(avg(value), 6) AS v FROM ev GROUP BY opt) SELECT opt, v, v >= max(v) OVER () - 1e-6 AS best, row_number() OVER (ORDER BY v DESC, opt) = 1 AS first_best FROM m")
def best_of(spark, sf_dir):
    m = runs(spark, sf_dir).groupBy("opt").agg(F.round(F.avg("value"), 6).alias("v"))
    # one row: the best value, and the first run that has it
    top = F.broadcast(m.agg(F.max("v").alias("top"), F.min(F.struct((-F.col("v")).alias("v"), "opt"))["opt"].alias("first")))
    return m.join(top).select("opt", "v", (F.col("v") >= F.col("top") - 1e-6).alias("best"), (F.col("opt") == F.col("first")).alias("first_best"))


@query("log_names", f"WITH {EV} SELECT DISTINCT concat_ws('_', mode, opt, CASE WHEN seed = 0 THEN NULL ELSE 'seed' || seed END) || '.log' AS name, seed FROM ev")
def log_names(spark, sf_dir):
    name = F.concat(F.concat_ws("_", "mode", "opt", F.when(F.col("seed") != 0, F.concat(F.lit("seed"), F.col("seed").cast("string")))), F.lit(".log"))
    return runs(spark, sf_dir).select(name.alias("name"), "seed").distinct()


@query("pending_runs", f"WITH {EV}, c AS (SELECT opt, mode, seed, count(*) AS n FROM ev WHERE value > 40 GROUP BY ALL) SELECT DISTINCT opt, mode, seed FROM ev ANTI JOIN (SELECT * FROM c WHERE n > 300) d USING (opt, mode, seed)")
def pending_runs(spark, sf_dir):
    r = runs(spark, sf_dir)
    done = r.filter("value > 40").groupBy("opt", "mode", "seed").agg(n_rows().alias("n")).filter("n > 300")
    return r.select("opt", "mode", "seed").distinct().join(done, ["opt", "mode", "seed"], "left_anti")


@query("json_first", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k')::DOUBLE END, round(value, 3)) AS metric FROM events")
def json_first(spark, sf_dir):
    json = F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k").cast("double"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(json, F.round("value", 3)).alias("metric"))


@query("running_best", "SELECT event_type, event_id, round(value, 4) AS value FROM (SELECT *, min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value < b")
def running_best(spark, sf_dir):
    e = ranking.running(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_id", ["event_id"], F.col("value"), "b", ["event_type"], "min")
    return e.filter("b is null or value < b").select("event_type", "event_id", F.round("value", 4).alias("value"))


@query("eval_metrics", f"WITH {SOFT}, b AS (SELECT tok // 32 AS batch, avg(-ln(p)) AS loss, avg(CASE WHEN rk = 1 THEN 1.0 ELSE 0.0 END) AS acc FROM sm JOIN embeddings e ON e.vec_id = tok WHERE expert = label % 8 GROUP BY 1) SELECT round(avg(loss), 6) AS loss, round(avg(acc), 6) AS acc, round(power(2.71828, avg(loss)), 6) AS perplexity FROM b")
def eval_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("z"))
    target = F.get("z", F.col("label") % 8)
    loss = F.ln(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x))) - target
    b = e.groupBy(F.expr("vec_id div 32").alias("batch")).agg(F.avg(loss).alias("loss"), F.avg((F.array_position("z", F.array_max("z")) == F.col("label") % 8 + 1).cast("double")).alias("acc"))
    return b.agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg("acc"), 6).alias("acc"), F.round(F.pow(F.lit(2.71828), F.avg("loss")), 6).alias("perplexity"))


@query("cross_entropy", f"WITH {SOFT} SELECT label, round(avg(-ln(p)), 6) AS loss FROM sm JOIN embeddings e ON e.vec_id = tok WHERE label <> 9 AND expert = label % 8 GROUP BY label")
def cross_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter("label <> 9").select("label", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("z"))
    loss = F.ln(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x))) - F.get("z", F.col("label") % 8)
    return e.groupBy("label").agg(F.round(F.avg(loss), 6).alias("loss"))


@query("norms", "SELECT label, round(sqrt(sum(x * x)), 6) AS l2, round(power(sum(power(abs(x), 3)), 1.0 / 3), 6) AS l3, round(max(abs(x)), 6) AS linf, round(sqrt(avg(x * x)), 6) AS rms FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def norms(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("y")).select("label", F.col("y").cast("double").alias("x"))
    return x.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("x") ** 2)), 6).alias("l2"), F.round(F.pow(F.sum(F.abs("x") ** 3), F.lit(1.0 / 3)), 6).alias("l3"), F.round(F.max(F.abs("x")), 6).alias("linf"), F.round(F.sqrt(F.avg(F.col("x") ** 2)), 6).alias("rms"))


@query("throughput", "SELECT event_type, event_id, epoch(ts) - epoch(lag(ts) OVER w) AS seconds FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id) QUALIFY seconds > 0")
def throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    # times ascend, so the latest before a row is that of the row before it
    e = ranking.running(e, "at", ["at", "event_id"], F.col("at"), "before", ["event_type"], "max")
    return e.select("event_type", "event_id", (F.col("at") - F.col("before")).alias("seconds")).filter("seconds > 0")


@query("run_statistics", "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(max(value), 6) AS top, count(*)::BIGINT * 8192 AS tokens FROM events GROUP BY event_type")
def run_statistics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(n_rows().alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"), (n_rows() * 8192).alias("tokens"))


@query("norms_between_logs", "SELECT event_type, event_id // 100 AS log, round(max(value), 6) AS top, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def norms_between_logs(spark, sf_dir):
    """Events as steps with a gradient norm: its maximum and mean since the log before."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.expr("event_id div 100").alias("log")).agg(F.round(F.max("value"), 6).alias("top"), F.round(F.avg("value"), 6).alias("mean"))


@query("validation_steps", "WITH b AS (SELECT event_type, event_id // 20 AS batch, avg(value) AS loss FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY batch) AS n FROM b) SELECT m AS most, event_type, count(*)::BIGINT AS batches, round(avg(loss), 6) AS loss FROM r, (SELECT unnest([-1, 10]) AS m) WHERE m < 0 OR n <= m GROUP BY ALL")
def validation_steps(spark, sf_dir):
    """Events as validation batches of 20: the mean of their losses, of all and of the first ten."""
    batches = table(spark, sf_dir, "events").groupBy("event_type", F.expr("event_id div 20").alias("batch")).agg(F.avg("value").alias("loss"))
    parts = [RUN.mean_loss(batches, "event_type", "batch", "loss", most).select(F.lit(most).alias("most"), "event_type", "batches", F.round("loss", 6).alias("loss")) for most in (-1, 10)]
    return parts[0].unionByName(parts[1])


@query("uniform_average", "SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type, event_id // 500 ORDER BY event_id), 6) AS mean FROM events WHERE event_id % 5 = 0")
def uniform_average(spark, sf_dir):
    w = Window.partitionBy("event_type", F.expr("event_id div 500")).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").filter("event_id % 5 = 0").select("event_type", "event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


def exponential_mean(rows, group: str, order: str, value: str, rate: float = 0.1, width: int = 4096):
    """Per group: n and the mean that begins at the first value and moves by ``rate`` to each later one.

    Rows are folded in blocks of ``width`` consecutive ids; a block's share fades with the number of rows after it.
    """
    keep = 1 - rate
    folded = F.aggregate("v", F.lit(0.0), lambda m, x: m * keep + x[value].cast("double") * rate)
    blocks = rows.groupBy(group, F.floor(F.col(order) / width).alias("block")).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("v"))
    blocks = blocks.select(group, "block", F.size("v").cast("bigint").alias("n"), F.get("v", F.lit(0))[value].alias("first"), folded.alias("part"))
    later = Window.partitionBy(group).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    faded = blocks.withColumn("part", F.col("part") * F.pow(F.lit(keep), F.coalesce(F.sum("n").over(later), F.lit(0))))
    return faded.groupBy(group).agg(F.sum("n").alias("n"), F.sum("part").alias("part"), F.min_by("first", "block").alias("first")).select(group, "n", (F.col("part") + F.pow(F.lit(keep), F.col("n")) * F.col("first")).alias("mean"))


@query("exponential_average", "WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*)::BIGINT AS n, round(sum(value * power(0.9::DOUBLE, n - k) * CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END), 6) AS mean FROM s GROUP BY event_type")
def exponential_average(spark, sf_dir):
    return exponential_mean(table(spark, sf_dir, "events"), "event_type", "event_id", "value").select("event_type", "n", F.round("mean", 6).alias("mean"))


WARM = 40


def steps(spark, sf_dir):
    """Events as steps of runs of 400."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 400).alias("i"))


@query("cosine_schedule", "SELECT event_id, i, round(CASE WHEN i < 40 THEN (i + 1) / 40.0::DOUBLE ELSE 0.1 + 0.45 * (1 + cos(pi() * (i - 40) / 360.0)) END, 9) AS lr FROM (SELECT event_id, event_id % 400 AS i FROM events)")
def cosine_schedule(spark, sf_dir):
    i = F.col("i")
    return steps(spark, sf_dir).select("event_id", "i", F.round(F.when(i < WARM, (i + 1) / F.lit(40.0)).otherwise(0.1 + 0.45 * (1 + F.cos(F.pi() * (i - WARM) / 360.0))), 9).alias("lr"))


@query("wsd_schedule", "SELECT event_id, i, kind, round(CASE WHEN i < 40 THEN i / 40.0::DOUBLE WHEN i < 300 THEN 1.0 ELSE CASE kind WHEN 'linear' THEN 1 - (i - 300) / 100.0::DOUBLE WHEN 'cosine' THEN 0.5 * (1 + cos(pi() * (i - 300) / 100.0)) WHEN 'sqrt' THEN 1 - sqrt((i - 300) / 100.0::DOUBLE) WHEN 'square' THEN 1 - power((i - 300) / 100.0::DOUBLE, 2) END END, 9) AS lr FROM (SELECT event_id, event_id % 400 AS i FROM events), (SELECT unnest(['linear', 'cosine', 'sqrt', 'square']) AS kind)")
def wsd_schedule(spark, sf_dir):
    x = (F.col("i") - 300) / F.lit(100.0)
    fall = F.when(F.col("kind") == "linear", 1 - x).when(F.col("kind") == "cosine", 0.5 * (1 + F.cos(F.pi() * x))).when(F.col("kind") == "sqrt", 1 - F.sqrt(x)).otherwise(1 - x * x)
    lr = F.when(F.col("i") < WARM, F.col("i") / F.lit(40.0)).when(F.col("i") < 300, 1.0).otherwise(fall)
    return steps(spark, sf_dir).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("linear", "cosine", "sqrt", "square")]))).select("event_id", "i", "kind", F.round(lr, 9).alias("lr"))


@query("half_life_warmup", "SELECT event_id, i, round(least(i / 100.0::DOUBLE, 1) * 5, 9) AS alpha, round(least(exp(ln(0.9) * ln(0.9999) / ((1 - least(i / 100.0::DOUBLE, 1)) * ln(0.9999) + least(i / 100.0::DOUBLE, 1) * ln(0.9))), 0.9999), 9) AS beta FROM (SELECT event_id, event_id % 400 AS i FROM events)")
def half_life_warmup(spark, sf_dir):
    a = F.least(F.col("i") / F.lit(100.0), F.lit(1.0))
    slow, fast = F.ln(F.lit(0.9999)), F.ln(F.lit(0.9))
    return steps(spark, sf_dir).select("event_id", "i", F.round(a * 5, 9).alias("alpha"), F.round(F.least(F.exp(fast * slow / ((1 - a) * slow + a * fast)), F.lit(0.9999)), 9).alias("beta"))


@query("timestep_cycle", "SELECT vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) % 8 + 0.5::DOUBLE) / 8 AS t FROM embeddings")
def timestep_cycle(spark, sf_dir):
    r = ranking.global_rank(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", ["vec_id"])
    return r.select("vec_id", (((F.col("rn") - 1) % 8 + 0.5) / 8).alias("t"))


@query("angular_update", "WITH x AS (SELECT a.vec_id, sum(u * v) AS d, sqrt(sum(u * u)) AS nu, sqrt(sum(v * v)) AS nv FROM (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS u FROM embeddings, range(64) r(k)) a JOIN (SELECT vec_id - 1 AS vec_id, k, embedding[k + 1]::DOUBLE AS v FROM embeddings, range(64) r(k)) b USING (vec_id, k) GROUP BY 1) SELECT vec_id, round(acos(greatest(-1, least(1, d / (nu * nv)))), 6) AS angle, round(sqrt(nu * nu + nv * nv - 2 * d) / nu, 6) AS relative FROM x")
def angular_update(spark, sf_dir):
    from siftwell.operators.scoring import dot

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("u"))
    x = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v")), "vec_id")
    x = x.select("vec_id", dot(F.col("u"), F.col("v")).alias("d"), F.sqrt(dot(F.col("u"), F.col("u"))).alias("nu"), F.sqrt(dot(F.col("v"), F.col("v"))).alias("nv"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("d") / (F.col("nu") * F.col("nv"))))
    return x.select("vec_id", F.round(F.acos(cos), 6).alias("angle"), F.round(F.sqrt(F.col("nu") ** 2 + F.col("nv") ** 2 - 2 * F.col("d")) / F.col("nu"), 6).alias("relative"))


@query("downsample", "SELECT event_type, event_id // 100 AS block, round(avg(value), 6) AS mean, round(sqrt(avg(value * value)), 6) AS rms, round(arg_min(value, event_id), 6) AS first FROM events GROUP BY 1, 2")
def downsample(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.expr("event_id div 100").alias("block")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sqrt(F.avg(F.col("value") ** 2)), 6).alias("rms"), F.round(F.min_by("value", "event_id"), 6).alias("first"))


@query("interval_asof", "SELECT event_id, i, CASE WHEN i >= 250 THEN 50 WHEN i >= 100 THEN 10 ELSE 1 END::BIGINT AS every FROM (SELECT event_id, event_id % 400 AS i FROM events)")
def interval_asof(spark, sf_dir):
    # a schedule has a handful of entries
    schedule = spark.createDataFrame([(0, 1), (100, 10), (250, 50)], "at bigint, every bigint")
    return steps(spark, sf_dir).join(F.broadcast(schedule), F.col("at") <= F.col("i")).groupBy("event_id", "i").agg(F.max_by("every", "at").alias("every"))


@query("keep_last", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def keep_last(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(w).alias("n")).filter("n <= 5").drop("n")


@query("checkpoint_purge", "WITH c AS (SELECT event_type AS run, 'step-' || event_id * 50 AS folder, event_id * 50 AS s FROM events WHERE event_id % 10 = 0), k AS (SELECT run, max(s) AS newest, min(s) AS least FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY s DESC) AS n FROM c) WHERE n <= 3 GROUP BY run) SELECT run, folder, s < least AS purge, s = newest AS newest FROM c JOIN k USING (run)")
def checkpoint_purge(spark, sf_dir):
    """Every tenth event as a checkpoint of its type's run: which go when the three newest of a run stay, and which is the one to start from."""
    saved = table(spark, sf_dir, "events").filter("event_id % 10 = 0").select(F.col("event_type").alias("run"), F.concat(F.lit("step-"), (F.col("event_id") * 50).cast("string")).alias("folder"))
    return RUN.checkpoints(saved, "run", "folder", 3).select("run", "folder", "purge", "newest")


def logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tok"), F.posexplode(F.slice("embedding", 1, 8)).alias("e", "y")).select("tok", F.col("e").cast("bigint").alias("expert"), F.col("y").cast("double").alias("z"))


def softmaxed(spark, sf_dir):
    w = Window.partitionBy("tok")
    return logits(spark, sf_dir).withColumn("p", F.exp("z") / F.sum(F.exp("z")).over(w)).withColumn("rk", F.row_number().over(w.orderBy(F.desc("z"), "expert")))


@query("token_choice", f"WITH {SOFT} SELECT tok, expert, round(p, 6) AS p, round(p / sum(p) OVER (PARTITION BY tok), 6) AS share FROM sm WHERE rk <= 2")
def token_choice(spark, sf_dir):
    top = softmaxed(spark, sf_dir).filter("rk <= 2")
    return top.select("tok", "expert", F.round("p", 6).alias("p"), F.round(F.col("p") / F.sum("p").over(Window.partitionBy("tok")), 6).alias("share"))


def take_by_expert(scores, capacity: int, n_experts: int):
    """Each expert's best tokens: ``capacity`` times the number of tokens over the number of experts; the lesser token wins a tie."""
    n = F.broadcast(scores.agg(F.count_distinct("tok").alias("n")))
    ranked = ranking.global_rank(scores.withColumn("down", -F.col("z")), "down", ["down", "tok"], "rk", ["expert"])
    return ranked.join(n).filter(F.col("rk") <= F.expr(f"n * {capacity} div {n_experts}")).select("tok", "expert")


@query("expert_choice", f"WITH {LOGIT} SELECT tok, expert FROM (SELECT *, row_number() OVER (PARTITION BY expert ORDER BY z DESC, tok) AS rk FROM lg) WHERE rk <= (SELECT count(*) FROM embeddings) * 2 // 8")
def expert_choice(spark, sf_dir):
    return take_by_expert(logits(spark, sf_dir), 2, 8)


@query("balance_loss", f"WITH {SOFT} SELECT round(8 * sum(f * pm), 6) AS loss, round(-avg(h), 6) AS entropy FROM (SELECT expert, avg(CASE WHEN rk <= 2 THEN 1.0 ELSE 0.0 END) AS f, avg(p) AS pm, avg(p * ln(p)) * 8 AS h FROM sm GROUP BY expert)")
def balance_loss(spark, sf_dir):
    e = softmaxed(spark, sf_dir).groupBy("expert").agg(F.avg((F.col("rk") <= 2).cast("double")).alias("f"), F.avg("p").alias("pm"), (F.avg(F.col("p") * F.ln("p")) * 8).alias("h"))
    return e.agg(F.round(8 * F.sum(F.col("f") * F.col("pm")), 6).alias("loss"), F.round(-F.avg("h"), 6).alias("entropy"))


@query("router_z_loss", f"WITH {LOGIT} SELECT round(avg(power(l, 2)), 6) AS z_loss FROM (SELECT ln(sum(exp(z))) AS l FROM lg GROUP BY tok)")
def router_z_loss(spark, sf_dir):
    return logits(spark, sf_dir).groupBy("tok").agg(F.ln(F.sum(F.exp("z"))).alias("l")).agg(F.round(F.avg(F.col("l") ** 2), 6).alias("z_loss"))


@query("tokens_per_expert", f"WITH {SOFT}, c AS (SELECT expert, count(*) AS n FROM sm WHERE rk <= 2 GROUP BY expert) SELECT expert, n::BIGINT AS n, round(n / sum(n) OVER (), 6) AS share, round(0.01 * sign(avg(n) OVER () - n), 6)::DOUBLE AS bias FROM c")
def tokens_per_expert(spark, sf_dir):
    c = softmaxed(spark, sf_dir).filter("rk <= 2").groupBy("expert").agg(n_rows().alias("n"))
    total = c.agg(F.sum("n").alias("t"), F.avg("n").alias("m"))
    return c.join(F.broadcast(total)).select("expert", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.round(0.01 * F.signum(F.col("m") - F.col("n")), 6).alias("bias"))


@query("group_limited_routing", f"WITH {LOGIT}, s AS (SELECT tok, expert, expert // 2 AS grp, 1 / (1 + exp(-z)) AS p FROM lg), g AS (SELECT tok, grp FROM (SELECT tok, grp, row_number() OVER (PARTITION BY tok ORDER BY round(sum(p), 12) DESC, grp) AS rk FROM s GROUP BY tok, grp) WHERE rk <= 2) SELECT tok, expert, round(p / sum(p) OVER (PARTITION BY tok), 6) AS share FROM (SELECT s.*, row_number() OVER (PARTITION BY tok ORDER BY p DESC, expert) AS rk FROM s SEMI JOIN g USING (tok, grp)) WHERE rk <= 2")
def group_limited_routing(spark, sf_dir):
    s = logits(spark, sf_dir).select("tok", "expert", F.expr("expert div 2").alias("grp"), (1 / (1 + F.exp(-F.col("z")))).alias("p"))
    groups = s.groupBy("tok", "grp").agg(F.round(F.sum("p"), 12).alias("g")).withColumn("rk", F.row_number().over(Window.partitionBy("tok").orderBy(F.desc("g"), "grp"))).filter("rk <= 2")
    top = s.join(groups, ["tok", "grp"], "left_semi").withColumn("rk", F.row_number().over(Window.partitionBy("tok").orderBy(F.desc("p"), "expert"))).filter("rk <= 2")
    return top.select("tok", "expert", F.round(F.col("p") / F.sum("p").over(Window.partitionBy("tok")), 6).alias("share"))


@query("reorder_tokens", f"WITH {SOFT} SELECT tok, expert, row_number() OVER (ORDER BY expert, tok) - 1 AS place FROM sm WHERE rk <= 2")
def reorder_tokens(spark, sf_dir):
    top = softmaxed(spark, sf_dir).filter("rk <= 2").select("tok", "expert")
    return ranking.running_sum(top.withColumn("at", F.col("expert") * (1 << 40) + F.col("tok")), "at", ["at"], F.lit(1), "place").select("tok", "expert", "place")


@query("expert_shares", f"WITH {SOFT}, x AS (SELECT tok % 5 AS layer, expert FROM sm WHERE rk <= 2), n AS (SELECT layer, expert, count(*)::BIGINT AS n FROM x GROUP BY ALL) SELECT CASE layer WHEN 0 THEN 'first' WHEN 2 THEN 'mid' ELSE 'last' END AS layer, expert, n, round(n / sum(n) OVER (PARTITION BY layer), 6) AS share FROM n WHERE layer IN (0, 2, 4)")
def expert_shares(spark, sf_dir):
    """Tokens of five layers: what share of the first, the middle and the last layer's choices each expert has."""
    chosen = softmaxed(spark, sf_dir).filter("rk <= 2").select((F.col("tok") % 5).alias("layer"), "expert")
    return R.expert_shares(chosen, 5).withColumn("share", F.round("share", 6))


@query("split_losses", "WITH b AS (SELECT CASE WHEN event_id % 10 = 9 THEN 'val' ELSE 'train' END AS split, event_id // 16 AS batch, avg(value) AS loss FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY batch) AS n FROM b) SELECT split, count(*)::BIGINT AS batches, round(avg(loss), 6) AS loss FROM r WHERE n <= 25 GROUP BY split")
def split_losses(spark, sf_dir):
    """The mean of the first 25 batches' losses of either split."""
    batches = table(spark, sf_dir, "events").groupBy(F.when(F.col("event_id") % 10 == 9, "val").otherwise("train").alias("split"), F.expr("event_id div 16").alias("batch")).agg(F.avg("value").alias("loss"))
    return RUN.mean_loss(batches, "split", "batch", "loss", 25).withColumn("loss", F.round("loss", 6))


@query("combine_experts", f"WITH {SOFT} SELECT tok, round(sum(p * (expert + 1)), 6) AS y FROM sm WHERE rk <= 2 GROUP BY tok")
def combine_experts(spark, sf_dir):
    return softmaxed(spark, sf_dir).filter("rk <= 2").groupBy("tok").agg(F.round(F.sum(F.col("p") * (F.col("expert") + 1)), 6).alias("y"))


@query("permute_offsets", f"WITH {SOFT}, c AS (SELECT expert, count(*)::BIGINT AS n FROM sm WHERE rk <= 2 GROUP BY expert), a AS (SELECT expert, n, (greatest(n, 32) + 31) // 32 * 32 AS aligned FROM c) SELECT expert, n, aligned, (sum(aligned) OVER (ORDER BY expert) - aligned)::BIGINT AS start FROM a")
def permute_offsets(spark, sf_dir):
    c = softmaxed(spark, sf_dir).filter("rk <= 2").groupBy("expert").agg(n_rows().alias("n")).withColumn("aligned", F.expr("(greatest(n, 32) + 31) div 32 * 32"))
    # a row for each expert
    return c.withColumn("start", F.sum("aligned").over(Window.orderBy("expert")) - F.col("aligned"))


@query("round_robin", "SELECT vec_id AS tok, slot, (vec_id * 2 + slot) % 8 AS expert FROM embeddings, range(2) b(slot)")
def round_robin(spark, sf_dir):
    """Tokens dealt to experts in turn, two each."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tok"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("slot")).withColumn("expert", (F.col("tok") * 2 + F.col("slot")) % 8)


ANSWER = "CASE WHEN o_orderkey % 3 = 0 THEN 'so 12 and then #### ' || printf('%d', o_orderkey) || ' ok' WHEN o_orderkey % 3 = 1 THEN 'first 7, then ' || o_orderkey ELSE 'none' END"


def answers(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("so 12 and then #### "), F.col("o_orderkey").cast("string"), F.lit(" ok"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("first 7, then "), F.col("o_orderkey").cast("string"))).otherwise("none")
    marked = F.regexp_extract(text, r"####\s*(-?[\d,]+)", 1)
    last = F.element_at(F.regexp_extract_all(text, F.lit(r"-?\d[\d,]*"), F.lit(0)), -1)
    found = F.when(marked != "", marked).otherwise(F.when(text.rlike(r"\d"), last))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.replace(found, F.lit(","), F.lit("")).alias("answer"))


@query("numeric_answer", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey::VARCHAR END AS answer FROM orders")
def numeric_answer(spark, sf_dir):
    return answers(spark, sf_dir)


REWARDS = "rw AS (SELECT o_orderkey AS id, o_orderkey // 4 AS grp, CASE WHEN o_orderkey % 3 < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM orders)"


def rewards(spark, sf_dir):
    right = F.coalesce((F.col("answer") == F.col("o_orderkey").cast("string")).cast("double"), F.lit(0.0))
    return answers(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey div 4").alias("grp"), right.alias("r"))


@query("match_reward", f"WITH {REWARDS} SELECT * FROM rw")
def match_reward(spark, sf_dir):
    return rewards(spark, sf_dir)


@query("group_advantages", f"WITH {REWARDS} SELECT id, round(exp(r / 0.5) / avg(exp(r / 0.5)) OVER (PARTITION BY grp) - 1, 6) AS exponential, round(r - avg(r) OVER (PARTITION BY grp), 6) AS centred FROM rw")
def group_advantages(spark, sf_dir):
    w = Window.partitionBy("grp")
    return rewards(spark, sf_dir).select("id", F.round(F.exp(F.col("r") / 0.5) / F.avg(F.exp(F.col("r") / 0.5)).over(w) - 1, 6).alias("exponential"), F.round(F.col("r") - F.avg("r").over(w), 6).alias("centred"))


@query("clipped_policy_loss", "WITH x AS (SELECT exp((l_discount - l_tax) / 2) AS ratio, l_quantity - 25 AS adv, (l_discount - l_tax) / 2 AS d, l_discount / 2 - 1 AS now FROM lineitem), t AS (SELECT -avg(least(ratio * adv, greatest(0.98, least(1.02, ratio)) * adv)) AS loss, avg(ratio - 1 - d) AS kl, -avg(now) AS entropy, avg(CASE WHEN abs(ratio - 1) > 0.02 THEN 1.0 ELSE 0.0 END) AS clipped FROM x) SELECT round(loss, 6) AS loss, round(kl, 6) AS kl, round(entropy, 6) AS entropy, round(loss - 0.01 * entropy + 0.1 * kl, 6) AS total, round(clipped, 6) AS clipped FROM t")
def clipped_policy_loss(spark, sf_dir):
    """Lines as tokens with a new and an old log-probability: the clipped loss, its divergence estimate, an entropy bonus, and their sum."""
    x = table(spark, sf_dir, "lineitem").select((F.col("l_discount") / 2 - 1).alias("now"), (F.col("l_tax") / 2 - 1).alias("old"), (F.col("l_quantity") - 25).alias("adv"))
    found = RUN.clipped_loss(x, "now", "old", "adv", clip=0.02, entropy_weight=0.01, divergence_weight=0.1)
    return found.select(*[F.round(c, 6).alias(c) for c in ("loss", "kl", "entropy", "total", "clipped")])


@query("text_reward", "WITH a AS (SELECT conv_id, min(turn) AS turn, arg_min(split_part(text, ' ', 1), turn) AS answer FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT c.conv_id, c.turn, round(CASE WHEN length(text) = 0 THEN 0 ELSE (CASE WHEN length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / length(text)::DOUBLE > 0.1 THEN 0.1 ELSE 1.0 END) * (1 - 0.9 * length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / length(text)::DOUBLE) * CASE WHEN contains(lower(text), lower(answer)) THEN 2.0 ELSE 0.5 END END, 6) AS reward FROM conversations c JOIN a USING (conv_id) WHERE role = 'assistant'")
def text_reward(spark, sf_dir):
    """An assistant's turns, with the first word of the user's first turn as the answer that is expected."""
    c = table(spark, sf_dir, "conversations")
    expected = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by(F.split_part("text", F.lit(" "), F.lit(1)), "turn").alias("answer"))
    turns = c.filter("role = 'assistant'").join(expected, "conv_id")
    return turns.select("conv_id", "turn", F.round(RUN.text_reward(F.col("text"), F.col("answer")), 6).alias("reward"))


@query("loss_compare", "SELECT a.l_orderkey AS step, round(a.v, 4) AS baseline, round(b.v, 4) AS test, round(b.v - a.v, 4) AS diff FROM (SELECT l_orderkey, sum(l_tax) AS v FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) a JOIN (SELECT l_orderkey, sum(l_discount) AS v FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) b USING (l_orderkey)")
def loss_compare(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("step")).agg(F.sum("l_tax").alias("a"))
    b = li.filter("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("step")).agg(F.sum("l_discount").alias("b"))
    return a.join(b, "step").select("step", F.round("a", 4).alias("baseline"), F.round("b", 4).alias("test"), F.round(F.col("b") - F.col("a"), 4).alias("diff"))


@query("loss_equal", "SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS only_test, b.k IS NULL AS only_baseline FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def loss_equal(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("a")).distinct()
    b = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full").filter("a is null or b is null").select(F.coalesce("a", "b").alias("k"), F.col("a").isNull().alias("only_test"), F.col("b").isNull().alias("only_baseline"))


@query("weight_deltas", "SELECT p_brand, count(*)::BIGINT AS n, round(avg(abs(p_retailprice - c_acctbal)), 6) AS mean, round(max(abs(p_retailprice - c_acctbal)), 6) AS top FROM part JOIN customer ON p_partkey = c_custkey GROUP BY p_brand")
def weight_deltas(spark, sf_dir):
    delta = F.abs(F.col("p_retailprice") - F.col("c_acctbal"))
    joined = table(spark, sf_dir, "part").join(table(spark, sf_dir, "customer"), F.col("p_partkey") == F.col("c_custkey"))
    return joined.groupBy("p_brand").agg(n_rows().alias("n"), F.round(F.avg(delta), 6).alias("mean"), F.round(F.max(delta), 6).alias("top"))


@query("token_balanced_loss", "SELECT round(sum(l) / avg(n), 6) AS loss FROM (SELECT l_linenumber AS rank, sum(l_tax) AS l, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)")
def token_balanced_loss(spark, sf_dir):
    ranks = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").groupBy("l_linenumber").agg(F.sum("l_tax").alias("l"), n_rows().alias("n"))
    return ranks.agg(F.round(F.sum("l") / F.avg("n"), 6).alias("loss"))


@query("logit_divergence", f"WITH {SOFT}, b AS (SELECT tok + 1 AS tok, expert, p AS q FROM sm) SELECT tok, round(sum(p * (ln(p) - ln(q))) / 8, 9) AS kl FROM sm JOIN b USING (tok, expert) GROUP BY tok")
def logit_divergence(spark, sf_dir):
    p = softmaxed(spark, sf_dir).select("tok", "expert", "p")
    q = p.select((F.col("tok") + 1).alias("tok"), "expert", F.col("p").alias("q"))
    return p.join(q, ["tok", "expert"]).groupBy("tok").agg(F.round(F.sum(F.col("p") * (F.ln("p") - F.ln("q"))) / 8, 9).alias("kl"))


@query("fill_placeholders", "WITH d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents WHERE lang = 'fr') SELECT a.doc_id AS place, b.doc_id AS item FROM d a JOIN d b ON a.k = b.r")
def fill_placeholders(spark, sf_dir):
    """French documents as places and as items in the order of their length: the first place gets the first item."""
    d = table(spark, sf_dir, "documents").filter("lang = 'fr'")
    items = ranking.global_rank(d.select(F.col("doc_id").alias("item"), "n_chars"), "n_chars", ["n_chars", "item"]).drop("n_chars")
    return RUN.filled(ranking.global_rank(d.select(F.col("doc_id").alias("place")), "place", ["place"]), items, "rn").select("place", "item")
"""Logs, names and comparisons of training runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the formats.
COLOURS, STEP_LOSS = r"\x1b\[[0-9;]*m", r"step:\s*(\d+)\s*loss:\s*(\d+\.\d+)"


def plain(line: Column) -> Column:
    """A log line without terminal colours."""
    return F.regexp_replace(line, COLOURS, "")


def step_losses(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """step, loss of the lines that have both; of a step that is logged again the last counts."""
    text = plain(F.col(line))
    found = lines.filter(text.rlike(STEP_LOSS)).select(F.regexp_extract(text, STEP_LOSS, 1).cast("bigint").alias("step"), F.regexp_extract(text, STEP_LOSS, 2).cast("double").alias("loss"), F.col(order).alias("_at"))
    return found.groupBy("step").agg(F.max_by("loss", "_at").alias("loss"))


def loss_summary(baseline: DataFrame, test: DataFrame) -> DataFrame:
    """One row: the average losses of two runs and their difference; N/A in the text of what has no rows."""
    both = baseline.agg(F.avg("loss").alias("baseline")).join(test.agg(F.avg("loss").alias("test")))  # one row each
    said = lambda c: F.coalesce(F.format_number(c, 6), F.lit("N/A"))
    return both.select("baseline", "test", (F.col("test") - F.col("baseline")).alias("difference"), F.concat_ws(" ", said(F.col("baseline")), said(F.col("test")), said(F.col("test") - F.col("baseline"))).alias("text"))


def loss_mismatches(runs: list[DataFrame]) -> DataFrame:
    """run, step, first, other: where a run's steps or losses aren't those of the first run; no rows if all are equal."""
    first = runs[0].select("step", F.col("loss").alias("first"))
    parts = [first.join(r.select("step", F.col("loss").alias("other")), "step", "full").filter(~F.col("first").eqNullSafe(F.col("other"))).select(F.lit(k).cast("bigint").alias("run"), "step", "first", "other") for k, r in enumerate(runs[1:], 1)]
    return reduce(DataFrame.unionByName, parts)


def logprob_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: positions compared, how many differ, largest and mean difference, in single precision."""
    joined = a.select(*keys, F.col(value).cast("float").alias("_a")).join(b.select(*keys, F.col(value).cast("float").alias("_b")), keys)
    gap = F.abs(F.col("_a").cast("double") - F.col("_b").cast("double"))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a") != F.col("_b")).alias("n_different"), F.max(gap).alias("max_delta"), F.avg(gap).alias("avg_delta"))


def reduce_ranks(rows: DataFrame, step: str, value: str) -> DataFrame:
    """Per step the sum, mean and maximum over ranks."""
    return rows.groupBy(step).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def should_log(step: Column, every: int) -> Column:
    return (step == 1) | (step % every == 0)


def tags(names: DataFrame, corpus: str, name: str = "name") -> DataFrame:
    """One row: scale and seed as the first log name of a corpus (in name order) has them; small and 0 where it has none."""
    own = names.filter(F.col(name).contains(corpus)).agg(F.min(name).alias("_name"))
    scale = F.when(F.col("_name").contains("small"), "small").when(F.col("_name").contains("full"), "full").otherwise("small")
    return own.select(scale.alias("scale"), F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(_name, 'seed(\\d+)', 1), '') as bigint)"), F.lit(0).cast("bigint")).alias("seed"))


#: Arguments that stand elsewhere in a name, or in none: fixed values.
NEVER_NAMED = ("batch_size", "acc_steps", "run_prefix", "experiment_name", "moe", "weight_average", "exponential_weight_average")


def experiment_name(args: Column, defaults: dict[str, str], key_args: list[str] = (), ignored: list[str] = ()) -> Column:
    """A run's name from its arguments (a map of text in their order): batch x accumulation steps, key-value of the key
    arguments, and after two underscores key-value of each other one that has a default and isn't at it.

    A model's value begins with moe_ and ends in _WA or _EWA where these are True; ``run_prefix`` stands first; an
    ``experiment_name`` that is given is the name. Values that are null are written None.
    """
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else F.lit(None).cast("map<string,string>")
    value = lambda k: F.coalesce(F.try_element_at(args, F.lit(k)), F.lit("None"))
    on = lambda k: F.coalesce(F.try_element_at(args, F.lit(k)) == "True", F.lit(False))
    model = F.concat(F.when(on("moe"), "moe_").otherwise(""), value("model"), F.when(on("weight_average"), "_WA").otherwise(""), F.when(on("exponential_weight_average"), "_EWA").otherwise(""))
    named = [F.when(F.map_contains_key(args, k), F.concat(F.lit(f"{k}-"), model if k == "model" else value(k))) for k in key_args]
    prefix = F.concat_ws("_", F.try_element_at(args, F.lit("run_prefix")), F.concat(value("batch_size"), F.lit("x"), value("acc_steps")), *named)
    changed = F.map_filter(args, lambda k, v: ~k.isin(*key_args, *ignored, *NEVER_NAMED) & F.map_contains_key(known, k) & ~v.eqNullSafe(F.try_element_at(known, k))) if defaults else F.map_filter(args, lambda k, v: F.lit(False))
    rest = F.array_join(F.transform(F.map_entries(changed), lambda e: F.concat(e["key"], F.lit("-"), F.coalesce(e["value"], F.lit("None")))), "_")
    return F.coalesce(F.try_element_at(args, F.lit("experiment_name")), F.when(rest != "", F.concat(prefix, F.lit("__"), rest)).otherwise(prefix))


def checkpoints(saved: DataFrame, run: str, folder: str, keep: int) -> DataFrame:
    """``saved`` with step (the number in step-<n>; other names are left out), purge (not among the ``keep`` newest of its run) and newest."""
    numbered = saved.withColumn("step", F.expr(f"try_cast(nullif(regexp_extract({folder}, '^step-(\\\\d+)$', 1), '') as bigint)")).filter("step is not null")
    # Spark keeps the first of a run before it sorts it
    latest = numbered.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("step")))).filter(F.col("_n") <= keep)
    bounds = latest.groupBy(F.col(run).alias("_run")).agg(F.min("step").alias("_least"), F.max("step").alias("_most"))
    met = numbered.join(bounds, F.col(run).eqNullSafe(F.col("_run")))
    return met.withColumn("purge", F.col("step") < F.col("_least")).withColumn("newest", F.col("step") == F.col("_most")).drop("_run", "_least", "_most")


def mean_loss(batches: DataFrame, group: str, batch: str, loss: str, most: int = -1) -> DataFrame:
    """``group``, batches, loss: the mean of the batches' losses, of the first ``most`` in order (-1: of all)."""
    kept = batches
    if most >= 0:
        kept = batches.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(batch))).filter(F.col("_n") <= most)
    return kept.groupBy(group).agg(F.count(F.lit(1)).alias("batches"), F.avg(loss).alias("loss"))


def rank_folders(names: DataFrame, name: str = "name", pattern: str = r"rank_(\d+)") -> DataFrame:
    """name, rank of folders named by a rank; raises if names differ in more than the rank."""
    found = names.filter(F.col(name).rlike(pattern)).select(name, F.regexp_extract(name, pattern, 1).cast("bigint").alias("rank"), F.regexp_replace(name, pattern, "rank_*").alias("_template"))
    one = F.count_distinct("_template") <= 1
    # one row
    checked = F.broadcast(found.agg(F.assert_true(one, F.lit("folders differ in more than the rank")).alias("_checked")))
    return found.join(checked, F.col("_checked").isNull()).select(name, "rank")


def special_tokens(config: Column) -> Column:
    """(key, id, content) of the special tokens that a tokenizer's configuration (JSON) names: by key, and in its decoder table."""
    keys = ("bos_token", "eos_token", "pad_token", "unk_token", "sep_token", "cls_token", "mask_token")
    none = F.lit(None).cast("bigint")

    def found(text: Column, top: Column) -> Column:
        # only what looks like JSON is parsed again
        content = lambda k: F.when(top[k].rlike(r"^[{\[]"), F.coalesce(F.get_json_object(text, f"$.{k}.content"), top[k])).otherwise(top[k])
        named = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), none.alias("id"), content(k).alias("content")) for k in keys]), lambda s: s["content"].isNotNull())
        table = F.map_entries(F.from_json(F.coalesce(top["added_tokens_decoder"], F.lit("{}")), "map<string,string>"))
        added = F.transform(table, lambda e: F.struct(F.lit("added").alias("key"), e["key"].cast("bigint").alias("id"), F.get_json_object(e["value"], "$.content").alias("content")))
        return F.concat(named, F.filter(added, lambda s: s["content"].isNotNull()))

    # bound by arrays of one, so that the text is made once and parsed once
    parsed = F.transform(F.array(config), lambda c: F.struct(c.alias("text"), F.from_json(c, ", ".join(f"{k} string" for k in (*keys, "added_tokens_decoder"))).alias("top")))
    return F.element_at(F.transform(parsed, lambda s: found(s["text"], s["top"])), 1)


def throughput(seconds: Column, n_tokens: Column, loading: Column, flops_per_token: float, peak_flops: float, model_ranks: int = 1) -> dict[str, Column]:
    """Tokens a second of a device, its share of the peak and TFLOPS, and the share of time that went into loading data.

    All are null where no time went by.
    """
    tps = n_tokens / F.nullif(seconds * model_ranks, F.lit(0.0))
    return {"tps": tps, "mfu": 100 * flops_per_token * tps / peak_flops, "tflops": flops_per_token * tps / 1e12, "loading_share": 100 * loading / F.nullif(seconds, F.lit(0.0))}


def weight_deltas(now: DataFrame, before: DataFrame, name: str = "name", values: str = "w") -> DataFrame:
    """module, n, magnitude, relative: means over the parameters of a module (a name's first two parts) of the norm
    of the change and of that over the parameter's norm. Parameters that one side lacks are left out."""
    square = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    change = F.zip_with(F.col(values), F.col("_before"), lambda a, b: a - b)
    both = now.select(name, values).join(before.select(name, F.col(values).alias("_before")), name)
    each = both.select(F.substring_index(name, ".", 2).alias("module"), square(change).alias("_d"), square(F.col(values)).alias("_n"))
    return each.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("magnitude"), F.avg(F.col("_d") / (F.col("_n") + 1e-8)).alias("relative"))


def clipped_loss(tokens: DataFrame, now: str, old: str, advantage: str, clip: float = 0.2, entropy_weight: float = 0.0, divergence_weight: float = 0.0) -> DataFrame:
    """One row: the clipped policy loss of tokens' log-probabilities, the divergence estimate r - 1 - ln r, the entropy
    (the mean of -ln p), the share of clipped ratios, and total: loss - weight * entropy + weight * divergence."""
    ratio, adv = F.exp(F.col(now) - F.col(old)), F.col(advantage)
    bounded = F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio))
    sums = tokens.agg((-F.avg(F.least(ratio * adv, bounded * adv))).alias("loss"), F.avg(ratio - 1 - (F.col(now) - F.col(old))).alias("kl"), (-F.avg(now)).alias("entropy"), F.avg((F.abs(ratio - 1) > clip).cast("double")).alias("clipped"))
    return sums.withColumn("total", F.col("loss") - entropy_weight * F.col("entropy") + divergence_weight * F.col("kl"))


def filled(places: DataFrame, items: DataFrame, rank: str) -> DataFrame:
    """Places with the items of the same rank; raises if there aren't as many of both."""
    # one row
    counts = F.broadcast(places.agg(F.count(F.lit(1)).alias("_p")).join(items.agg(F.count(F.lit(1)).alias("_i"))).select(F.assert_true(F.col("_p") == F.col("_i"), F.concat(F.col("_p").cast("string"), F.lit(" places for "), F.col("_i").cast("string"), F.lit(" items"))).alias("_checked")))
    return places.join(items, rank).join(counts, F.col("_checked").isNull()).drop("_checked")


def text_reward(text: Column, answer: Column) -> Column:
    """A completion's reward: 0 if it is empty; a tenth where over a tenth of its characters aren't ASCII; less the more
    capitals it has, down to a tenth; twice that if it has the expected answer in any case, else half."""
    n = F.length(text)
    odd, upper = F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / n, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / n
    value = F.when(odd > 0.1, 0.1).otherwise(1.0) * (1 - 0.9 * upper) * F.when(F.contains(F.lower(text), F.lower(answer)), 2.0).otherwise(0.5)
    return F.when(n == 0, 0.0).otherwise(value)

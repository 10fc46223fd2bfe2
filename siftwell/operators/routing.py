"""Routing of tokens to experts, from rows (tok, expert, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.hashing import hash01


def with_probability(logits: DataFrame, gate: str = "softmax") -> DataFrame:
    """``logits`` and p: the softmax over a token's experts, or the sigmoid of each."""
    if gate not in ("softmax", "sigmoid"):
        raise ValueError(f"no gate is named {gate!r}; there are sigmoid, softmax")
    own = Window.partitionBy("tok")
    top = F.max("z").over(own)
    return logits.withColumn("p", F.exp(F.col("z") - top) / F.sum(F.exp(F.col("z") - top)).over(own) if gate == "softmax" else 1 / (1 + F.exp(-F.col("z"))))


def top_experts(probabilities: DataFrame, k: int, by: Column | None = None) -> DataFrame:
    """The ``k`` best experts of each token, by p or ``by``; the lesser expert wins a tie."""
    order = Window.partitionBy("tok").orderBy(F.desc("_by"), "expert")
    return probabilities.withColumn("_by", F.col("p") if by is None else by).withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k).drop("_by")


def choose(logits: DataFrame, k: int, softmax_first: bool = True) -> DataFrame:
    """tok, expert, weight: p of the best experts (softmax before the choice), or the softmax over the chosen alone."""
    top = top_experts(with_probability(logits), k)
    share = F.col("p") / F.sum("p").over(Window.partitionBy("tok"))
    return top.select("tok", "expert", (F.col("p") if softmax_first else share).alias("weight"))


def choose_with_bias(logits: DataFrame, biases: DataFrame, k: int, gate: str = "sigmoid", scale: float = 1.0, normalise: bool = True) -> DataFrame:
    """tok, expert, weight: experts chosen by p plus their bias (expert, bias: a row for each expert), weighed by p alone."""
    biased = with_probability(logits, gate).join(F.broadcast(biases), "expert")
    top = top_experts(biased, k, F.col("p") + F.col("bias"))
    weight = F.col("p") / (F.sum("p").over(Window.partitionBy("tok")) + 1e-20) if normalise else F.col("p")
    return top.select("tok", "expert", (weight * scale).alias("weight"))


def updated_biases(chosen: DataFrame, biases: DataFrame, rate: float = 1e-3) -> DataFrame:
    """expert, n, bias: moved by ``rate`` towards experts under the mean count, and centred again."""
    every = Window.partitionBy()  # a row for each expert
    counts = biases.join(chosen.groupBy("expert").agg(F.count(F.lit(1)).alias("_n")), "expert", "left").withColumn("n", F.coalesce("_n", F.lit(0)))
    step = rate * F.signum(F.avg("n").over(every) - F.col("n"))
    moved = counts.withColumn("_step", step)
    return moved.select("expert", "n", (F.col("bias") + F.col("_step") - F.avg("_step").over(every)).alias("bias"))


def log_probability(logits: DataFrame) -> DataFrame:
    """``logits`` and lp: the log-softmax over a token's experts, finite however far apart the logits are."""
    every = Window.partitionBy("tok")  # a row for each expert
    top = F.max("z").over(every)
    return logits.withColumn("_top", top).withColumn("lp", F.col("z") - F.col("_top") - F.ln(F.sum(F.exp(F.col("z") - F.col("_top"))).over(every))).drop("_top")


def balance_loss(logits: DataFrame, k: int, log_space: bool = False) -> DataFrame:
    """One row: experts times the mean over experts of (share of tokens that choose it) times (its mean probability).

    With ``log_space`` probabilities are averaged as their logarithms, by the logarithm of a sum of exponentials
    over the tokens, so none is lost below the smallest number.
    """
    if not log_space:
        p = with_probability(logits)
        mean = p.groupBy("expert").agg(F.avg("p").alias("m"), F.count(F.lit(1)).alias("n"))
    else:
        lp = log_probability(logits)
        p = lp.withColumn("p", F.exp("lp"))
        # a row for each expert
        tops = F.broadcast(lp.groupBy("expert").agg(F.max("lp").alias("_top")))
        mean = lp.join(tops, "expert").groupBy("expert", "_top").agg(F.sum(F.exp(F.col("lp") - F.col("_top"))).alias("s"), F.count(F.lit(1)).alias("n")).select("expert", F.exp(F.col("_top") + F.ln("s") - F.ln("n")).alias("m"), "n")
    chosen = top_experts(p, k).groupBy("expert").agg(F.count(F.lit(1)).alias("_in"))
    experts = mean.join(chosen, "expert", "left").withColumn("f", F.coalesce("_in", F.lit(0)) / F.col("n"))
    return experts.agg((F.avg(F.col("f") * F.col("m")) * F.count(F.lit(1))).alias("loss"))


def generated(logits: DataFrame, seed: int, temperature: float = 1.0, k: int | None = None) -> DataFrame:
    """tok, choice: one draw for each token from the softmax of its ``k`` highest logits over the temperature.

    The largest logit plus Gumbel noise of a hash is such a draw. Logits that tie with the k-th stay.
    """
    kept = logits if k is None else logits.withColumn("_rank", F.rank().over(Window.partitionBy("tok").orderBy(F.desc("z")))).filter(F.col("_rank") <= k)
    noise = -F.ln(-F.ln(hash01(seed, "tok", "expert")))
    return kept.groupBy("tok").agg(F.max_by("expert", F.struct(F.round(F.col("z") / max(temperature, 1e-6) + noise, 9), -F.col("expert"))).alias("choice"))


def logit_histogram(logits: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """bin, n of all logits: equal bins between low and high, outer ones open."""
    place = F.floor((F.col("z") - low) / (high - low) * bins)
    return logits.groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def expert_shares(chosen: DataFrame, layers: int) -> DataFrame:
    """layer (first, mid, last), expert, n, share of the layer's choices, of rows (layer from 0, expert)."""
    named = F.when(F.col("layer") == 0, "first").when(F.col("layer") == layers - 1, "last").when(F.col("layer") == layers // 2, "mid")
    counts = chosen.withColumn("layer", named).filter("layer is not null").groupBy("layer", "expert").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("layer")))  # a row for each expert

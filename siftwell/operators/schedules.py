"""Learning-rate schedules as columns of a step column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a rate falls from 1 to its last value, by the share of the decay that is done.
DECAYS = ("linear", "exp", "cosine", "mirror_cosine", "square", "sqrt")


def warmed(step: Column, n_warmup: int, div_factor: float) -> Column:
    """From 1 / div_factor to 1 in ``n_warmup`` steps."""
    share = step / F.lit(float(max(n_warmup, 1)))
    return share + (1 - share) / div_factor


def cos_inf(step: Column, n_iterations: int, n_warmup: int, div_factor: float, final_div_factor: float, n_inf: int) -> Column:
    """Warm-up, a half cosine, and its last value for the ``n_inf`` last steps and after."""
    last, end = 1 / div_factor / final_div_factor, n_iterations - n_inf
    t = (step - n_warmup) / F.lit(float(max(end - n_warmup, 1)))
    return F.when(step < n_warmup, warmed(step, n_warmup, div_factor)).when(step < end, last + 0.5 * (1 - last) * (1 + F.cos(F.pi() * t))).otherwise(last)


def fallen(kind: str, t: Column, last: float) -> Column:
    """The rate when share ``t`` of a decay to ``last`` is done."""
    between = lambda x: last + (1 - last) * x
    cosine = between(0.5 * (1 + F.cos(F.pi() * t)))
    rules = {"linear": between(1 - t), "exp": F.pow(F.lit(float(last)), t), "cosine": cosine, "mirror_cosine": 2 * between(1 - t) - cosine, "square": between(1 - t * t), "sqrt": between(1 - F.sqrt(t))}
    if kind not in rules:
        raise ValueError(f"no decay is named {kind!r}; there are {', '.join(DECAYS)}")
    return rules[kind]


def warmup_hold_decay(step: Column, n_iterations: int, n_warmup: int, decay_share: float, kind: str = "linear", last: float = 0.0, div_factor: float = 100.0) -> Column:
    """Warm-up, 1, a decay over the last ``decay_share`` of the steps, and its last value after."""
    n_decay = int(decay_share * n_iterations)
    hold = n_iterations - n_decay
    t = (step - hold) / F.lit(float(max(n_decay, 1)))
    return F.when(step < n_warmup, warmed(step, n_warmup, div_factor)).when(step < hold, 1.0).when(step < n_iterations, fallen(kind, F.greatest(t, F.lit(0.0)), last)).otherwise(float(last))


def warmup_stable_decay(step: Column, n_steps: int, n_warmup: int, decay_share: float | None = None, kind: str = "linear", least: float = 0.0) -> Column:
    """Warm-up that begins above 0, 1, and a decay that ends above 0, as there is one step more than are taken.

    Warm-up is cut to the steps there are, and the decay to those that warm-up leaves (all of them without ``decay_share``).
    """
    if kind not in ("linear", "sqrt", "cosine"):
        raise ValueError(f"no decay is named {kind!r}; there are linear, sqrt, cosine")
    n_warmup = min(n_warmup, n_steps)
    n_decay = n_steps - n_warmup if decay_share is None else min(round(n_steps * decay_share), n_steps - n_warmup)
    flat = n_steps + 1 - n_decay
    t = (step + 1 - flat) / F.lit(float(max(n_decay, 1)))
    return F.when(step < n_warmup, (step + 1) / F.lit(float(max(n_warmup, 1)))).when(step < flat, 1.0).otherwise(fallen(kind, F.greatest(t, F.lit(0.0)), least))


def prodigy_rate(d: Column, rate: Column, k: Column, beta1: float = 0.9, beta2: float = 0.999, corrected: bool = True) -> Column:
    """The effective rate d * rate, with the correction of both moments' bias if asked for."""
    return d * rate * (F.sqrt(1 - F.pow(F.lit(beta2), k + 1)) / (1 - F.pow(F.lit(beta1), k + 1)) if corrected else 1.0)


def horizon_means(rows: DataFrame, group: str, horizon: str, value: str, most: int) -> DataFrame:
    """``group``, back, mean: means of the 1, 2, ... ``most`` newest horizons' averages (a row for each of these)."""
    newest = Window.partitionBy(group).orderBy(F.desc(horizon))
    averages = rows.groupBy(group, horizon).agg(F.avg(value).alias("_mean"))
    kept = averages.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= most)
    return kept.select(group, F.col("back").cast("bigint").alias("back"), F.avg("_mean").over(newest.rowsBetween(Window.unboundedPreceding, 0)).alias("mean"))


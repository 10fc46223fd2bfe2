"""Choosing samples by score: Boltzmann sampling, redundancy, replay."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.hashing import hash01


def boltzmann(scores: DataFrame, temperature: float, score: str = "score", group: str = "step") -> DataFrame:
    """``scores`` and prob: exp((score - max) / temperature), normed within the group.

    The group's maximum and sum are aggregated and joined, so a large group isn't one task's.
    """
    top = scores.groupBy(group).agg(F.max(score).alias("_top"))
    weighed = scores.join(top, group).withColumn("_w", F.exp((F.col(score) - F.col("_top")) / max(temperature, 1e-6)))
    total = weighed.groupBy(group).agg(F.sum("_w").alias("_sum"))
    return weighed.join(total, group).withColumn("prob", F.col("_w") / F.col("_sum")).drop("_top", "_w", "_sum")


def top_k(rows: DataFrame, k: int, order: list, group: str = "step") -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark limits a group before sorting it."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= k)


def gumbel(score: Column, temperature: float, seed: int, *keys: str) -> Column:
    """A key whose k largest are k draws without replacement from the Boltzmann distribution."""
    return score / temperature - F.ln(-F.ln(hash01(seed, *keys)))


def greedy(rows: DataFrame, k: int, eta: float, penalty: float, temperature: float | None = None, seed: int = 0) -> DataFrame:
    """step, sample_id, rank: samples chosen one after another within each step.

    ``rows``: step, sample_id, score, g (a sample's flat gradient factors). Each round's score is
    eta * score - eta**2 * penalty * (g . mean of the chosen); the largest is taken, or one drawn
    at ``temperature``: the largest of exponents (no further than 50 below the best) and Gumbel noise of a
    hash. Scores that are no numbers are the least. A step is one batch of candidates, so its size is that of a batch.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_id")
        g, score = np.stack(pdf.g), np.nan_to_num(pdf.score.to_numpy(float), nan=-1e9)
        open_, total, out = np.ones(len(pdf), bool), np.zeros(g.shape[1]), []
        step, ids = int(pdf.step.iloc[0]), pdf.sample_id.tolist()
        for r in range(min(k, len(pdf))):
            now = eta * score - (eta**2 * penalty * (g @ total) / r if r else 0.0)
            if temperature is None:
                pick = int(np.argmax(np.where(open_, now, -np.inf)))
            else:
                z = np.clip((now - now[open_].max()) / max(temperature, 1e-6), -50, 0)
                u = np.array([(int(hashlib.md5(f"{seed}:{step}:{r}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in ids])
                pick = int(np.argmax(np.where(open_, z - np.log(-np.log(u)), -np.inf)))
            open_[pick] = False
            total += g[pick]
            out.append(pick)
        return pd.DataFrame({"step": pdf.step.iloc[0], "sample_id": pdf.sample_id.to_numpy()[out], "rank": np.arange(1, len(out) + 1)})

    return rows.groupBy("step").applyInPandas(choose, "step bigint, sample_id bigint, rank bigint")


def selection_stats(probabilities: DataFrame, score: str = "score") -> DataFrame:
    """step, entropy, mean_score, std_score (0 for one candidate)."""
    return probabilities.groupBy("step").agg((-F.sum(F.col("prob") * F.ln(F.col("prob") + 1e-10))).alias("entropy"), F.avg(score).alias("mean_score"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_score"))


def cosine(product: Column, norm_a: Column, norm_b: Column, eps: float = 1e-12) -> Column:
    return product / F.greatest(norm_a * norm_b, F.lit(eps))


def replay_metric(rows: DataFrame, metric: str) -> Column:
    """The logged dot, or its cosine; asking for a cosine of rows that were logged without norms raises."""
    if metric == "dot_product":
        return F.col("dot")
    if metric != "cosine":
        raise ValueError(f"no metric is named {metric!r}; there are dot_product, cosine")
    if not {"train_grad_norm", "val_grad_norm"} <= set(rows.columns):
        raise ValueError("a cosine needs train_grad_norm and val_grad_norm")
    return cosine(F.col("dot"), F.col("train_grad_norm"), F.col("val_grad_norm"))

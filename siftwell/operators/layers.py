"""Gradients of parameters that are vectors: normalisations, biases and embeddings.

A sample's gradient of such a parameter has as many numbers as the layer is wide (for an embedding,
as many for each token of the sample), so it is a table of numbers: sample_id, layer, part, token, i, g.
Linear layers and convolutions go through ``blocks``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators import blocks

#: What tells one number of a parameter from another.
PLACE = ["layer", "part", "token", "i"]


def normalised(x: Column, rms: bool = False, eps: float = 1e-5) -> Column:
    """A layer's input over the root of its variance (``rms``: of its mean square)."""
    mean = lambda f: F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v)) / F.size(x)
    centre = F.lit(0.0) if rms else mean(lambda v: v)
    spread = mean(lambda v: (v - centre) * (v - centre))
    return F.transform(x, lambda v: (v - centre) / F.sqrt(spread + eps))


def summed(rows: DataFrame, part: str, value: Column, at: Column | None = None) -> DataFrame:
    """A sample's sums over tokens of an array, number by number."""
    place = F.lit(0) if at is None else at
    spread = rows.select("sample_id", "layer", F.lit(part).alias("part"), place.cast("bigint").alias("token"), F.posexplode(value).alias("i", "x"))
    return spread.groupBy("sample_id", "layer", "part", "token", F.col("i").cast("bigint").alias("i")).agg(F.sum("x").alias("g"))


def vector_gradients(rows: DataFrame, kind: str) -> DataFrame:
    """sample_id, layer, part, token, i, g of rows sample_id, layer, a, b (a row a token; b: the gradient of the layer's output).

    ``kind``: layernorm (weight and bias), rmsnorm (weight), bias (of any layer), embedding (with the token in
    ``tok``; its number is in ``token``, and a token that a sample has twice is one row). Rows without b add nothing.
    """
    product = lambda rms: F.zip_with("b", normalised(F.col("a"), rms), lambda g, x: g * x)
    if kind == "layernorm":
        return summed(rows, "weight", product(False)).unionByName(summed(rows, "bias", F.col("b")))
    if kind == "rmsnorm":
        return summed(rows, "weight", product(True))
    if kind == "bias":
        return summed(rows, "bias", F.col("b"))
    if kind == "embedding":
        return summed(rows, "weight", F.col("b"), F.col("tok"))
    raise ValueError(f"no kind is named {kind!r}; there are layernorm, rmsnorm, bias, embedding")


def mean_gradients(gradients: DataFrame) -> DataFrame:
    """layer, part, token, i, g: averages over all samples (those that lack a number count as 0 there)."""
    # one row
    n = F.broadcast(gradients.agg(F.count_distinct("sample_id").alias("_n")))
    total = gradients.groupBy(*PLACE).agg(F.sum("g").alias("g"))
    return total.join(n).select(*PLACE, (F.col("g") / F.col("_n")).alias("g"))


def conv1d_gradient(rows: DataFrame) -> DataFrame:
    """layer, o, i, g: the mean gradients of layers that hold their weights input by output."""
    return blocks.entries(blocks.gradient(rows)).select("layer", F.col("i").alias("o"), F.col("o").alias("i"), F.col("x").alias("g"))


def squared_norms(gradients: DataFrame) -> DataFrame:
    """sample_id, norm2: squared norms over all parameters."""
    return gradients.groupBy("sample_id").agg(F.sum(F.col("g") * F.col("g")).alias("norm2"))


def dot_totals(train: list[DataFrame], val: list[DataFrame]) -> DataFrame:
    """sample_id, dot, train_grad_norm, val_grad_norm over all parameters of all layers.

    The validation gradient is the average over its samples; parameters that it lacks add to the norm alone.
    """
    mean = reduce(DataFrame.unionByName, [mean_gradients(v) for v in val]).withColumnRenamed("g", "_v")
    # one row
    norm = F.broadcast(mean.agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("val_grad_norm")))
    each = reduce(DataFrame.unionByName, train).join(mean, PLACE, "left")
    total = each.groupBy("sample_id").agg(F.sum(F.col("g") * F.coalesce("_v", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("train_grad_norm"))
    return total.join(norm).select("sample_id", "dot", "train_grad_norm", "val_grad_norm")

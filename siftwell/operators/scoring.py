"""Influence scores of candidate samples from per-token factors.

A sample's gradient of a layer is the sum over tokens of outer(b, a). Its score under an
optimizer is the inner product with a preconditioned validation direction, computed from
the factors without forming the gradient: sum over tokens of b' D a, with D = C * b_V a_V'.
``blocks`` has the layers' matrices and multiplies them; here is what works on columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers wider than this are vocabulary-sized and aren't scored.
WIDEST = 32768
BETA2, EPS, STEP, RHO = 0.999, 1e-8, 10, 0.04


def factors(embeddings: DataFrame, n_layers: int = 2, n_tokens: int = 2, width: int = 8) -> DataFrame:
    """sample_id, step, label, layer, t, a, b from one flat vector for each sample."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    parts = [F.struct(F.lit(k).alias("layer"), F.lit(t).alias("t"), F.slice(x, (k * n_tokens + t) * 2 * width + 1, width).alias("a"), F.slice(x, (k * n_tokens + t) * 2 * width + width + 1, width).alias("b")) for k in range(n_layers) for t in range(n_tokens)]
    spread = embeddings.select(F.col("vec_id").alias("sample_id"), F.expr("vec_id div 16").alias("step"), "label", F.explode(F.array(*parts)).alias("f"))
    return spread.select("sample_id", "step", "label", "f.*")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def literal(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def times(matrix: np.ndarray, vector: Column) -> Column:
    """A small fixed matrix times a vector column."""
    return F.array(*[dot(literal(row), vector) for row in matrix])


def sanitized(x: Column, bound: float = 1e9) -> Column:
    """NaN is 0; infinities are the bounds."""
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)))


def unfolded(image: Column, channels: int, height: int, width: int, kernel: int, stride: int = 1, padding: int = 0) -> Column:
    """The patches of a flat image that a convolution sees, row by row: each is the input of a linear layer."""
    high, wide = (height + 2 * padding - kernel) // stride + 1, (width + 2 * padding - kernel) // stride + 1

    def pixel(c: int, r: Column, k: Column) -> Column:
        inside = (r >= 0) & (r < height) & (k >= 0) & (k < width)
        return F.when(inside, F.get(image, (c * height * width + r * width + k).cast("int"))).otherwise(0.0)

    def patch(p: Column) -> Column:
        r, k = F.floor(p / wide) * stride - padding, p % wide * stride - padding
        return F.array(*[pixel(c, r + i, k + j) for c in range(channels) for i in range(kernel) for j in range(kernel)])

    return F.transform(F.sequence(F.lit(0), F.lit(high * wide - 1)), patch)


def scaled_norms(squares: Column, scale: float) -> Column:
    """Squared norms of gradients that were scaled."""
    return squares * scale**2


def train_rows(rows: DataFrame, is_val: str, n_train: int, n_total: int, reduction: str = "mean") -> DataFrame:
    """Rows of the training part alone, with b as if the loss were of that part: times n_total / n_train for a mean of all, 1 / n_train for a sum."""
    if reduction not in ("mean", "sum"):
        raise ValueError(f"no reduction is named {reduction!r}; there are mean, sum")
    factor = n_total / n_train if reduction == "mean" else 1 / n_train
    return rows.filter(~F.col(is_val)).withColumn("b", F.transform("b", lambda x: x * factor))


def count_sketch(vectors: DataFrame, id_col: str, vector_col: str, size: int, seed: int) -> DataFrame:
    """id, bucket, value: signed sums of the elements that hash to each of ``size`` buckets."""
    from siftwell.functions.hashing import hash_long

    spread = vectors.select(id_col, F.posexplode(vector_col).alias("i", "x"))
    sign = F.when(hash_long(f"{seed}s", "i") % 2 == 0, 1.0).otherwise(-1.0)
    return spread.groupBy(id_col, (hash_long(f"{seed}h", "i") % size).alias("bucket")).agg(F.sum(sign * F.col("x").cast("double")).alias("value"))

"""One step of optimizers' moving averages, as columns of their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moved(mean: Column, x: Column, beta: float) -> Column:
    """The moving average after ``x``."""
    return mean * beta + x * (1 - beta)


def ademamix(g: Column, fast: Column, slow: Column, v: Column, t: Column, betas=(0.9, 0.999, 0.9999), alpha: float = 5.0, eps: float = 1e-8) -> dict[str, Column]:
    """Two averages of one gradient: the corrected fast one plus ``alpha`` times the slow one, over the root of the second moment."""
    fast, slow, v = moved(fast, g, betas[0]), moved(slow, g, betas[2]), moved(v, g * g, betas[1])
    corrected = fast / (1 - F.pow(F.lit(betas[0]), t))
    return {"fast": fast, "slow": slow, "v": v, "update": (corrected + alpha * slow) / (F.sqrt(v) / F.sqrt(1 - F.pow(F.lit(betas[1]), t)) + eps)}


def lion(g: Column, m: Column, betas=(0.9, 0.99)) -> dict[str, Column]:
    """The sign of a short average; a longer one is kept."""
    return {"update": F.signum(moved(m, g, betas[0])), "m": moved(m, g, betas[1])}


def adopt(g: Column, m: Column, v: Column, betas=(0.9, 0.9999), eps: float = 1e-6) -> dict[str, Column]:
    """The gradient is divided by the root of the second moment before it, which takes the gradient in afterwards."""
    m = moved(m, g / F.greatest(F.sqrt(v), F.lit(eps)), betas[0])
    return {"update": m, "m": m, "v": moved(v, g * g, betas[1])}


def mars(g: Column, last_g: Column, m: Column, v: Column, norm: Column | None = None, betas=(0.95, 0.99), gamma: float = 0.025) -> dict[str, Column]:
    """Averages of a gradient that is corrected by its change, and cut to norm 1 (``norm``: that of the corrected one's whole)."""
    c = g + (g - last_g) * (gamma * betas[0] / (1 - betas[0]))
    c = c / F.greatest(F.abs(c) if norm is None else norm, F.lit(1.0))
    return {"corrected": c, "m": moved(m, c, betas[0]), "v": moved(v, c * c, betas[1])}


def sophia(g: Column, m: Column, h: Column, betas=(0.965, 0.99), rho: float = 0.04) -> dict[str, Column]:
    """The average's sign, at most 1 and less where the curvature is large."""
    m = moved(m, g, betas[0])
    return {"m": m, "h": moved(h, g * g, betas[1]), "update": F.signum(m) * F.least(F.abs(m) / (rho * h + 1e-15), F.lit(1.0))}


def signum(g: Column, m: Column, momentum: float = 0.9) -> dict[str, Column]:
    m = moved(m, g, momentum)
    return {"m": m, "update": F.signum(m)}


def trust_ratio(weight_norm: Column, update_norm: Column) -> Column:
    """Norm of the weights over that of the update, 1 if either is 0."""
    return F.when((weight_norm > 0) & (update_norm > 0), weight_norm / update_norm).otherwise(1.0)


def with_previous(states: DataFrame, param: str, step: str, moment: str = "v", name: str = "previous") -> DataFrame:
    """``states`` and the moment at the same parameter's step before; at the first step its own."""
    return states.withColumn(name, F.coalesce(F.lag(moment).over(Window.partitionBy(param).orderBy(step)), F.col(moment)))


def adopt_kernel(previous: Column, t: Column, beta2: float = 0.999, eps: float = 1e-8) -> Column:
    """1 over the corrected root of the moment of the step before (corrected as of step t - 1, at least 1)."""
    return 1 / F.greatest(F.sqrt(previous / (1 - F.pow(F.lit(beta2), F.greatest(t - 1, F.lit(1))))), F.lit(eps))


def raw_moment(gradients: DataFrame, param: str, t: str, g: str, beta2: float = 0.999) -> DataFrame:
    """param, v: the moving average of squared gradients since 0 at each parameter's last step (t = 1, 2, ..., without correction).

    In closed form, so that no series is held: each square weighs (1 - beta2) * beta2 ** (steps after it).
    """
    # a row for each parameter
    last = gradients.groupBy(param).agg(F.max(t).alias("_last"))
    weight = (1 - beta2) * F.pow(F.lit(beta2), F.col("_last") - F.col(t))
    return gradients.join(last, param).groupBy(param).agg(F.sum(weight * F.col(g) ** 2).alias("v"))

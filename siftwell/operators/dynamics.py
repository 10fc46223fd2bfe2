"""Statistics of training steps: norms of layers and neurons, root mean squares, and their curves made shorter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def step_statistics(rows: DataFrame, eps: float = 1e-8, scalars: str = "is_scalar") -> DataFrame:
    """step, layer, neuron (null: the whole layer; layer null too: the whole step), and what can be said of each.

    ``rows``: a row for each neuron, with arrays ``before`` and ``after`` (its parameters), ``grad``, ``fast`` and
    ``slow`` (moments; null where the optimizer has none). All levels come of one pass: sums of products are grouped
    by neuron, layer and step at once. Norms, the update's size by the parameters' and its angle (0 to pi); root mean
    squares, and the ratio of the slow moment's to the fast one's (null without them, and where the fast one is 0).
    Rows of vectors (``scalars`` true) count for the root mean squares of their layer only, as they have no neurons.
    """
    sums = rows.select(
        "step", "layer", "neuron", F.col(scalars).alias("scalar"), F.size("before").alias("n"), inner("before", "before").alias("pp"), inner("after", "after").alias("aa"), inner("before", "after").alias("pa"), inner("grad", "grad").alias("gg"),
        inner("fast", "fast").alias("ff"), inner("slow", "slow").alias("ss"), F.aggregate(F.zip_with("after", "before", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("dd"),
    )
    totals = [F.sum(c).alias(c) for c in ("n", "pp", "aa", "pa", "gg", "ff", "ss", "dd")]
    levels = sums.groupingSets([["step", "layer", "scalar", "neuron"], ["step", "layer", "scalar"], ["step"]], "step", "layer", "scalar", "neuron").agg(*totals, F.grouping("neuron").alias("no_neuron"), F.grouping("layer").alias("no_layer"))
    many = ~F.coalesce("scalar", F.lit(False))
    norm = lambda c: F.when(many, F.sqrt(c))
    cosine = F.col("pa") / F.greatest(F.sqrt("pp") * F.sqrt("aa"), F.lit(1e-8))
    rms = lambda c: F.sqrt(F.col(c) / F.col("n"))
    level = F.when(F.col("no_layer") == 1, "step").when(F.col("no_neuron") == 1, "layer").otherwise("neuron")
    return levels.withColumn("level", level).filter(many | (F.col("level") == "layer")).select(
        "level", "step", "layer", "neuron", norm("pp").alias("norm"), norm("gg").alias("grad_norm"), norm("dd").alias("update_norm"), F.when(many, (F.sqrt("dd") + eps) / (F.sqrt("pp") + eps)).alias("relative_update"), F.when(many, F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))).alias("angular_update"),
        rms("pp").alias("rms"), rms("gg").alias("grad_rms"), rms("dd").alias("update_rms"), rms("ff").alias("fast_rms"), rms("ss").alias("slow_rms"), F.when(F.col("ff") > 0, F.sqrt(F.col("ss") / F.col("ff"))).alias("fast_slow_ratio"),
    )


#: What a block of steps is reduced to; the global ones are over all channels too.
REDUCERS = ("mean", "rms", "first", "global_mean", "global_rms")


def shortened(series: DataFrame, by: list[str], step: str, channel: str, value: str, block: int, reducer: str, most_channels: int = 0) -> DataFrame:
    """``by``, block, channel (null for the global reducers) and value: each ``block`` steps as one, of the first ``most_channels`` channels (0: of all).

    ``first`` is the value at the first step that is there. Steps and channels are numbered from 0.
    """
    if reducer not in REDUCERS:
        raise ValueError(f"no reducer is named {reducer!r}; there are {', '.join(REDUCERS)}")
    kept = series if most_channels <= 0 else series.filter(F.col(channel) < most_channels)
    x = F.col(value)
    made = F.min_by(x, F.col(step)) if reducer == "first" else F.avg(x) if reducer.endswith("mean") else F.sqrt(F.avg(x * x))
    place = F.lit(None).cast("long") if reducer.startswith("global") else F.col(channel)
    return kept.groupBy(*by, F.floor(F.col(step) / block).cast("long").alias("block"), place.alias("channel")).agg(made.alias("value"))

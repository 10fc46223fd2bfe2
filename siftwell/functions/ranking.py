"""Global ranks and running sums, minima and maxima without a window over the whole table.

Rows are dealt into ordered buckets; windows run inside buckets, and only one row for
each bucket is folded in order. There are ``BUCKETS`` at most, however the keys lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal ranges that the span of a number column is cut into.
BUCKETS = 4096


def hash_bucket(hex_col: str) -> Column:
    """The bucket of hexadecimal keys: 4,096 equal ranges of them."""
    return F.conv(F.substring(hex_col, 1, 3), 16, 10).cast("bigint")


def with_bucket(df: DataFrame, bucket: Column | str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` and ``_bucket``: the given one, or the range of a number column that a row is in.

    Nulls come first, as they do when rows are sorted; they are dealt to as many buckets by a hash,
    in which order they then are.
    """
    if not isinstance(bucket, str):
        return df.withColumn("_bucket", bucket)
    x = F.col(bucket).cast("double")
    # one row
    span = F.broadcast(df.agg(F.min(x).alias("_low"), F.max(x).alias("_high")))
    place = F.floor((x - F.col("_low")) / (F.col("_high") - F.col("_low")) * (buckets - 1)).cast("bigint")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(buckets)) - buckets
    return df.join(span).withColumn("_bucket", F.when(x.isNull(), spread).when(F.col("_high") > F.col("_low"), place).otherwise(F.lit(0).cast("bigint"))).drop("_low", "_high")


def running(df: DataFrame, bucket: Column | str, order: list, value: Column, name: str, group: list[str] | None = None, fold: str = "sum") -> DataFrame:
    """``df`` and the sum, min or max of ``value`` over the rows before each (exclusive; null if there is none), within ``group`` if given.

    ``bucket``: a number column that the order begins with (ascending), or an expression that
    doesn't decrease with the order. Rows whose group or number is null are kept.
    """
    group, f = group or [], {"sum": F.sum, "min": F.min, "max": F.max}[fold]
    numbered = with_bucket(df.withColumn("_value", value), bucket)
    totals = numbered.groupBy(*group, "_bucket").agg(f("_value").alias("_total"))
    over = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.col("_bucket").alias("_b"), f("_total").over(over).alias("_base"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = numbered.withColumn("_local", f("_value").over(inside))
    same = F.col("_bucket") == F.col("_b")
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    both = {"sum": F.coalesce("_base", F.lit(0)) + F.coalesce("_local", F.lit(0)), "min": F.least("_base", "_local"), "max": F.greatest("_base", "_local")}[fold]
    return local.join(bases, same).withColumn(name, both).drop("_bucket", "_value", "_base", "_local", "_b", *[f"_g{k}" for k in range(len(group))])


def running_sum(df: DataFrame, bucket: Column | str, order: list, value: Column, name: str, group: list[str] | None = None) -> DataFrame:
    """As ``running``, for whole numbers; 0 where no row is before."""
    return running(df, bucket, order, value.cast("bigint"), name, group).withColumn(name, F.col(name).cast("bigint"))


def global_rank(df: DataFrame, bucket: Column | str, order: list, name: str = "rn", group: list[str] | None = None) -> DataFrame:
    """``df`` and each row's place, from 1, in the order (within ``group`` if given)."""
    ranked = running_sum(df, bucket, order, F.lit(1), "_before", group)
    return ranked.withColumn(name, (F.col("_before") + 1).cast("bigint")).drop("_before")

"""Randomness that doesn't depend on partitions or order: hashes of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_key(seed: int | str, *keys: Column | str) -> Column:
    """32 hexadecimal digits; ordering by them shuffles."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def hash_long(seed: int | str, *keys: Column | str) -> Column:
    """A uniform integer of 52 bits."""
    return F.conv(F.substring(hex_key(seed, *keys), 1, 13), 16, 10).cast("bigint")


def hash01(seed: int | str, *keys: Column | str) -> Column:
    """Uniform in (0, 1)."""
    return (hash_long(seed, *keys).cast("double") + 0.5) / F.lit(float(2**52))


def hash_mod(seed: int | str, n: Column | int, *keys: Column | str) -> Column:
    """Uniform in 0 .. n-1."""
    return F.pmod(hash_long(seed, *keys), n if isinstance(n, Column) else F.lit(n).cast("bigint"))

"""Numbers: idf, saturation, length and the eight switch settings, softmax, dot products, hash order."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight settings in bit order idf, saturation, length.
CONFIGS = tuple("".join(b) for b in product("01", repeat=3))
K1, B = 1.2, 0.75


def smoothed_idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 1/2) / (df + 1/2)); df may be 0."""
    return F.log1p((n - df + 0.5) / (df + 0.5))


def relative_length(length: Column, average: Column, b: float = B) -> Column:
    """1 - b + b * length / average; 1 where the average is 0."""
    return F.when(average > 0, (1 - b) + b * length / average).otherwise(F.lit(1.0))


def transformed(value: Column, idf: Column, relative: Column, config: str, k1: float = K1) -> Column:
    """A posting's value under one setting."""
    by_length = relative if config[2] == "1" else F.lit(1.0)
    out = (k1 + 1) * value / (value + k1 * by_length) if config[1] == "1" else value / by_length
    return out * idf if config[0] == "1" else out


def effective_key(config: Column, k1: Column, b: Column) -> Column:
    """The setting with inert parameters dropped, so that equal postings have equal keys: k1 counts with saturation, b with length."""
    return F.concat_ws("|", config, F.when(F.substring(config, 2, 1) == "1", k1.cast("string")).otherwise("-"), F.when(F.substring(config, 3, 1) == "1", b.cast("string")).otherwise("-"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hash_key(seed: str, key: Column) -> Column:
    """Order by this is order by the SHA-256 of ``seed:key``, whatever the input's order."""
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)


def softplus(x: Column) -> Column:
    """ln(1 + e**x), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))

"""Vectors as arrays of numbers; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 where either is empty or zero. The longer vector is cut to the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(x) * norm(y)
    return F.when((n <= 0) | (size == 0), 0.0).otherwise(dot(x, y) / size)


def normalized(v) -> Column:
    """v at length 1; zeros where its length is 0."""
    with_norm = F.transform(F.array(doubles(v)), lambda d: F.struct(d.alias("d"), norm(d).alias("n")))  # a lambda, so that the norm is taken once
    return F.element_at(F.transform(with_norm, lambda p: F.transform(p["d"], lambda x: F.when(p["n"] == 0, 0.0).otherwise(x / p["n"]))), 1)


def preview(v, shown: int = 8) -> Column:
    return F.struct(F.size(v).alias("dimensions"), F.slice(v, 1, shown).alias("values"))


def literal(v, digits: int = 8) -> Column:
    return F.transform(doubles(v), lambda x: F.round(x, digits))


def hashed(t, dimensions: int = 1024) -> Column:
    """A vector of length 1 that depends on the trimmed lower-case text only: bytes of its SHA-256 digests, from -1 to 1."""
    key = F.lower(F.trim(t))
    hexes = F.concat(*(F.sha2(F.concat(key, F.lit(f":{at}")), 256) for at in range(0, dimensions, 32)))
    values = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.conv(F.substr(hexes, 2 * k + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)
    with_norm = F.transform(F.array(values), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))  # a lambda, so that digests are made once
    return F.element_at(F.transform(with_norm, lambda p: F.transform(p["v"], lambda x: x / p["n"])), 1)

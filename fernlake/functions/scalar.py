"""Scalar helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Place of each band in an image's stack; there is no band 10.
BANDS = {"1": 0, "2": 1, "3": 2, "4": 3, "5": 4, "6": 5, "7": 6, "8": 7, "8a": 8, "9": 9, "11": 10, "12": 11}


def band_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "^0+", "")


def band_index(c: Column) -> Column:
    """The band's place; an unknown one fails."""
    known = F.create_map(*[x for k, v in BANDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(known[band_id(c)], F.raise_error(F.concat(F.lit("unknown band "), c)).cast("int"))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def is_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def token_count(c: Column) -> Column:
    return F.size(F.split(c, " "))


def bits(c: Column, width: int) -> Column:
    return F.lpad(F.bin(c), width, "0")


def padded(c: Column, size: int, fill) -> Column:
    """The array cut or filled up to a size."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(fill), size)), 1, size)


def warmup(step: Column, warm: float, total: float) -> Column:
    """Learning rate factor: rises to 1 over the warm share, then falls to 0."""
    x = step / F.lit(float(total))
    return F.when(x < warm, x / warm).otherwise(F.greatest((1 - x) / F.lit(1 - warm), F.lit(0.0)))


def _difference(a: Column, b: Column) -> Column:
    """Differences in double precision, whatever the arrays hold."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(_difference(a, b), F.lit(0.0), lambda s, x: s + x * x)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(_difference(a, b), F.lit(0.0), lambda s, x: s + F.abs(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.transform(_difference(a, b), F.abs))


DISTANCES = {"sqeuclidean": squared_distance, "euclidean": lambda a, b: F.sqrt(squared_distance(a, b)), "cityblock": manhattan, "cosine": cosine_distance, "chebyshev": chebyshev}


def truncated_pair(a: Column, b: Column, limit: int) -> tuple[Column, Column]:
    """Two token arrays cut to a joint length: the longer gives up tokens first, the second of equals."""
    na, nb = F.size(a), F.size(b)
    half = F.lit(limit // 2)
    ka = F.when(na + nb <= limit, na).when(nb <= limit - F.least(na, half + limit % 2), F.least(na, F.greatest(F.lit(limit) - nb, half + limit % 2))).otherwise(F.least(na, half + limit % 2))
    kb = F.least(nb, F.lit(limit) - ka)
    return F.slice(a, 1, F.greatest(ka, F.lit(0))), F.slice(b, 1, F.greatest(kb, F.lit(0)))


def pair_features(a: Column, b: Column, limit: int, pad: int = 0) -> dict[str, Column]:
    """ids, segments and mask of a pair of id arrays, each padded to the limit."""
    x, y = truncated_pair(a, b, limit)
    both = F.concat(x, y)
    segments = F.concat(F.array_repeat(F.lit(0), F.size(x)), F.array_repeat(F.lit(1), F.size(y)))
    return {"ids": padded(both, limit, pad), "segments": padded(segments, limit, 0), "mask": padded(F.array_repeat(F.lit(1), F.size(both)), limit, 0)}

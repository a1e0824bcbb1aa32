"""Vectors as arrays of doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: PJ19: how the norm is kept from zero.
EPS = {"plus": 1e-12, "loose": 1e-5, "floor": 1e-12}


def dot(a: Column, b: Column) -> Column:
    """PJ21."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column, form: str = "plus") -> Column:
    """PJ19: v over its length; plus and loose add a little to the length, floor bounds it below."""
    length = F.greatest(norm(v), F.lit(EPS[form])) if form == "floor" else norm(v) + F.lit(EPS[form])
    return F.transform(v, lambda x: x.cast("double") / length)


def prefix(v: Column, width: int) -> Column:
    """PJ20."""
    return F.slice(v, 1, max(1, width))


def prefix_widths(width: int, divisors: list[int]) -> list[int]:
    """PJ20: width // divisor for each, in [1, width], in order, each once."""
    return list(dict.fromkeys(min(width, max(1, width // d)) for d in divisors))


def cosine_distance(a: Column, b: Column) -> Column:
    """PJ21."""
    return 1 - dot(unit(a), unit(b))


def angular(distance: Column) -> Column:
    """PJ21: the length of the difference of unit vectors at a cosine distance."""
    return F.sqrt(2 * F.greatest(distance, F.lit(0.0)))


def density(distances: Column) -> Column:
    """PJ24: sum of 1 / (d^2 + 1e-6)."""
    return F.aggregate(distances, F.lit(0.0), lambda s, d: s + 1 / (d * d + 1e-6))


def variance(values: list[Column]) -> Column:
    """Population variance of a row's numbers."""
    mean = reduce(lambda a, b: a + b, values) / len(values)
    return reduce(lambda a, b: a + b, [(v - mean) * (v - mean) for v in values]) / len(values)


def slice_count(channels: list[int], preferred: int) -> int:
    """PJ22: the most slices, up to the preferred number, that divide every map's channels."""
    return next(c for c in range(preferred, 0, -1) if all(n % c == 0 for n in channels))


def interleave(maps: list[Column], channels: list[int], preferred: int) -> Column:
    """PJ22: slices of all maps in turn, the map of fewest channels first, so that a prefix holds a part of each."""
    order = sorted(range(len(maps)), key=lambda i: channels[i])
    n = slice_count(channels, preferred)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(*[F.slice(maps[j], i * (channels[j] // n) + 1, channels[j] // n) for j in order])))


def concatenated(maps: list[Column]) -> Column:
    """PJ23: one vector of all maps, one after the other."""
    return F.concat(*maps)


def separated(maps: list[Column]) -> Column:
    """PJ23: a generator of map_idx, embedding: a row for each map."""
    return F.posexplode(F.array(*maps)).alias("map_idx", "embedding")

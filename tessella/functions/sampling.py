"""Seeded hashes of keys: the same in every engine that has MD5, so that samples can be checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(key: Column, seed: int) -> Column:
    """A text that puts keys in a seeded random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def bucket(key: Column, seed: int, n: int) -> Column:
    """One of n buckets, by the first 60 bits of the hash."""
    return F.conv(F.substring(order_key(key, seed), 1, 15), 16, 10).cast("long") % n

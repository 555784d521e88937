"""Repeatable random order: the md5 of a key and a seed, so that any engine can replay it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def hash_order(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def hash_uniform(*parts: Column | int | str) -> Column:
    """Whole number in [0, 2**32) from the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")

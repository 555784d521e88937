"""Array-of-double arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_all(a: Column, digits: int = 6) -> Column:
    """Round every element half to even."""
    return F.transform(a, lambda x: F.bround(x, digits))


def take_dims(features: Column, dims: int | None) -> Column:
    """The first ``dims`` features (the means), or all of them."""
    return features if dims is None else F.slice(features, 1, dims)


def standardize(a: Column, mean: Column, std: Column) -> Column:
    """``(x - mean) / std``; a constant feature is divided by one."""
    centred = F.zip_with(a, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: F.when(s == 0, x).otherwise(x / s))


def subarray(a: Column, start: Column, length: Column) -> Column:
    """``length >= 1`` elements from the 0-based ``start``, for use inside lambdas.

    ``slice`` inside a lambda copies the whole array at every call; reading by index does not, so
    cutting a long document into many parts stays linear.
    """
    return F.transform(F.sequence(start, start + length - 1), lambda i: F.get(a, i))

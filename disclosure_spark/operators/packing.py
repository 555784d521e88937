"""Greedy packing of consecutive lines into chunks below a word budget.

The lines of a report travel together in its row, so packing needs no shuffle: word counts are
taken in the JVM, only those integers cross to Python for the ordered fold, and the chunk texts
are cut from the line array back in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclosure_spark.functions.text import lines_of, word_count
from disclosure_spark.functions.vectors import subarray


def word_budget(max_len: int) -> int:
    """Nine tenths of the sequence length, leaving room for sub-word growth."""
    return int(max_len * 0.9)


def chunk_bounds(counts: Iterable[int], budget: int, lossless: bool) -> list[int]:
    """Flat ``[start, length, start, length, ...]`` of the chunks of one document.

    A chunk takes lines while its word total stays below ``budget``; a first line of any size
    opens a chunk.  Without ``lossless``, the line that would overflow is dropped and the
    document's last line is never looked at.
    """
    counts = list(counts)
    visible = counts if lossless else counts[:-1]
    bounds: list[int] = []
    words = None
    for at, n in enumerate(visible):
        if words is not None and words + n < budget:
            words += n
            bounds[-1] += 1
        elif words is None or lossless:
            bounds += [at, 1]
            words = n
        else:
            words = None
    return bounds


def _bounds_udf(budget: int, lossless: bool):
    def fold(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: chunk_bounds(c, budget, lossless))

    return F.pandas_udf(fold, "array<int>")


def _cut(lines: Column, bounds: Column) -> Column:
    last = F.shiftright(F.size(bounds), 1) - 1
    chunks = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        chunks,
        lambda i: F.array_join(subarray(lines, bounds[i * 2], bounds[i * 2 + 1]), " "),
    )


def pack_reports(
    docs: DataFrame,
    max_len: int,
    *,
    mode: str = "lossless",
    key: str = "report_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(key, *keep, chunk, text)``: the lines of each document packed below the word budget.

    ``mode='compat'`` loses the last line and one line per overflow, ``'lossless'`` keeps all.
    """
    if mode not in ("compat", "lossless"):
        raise ValueError(f"unknown packing mode {mode!r}")
    fold = _bounds_udf(word_budget(max_len), mode == "lossless")
    lined = docs.select(key, *keep, lines_of(F.col(text)).alias("_lines"))
    counted = lined.withColumn("_n", F.transform("_lines", lambda s: word_count(s).cast("int")))
    # no filter on empty packings: it would be pushed below the fold and run it twice
    bounded = counted.withColumn("_at", fold("_n"))
    return bounded.select(key, *keep, F.posexplode(_cut(F.col("_lines"), F.col("_at"))).alias("chunk", "text"))

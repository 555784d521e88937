"""Columns of many small records as one row per bucket, so that a shuffle of millions of records moves few rows.

A task sorts the records of some megabytes of text by bucket and sends, per bucket and column, one run of
bytes.  The receiving group works on whole arrays.  Buckets are even shares of a hash, and their number
grows with the bytes of text, so that a group stays small at every size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_PER_BUCKET = 2_000_000
NO_ID = -(1 << 63)


def bucket_count(docs: DataFrame, text_col: str = "text", per_bucket: int = TEXT_PER_BUCKET) -> int:
    """Number of buckets for the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long")).alias("n")).head()["n"]
    return max(1, -(-(total or 0) // per_bucket))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carried: str) -> DataFrame:
    """``doc`` (integer id, nulls first), ``version`` and ``text``.

    Rows that share an id are versions of one document; the version is 0 where no id repeats, else a hash
    of the text, so that equal rows are one version and different texts keep apart.  ``carried`` columns come along.
    """
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    repeats = docs.groupBy(ids.alias("doc")).count().filter("count > 1").limit(1).count() > 0
    text = F.coalesce(F.col(text_col), F.lit(""))
    version: Column = F.xxhash64(text) if repeats else F.lit(0).cast("long")
    return docs.select(ids.alias("doc"), version.alias("version"), text.alias("text"), *carried)


def plain_id(doc: str = "doc") -> Column:
    return F.when(F.col(doc) != NO_ID, F.col(doc))


def send(bucket: np.ndarray, columns: dict[str, np.ndarray], order: tuple[str, ...]) -> pd.DataFrame:
    """One row per bucket that has records; the columns come as runs of bytes."""
    at = np.argsort(bucket, kind="stable")
    ordered = bucket[at]
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(at)]))
    out: dict[str, object] = {"bucket": ordered[starts]} if len(at) else {"bucket": ordered}
    for name in order:
        values = np.ascontiguousarray(columns[name][at])
        raw, size = values.tobytes(), values.dtype.itemsize
        out[name] = [raw[size * a:size * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)] if len(at) else []
    return pd.DataFrame(out)


def receive(rows: pd.DataFrame, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The records of a group."""
    return {name: np.frombuffer(b"".join(rows[name]), dtype=kind) for name, kind in kinds.items()}


def schema(kinds: dict[str, str]) -> str:
    return ", ".join(["bucket long", *[f"{name} binary" for name in kinds]])


def runs(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal rows."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new

"""Pooling, scaling, encoding and projection of embeddings."""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disclosure_spark.functions.vectors import round_all, standardize
from disclosure_spark.operators.kernel import SEED, merged_vectors, uniform
from disclosure_spark.session import broadcast_if_small, single_value


def moments(df: DataFrame, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """``(by, n, mean, std)`` with population deviations, for arrays of any width.

    The summarizer merges partial vectors before the shuffle, so neither a wide array nor a group
    holding most of the rows multiplies what is moved.
    """
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(features)))
    summed = df.groupBy(*by).agg(stats.alias("s"))
    n = F.col("s.count")
    spread = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return summed.select(*by, n.alias("n"), vector_to_array("s.mean").alias("mean"), spread.alias("std"))


def pool_sequences(steps: DataFrame, key: str = "report_id", embedding: str = "embedding") -> DataFrame:
    """Mean and population deviation over a report's sequence embeddings, one array after the other."""
    return moments(steps, embedding, [key]).select(key, F.concat("mean", "std").alias("features"))


def pool_sequences_by_position(steps: DataFrame, key: str = "report_id", embedding: str = "embedding") -> DataFrame:
    """The same pooling with plain aggregates over exploded positions; for narrow arrays and cross-checks."""
    cells = steps.select(key, F.posexplode(embedding).alias("at", "v"))
    pooled = cells.groupBy(key, "at").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "mean", "std")))
    return pooled.groupBy(key).agg(ordered.alias("c")).select(key, F.concat("c.mean", "c.std").alias("features"))


def scale(df: DataFrame, fitted: DataFrame, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """Standardize with moments fitted elsewhere (constant features are only centred)."""
    if by:
        joined = df.join(broadcast_if_small(fitted.select(*by, "mean", "std"), 1_000), list(by))
        scaled = standardize(F.col(features), F.col("mean"), F.col("std"))
        return joined.withColumn(features, scaled).select(*df.columns)
    one = single_value(fitted.select(F.struct("mean", "std").alias("m")))
    held = df.withColumn("_m", one)
    scaled = standardize(F.col(features), F.col("_m.mean"), F.col("_m.std"))
    return held.withColumn(features, scaled).drop("_m")


def scale_split(train: DataFrame, test: DataFrame, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Both parts scaled with the statistics of the first."""
    fitted = moments(train, features)
    return scale(train, fitted, features), scale(test, fitted, features)


def encode_labels(df: DataFrame, label: str, out: str = "y") -> DataFrame:
    """Class numbers 0.. by sorted order of the class names (there are few of them)."""
    names = df.select(label).distinct()
    ranked = names.withColumn(out, (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(label)) - 1).cast("int"))
    return df.join(broadcast_if_small(ranked, 100_000), label)


def attach_steps(index: DataFrame, steps: DataFrame, key: str = "report_id") -> DataFrame:
    """Sequence features of the indexed reports, with the index columns carried along."""
    return steps.join(index, key)


def step_counts(steps: DataFrame, key: str = "report_id") -> DataFrame:
    return steps.groupBy(key).agg(F.count("*").alias("n_steps"))


def steps_histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.col("n_steps").alias("length")).agg(F.count("*").alias("occurences"))


def longest_report(counts: DataFrame, key: str = "report_id") -> DataFrame:
    """The report with most steps; the earliest wins a tie."""
    best = F.max_by(F.struct(F.col(key), "n_steps"), F.struct("n_steps", (-F.col(key)).alias("first")))
    return counts.agg(best.alias("b")).select("b.*")


def length_batches(steps: DataFrame, key: str = "report_id", embedding: str = "embedding") -> DataFrame:
    """``(key, n_steps)`` of reports with at least one non-empty step.

    Reports of equal ``n_steps`` form one batch.  They stay one row each instead of being collected,
    so a very common length is no burden; a trainer reads a batch by partition of ``n_steps``.
    """
    first_width = F.min_by(F.size(embedding), "step")
    sized = steps.groupBy(key).agg(F.count("*").alias("n_steps"), first_width.alias("w"))
    return sized.filter((F.col("n_steps") > 0) & (F.col("w") > 0)).select(key, "n_steps")


def embed(
    chunks: DataFrame,
    network: Callable[[Sequence[str]], np.ndarray],
    *,
    key: str = "report_id",
    order: str = "chunk",
    text: str = "text",
    digits: int = 6,
    most_characters: int = 1 << 18,
) -> DataFrame:
    """``(key, step, embedding)`` from a caller-supplied network, run on Arrow batches in the tasks.

    ``network`` maps a list of texts to a matrix with one row each; values are rounded half to even.  A call
    gets texts of at most ``most_characters`` together, or a single longer one, so its memory is bounded by the
    work and not by the number of rows.  A null text is an empty one.
    """
    import pyspark.sql.types as T

    schema = T.StructType([
        T.StructField(key, chunks.schema[key].dataType), T.StructField("step", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
    ])

    def run(batches):
        for pdf in batches:
            texts = pdf[text].fillna("")
            ends = texts.str.len().cumsum().to_numpy()
            start = 0
            while start < len(pdf):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + most_characters, side="right")))
                rows = np.asarray(network(texts.iloc[start:stop].tolist()), dtype=float)
                part = pdf.iloc[start:stop]
                yield pd.DataFrame({key: part[key], "step": part[order].astype("int32"), "embedding": list(rows)})
                start = stop

    raw = chunks.select(key, order, text).mapInPandas(run, schema)
    return raw.withColumn("embedding", round_all(F.col("embedding"), digits))


@functools.lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)


def hashed_projection(
    context: SparkContext, width: int = 32, buckets: int = 1_024, seed: int = SEED
) -> Callable[[Sequence[str]], np.ndarray]:
    """A network for ``embed``: mean over a text's words of one hashed row of a seeded weight matrix.

    Words are maximal stretches without blanks, lower-cased in A-Z; the bucket of a word is its md5 modulo ``buckets``
    (first 8 hex digits), weights lie evenly in (-1, 1).  The matrix is sent to each worker once.  A text without
    words becomes zeros.
    """
    weights = np.array([[2 * uniform(seed, b, j) - 1 for j in range(width)] for b in range(buckets)])
    held = context.broadcast(weights)
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = re.compile(r"[^\x20\x09-\x0D]+")

    def run(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for row, text in enumerate(texts):
            found = [_word_hash(w) % buckets for w in words.findall(text.translate(lower))]
            if found:
                out[row] = np.bincount(found, minlength=buckets) @ held.value / len(found)
        return out

    return run


def covariance(df: DataFrame, features: str = "features") -> np.ndarray:
    """Population covariance; deviations from the mean are multiplied in the tasks and summed in two rounds.

    The matrix itself reaches the driver: its size is the square of the number of features and does not
    depend on rows.
    """
    if df.isEmpty():
        return np.zeros((0, 0))
    fitted = moments(df, features).first()
    mean = np.array(fitted["mean"])
    width = len(mean)

    def products(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf[features].to_numpy()) - mean
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(width, dtype=np.int32), "vector": list(total)})

    summed = np.zeros((width, width))
    for r in merged_vectors(df.select(features).mapInPandas(products, "at int, vector array<double>"), "at").collect():
        summed[r["at"]] = r["vector"]
    return summed / fitted["n"]


def principal_axes(matrix: np.ndarray, dims: int, steps: int = 1_000) -> np.ndarray:
    """Leading eigenvectors (one a row) by power iteration, each taken out of the matrix before the next one.

    The start is ``1, 1/2, 1/3, ...`` and the number of steps fixed, so that any other engine finds the same
    values; the largest loading (the first of equals) is positive.  Where nothing is left to explain, an axis is zero.
    """
    left, axes = np.array(matrix, dtype=float), []
    floor = 1e-12 * np.trace(left)
    for _ in range(dims):
        v = 1 / np.arange(1, len(left) + 1)
        for _ in range(steps):
            turned = left @ v
            size = np.sqrt(turned @ turned)
            if size <= floor * np.sqrt(v @ v):
                v = np.zeros_like(v)
                break
            v = turned / size
        if v.any():
            v = v * np.sign(v[np.argmax(np.abs(v))])
        axes.append(v)
        left = left - (v @ left @ v) * np.outer(v, v)
    return np.array(axes)


def project(df: DataFrame, features: str = "features", dims: int = 2) -> DataFrame:
    """First principal components of already scaled features, as ``pc1, pc2, ...``."""
    axes = principal_axes(covariance(df, features), dims)

    def along(axis: np.ndarray) -> Column:
        loadings = F.lit([float(v) for v in axis]) if len(axis) else F.array().cast("array<double>")
        return F.aggregate(F.zip_with(features, loadings, lambda x, w: x * w), F.lit(0.0), lambda total, x: total + x)

    kept = [c for c in df.columns if c != features]
    return df.select(*kept, *[along(axis).alias(f"pc{i + 1}") for i, axis in enumerate(axes)])

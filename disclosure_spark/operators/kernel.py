"""Kernel machines on random Fourier features: every cell of a curve is fitted in the same passes.

A cell is one machine: its own training rows, scaler and kernel width.  Each step of the descent reads the rows
once, adds up the gradients of all cells inside the tasks and merges them in two rounds; what reaches the
driver is one vector per cell, so its size depends on cells and width and never on rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64  # first round of a merge: partial vectors of this many groups of tasks
SEED = 42
BLOCK = 512  # rows lifted at once, so that a task holds BLOCK x width numbers per cell
# sin(pi r) / r as a polynomial in r * r, to the last digits of a double for r from -1/2 to 1/2
_SINE = (
    3.141592653589793, -5.16771278004997, 2.5501640398773455, -0.5992645293207869, 0.08214588661099356,
    -0.007370430943702136, 0.0004663027874593273, -2.1915250301851375e-05, 7.94853903737232e-07, -2.228371216069697e-08,
)


def uniform(*name: object) -> float:
    """Number in (0, 1) from the first 13 hex digits of the md5 of the parts joined by ``:``."""
    digits = hashlib.md5(":".join(map(str, name)).encode(), usedforsecurity=False).hexdigest()[:13]
    return (int(digits, 16) + 0.5) / 16.0**13


def fourier_weights(n_inputs: int, width: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Standard normal directions (inputs x width, by Box and Muller) and phases, the same in every run."""
    directions = np.empty((n_inputs, width))
    for i in range(n_inputs):
        for j in range(width):
            radius = np.sqrt(-2 * np.log(uniform(seed, "r", i, j)))
            directions[i, j] = radius * np.cos(2 * np.pi * uniform(seed, "a", i, j))
    return directions, np.array([2 * np.pi * uniform(seed, "b", j) for j in range(width)])


def lift(x: np.ndarray, gamma: float, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Features whose inner products approach the RBF kernel (Rahimi and Recht, 2007)."""
    return np.sqrt(2 / len(phases)) * np.cos(np.sqrt(2 * gamma) * (x @ directions) + phases)


def lift_rows(
    df: DataFrame, gamma: float, width: int, n_inputs: int, *, features: str = "features", out: str = "lifted", seed: int = SEED
) -> DataFrame:
    """Adds ``out``, the Fourier features of each row."""
    held = df.sparkSession.sparkContext.broadcast(fourier_weights(n_inputs, width, seed))

    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(lift(np.vstack(x.to_numpy()), gamma, *held.value)))

    return df.withColumn(out, F.pandas_udf(run, "array<double>")(features))


@dataclass(frozen=True)
class Cell:
    """One machine: where its scaler stands, its kernel width and the number of its training rows."""

    scaler: int
    gamma: float
    n_train: int


def merged_vectors(parts: DataFrame, by: str, value: str = "vector") -> DataFrame:
    """``(by, vector)``: sums of equally long arrays, first per group of tasks, then over the groups."""
    total = Summarizer.metrics("sum").summary(array_to_vector("vector"))
    parts = parts.select(by, F.col(value).alias("vector"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"))
    once = parts.groupBy(by, "_salt").agg(total.alias("s")).select(by, vector_to_array("s.sum").alias("vector"))
    return once.groupBy(by).agg(total.alias("s")).select(by, vector_to_array("s.sum").alias("vector"))


Visit = Callable[[int, np.ndarray, np.ndarray, np.ndarray], None]


def half_versine(turns: np.ndarray) -> np.ndarray:
    """``(1 - cos(2 pi turns)) / 2`` to about 1e-15; overwrites ``turns``.

    Whole turns are taken off and a polynomial is summed in passes over the array, which takes about a quarter
    of the time of ``np.cos``.
    """
    turns -= np.rint(turns)
    square = turns * turns
    out = square * _SINE[-1]
    for c in _SINE[-2:0:-1]:
        out += c
        out *= square
    out += _SINE[0]
    out *= turns
    out *= out
    return out


def _visit_cells(batches: Iterator[pd.DataFrame], cells: Sequence[Cell], scalers, weights, features: str, least: int, visit: Visit) -> None:
    """Call ``visit(cell, half versines, signs, sides)`` for blocks of those rows whose side in the cell is at least ``least``.

    A lifted row is ``sqrt(2 / width) * (1 - 2 * half versines)``; callers fold the constants into their sums.
    """
    directions, phases = weights
    offset = phases / (2 * np.pi)
    for pdf in batches:
        for start in range(0, len(pdf), BLOCK):
            rows = pdf.iloc[start : start + BLOCK]
            x = np.vstack(rows[features].to_numpy())
            signs = np.where(rows["y"].to_numpy() == 1, 1.0, -1.0)
            sides = np.vstack(rows["sides"].to_numpy())
            turned: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # rows and their directions, of the scaler's last cell
            for at, cell in enumerate(cells):
                wanted = np.flatnonzero(sides[:, at] >= least)
                if not len(wanted):
                    continue
                if cell.scaler not in turned or not np.array_equal(turned[cell.scaler][0], wanted):
                    mean, std = scalers[cell.scaler]
                    turned[cell.scaler] = wanted, ((x[wanted] - mean) / np.where(std == 0, 1, std)) @ directions
                turns = turned[cell.scaler][1] * (np.sqrt(2 * cell.gamma) / (2 * np.pi))
                turns += offset
                visit(at, half_versine(turns), signs[wanted], sides[wanted, at])


def _margins(versines: np.ndarray, machine: np.ndarray) -> np.ndarray:
    """Inner products of lifted rows and a machine, with its intercept."""
    high = np.sqrt(2 / versines.shape[1])
    return versines @ (-2 * high * machine[:-1]) + (high * machine[:-1].sum() + machine[-1])


def fit_cells(
    rows: DataFrame,
    cells: Sequence[Cell],
    scalers: Sequence[tuple[np.ndarray, np.ndarray]],
    *,
    C: float = 1.0,
    width: int = 256,
    n_inputs: int,
    features: str = "features",
    max_iter: int = 50,
    seed: int = SEED,
) -> np.ndarray:
    """Weights of all machines (cells x width + 1, the last one the intercept).

    ``rows`` hold ``features``, ``y`` (0 or 1) and ``sides``, an array with one small integer per cell: 1 where
    the row trains that cell, 0 where it is only scored, -1 where it has no part in it.  Minimised is the mean
    squared hinge loss plus ``|w|^2 / (2 C n)`` without the intercept, by accelerated gradient steps of the safe
    length: lifted rows are no longer than the root of 3.  Each of the ``max_iter`` steps is one pass over the
    rows for all cells.  A cell without training rows keeps weights of zero.
    """
    context = rows.sparkSession.sparkContext
    held = context.broadcast((fourier_weights(n_inputs, width, seed), list(scalers)))
    penalty = np.array([1 / (C * max(c.n_train, 1)) for c in cells])[:, None]
    penalty = np.hstack([np.repeat(penalty, width, axis=1), np.zeros((len(cells), 1))])
    counts = np.array([max(c.n_train, 1) for c in cells])[:, None]
    step = 1 / (6 + penalty.max(1, keepdims=True))
    narrow = rows.select(features, "y", "sides")
    before = now = np.zeros((len(cells), width + 1))
    for t in range(max_iter):
        ahead = now + t / (t + 3) * (now - before)

        def gradients(batches, ahead=ahead):
            weights, scaled = held.value
            total = np.zeros_like(ahead)
            high = np.sqrt(2 / width)

            def add(at, versines, signs, side):
                pull = signs * np.maximum(0, 1 - signs * _margins(versines, ahead[at]))
                total[at, :-1] -= 2 * high * (pull.sum() - 2 * (pull @ versines))
                total[at, -1] -= 2 * pull.sum()

            _visit_cells(batches, cells, scaled, weights, features, 1, add)  # the rows that train a cell
            yield pd.DataFrame({"cell": np.arange(len(total), dtype=np.int32), "vector": list(total)})

        summed = np.zeros_like(now)
        for r in merged_vectors(narrow.mapInPandas(gradients, "cell int, vector array<double>"), "cell").collect():
            summed[r["cell"]] = r["vector"]
        before, now = now, ahead - step * (summed / counts + penalty * ahead)
    return now


def count_right(
    rows: DataFrame,
    cells: Sequence[Cell],
    scalers: Sequence[tuple[np.ndarray, np.ndarray]],
    fitted: np.ndarray,
    *,
    n_inputs: int,
    features: str = "features",
    seed: int = SEED,
) -> DataFrame:
    """``(cell, side, correct, n)`` of all machines in one pass; ``side`` is ``train`` or ``valid``."""
    width = fitted.shape[1] - 1
    held = rows.sparkSession.sparkContext.broadcast((fourier_weights(n_inputs, width, seed), list(scalers), fitted))

    def count(batches):
        weights, scaled, machine = held.value
        total = np.zeros((len(cells), 2, 2), dtype=np.int64)

        def add(at, versines, signs, side):
            right = (_margins(versines, machine[at]) > 0) == (signs > 0)
            for which in (0, 1):
                total[at, which] += int((right & (side == which)).sum()), int((side == which).sum())

        _visit_cells(batches, cells, scaled, weights, features, 0, add)
        found = [(at, ("valid", "train")[w], *map(int, total[at, w])) for at in range(len(cells)) for w in (0, 1)]
        yield pd.DataFrame([r for r in found if r[3]], columns=["cell", "side", "correct", "n"])

    parts = rows.select(features, "y", "sides").mapInPandas(count, "cell int, side string, correct long, n long")
    return parts.groupBy("cell", "side").agg(F.sum("correct").alias("correct"), F.sum("n").alias("n"))


def fit_machine(
    train: DataFrame, *, gamma: float, width: int, n_inputs: int, n_rows: int, features: str = "features", label: str = "y", **options
) -> np.ndarray:
    """One machine on already scaled rows: weights of the lifted features and the intercept."""
    rows = train.select(features, F.col(label).cast("int").alias("y"), F.array(F.lit(1)).alias("sides"))
    as_is = [(np.zeros(n_inputs), np.ones(n_inputs))]
    return fit_cells(rows, [Cell(0, gamma, n_rows)], as_is, width=width, n_inputs=n_inputs, features=features, **options)[0]


def add_margin(
    df: DataFrame, machine: np.ndarray, *, gamma: float, n_inputs: int, features: str = "features", seed: int = SEED
) -> DataFrame:
    """Adds ``margin`` and ``pred``, its side."""
    held = df.sparkSession.sparkContext.broadcast((fourier_weights(n_inputs, len(machine) - 1, seed), machine))

    def run(x: pd.Series) -> pd.Series:
        weights, w = held.value
        if not len(x):
            return pd.Series([], dtype=float)
        return pd.Series(lift(np.vstack(x.to_numpy()), gamma, *weights) @ w[:-1] + w[-1])

    scored = df.withColumn("margin", F.pandas_udf(run, "double")(features))
    return scored.withColumn("pred", (F.col("margin") > 0).cast("int"))

"""Classifiers on report features: Gaussian naive Bayes, k nearest neighbours, kernel machine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, NaiveBayesModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclosure_spark.operators.neighbours import nearest_neighbours, vote

SEED = 42


def fit_naive_bayes(train: DataFrame, features: str = "features", label: str = "y") -> NaiveBayesModel:
    """Gaussian naive Bayes; variances carry 1e-9 of the largest feature variance."""
    prepared = train.select(F.col(label).cast("double").alias(label), array_to_vector(features).alias("_v"))
    return NaiveBayes(modelType="gaussian", featuresCol="_v", labelCol=label).fit(prepared)


def score_naive_bayes(model: NaiveBayesModel, df: DataFrame, features: str = "features") -> DataFrame:
    """Adds ``pred`` and ``score``, the probability of class 1."""
    scored = model.transform(df.withColumn("_v", array_to_vector(features)))
    return scored.select(
        *df.columns, F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("score")
    )


def score_knn(
    train: DataFrame, test: DataFrame, k: int, *, key: str = "report_id", features: str = "features", label: str = "y"
) -> DataFrame:
    """Test rows with ``pred`` and ``score`` by majority of the k nearest train rows."""
    found = nearest_neighbours(
        test.withColumnRenamed(key, "qid"), train.withColumnRenamed(key, "tid"), k, features=features, label=label
    )
    voted = vote(found, k, label=label).withColumnRenamed("qid", key)
    return test.join(voted, key)


def fourier_features(df: DataFrame, gamma: float, width: int, n_inputs: int, features: str = "features") -> DataFrame:
    """Random Fourier features of the RBF kernel (Rahimi and Recht, 2007) as ``_z``."""
    rng = np.random.default_rng(SEED)
    weight = rng.normal(scale=np.sqrt(2 * gamma), size=(n_inputs, width))
    shift = rng.uniform(0, 2 * np.pi, width)

    def lift(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.sqrt(2 / width) * np.cos(np.vstack(x.to_numpy()) @ weight + shift)))

    return df.withColumn("_z", array_to_vector(F.pandas_udf(lift, "array<double>")(features)))


def fit_kernel_machine(
    train: DataFrame,
    *,
    C: float = 1.0,
    gamma: float = 0.01,
    width: int = 256,
    n_inputs: int,
    n_rows: int,
    features: str = "features",
    label: str = "y",
    max_iter: int = 50,
    probability: bool = True,
):
    """Large-margin classifier on Fourier features with a logistic calibration of its margin (Platt, 1999).

    An approximation of the RBF machine; the penalty is ``1 / (C n)`` of the averaged hinge loss.
    """
    lifted = fourier_features(train, gamma, width, n_inputs, features)
    lifted = lifted.select(F.col(label).cast("double").alias(label), "_z")
    margin = LinearSVC(
        featuresCol="_z", labelCol=label, regParam=1.0 / (C * n_rows), maxIter=max_iter,
        standardization=False, rawPredictionCol="_margin", predictionCol="_svc",
    )
    if not probability:
        return Pipeline(stages=[margin]).fit(lifted)
    platt = LogisticRegression(featuresCol="_margin", labelCol=label, maxIter=max_iter)
    return Pipeline(stages=[margin, platt]).fit(lifted)


def score_kernel_machine(
    model, df: DataFrame, *, gamma: float = 0.01, width: int = 256, n_inputs: int, features: str = "features"
) -> DataFrame:
    """Adds ``pred`` (side of the margin) and, if calibrated, ``score``."""
    scored = model.transform(fourier_features(df, gamma, width, n_inputs, features))
    columns = [*df.columns, F.col("_svc").cast("int").alias("pred")]
    if "probability" in scored.columns:
        columns.append(vector_to_array("probability")[1].alias("score"))
    return scored.select(*columns)

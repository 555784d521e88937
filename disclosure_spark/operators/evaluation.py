"""Classifier metrics from scored rows (``y``, ``pred``, ``score``) and the company drift audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disclosure_spark.session import materialize


def confusion_matrix(scored: DataFrame, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """``(y, pred, n)`` for every pair of classes, absent pairs as 0."""
    counts = scored.groupBy("y", "pred").agg(F.count("*").alias("n"))
    pairs = [(a, b) for a in classes for b in classes]
    grid = scored.sparkSession.createDataFrame(pairs, "y int, pred int")
    return grid.join(counts, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_report(scored: DataFrame, classes: Sequence[int] = (0, 1), digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    pairs = scored.groupBy("y", "pred").agg(F.count("*").alias("n"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("double")

    sums = pairs.agg(
        *[total((F.col("y") == c) & (F.col("pred") == c)).alias(f"tp{c}") for c in classes],
        *[total(F.col("pred") == c).alias(f"said{c}") for c in classes],
        *[total(F.col("y") == c).alias(f"is{c}") for c in classes],
        total(F.lit(True)).alias("all"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    rows = []
    for c in classes:
        p, r = ratio(F.col(f"tp{c}"), F.col(f"said{c}")), ratio(F.col(f"tp{c}"), F.col(f"is{c}"))
        rows.append((str(c), p, r, ratio(2 * p * r, p + r), F.col(f"is{c}")))
    hit = sum([F.col(f"tp{c}") for c in classes[1:]], F.col(f"tp{classes[0]}"))
    accuracy = ratio(hit, F.col("all"))

    def mean(i: int, weighted: bool) -> Column:
        terms = [row[i] * (row[4] if weighted else F.lit(1.0)) for row in rows]
        return ratio(sum(terms[1:], terms[0]), F.col("all") if weighted else F.lit(float(len(classes))))

    averages = [
        (name, *[mean(i, weighted) for i in (1, 2, 3)], F.col("all"))
        for name, weighted in (("macro avg", False), ("weighted avg", True))
    ]
    rows += [("accuracy", accuracy, accuracy, accuracy, F.col("all")), *averages]
    names = ("precision", "recall", "f1_score")
    structs = [
        F.struct(F.lit(n).alias("label"), *[F.round(v, digits).alias(x) for v, x in zip(vs, names)], s.cast("long").alias("support"))
        for n, *vs, s in rows
    ]
    return sums.select(F.inline(F.array(*structs)))


def _score_steps(scored: DataFrame, buckets: int = 1024) -> DataFrame:
    """Positives and negatives at each distinct score with running totals from the highest score down.

    Distinct scores may be as many as rows, so no single task may order them all: approximate
    quantiles cut them into about equal buckets, totals run inside each bucket, and the few bucket
    totals give the offsets.
    """
    steps = scored.groupBy("score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    steps = materialize(steps, "score-steps")
    inner = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(steps.approxQuantile("score", inner, 0.25 / buckets)))  # at most `buckets` values
    cut = [float("-inf"), *bounds, float("inf")]
    steps = Bucketizer(splits=cut, inputCol="score", outputCol="b").transform(steps)
    down = W.orderBy(F.desc("b")).partitionBy(F.lit(0))
    order = F.desc("score")
    totals = (
        steps.groupBy("b")
        .agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), F.max_by(F.struct("pos", "neg"), "score").alias("head"))
        .select(
            "b",
            (F.sum("bp").over(down) - F.col("bp")).alias("tp0"),
            (F.sum("bn").over(down) - F.col("bn")).alias("fp0"),
            F.lead("head").over(down).alias("next_head"),
            F.sum("bp").over(W.partitionBy(F.lit(0))).alias("all_pos"),
            F.sum("bn").over(W.partitionBy(F.lit(0))).alias("all_neg"),
        )
    )
    inside = W.partitionBy("b").orderBy(order)
    return steps.join(F.broadcast(totals), "b").select(
        "score", "pos", "neg", "all_pos", "all_neg",
        (F.sum("pos").over(inside) + F.col("tp0")).alias("tp"),
        (F.sum("neg").over(inside) + F.col("fp0")).alias("fp"),
        F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("next_head")).alias("next"),
    )


def roc_points(scored: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """``(threshold, fpr, tpr)`` from the origin on; points on a straight stretch may be dropped.

    The origin carries the threshold ``highest score + 1``.
    """
    steps = _score_steps(scored)
    fpr = F.try_divide(F.col("fp"), F.col("all_neg")).alias("fpr")
    tpr = F.try_divide(F.col("tp"), F.col("all_pos")).alias("tpr")
    kept = steps
    if drop_intermediate:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bend = (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
        kept = steps.filter(first | F.col("next").isNull() | bend)
    points = kept.select(F.col("score").alias("threshold"), fpr, tpr)
    origin = steps.agg((F.max("score") + 1).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(points)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the curve: each negative counts the positives above it, and half of those beside it."""
    steps = _score_steps(scored)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return steps.agg(F.try_divide(area, F.max("all_pos").cast("double") * F.max("all_neg")).alias("auc"))


COMPANY_KEYS = ("cik", "ticker", "name")


def company_counts(train: DataFrame, test: DataFrame, order: str = "report_id") -> DataFrame:
    """Per company: positives and negatives in both parts, train ratio and cosine of the two count pairs.

    The ticker and name come from the company's first train report, or else its first test report.
    """
    rows = train.select(*COMPANY_KEYS, order, "change_nominal", F.lit(0).alias("side")).unionByName(
        test.select(*COMPANY_KEYS, order, "change_nominal", F.lit(1).alias("side"))
    )
    up = F.col("change_nominal") == "positive"

    def count(side: int, positive: bool) -> Column:
        return F.count_if((F.col("side") == side) & (up if positive else ~up))

    # First one row per company and spelling of its names, which hashing combines before the
    # shuffle; the earliest spelling is then picked from those few rows.
    names = ("train_positives", "train_negatives", "test_positives", "test_negatives")
    spelled = rows.groupBy(*COMPANY_KEYS).agg(
        *[count(side, positive).alias(n) for n, (side, positive) in zip(names, ((0, True), (0, False), (1, True), (1, False)))],
        F.min(F.when(F.col("side") == 0, F.col(order))).alias("in_train"),
        F.min(F.when(F.col("side") == 1, F.col(order))).alias("in_test"),
    )
    rank = F.struct(F.col("in_train").isNull(), F.coalesce("in_train", "in_test"))
    counts = spelled.groupBy("cik").agg(
        F.min_by(F.struct("ticker", "name"), rank).alias("who"), *[F.sum(n).alias(n) for n in names]
    )
    a, b, c, d = (F.col(x) for x in ("train_positives", "train_negatives", "test_positives", "test_negatives"))
    norms = F.sqrt((a * a + b * b).cast("double")) * F.sqrt((c * c + d * d).cast("double"))
    return counts.select(
        "cik", "who.*", "train_positives", "train_negatives",
        F.try_divide(a, a + b).alias("train_positive_ratio"),
        "test_positives", "test_negatives",
        F.try_divide(a * c + b * d, norms).alias("cosine_similarity_train_test"),
    )


def company_predictions(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per company and model: predicted positives and negatives, and two accuracies.

    ``{model}_accuracy`` counts only positives predicted positive as correct (the audit's own
    measure); ``{model}_true_accuracy`` is the usual share of right predictions.
    """
    columns = []
    for m in models:
        mine = F.col("model") == m
        hit_up = F.count_if(mine & (F.col("pred") == 1) & (F.col("y") == 1))
        right = F.count_if(mine & (F.col("pred") == F.col("y")))
        seen = F.count_if(mine)
        columns += [
            F.count_if(mine & (F.col("pred") == 1)).alias(f"{m}_test_pred_positives"),
            F.count_if(mine & (F.col("pred") != 1)).alias(f"{m}_test_pred_negatives"),
            F.try_divide(hit_up, seen).alias(f"{m}_accuracy"),
            F.try_divide(right, seen).alias(f"{m}_true_accuracy"),
        ]
    return scored.groupBy("cik").agg(*columns)


def company_drift(
    train: DataFrame, test: DataFrame, scored: DataFrame, models: Sequence[str] = ("nb", "knn", "svm"), order: str = "report_id"
) -> DataFrame:
    """Audit whether a classifier learned the company instead of the text, one row per company."""
    joined = company_counts(train, test, order).join(company_predictions(scored, models), "cik", "left")
    zeros = {f"{m}_test_pred_{side}": 0 for m in models for side in ("positives", "negatives")}
    return joined.fillna(zeros)


def by_train_ratio(drift: DataFrame) -> DataFrame:
    """Companies by train positive ratio, highest first, those never in train last."""
    return drift.orderBy(F.desc_nulls_last("train_positive_ratio"), "cik")


def similarity_points(drift: DataFrame, model: str) -> DataFrame:
    """Train/test similarity against accuracy of one model, rows with a gap left out."""
    return drift.select("cik", "cosine_similarity_train_test", f"{model}_accuracy").dropna()

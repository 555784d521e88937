import math

import numpy as np
import pytest

from disclosure_spark.operators import evaluation as EV
from tests.conftest import rows


def scored(spark, data):
    return spark.createDataFrame([(y, p, float(s)) for y, p, s in data], "y int, pred int, score double")


def test_confusion_completes_pairs(spark):
    assert rows(EV.confusion_matrix(scored(spark, [(1, 1, 1), (1, 1, 1)]))) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 2)]


def test_report_with_a_class_never_predicted(spark):
    got = {r["label"]: (r["precision"], r["recall"], r["f1_score"], r["support"]) for r in
           EV.class_report(scored(spark, [(0, 0, 0), (0, 0, 0), (1, 0, 0)])).collect()}
    assert got["0"] == (0.6667, 1.0, 0.8, 2)
    assert got["1"] == (0.0, 0.0, 0.0, 1)
    assert got["accuracy"] == (0.6667, 0.6667, 0.6667, 3)
    assert got["macro avg"] == (0.3333, 0.5, 0.4, 3)
    assert got["weighted avg"] == (0.4444, 0.6667, 0.5333, 3)


def reference_curve(data):
    """Plain cumulative curve at every distinct score."""
    points, tp, fp = [], 0, 0
    pos = sum(y for y, *_ in data)
    for s in sorted({s for *_, s in data}, reverse=True):
        tp += sum(1 for y, _, v in data if v == s and y == 1)
        fp += sum(1 for y, _, v in data if v == s and y == 0)
        points.append((s, fp / (len(data) - pos), tp / pos))
    return points


@pytest.mark.parametrize("distinct", [3, 5000])
def test_roc_and_auc(spark, distinct):
    rng = np.random.default_rng(distinct)
    data = [(int(rng.random() < 0.4), 0, float(rng.integers(0, distinct)) / distinct) for _ in range(6000)]
    data += [(i % 2, 0, 0.25) for i in range(3000)]  # one score holds a third of the rows
    frame = scored(spark, data)
    expected = reference_curve(data)
    got = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in EV.roc_points(frame, drop_intermediate=False).collect()), reverse=True)
    assert got[0] == (max(s for *_, s in data) + 1, 0.0, 0.0)
    assert np.allclose(got[1:], expected)
    area, x0, y0 = 0.0, 0.0, 0.0
    for _, x, y in expected:
        area, x0, y0 = area + (x - x0) * (y + y0) / 2, x, y
    assert EV.roc_auc(frame).first()["auc"] == pytest.approx(area)
    kept = EV.roc_points(frame).count()
    assert kept <= len(expected) + 1


def test_straight_points_are_dropped(spark):
    data = [(1, 0, 0.9), (1, 0, 0.8), (1, 0, 0.7), (0, 0, 0.6), (0, 0, 0.5)]
    got = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in EV.roc_points(scored(spark, data)).collect())
    # 0.8 lies on the straight stretch from 0.9 to 0.7
    assert [g[0] for g in got] == [0.5, 0.7, 0.9, 1.9]


def test_one_class_only(spark):
    assert EV.roc_auc(scored(spark, [(1, 1, 0.5), (1, 1, 0.4)])).first()["auc"] is None


def company_rows(spark, *data):
    return spark.createDataFrame(
        [(i, c, t, n, d) for i, (c, t, n, d) in enumerate(data)],
        "report_id long, cik long, ticker string, name string, change_nominal string",
    )


def test_company_audit(spark):
    train = company_rows(spark, (1, "A", "first", "positive"), (1, "A", "second", "negative"), (1, "A", "third", "positive"))
    test = company_rows(spark, (1, "A", "late", "positive"), (2, "B", "only", "negative"), (2, "B", "only", "positive"))
    said = spark.createDataFrame(
        [(1, 1, 1, "nb"), (2, 0, 1, "nb"), (2, 0, 0, "nb"), (2, 1, 1, "knn")], "cik long, y int, pred int, model string"
    )
    got = {r["cik"]: r for r in EV.company_drift(train, test, said, ("nb", "knn")).collect()}
    one, two = got[1], got[2]
    assert (one["name"], one["train_positives"], one["train_negatives"], one["test_positives"]) == ("first", 2, 1, 1)
    assert one["train_positive_ratio"] == pytest.approx(2 / 3)
    assert one["cosine_similarity_train_test"] == pytest.approx(2 / math.sqrt(5))
    assert two["train_positive_ratio"] is None and two["cosine_similarity_train_test"] is None
    assert (two["nb_test_pred_positives"], two["nb_test_pred_negatives"]) == (1, 1)
    assert (two["nb_accuracy"], two["nb_true_accuracy"]) == (0.0, 0.5)
    assert (one["knn_test_pred_positives"], one["knn_accuracy"]) == (0, None)
    ordered = [r["cik"] for r in EV.by_train_ratio(EV.company_drift(train, test, said, ("nb",))).collect()]
    assert ordered == [1, 2]
    points = EV.similarity_points(EV.company_drift(train, test, said, ("nb",)), "nb")
    assert [r["cik"] for r in points.collect()] == [1]

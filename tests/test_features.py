import numpy as np
import pytest
from pyspark.sql import functions as F

from disclosure_spark.operators import curves as CV
from disclosure_spark.operators import features as FT
from disclosure_spark.operators import models as M
from disclosure_spark.sources import readers, sinks


@pytest.fixture(scope="module")
def steps(spark):
    rng = np.random.default_rng(0)
    data = [(i % 7 if i % 3 else 0, i, [float(v) for v in rng.normal(size=4)]) for i in range(90)]
    return spark.createDataFrame(data, "report_id long, step int, embedding array<double>")


def test_pooling_forms_agree(steps):
    a = {r["report_id"]: r["features"] for r in FT.pool_sequences(steps).collect()}
    b = {r["report_id"]: r["features"] for r in FT.pool_sequences_by_position(steps).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])


def test_pooling_of_one_step(spark):
    one = spark.createDataFrame([(1, 0, [2.0, 3.0])], "report_id long, step int, embedding array<double>")
    assert FT.pool_sequences(one).first()["features"] == [2.0, 3.0, 0.0, 0.0]


def test_scaling_uses_train_and_keeps_constants(spark):
    train = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    test = spark.createDataFrame([([4.0, 6.0],)], "features array<double>")
    a, b = FT.scale_split(train, test)
    assert sorted(r["features"] for r in a.collect()) == [[-1.0, 0.0], [1.0, 0.0]]
    assert b.first()["features"] == [2.0, 1.0]


def test_empty_steps_are_left_out(spark):
    data = [(1, 0, [1.0]), (1, 1, [1.0]), (2, 0, [])]
    df = spark.createDataFrame(data, "report_id long, step int, embedding array<double>")
    assert [tuple(r) for r in FT.length_batches(df).collect()] == [(1, 2)]


def test_longest_first_wins(spark):
    df = spark.createDataFrame([(5, 3), (2, 3), (1, 1)], "report_id long, n_steps long")
    assert tuple(FT.longest_report(df).first()) == (2, 3)


def test_projection_equals_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "report_id long, features array<double>")
    scaled = FT.scale(df, FT.moments(df))
    got = FT.project(scaled).orderBy("report_id").collect()
    z = (x - x.mean(0)) / x.std(0)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    for i in (0, 1):
        mine, theirs = np.array([r[f"pc{i + 1}"] for r in got]), z @ axes[i]
        assert np.allclose(np.abs(mine), np.abs(theirs), atol=1e-6)


def test_axes_are_orthogonal_signed_and_deterministic():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4)) * [4, 3, 2, 0]
    axes = FT.principal_axes(np.cov(x.T, bias=True), 4)
    assert np.allclose(axes[:3] @ axes[:3].T, np.eye(3), atol=1e-8)
    assert all(a[np.argmax(np.abs(a))] > 0 for a in axes[:3])
    assert not axes[3].any()  # three directions explain everything


def test_projection_without_rows_or_spread(spark):
    empty = spark.createDataFrame([], "report_id long, features array<double>")
    assert FT.project(empty).columns == ["report_id", "pc1", "pc2"] and FT.project(empty).count() == 0
    same = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "report_id long, features array<double>")
    assert [(r["pc1"], r["pc2"]) for r in FT.project(same).collect()] == [(0.0, 0.0)] * 2


def test_embedding_calls_are_bounded_by_text(spark):
    texts = ["abcd", "ab", "abcdefghijkl", "", "a", None, "abcdefg"]
    chunks = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "report_id long, chunk int, text string").coalesce(1)
    out = FT.embed(chunks, lambda t: np.array([[len(t), sum(map(len, t)), len(x)] for x in t]), most_characters=8)
    got = [r["embedding"] for r in out.orderBy("step").collect()]
    assert [g[2] for g in got] == [4, 2, 12, 0, 1, 0, 7]
    assert all(total <= 8 or n == 1 for n, total, _ in got)


def test_hashed_projection_is_the_mean_of_word_rows(spark):
    network = FT.hashed_projection(spark.sparkContext, width=5, buckets=64)
    one, other, both, none = network(["Cat", "dog", " cat\tDOG dog\n", " "])
    assert np.allclose(both, (one + 2 * other) / 3) and not none.any() and (one != other).any()


def test_embedding_hook_rounds_half_to_even(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "bb")], "report_id long, chunk int, text string")
    out = FT.embed(chunks, lambda texts: np.array([[len(t) / 3, 0.0000005] for t in texts]))
    assert sorted((r["step"], r["embedding"]) for r in out.collect()) == [(0, [0.333333, 0.0]), (1, [0.666667, 0.0])]


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes no line can part: a disc and the ring around it."""
    rng = np.random.default_rng(4)
    data = []
    for i in range(240):
        radius = rng.uniform(0, 1) if i % 2 else rng.uniform(2, 3)
        turn = rng.uniform(0, 2 * np.pi)
        data.append((i, [radius * np.cos(turn), radius * np.sin(turn)], i % 2, "positive" if i % 2 else "negative"))
    data = [(i, [float(v) for v in x], y, n) for i, x, y, n in data]
    return spark.createDataFrame(data, "report_id long, features array<double>, y int, change_nominal string")


def test_kernel_machine_learns_a_ring(rings):
    options = {"gamma": 1.0, "n_inputs": 2}
    model = M.fit_kernel_machine(rings, C=10.0, n_rows=240, **options)
    scored = M.score_kernel_machine(model, rings, **options)
    assert scored.filter("pred = y").count() > 230
    up = scored.groupBy("y").agg(F.avg("score").alias("s")).orderBy("y").collect()
    assert up[0]["s"] < 0.3 < 0.7 < up[1]["s"]


def test_model_round_trip(rings, tmp_path):
    options = {"gamma": 1.0, "n_inputs": 2}
    model = M.fit_kernel_machine(rings, n_rows=240, max_iter=5, **options)
    sinks.save_model(model, str(tmp_path / "m"))
    again = readers.load_model(str(tmp_path / "m"))
    a = M.score_kernel_machine(model, rings, **options).orderBy("report_id").collect()
    assert a == M.score_kernel_machine(again, rings, **options).orderBy("report_id").collect()


def test_kernel_curve_prefers_a_fitting_width(rings):
    curve = {r["gamma"]: r["valid_scores_mean"] for r in
             CV.svm_validation_curve(rings, 10.0, (1e-4, 1.0), n_inputs=2, k=3, max_iter=10).collect()}
    assert curve[1.0] > 0.9 > curve[1e-4], curve


def test_naive_bayes_two_forms_agree(rings):
    """The full-size point of the learning curve equals a fold-wise fit with the library model."""
    curve = CV.nb_learning_curve(rings, fractions=(1.0,), k=3).first()
    folded = CV.stratified_folds(rings, "report_id", "y", 3).cache()
    scores = []
    for fold in range(3):
        train, valid = FT.scale_split(folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold))
        scored = M.score_naive_bayes(M.fit_naive_bayes(train), valid)
        scores.append(scored.filter("pred = y").count() / scored.count())
    assert curve["valid_scores_mean"] == pytest.approx(np.mean(scores))


def test_grid_beyond_the_train_rows_is_an_error(rings):
    with pytest.raises(Exception, match="fewer than"):
        CV.knn_validation_curve(rings, (301,), k=3).collect()

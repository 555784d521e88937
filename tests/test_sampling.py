import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from disclosure_spark.operators import sampling as SP
from tests.conftest import rows


def order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k))


@pytest.fixture(scope="module")
def people(spark):
    """9,001 rows; class a holds about two thirds of them."""
    cls = F.when(F.col("id") % 3 < 2, "a").when(F.col("id") % 9 == 2, "b").otherwise("c")
    return spark.range(9001).select("id", cls.alias("cls"))


@pytest.mark.parametrize("n", [0, 1, 2, 4, 10, 997])
def test_split_sizes(spark, n):
    out = SP.exact_split(spark.range(n), "id")
    sizes = collections.Counter(r["split"] for r in out.collect())
    a, b = int(n * 0.6), int(n * 0.2)
    assert [sizes["train"], sizes["validate"], sizes["test"]] == [a, b, n - a - b]


def test_split_members_follow_the_hash(spark):
    out = {r["id"]: r["split"] for r in SP.exact_split(spark.range(500), "id").collect()}
    ranked = order(range(500))
    assert {k for k, v in out.items() if v == "train"} == set(ranked[:300])
    assert {k for k, v in out.items() if v == "test"} == set(ranked[400:])


def test_split_does_not_depend_on_partitions(spark):
    base = spark.range(1000)
    one = rows(SP.exact_split(base.coalesce(1), "id"))
    assert rows(SP.exact_split(base.repartition(13), "id")) == one


def test_balance(people):
    out = SP.balance_classes(people, "id", "cls")
    counts = {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()}
    least = people.filter("cls = 'b'").count()
    assert counts == {"a": least, "b": least, "c": least}
    mine = order([r["id"] for r in people.filter("cls = 'a'").collect()])[:least]
    assert {r["id"] for r in out.filter("cls = 'a'").collect()} == set(mine)


def test_balance_with_a_class_missing(spark):
    df = spark.createDataFrame([(1, "x", 0), (2, "x", 0), (3, "y", 0), (4, "y", 1)], "id long, part string, cls int")
    within = SP.balance_classes(df, "id", "cls", within=["part"], classes=2)
    assert sorted(r["id"] for r in within.collect()) == [3, 4]
    assert SP.balance_classes(df.filter("part = 'x'"), "id", "cls").count() == 2


def test_stratified_folds(people):
    out = SP.stratified_folds(people, "id", "cls").collect()
    by = collections.Counter((r["cls"], r["fold"]) for r in out)
    for cls in "abc":
        sizes = [by[(cls, f)] for f in range(5)]
        assert sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 1


@pytest.mark.parametrize("n", [5, 7, 1003, 25_003])
def test_contiguous_folds(spark, n):
    skewed = spark.range(n).select((F.col("id") * F.col("id")).alias("v"))
    out = sorted((r["v"], r["fold"]) for r in SP.contiguous_folds(skewed, "v").collect())
    q, r = divmod(n, 5)
    expected = [f for f in range(5) for _ in range(q + (f < r))]
    assert [f for _, f in out] == expected


def test_values_at_ranks(spark, monkeypatch):
    monkeypatch.setattr(SP, "_RANK_AT_MOST", 20)
    monkeypatch.setattr(SP, "_CELLS", 64)
    drawn = random.Random(11)
    made = [drawn.choice([3, -2**63, 2**63 - 1, drawn.randrange(10**12), drawn.randrange(50)]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in [*made, None]], "v long")
    ranks = [1, 2, 399, 400, 777, 1500, 1999, 2000]
    assert SP.values_at_ranks(df, "v", ranks) == [sorted(made)[r - 1] for r in ranks]
    with pytest.raises(ValueError):
        SP.values_at_ranks(df, "v", [2001])


def test_contiguous_folds_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(SP, "_RANK_AT_MOST", 20)
    monkeypatch.setattr(SP, "_CELLS", 64)
    test_contiguous_folds(spark, 2003)


def test_contiguous_folds_of_nulls_and_ties(spark):
    df = spark.createDataFrame([(None,), (4,), (4,), (4,), (9,)], "v long")
    assert rows(SP.contiguous_folds(df, "v", 2)) == sorted([(None, None), (4, 0), (4, 0), (4, 0), (9, 1)], key=repr)
    assert SP.contiguous_folds(df.limit(0), "v").count() == 0


def test_hash_rank(people):
    out = SP.hash_rank(people, F.col("id"), by=["cls"])
    for cls in "abc":
        got = [r["id"] for r in sorted(out.filter(F.col("cls") == cls).collect(), key=lambda r: r["ord"])]
        assert got == order(got)
        assert sorted(r["ord"] for r in out.filter(F.col("cls") == cls).collect()) == list(range(1, len(got) + 1))


def test_replay(spark):
    index = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    test = spark.createDataFrame([("b",), ("c",)], "key string")
    assert rows(SP.replay_split(index, train, test, "key")) == [("a", "train"), ("b", "train"), ("c", "test")]


def test_broadcast_only_below_the_bound(spark):
    from disclosure_spark.session import broadcast_if_small

    big = spark.range(1000).withColumn("x", F.lit(1))
    for bound, hinted in ((10, False), (50, True)):
        side = broadcast_if_small(spark.range(50).select("id", (F.col("id") * 2).alias("v")), bound)
        assert ("hint" in side._jdf.queryExecution().logical().toString().lower()) is hinted
        assert big.join(side, "id").count() == 50

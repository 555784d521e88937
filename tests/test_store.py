"""The shared folder, vocabulary without a cut, membership beyond 500 and redelivered prices."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from disclosure_spark.operators import corpora, membership, text
from disclosure_spark.session import work_dir
from disclosure_spark.streaming import intake

from .conftest import rows


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf({k.replace("_", "."): v for k, v in values.items()})


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]", "spark://host:7077"])
def test_cluster_without_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        work_dir(_Session(spark_master=master), "x")


def test_shared_folder_is_taken_from_the_session():
    session = _Session(spark_master="yarn")
    session.conf.values["spark.checkpoint.dir"] = "hdfs://store/checkpoints/"
    assert work_dir(session, "x").startswith("hdfs://store/checkpoints/x-")
    assert work_dir(_Session(spark_master="local[4]"), "x").startswith("/")


def test_vocabulary_keeps_every_word(spark):
    docs = spark.range(2500).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x")).alias("text"))
    tokens = corpora.build_vocabulary(docs)
    assert tokens.filter(F.col("token").rlike("^w[0-9]+x$")).count() == 2500
    assert corpora.build_vocabulary(docs, size=10).filter(F.col("token").rlike("^w[0-9]+x$")).count() == 10


def test_snapshot_with_more_than_500_members(spark):
    wide = spark.range(700).select(F.concat(F.lit("T"), "id").alias("Ticker"), F.lit("X").alias("01/10/2010"))
    wide = wide.withColumns({"ISIN Code": F.lit(""), "Company Name": F.lit("")})
    cik = spark.range(700).select("id", F.col("id").alias("ord"), F.col("id").alias("cik"), F.concat(F.lit("T"), "id").alias("ticker"))
    assert membership.build_membership(wide, cik).count() == 700


def test_histogram_and_runs_are_sorted(spark):
    docs = spark.createDataFrame([(1, "a b c\nd\ne f\ng h")], "report_id long, text string")
    assert [r[0] for r in text.words_per_line(docs).collect()] == [1, 2, 3]
    runs = spark.createDataFrame([("b c", 2), ("a b", 2), ("x y", 5)], "run string, n long")
    assert [r.run for r in corpora.most_frequent_runs(runs).collect()] == ["x y", "a b", "b c"]
    assert [r.run for r in corpora.most_frequent_runs(runs, 1).collect()] == ["x y"]


def test_a_day_that_comes_again_counts_once(spark, tmp_path):
    schema = "kind string, ticker string, date date, report_id long, open double, close double"
    day = lambda n: dt.date(2010, 1, n)
    price = lambda n, close: ("price", "A", day(n), None, 10.0, close)
    landed, store, progress = (str(tmp_path / n) for n in ("landed", "store", "progress"))
    first = [("report", "A", day(4), 1, None, None), price(4, 11.0), price(5, 12.0)]
    second = [price(4, 99.0), price(5, 99.0)]
    third = [price(6, 12.0)]
    answers = []
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landed)
        stream = intake.file_stream(spark, spark.createDataFrame([], schema).schema, landed)
        intake.stream_labels(stream, store, progress).awaitTermination()
        answers.append(rows(spark.read.parquet(f"{store}/labels").select("report_id", F.round("change_ratio", 6).alias("r"))))
    assert answers == [[], [], [(1, 0.2)]]


def test_only_months_that_a_report_waits_for_are_read(spark, tmp_path):
    schema = "kind string, ticker string, date date, report_id long, open double, close double"
    price = lambda month, n, close: ("price", "A", dt.date(2010, month, n), None, 10.0, close)
    landed, store, progress = (str(tmp_path / n) for n in ("landed", "store", "progress"))
    first = [price(1, n, 11.0) for n in (4, 5, 6)]
    second = [("report", "A", dt.date(2010, 3, 1), 1, None, None), price(2, 1, 10.0), *[price(3, n, 12.0) for n in (1, 2, 3)]]
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landed)
        stream = intake.file_stream(spark, spark.createDataFrame([], schema).schema, landed)
        intake.stream_labels(stream, store, progress).awaitTermination()
        for file in (tmp_path / "store" / "prices" / "batch=0" / "month=2010-01").glob("*.parquet"):
            file.write_bytes(b"unreadable")  # a batch that opened this month would fail
    assert rows(spark.read.parquet(f"{store}/labels").select("report_id", F.round("change_ratio", 6).alias("r"))) == [(1, 0.2)]
    assert sorted(p.name for p in (tmp_path / "store" / "prices").glob("batch=*/month=*")) == ["month=2010-01", "month=2010-02", "month=2010-03"]

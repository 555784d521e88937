import datetime as dt

from pyspark.sql import functions as F

from disclosure_spark.operators import membership as MB
from disclosure_spark.operators import prices as PR
from disclosure_spark.operators import text as TX
from disclosure_spark.sources import readers as R
from disclosure_spark.sources import sinks as K
from disclosure_spark.streaming import intake
from tests.conftest import rows


def test_filing_summaries(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("CIK,FILING_DATE,FORM_TYPE,FILE_NAME\n7,20040102,10-K,D:\\a\\b.txt\n8,x20040102,10-Q,c\n")
    assert rows(R.read_filing_summaries(spark, str(p))) == [
        (7, dt.date(2004, 1, 2), "10-K", "./data/a/b.txt"), (8, None, "10-Q", "c"),
    ]


def test_composition_and_map(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("Ticker\tISIN Code\tCompany Name\t31/12/2003\t30/09/2003\nA (x)\ti\tn\tX\tX\nQ\ti\tn\tX\t\n")
    (tmp_path / "m.txt").write_text("CIK|Ticker|Name|Other\n5|A|Alpha|z\n6|A|Later|z\n")
    wide, cik_map = R.read_composition(spark, str(tmp_path / "c.tsv")), R.read_cik_map(spark, str(tmp_path / "m.txt"))
    members = MB.build_membership(wide, cik_map)
    assert rows(members) == [(dt.date(2003, 12, 31), 5)]
    K.write_csv(MB.unmatched_tickers(wide, cik_map), str(tmp_path / "u"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "u"))) == [("Q",)]


def test_snapshots(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",Date,CIK_0,CIK_1\n0,20031231,5,\n1,20040331,5,6.0\n")
    got = rows(R.read_membership_snapshots(spark, str(tmp_path / "s.csv")))
    assert got == [(dt.date(2003, 12, 31), 5), (dt.date(2004, 3, 31), 5), (dt.date(2004, 3, 31), 6)]


def test_labelled_index_round_trip(spark, tmp_path):
    head = "CIK\tTicker\tCompany\tFiling_Date\tForm_Type\tChange_Ratio\tChange_Nominal\tFile_Path\n"
    (tmp_path / "i.tsv").write_text(head + "1\tA\tAcme\t20100104\t10-K\t-0.5\tnegative\t./data/multiline_reports/multiline_report12\n")
    index = R.read_labelled_index(spark, str(tmp_path / "i.tsv"))
    row = index.first()
    assert (row["report_id"], row["filing_date"], row["change_ratio"]) == (12, dt.date(2010, 1, 4), -0.5)
    K.write_tsv(index, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out")).first()["change_nominal"] == "negative"
    plain = tmp_path / "p.tsv"
    plain.write_text("CIK\tTicker\tCompany\tFiling_Date\tForm_Type\tFile_Path\n1\tA\tAcme\t20100104\t10-K\tx/multiline_report3\n")
    assert R.read_report_index(spark, str(plain)).first()["report_id"] == 3


def test_documents_and_lines(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "multiline_report1").write_bytes(b"one\r\ntwo\r\n")
    (docs / "other").write_text("x")
    assert rows(R.read_lines(spark, str(docs), "multiline_report*"), "pos", "line") == [(0, "one"), (1, "two")]
    assert R.read_documents(spark, str(docs), "multi*").first()["text"] == "one\ntwo\n"


def test_feature_files_join_their_index(spark, tmp_path):
    folder = tmp_path / "features"
    folder.mkdir()
    (folder / "multiline_report4.csv").write_text("F_0\tF_1\n1.0\t2.0\n3.0\t4.0\n")
    (folder / "multiline_report5.csv").write_text("F_0\tF_1\n9.0\t9.0\n")
    index = spark.createDataFrame([("a/multiline_report4", "positive")], "file_path string, change_nominal string")
    got = rows(R.read_index_features(spark, index, str(folder)), "step", "embedding", "change_nominal")
    assert got == [(0, [1.0, 2.0], "positive"), (1, [3.0, 4.0], "positive")]


def test_payload_files(spark, tmp_path):
    (tmp_path / "ABC.json").write_text('{"Time Series (Daily)": {"2010-01-04": {"1. open": "1", "4. close": "2"}}}')
    days = PR.payload_prices(PR.parse_payloads(R.read_daily_payloads(spark, str(tmp_path))))
    assert rows(days) == [(dt.date(2010, 1, 4), "ABC", 1.0, 2.0)]


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("[PAD]\nthe\n##s\n")
    assert rows(R.read_vocabulary(spark, str(tmp_path / "vocab.txt")), "id", "token") == [(0, "[PAD]"), (1, "the"), (2, "##s")]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b\nc"), (2, "d e")], "report_id long, text string")
    K.write_lines_by_count(TX.lines_by_word_count(docs), str(tmp_path / "lines"))
    assert sorted(p.name for p in (tmp_path / "lines").iterdir() if p.is_dir()) == ["words_in_sequence=1", "words_in_sequence=2"]
    K.export_documents(docs, str(tmp_path / "docs"))
    assert R.read_documents(spark, str(tmp_path / "docs")).count() == 2
    metrics = TX.metrics_row(docs, n=F.count("*"))
    K.append_metrics(metrics, str(tmp_path / "m"), "one")
    K.append_metrics(metrics, str(tmp_path / "m"), "two")
    assert rows(spark.read.parquet(str(tmp_path / "m"))) == [("one", "n", "2"), ("two", "n", "2")]
    K.write_splits(docs.withColumn("split", F.lit("train")), str(tmp_path / "split"))
    assert R.read_examples(spark, str(tmp_path / "split")).filter("split = 'train'").count() == 2
    errors = spark.createDataFrame([("A", 1)], "ticker string, error_code int")
    K.write_dead_letters(errors, str(tmp_path / "e"))
    K.write_dead_letters(errors, str(tmp_path / "e"))
    assert spark.read.option("header", True).option("sep", "|").csv(str(tmp_path / "e")).count() == 2


def test_clean_stream_in_two_runs(spark, tmp_path):
    sentence = "One two three four five six seven eight nine. "
    landed, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for i in (1, 2):
        spark.createDataFrame([(i, sentence * i)], "report_id long, text string").write.mode("append").parquet(landed)
        stream = intake.file_stream(spark, spark.read.parquet(landed).schema, landed)
        intake.stream_clean_reports(stream, out, progress).awaitTermination()
    whole = TX.clean_reports(spark.read.parquet(landed))
    assert rows(spark.read.parquet(out), "report_id", "pos", "sentence") == rows(whole)
    assert whole.count() == 3


def test_label_stream_waits_for_the_window(spark, tmp_path):
    schema = "kind string, ticker string, date date, report_id long, open double, close double"
    day = lambda n: dt.date(2010, 1, n)
    landed, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    batches = [
        [("report", "A", day(4), 1, None, None), ("price", "A", day(4), None, 10.0, 10.0), ("price", "A", day(5), None, 1.0, 1.0)],
        [("report", "B", day(4), 2, None, None)],
        [("price", "A", day(6), None, 1.0, 12.0)],
    ]
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(landed)
        stream = intake.file_stream(spark, spark.read.parquet(landed).schema, landed)
        intake.stream_labels(stream, store, progress).awaitTermination()
        seen.append(rows(spark.read.parquet(f"{store}/labels"), "report_id", "change_ratio"))
    assert seen == [[], [], [(1, 0.2)]]
    assert rows(spark.read.parquet(f"{store}/pending-2"), "report_id") == [(2,)]


def test_ordered_files_follow_one_another(spark, tmp_path):
    made = [(i * 7919 % 501, f"k{i}") for i in range(3000)] + [(None, "n")]
    df = spark.createDataFrame(made, "a int, b string").repartition(5)
    path = str(tmp_path / "ordered")
    K.write_ordered(df, path, "a", "b")
    back = sorted(K.read_ordered(spark, path).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in back] == list(range(len(made)))
    assert [(r["a"], r["b"]) for r in back] == sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    K.write_ordered(df.limit(0), path, "a")
    assert K.read_ordered(spark, path).count() == 0

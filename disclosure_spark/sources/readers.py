"""Readers of every input, each with an explicit schema."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disclosure_spark import schemas as S
from disclosure_spark.functions import text as X


def _file_order() -> Column:
    """Sorts rows as they stand in their files: file, block, then position inside the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _delimited(spark: SparkSession, path: str, schema, sep: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def read_filing_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Comma CSV of filings; dates parsed, Windows paths rewritten to the local data folder."""
    raw = _delimited(spark, path, S.FILING_SUMMARIES_RAW, ",")
    return raw.select(
        F.col("CIK").alias("cik"),
        F.try_to_date("FILING_DATE", "yyyyMMdd").alias("filing_date"),
        F.col("FORM_TYPE").alias("form_type"),
        X.local_path(F.col("FILE_NAME")).alias("file_name"),
    )


def read_composition(spark: SparkSession, path: str) -> DataFrame:
    """Wide composition TSV; every column stays text, as the date columns are only known from the header."""
    return spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).csv(path)


def read_membership_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Wide snapshot CSV (``Date, CIK_0, CIK_1, ...``) as long ``(snapshot_date, cik)``."""
    wide = spark.read.option("header", True).option("inferSchema", False).csv(path)
    members = [c for c in wide.columns if c.startswith("CIK_")]
    long = wide.unpivot(["Date"], members, "slot", "cik").filter(F.col("cik").isNotNull() & (F.col("cik") != ""))
    return long.select(
        F.to_date("Date", "yyyyMMdd").alias("snapshot_date"), F.col("cik").cast("double").cast("long").alias("cik")
    ).distinct()


def read_cik_map(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited company map with ``ord``, the order of its lines, for first-match look-ups."""
    wide = spark.read.option("header", True).option("sep", "|").option("inferSchema", False).csv(path)
    return wide.select(
        _file_order().alias("ord"), F.col("CIK").cast("long").alias("cik"),
        F.col("Ticker").alias("ticker"), F.col("Name").alias("name"),
    )


def read_report_index(spark: SparkSession, path: str) -> DataFrame:
    """TSV report index; ``report_id`` is the number in the report's file key."""
    return _index(_delimited(spark, path, S.REPORT_INDEX_RAW, "\t"))


def read_labelled_index(spark: SparkSession, path: str) -> DataFrame:
    raw = _delimited(spark, path, S.LABELLED_INDEX_RAW, "\t")
    return _index(raw, F.col("Change_Ratio").alias("change_ratio"), F.col("Change_Nominal").alias("change_nominal"))


def _index(raw: DataFrame, *more: Column) -> DataFrame:
    number = F.regexp_extract(X.file_key(F.col("File_Path")), r"(\d+)$", 1)
    return raw.select(
        number.cast("long").alias("report_id"), F.col("CIK").alias("cik"), F.col("Ticker").alias("ticker"),
        F.col("Company").alias("company"), X.compact_date(F.col("Filing_Date")).alias("filing_date"),
        F.col("Form_Type").alias("form_type"), *more, F.col("File_Path").alias("file_path"),
    )


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per text file: ``(path, text)`` with Unix line ends."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    whole = reader.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), X.unix_newlines(F.col("value")).alias("text"))


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, pos, line)`` of text files, in file order."""
    docs = read_documents(spark, path, glob)
    return docs.select("path", F.posexplode(X.lines_of(F.col("text"))).alias("pos", "line"))


def read_feature_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A folder of feature TSVs, one per report, as ``(path, key, step, embedding)`` in one scan."""
    lines = read_lines(spark, path, glob).filter(F.col("pos") > 0)
    values = F.transform(F.split("line", "\t"), lambda v: v.cast("double"))
    return lines.select(
        "path", X.file_key(F.col("path")).alias("key"), (F.col("pos") - 1).alias("step"), values.alias("embedding")
    )


def read_index_features(spark: SparkSession, index: DataFrame, path: str) -> DataFrame:
    """Feature steps of the indexed reports: one folder scan joined on the file key."""
    steps = read_feature_files(spark, path).drop("path")
    return index.withColumn("key", X.file_key(F.col("file_path"))).join(steps, "key")


def read_daily_payloads(spark: SparkSession, path: str, status: int = 200) -> DataFrame:
    """Landed vendor responses ``{ticker}.json`` as ``(ticker, status, body)``."""
    whole = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    ticker = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return whole.select(ticker.alias("ticker"), F.lit(status).alias("status"), F.col("value").alias("body"))


def read_trading_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.TRADING_DAY).parquet(path)


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.COMPANY).parquet(path)


def read_examples(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Model-ready example files by glob."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary file, one token per line; the id is the line number."""
    lines = read_lines(spark, path)
    return lines.select(F.trim("line").alias("token"), F.col("pos").alias("id"))


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

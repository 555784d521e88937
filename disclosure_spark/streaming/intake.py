"""Incremental forms of the batch jobs.

Every job reads a folder as a file stream, keeps its progress in a checkpoint folder and processes
what is there (``availableNow``), so it can be run again whenever new files land.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from disclosure_spark import schemas as S
from disclosure_spark.operators import prices
from disclosure_spark.operators.text import clean_reports

MONTH = "yyyy-MM"  # names of the price store's folders; later months sort later


def file_stream(spark: SparkSession, schema: StructType, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_clean_reports(raw: DataFrame, out: str, checkpoint: str, **clean_options: str) -> StreamingQuery:
    """Clean filings as they land; the sink's log makes each file count exactly once."""
    cleaned = clean_reports(raw, **clean_options)
    return (
        cleaned.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def _read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _per_batch(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_prices(payloads: DataFrame, table: str, errors: str, checkpoint: str) -> StreamingQuery:
    """Add the daily series of tickers not loaded yet; refused responses go to ``errors``.

    Each batch writes to its own folder, so a batch that is repeated after a failure replaces its
    own output.  Tickers that earlier batches loaded are skipped.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parsed = prices.parse_payloads(batch)
        incoming = prices.payload_prices(parsed)
        schema = StructType([*incoming.schema.fields, S.T.StructField("batch", S.T.LongType())])
        loaded = _read_or_empty(spark, table, schema).filter(F.col("batch") < number)
        fresh = incoming.join(loaded.select("ticker").distinct(), "ticker", "left_anti")
        fresh.dropDuplicates(["ticker", "date"]).write.mode("overwrite").parquet(f"{table}/batch={number}")
        prices.payload_errors(parsed).write.mode("overwrite").parquet(f"{errors}/batch={number}")

    return _per_batch(payloads, checkpoint, step)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stream_labels(events: DataFrame, store: str, checkpoint: str, days: int = prices.FORWARD_DAYS) -> StreamingQuery:
    """Label reports once enough trading days after their filing date have arrived.

    ``events`` mixes reports and prices in one stream: ``kind`` is ``report`` or ``price``, with
    ``ticker``, ``date`` and, by kind, ``report_id`` or ``open`` and ``close``.  Prices are kept in
    the store, and reports wait there until the batch join can answer them, so the state is a table
    and no ticker's rows have to meet in one stateful task.  The store is partitioned by batch and month: a
    batch opens only the months from its earliest waiting report on.  A report is answered as soon as its
    window is complete; days that land late for an already answered report do not change it.
    """
    kept = StructType([
        S.T.StructField("ticker", events.schema["ticker"].dataType), S.T.StructField("date", S.T.DateType()),
        S.T.StructField("open", S.T.DoubleType()), S.T.StructField("close", S.T.DoubleType()),
        S.T.StructField("batch", S.T.LongType()), S.T.StructField("month", S.T.StringType()),
    ])
    waiting = StructType([
        S.T.StructField("report_id", S.T.LongType()), kept["ticker"], S.T.StructField("filing_date", S.T.DateType()),
    ])

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = batch.filter("kind = 'price'").select("ticker", "date", "open", "close", F.date_format("date", MONTH).alias("month"))
        arrived.hint("rebalance", F.col("month")).write.mode("overwrite").partitionBy("month").parquet(f"{store}/prices/batch={number}")
        pending = _read_or_empty(spark, f"{store}/pending-{number - 1}", waiting)
        asked = batch.filter("kind = 'report'").select("report_id", "ticker", F.col("date").alias("filing_date"))
        open_reports = pending.unionByName(asked)
        # a day that is delivered again counts once, as it came first; only days that a report waits for are read
        since = open_reports.groupBy("ticker").agg(F.min("filing_date").alias("since"))
        first_month = since.agg(F.date_format(F.min("since"), MONTH)).first()[0]  # null without open reports: nothing is read
        months = F.col("month") >= F.lit(first_month).cast("string")
        stored = spark.read.schema(kept).parquet(f"{store}/prices").filter((F.col("batch") <= number) & months)
        stored = stored.join(since, "ticker").filter(F.col("date") >= F.col("since"))
        trading = stored.groupBy("ticker", "date").agg(F.min_by(F.struct("open", "close"), F.struct("batch", "open", "close")).alias("day"))
        trading = trading.select("ticker", "date", "day.open", "day.close")
        answers = f"{store}/labels/batch={number}"
        prices.label_price_change(open_reports, trading, days).write.mode("overwrite").parquet(answers)
        done = spark.read.parquet(answers).select("report_id")
        open_reports.join(done, "report_id", "left_anti").write.mode("overwrite").parquet(f"{store}/pending-{number}")
        _remove(spark, f"{store}/pending-{number - 2}")  # a batch that is run again needs the one before it alone

    return _per_batch(events, checkpoint, step)

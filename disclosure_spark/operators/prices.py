"""Daily prices and the three-day price move after a filing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disclosure_spark.schemas import DAILY_PAYLOAD

FORWARD_DAYS = 3  # Fixed value: trading days of a price move


def forward_window(trading_day: DataFrame, days: int = FORWARD_DAYS) -> DataFrame:
    """Each trading day with the close ``days - 1`` trading days later (null near the end)."""
    by_date = W.partitionBy("ticker").orderBy("date")
    return trading_day.select(
        "ticker", "date", "open", F.lead("close", days - 1).over(by_date).alias("close_after")
    )


def label_price_change(reports: DataFrame, trading_day: DataFrame, days: int = FORWARD_DAYS) -> DataFrame:
    """Adds ``change_ratio`` and ``change_nominal`` to reports with ``days`` prices on or after filing.

    Reports are first reduced to distinct (ticker, filing_date): however many reports one ticker
    has, its window then holds at most two rows per calendar day.  The answer goes back to the
    reports by an equality join, whose hot keys AQE may split.  Reports without enough prices are
    left out.
    """
    quotes = trading_day.select("ticker", "date", F.lit(1).alias("side"), "open", "close")
    asked = reports.select("ticker", F.col("filing_date").alias("date")).distinct()
    nothing = F.lit(None).cast("double")
    asked = asked.select("ticker", "date", F.lit(0).alias("side"), nothing.alias("open"), nothing.alias("close"))
    # one shuffle by ticker serves both windows
    rows = quotes.unionByName(asked).repartition("ticker")
    own_side = W.partitionBy("ticker", "side").orderBy("date")
    rows = rows.withColumn("close_after", F.lead("close", days - 1).over(own_side))
    quote = F.when(F.col("side") == 1, F.struct("open", "close_after"))
    # Newest first, prices before questions on the same day: the last price seen is the first one
    # on or after the filing date, and the frame only ever grows.
    newest_first = (
        W.partitionBy("ticker").orderBy(F.desc("date"), F.desc("side")).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    answered = (
        rows.withColumn("next", F.last(quote, ignorenulls=True).over(newest_first))
        .filter((F.col("side") == 0) & F.col("next.close_after").isNotNull() & F.col("next.open").isNotNull())
        .select("ticker", F.col("date").alias("filing_date"), change_ratio().alias("change_ratio"))
        .filter(F.col("change_ratio").isNotNull())
    )
    labelled = reports.join(answered, ["ticker", "filing_date"])
    nominal = F.when(F.col("change_ratio") >= 0, "positive").otherwise("negative")
    return labelled.withColumn("change_nominal", nominal)


def change_ratio():
    """Relative move from the first open to the last close; null where the open is zero."""
    opened, closed = F.col("next.open"), F.col("next.close_after")
    return F.try_divide(closed - opened, opened)


def positive_share(labelled: DataFrame, by: str = "form_type") -> DataFrame:
    """Share of filings followed by a rise, per form type."""
    positives = F.count_if(F.col("change_nominal") == "positive")
    return labelled.groupBy(by).agg(
        F.count("*").alias("n_filings"),
        positives.alias("n_positive"),
        F.round(positives / F.count("*"), 6).alias("positive_share"),
    )


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Landed vendor responses (``ticker, status, body``) with the parsed body and an accept flag."""
    parsed = payloads.withColumn("doc", F.from_json("body", DAILY_PAYLOAD))
    accepted = (
        (F.col("status") == 200) & F.col("doc.`Error Message`").isNull() & F.col("doc.`Time Series (Daily)`").isNotNull()
    )
    return parsed.withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def payload_prices(parsed: DataFrame) -> DataFrame:
    """Accepted responses as ``trading_day`` rows."""
    day = parsed.filter("accepted").select("ticker", F.explode("doc.`Time Series (Daily)`").alias("date", "point"))
    return day.select(
        F.to_date("date").alias("date"),
        "ticker",
        F.col("point.`1. open`").cast("double").alias("open"),
        F.col("point.`4. close`").cast("double").alias("close"),
    )


def payload_errors(parsed: DataFrame) -> DataFrame:
    """Refused responses as ``load_errors`` rows; a rate-limit note is told apart by its reason."""
    doc = F.col("doc")
    reason = (
        F.when(doc["Error Message"].isNotNull(), "error")
        .when(doc["Note"].isNotNull(), "note")
        .when(F.col("status") != 200, "status")
        .otherwise("no series")
    )
    return parsed.filter(~F.col("accepted")).select(
        "ticker",
        F.col("status").cast("int").alias("error_code"),
        F.coalesce(doc["Error Message"], F.lit("")).alias("error_message"),
        reason.alias("reason"),
    )


def not_loaded(wanted: DataFrame, company: DataFrame) -> DataFrame:
    """Distinct tickers asked for that have no company row yet."""
    return wanted.select("ticker").distinct().join(company.select("ticker"), "ticker", "left_anti")


def company_rows(index: DataFrame, tickers: DataFrame) -> DataFrame:
    """Company row of each ticker, taken from its first report."""
    first = index.groupBy("ticker").agg(F.min_by(F.struct("cik", "company"), "report_id").alias("c"))
    return first.join(tickers, "ticker", "left_semi").select(
        "ticker", F.col("c.cik").cast("string").alias("cik"), F.col("c.company").alias("name")
    )


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, one per key: what an insert under a primary key adds."""
    value = F.struct(*[c for c in incoming.columns if c not in keys])
    fresh = incoming.groupBy(*keys).agg(F.min(value).alias("v")).select(*keys, "v.*").select(*incoming.columns)
    return fresh.join(existing.select(*keys), keys, "left_anti")

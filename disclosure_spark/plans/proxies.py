"""Views that give the driver's star-schema tables the shapes of the filing jobs.

All of them are lazy projections and partial aggregations over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disclosure_spark.session import spread

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str, *, sparse: bool = False) -> DataFrame:
    """Orders as a report index; ``sparse`` leaves tickers beyond the priced ones in."""
    orders = table(spark, sf_dir, "orders")
    ticker = F.col("o_custkey")
    if not sparse:
        n = table(spark, sf_dir, "supplier").agg(F.count("*"))
        ticker = F.pmod(ticker, n.scalar())
    return orders.select(
        F.col("o_orderkey").alias("report_id"),
        F.col("o_custkey").alias("cik"),
        ticker.alias("ticker"),
        F.to_date("o_orderdate").alias("filing_date"),
        F.col("o_orderpriority").alias("form_type"),
    )


def trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as daily prices: first and last extended price of each (supplier, ship date)."""
    tie = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"))
        .agg(F.min_by("l_extendedprice", tie).alias("open"), F.max_by("l_extendedprice", tie).alias("close"))
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with an order in the quarter before each snapshot date."""
    quarter = F.add_months(F.trunc("o_orderdate", "quarter"), 3)
    return table(spark, sf_dir, "orders").select(quarter.alias("snapshot_date"), F.col("o_custkey").alias("cik")).distinct()


def composition_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership as a wide table of marks, some tickers carrying a remark in brackets."""
    cells = membership(spark, sf_dir).select(
        F.concat(
            F.format_string("Supplier#%09d", "cik"), F.when(F.col("cik") % 3 == 0, " (old)").otherwise("")
        ).alias("Ticker"),
        F.date_format("snapshot_date", "dd/MM/yyyy").alias("label"),
    )
    labels = [r["label"] for r in cells.select("label").distinct().orderBy("label").collect()]  # one per quarter of the calendar
    wide = cells.groupBy("Ticker").pivot("label", labels).agg(F.first(F.lit("X")))
    return wide.withColumns({"ISIN Code": F.lit(""), "Company Name": F.col("Ticker")})


def cik_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the company map; every tenth ticker stands on a second, later line as well."""
    base = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("cik"), F.col("s_name").alias("ticker"),
        F.concat(F.lit("Company "), "s_suppkey").alias("name"),
    )
    again = base.filter(F.col("ord") % 10 == 0).select(
        (F.col("ord") + 1_000_000_000).alias("ord"), (F.col("cik") + 1_000_000_000).alias("cik"), "ticker",
        F.concat("name", F.lit(" again")).alias("name"),
    )
    return base.unionByName(again)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a class; the quality flag stands for the direction of the price move."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("report_id"), F.col("quality").alias("label"))
    return docs.join(labels, "report_id")


def daily_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed vendor responses, one per user: a daily series, an error or a note."""
    order = F.struct("ts", "event_id")
    days = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("ticker"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
        .agg(F.min_by("value", order).alias("open"), F.max_by("value", order).alias("close"))
    )
    point = F.struct(F.col("open").cast("string").alias("1. open"), F.col("close").cast("string").alias("4. close"))
    series = days.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("date", point))).alias("m"))
    kind = F.col("ticker") % 10
    body = (
        F.when(kind == 0, F.to_json(F.struct(F.concat(F.lit("Invalid call for "), "ticker").alias("Error Message"))))
        .when(kind == 1, F.to_json(F.struct(F.lit("Please slow down").alias("Note"))))
        .otherwise(F.to_json(F.struct(F.col("m").alias("Time Series (Daily)"))))
    )
    status = F.when(kind == 2, 503).otherwise(200)
    return series.select("ticker", status.alias("status"), body.alias("body"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as report features with a binary class (labels 5 to 9 are positive)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("report_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.when(F.col("label") >= 5, "positive").otherwise("negative").alias("change_nominal"),
        (F.col("label") >= 5).cast("int").alias("y"),
    )


def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as per-step features, ten steps to a report."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("report_id"),
        (F.col("vec_id") % 10).cast("int").alias("step"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )

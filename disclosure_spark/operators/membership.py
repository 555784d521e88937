"""Index membership over time and company look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disclosure_spark.functions.text import bare_ticker, header_date
from disclosure_spark.session import broadcast_if_small

# Descriptive columns of the composition table, years and forms of the study.
DESCRIPTIVE = ("Ticker", "ISIN Code", "Company Name")
FIRST_YEAR, LAST_YEAR = 2004, 2018
FORMS = ("10-K", "10-Q")


def select_filings(
    filings: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR, forms: Sequence[str] = FORMS
) -> DataFrame:
    """Filings of the wanted forms and years, as a date range that a scan can push down."""
    date = F.col("filing_date")
    return filings.filter(
        (date >= F.make_date(F.lit(first_year), F.lit(1), F.lit(1)))
        & (date < F.make_date(F.lit(last_year + 1), F.lit(1), F.lit(1)))
        & F.col("form_type").isin(*forms)
    )


def first_match(lookup: DataFrame, key: str, *values: str) -> DataFrame:
    """One row per key: the values on the first line (by ``ord``) that holds it."""
    return lookup.groupBy(key).agg(F.min_by(F.struct(*values), "ord").alias("v")).select(key, "v.*")


def marked_cells(wide: DataFrame, after: str | None = "2003-09-30") -> DataFrame:
    """``(snapshot_date, ticker)`` for every ``X`` in a wide composition table newer than ``after``."""
    dates = [c for c in wide.columns if c not in DESCRIPTIVE]
    cells = wide.unpivot(["Ticker"], dates, "label", "mark").filter(F.col("mark") == "X")
    cells = cells.select(header_date(F.col("label")).alias("snapshot_date"), bare_ticker(F.col("Ticker")).alias("ticker"))
    return cells if after is None else cells.filter(F.col("snapshot_date") > F.lit(after).cast("date"))


def build_membership(
    wide: DataFrame, cik_map: DataFrame, after: str | None = "2003-09-30", cap: int | None = None
) -> DataFrame:
    """Long membership table ``(snapshot_date, cik)`` from a wide composition table.

    With ``cap``, each snapshot keeps its lowest ``cap`` company ids.  Spark limits the ranks
    before the shuffle, so a full snapshot never meets in one task.
    """
    cells = marked_cells(wide, after)
    members = cells.join(first_match(cik_map, "ticker", "cik"), "ticker").select("snapshot_date", "cik").distinct()
    if cap is None:
        return members
    rank = F.row_number().over(W.partitionBy("snapshot_date").orderBy("cik"))
    return members.withColumn("rn", rank).filter(F.col("rn") <= cap).drop("rn")


def unmatched_tickers(wide: DataFrame, cik_map: DataFrame, after: str | None = "2003-09-30") -> DataFrame:
    """Marked tickers that the company map does not know."""
    return marked_cells(wide, after).select("ticker").distinct().join(cik_map.select("ticker"), "ticker", "left_anti")


def members_per_snapshot(membership: DataFrame) -> DataFrame:
    return membership.groupBy("snapshot_date").agg(F.count("*").alias("n_members"))


def snapshot_calendar(filings: DataFrame, membership: DataFrame) -> DataFrame:
    """``(filing_date, snapshot_date)``: the newest snapshot on or before each distinct filing date.

    Both inputs are reduced to distinct dates, so the work is bounded by the calendar and not by
    the number of filings or members.
    """
    snapshots = membership.agg(F.sort_array(F.collect_set("snapshot_date")).alias("s"))
    dates = filings.select("filing_date").distinct().withColumn("s", snapshots.scalar())
    latest = F.array_max(F.filter("s", lambda d: d <= F.col("filing_date")))
    return dates.select("filing_date", latest.alias("snapshot_date")).filter(F.col("snapshot_date").isNotNull())


def filter_members(filings: DataFrame, membership: DataFrame) -> DataFrame:
    """Filings whose company is in the newest snapshot on or before the filing date."""
    calendar = broadcast_if_small(snapshot_calendar(filings, membership))
    dated = filings.join(calendar, "filing_date")
    return dated.join(membership.select("snapshot_date", "cik"), ["snapshot_date", "cik"], "left_semi")


def with_company(filings: DataFrame, cik_map: DataFrame) -> DataFrame:
    """Adds the first ticker and name of the company; unknown companies get nulls."""
    named = first_match(cik_map, "cik", "ticker", "name").withColumnRenamed("name", "company")
    return filings.join(named, "cik", "left")

"""Report cleaning and corpus statistics.  Every job here is narrow up to its final count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclosure_spark.functions import text as X


def clean_reports(raw: DataFrame, key: str = "report_id", text: str = "text", **marks: str) -> DataFrame:
    """Numbered meaningful sentences ``(key, pos, sentence)`` of raw filings."""
    kept = X.clean_sentences(F.col(text), **marks)
    return raw.select(key, F.posexplode(kept).alias("pos", "sentence"))


def clean_report_text(raw: DataFrame, key: str = "report_id", text: str = "text", **marks: str) -> DataFrame:
    """One row per filing: its clean sentences, one per line (the form the packing jobs read)."""
    return raw.select(key, F.array_join(X.clean_sentences(F.col(text), **marks), "\n").alias("text"))


def numbered_lines(docs: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """``(key, pos, line)`` in file order."""
    return docs.select(key, F.posexplode(X.lines_of(F.col(text))).alias("pos", "line"))


def count_words(docs: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """Words per document, and of the whole corpus in the row whose key is null."""
    counted = docs.select(key, X.word_count(F.col(text)).alias("n_words"))
    return counted.rollup(key).agg(F.sum("n_words").alias("n_words"))


def words_per_line(docs: DataFrame, text: str = "text") -> DataFrame:
    """Histogram: words per line -> number of lines, by rising number of words."""
    counted = _lines_with_count(docs, text).groupBy("words_in_sequence").agg(F.count("*").alias("appearances"))
    return counted.orderBy("words_in_sequence")


def lines_by_word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every line with its word count; the sink writes one folder per count."""
    return _lines_with_count(docs, text)


def _lines_with_count(docs: DataFrame, text: str) -> DataFrame:
    lines = docs.select(F.explode(X.lines_of(F.col(text))).alias("line"))
    return lines.select(X.word_count(F.col("line")).alias("words_in_sequence"), "line")


def metrics_row(df: DataFrame, **metrics: Column) -> DataFrame:
    """One-row metric frame."""
    return df.agg(*[c.alias(name) for name, c in metrics.items()])

"""Writers.  Each writes a whole frame in one job; nothing is appended row by row."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disclosure_spark.operators.numbering import range_sorted
from disclosure_spark.operators.prices import new_rows
from disclosure_spark.session import broadcast_if_small


def _as_text(df: DataFrame) -> DataFrame:
    """Every value as text; arrays joined by blanks (delimited text holds no arrays)."""
    columns = []
    for field in df.schema:
        value = F.col(field.name)
        if field.dataType.typeName() == "array":
            value = F.array_join(value.cast("array<string>"), " ")
        columns.append(value.cast("string").alias(field.name))
    return df.select(*columns)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _as_text(df).write.mode(mode).option("header", True).option("sep", "\t").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _as_text(df).write.mode(mode).option("header", True).csv(path)


def write_pipe(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _as_text(df).write.mode(mode).option("header", True).option("sep", "|").csv(path)


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    """Parquet, the form between jobs.

    With partition columns, rows are rebalanced by them first: small partitions get few files,
    and a value that holds most of the rows is split over several tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_ordered(df: DataFrame, path: str, *order: str, mode: str = "overwrite") -> None:
    """Parquet whose files, read in the order of their names, give the whole table sorted by ``order`` (nulls first).

    Ranges of the order go to one task each, so nothing passes through one machine.
    """
    range_sorted(df, order).write.mode(mode).parquet(path)


def read_ordered(spark: SparkSession, path: str, out: str = "position") -> DataFrame:
    """A table of :func:`write_ordered` with the 0-based ``out`` of each row over all its files."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_file")) - F.col("_n")  # one row per file
    joined = rows.join(broadcast_if_small(sizes.select("_file", before.alias("_before"))), "_file")
    return joined.withColumn(out, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def write_trading_days(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Prices sorted by ticker and date inside each file, so that later scans skip row groups."""
    df.hint("rebalance", F.col("ticker")).sortWithinPartitions("ticker", "date").write.mode(mode).parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    write_table(df, path, "split")


def export_documents(docs: DataFrame, path: str, key: str = "report_id", text: str = "text") -> None:
    """One folder with one text file per document; only for hand-over to other tools."""
    docs.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_lines_by_count(lines: DataFrame, path: str, count: str = "words_in_sequence", line: str = "line") -> None:
    """Lines as text, one folder per word count; a very common count is spread over several files."""
    rows = lines.select(count, F.col(line).alias("value")).hint("rebalance", F.col(count))
    rows.write.mode("overwrite").partitionBy(count).text(path)


def append_metrics(metrics: DataFrame, path: str, job: str) -> None:
    """One metrics row as ``(job, metric, value)`` lines of a shared table."""
    named = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in metrics.columns])
    metrics.select(F.lit(job).alias("job"), F.inline(named)).write.mode("append").parquet(path)


def write_dead_letters(errors: DataFrame, path: str) -> None:
    """Refused inputs with their reason, beside the main output."""
    write_pipe(errors, path, mode="append")


def append_new(incoming: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key is not in the table yet, one per key."""
    spark = incoming.sparkSession
    existing = spark.read.schema(incoming.schema).parquet(path)
    new_rows(incoming, existing, keys).write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)

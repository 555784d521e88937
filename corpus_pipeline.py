"""Training-data pipeline: five stages over the documents, each written as Parquet and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disclosure_spark.llm import byte_cnn, chunk_dedup, packing, set_join, winnowing
from disclosure_spark.session import work_dir

NEAR_WORDS, NEAR_PERCENT = 5, 80  # near-duplicates of the pipeline; op9 alone has its own contract of 4 and 85
ORACLE_SQL = None  # a trained network and a tokenizer are beyond SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return byte_cnn.keep_accepted(docs, byte_cnn.fit(docs, _table(spark, sf_dir, "labels")))


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return set_join.keep_one_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents hold."""
    cut = chunk_dedup.rewrite_documents(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cut


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return winnowing.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_each),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", keep_clean),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; a lost executor costs no finished stage."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

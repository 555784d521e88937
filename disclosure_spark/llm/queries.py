"""Registered queries of the training-data operators: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from disclosure_spark.llm import attention_lm, byte_cnn, chunk_dedup, fertility, html_extract, merkle, packing, periodic, set_join, suffix_dedup, url_filter, warc, winnowing
from disclosure_spark.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register
def op1_suffix_array_dedup(spark, sf_dir):
    removed = suffix_dedup.remove_repeated_strings(table(spark, sf_dir, "documents"))
    return suffix_dedup.removal_summary(removed)


@register
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register
def op3_html_extraction(spark, sf_dir):
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


@register
def op4_lm_scoring(spark, sf_dir):
    return attention_lm.score_documents(table(spark, sf_dir, "documents"))


@register
def op5_quality_classifier(spark, sf_dir):
    return byte_cnn.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op6_substring_dedup(spark, sf_dir):
    return chunk_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))


@register
def op7_quality_rules(spark, sf_dir):
    return fertility.apply_rules(table(spark, sf_dir, "documents"))


@register
def op8_benchmark_decontamination(spark, sf_dir):
    judged = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return winnowing.contamination_summary(judged)


@register
def op9_ngram_jaccard_join(spark, sf_dir):
    return set_join.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


@register
def op10_warc(spark, sf_dir):
    path = work_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.capture_summary(warc.assemble_captures(warc.read_records(spark, path)))


@register
def op11_merkle_manifest(spark, sf_dir):
    return merkle.verification_summary(merkle.manifest(table(spark, sf_dir, "documents")))


@register
def op12_periodic_runs(spark, sf_dir):
    return periodic.run_summary(table(spark, sf_dir, "documents"))


@register
def op13_url_filters(spark, sf_dir):
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark), model)


@register
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)

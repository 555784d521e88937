"""Registered queries: every one runs an operator over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disclosure_spark.functions import text as X
from disclosure_spark.functions.vectors import take_dims
from disclosure_spark.operators import (
    corpora, curves, evaluation, features, kernel, membership, models, packing, pairs, prices, sampling,
)
from disclosure_spark.operators import text as text_ops
from disclosure_spark.plans import proxies as V
from disclosure_spark.session import materialize, work_dir
from disclosure_spark.sources import sinks
from disclosure_spark.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


# --- filings, membership, companies -------------------------------------------------------------


@register
def filing_filter(spark, sf_dir):
    filings = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("cik"),
        F.col("o_orderdate").alias("filing_date"), F.col("o_orderpriority").alias("form_type"),
    )
    kept = membership.select_filings(filings, 1996, 1999, ("1-URGENT", "2-HIGH"))
    return kept.select("report_id", "cik", _day("filing_date"), "form_type")


@register
def unpivot_composition(spark, sf_dir):
    members = membership.build_membership(
        V.composition_wide(spark, sf_dir), V.cik_map(spark, sf_dir), after="1995-06-30"
    )
    return members.select(_day("snapshot_date"), "cik")


@register
def members_per_snapshot(spark, sf_dir):
    return membership.members_per_snapshot(V.membership(spark, sf_dir)).select(_day("snapshot_date"), "n_members")


@register
def ticker_first_match(spark, sf_dir):
    filings = V.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("cik")).distinct()
    return membership.with_company(filings, V.cik_map(spark, sf_dir))


@register
def unmatched_tickers(spark, sf_dir):
    return membership.unmatched_tickers(V.composition_wide(spark, sf_dir), V.cik_map(spark, sf_dir), after=None)


@register
def membership_asof(spark, sf_dir):
    kept = membership.filter_members(V.reports(spark, sf_dir, sparse=True), V.membership(spark, sf_dir))
    return kept.select("report_id", "cik", _day("filing_date"), _day("snapshot_date"))


# --- prices and labels --------------------------------------------------------------------------


def labelled_reports(spark, sf_dir, sparse=False):
    return prices.label_price_change(V.reports(spark, sf_dir, sparse=sparse), V.trading_day(spark, sf_dir))


@register
def label_price_change(spark, sf_dir):
    labelled = labelled_reports(spark, sf_dir)
    return labelled.select(
        "report_id", "ticker", _day("filing_date"), "form_type",
        F.round("change_ratio", 6).alias("change_ratio"), "change_nominal",
    )


@register
def label_price_change_sparse(spark, sf_dir):
    labelled = labelled_reports(spark, sf_dir, sparse=True)
    return labelled.select("report_id", "ticker", F.round("change_ratio", 6).alias("change_ratio"), "change_nominal")


@register
def positive_share_by_form(spark, sf_dir):
    return prices.positive_share(labelled_reports(spark, sf_dir))


@register
def not_loaded_tickers(spark, sf_dir):
    wanted = V.reports(spark, sf_dir, sparse=True).select("ticker")
    company = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"))
    return prices.not_loaded(wanted, company)


@register
def company_rows(spark, sf_dir):
    index = V.reports(spark, sf_dir).withColumn("company", F.concat(F.lit("Customer "), "cik"))
    return prices.company_rows(index, index.select("ticker").distinct())


@register
def json_series_parse(spark, sf_dir):
    days = prices.payload_prices(prices.parse_payloads(V.daily_payloads(spark, sf_dir)))
    return days.select(_day("date"), "ticker", "open", "close")


@register
def load_errors(spark, sf_dir):
    return prices.payload_errors(prices.parse_payloads(V.daily_payloads(spark, sf_dir)))


# --- text ---------------------------------------------------------------------------------------


@register
def strip_header(spark, sf_dir):
    pages = V.pages(spark, sf_dir)
    return pages.select("page_id", X.strip_header(F.col("html"), "</head>").alias("text"))


@register
def strip_exhibits(spark, sf_dir):
    pages = V.pages(spark, sf_dir)
    return pages.select("page_id", X.strip_exhibits(F.col("html"), "<footer").alias("text"))


@register
def clean_filing(spark, sf_dir):
    pages = V.pages(spark, sf_dir).select(F.col("page_id").alias("report_id"), F.col("html").alias("text"))
    docs = V.documents(spark, sf_dir).withColumn("report_id", -F.col("report_id") - 1)
    both = pages.unionByName(docs)
    return text_ops.clean_reports(both, header="</head>", exhibit="<footer")


@register
def split_sentences(spark, sf_dir):
    docs = V.documents(spark, sf_dir)
    sentences = X.split_sentences(X.single_line(F.col("text")))
    return docs.select("report_id", F.posexplode(sentences).alias("pos", "sentence"))


@register
def meaningful_sentences(spark, sf_dir):
    lines = text_ops.numbered_lines(V.documents(spark, sf_dir))
    return lines.filter(X.is_meaningful(F.col("line")))


@register
def word_count(spark, sf_dir):
    return text_ops.count_words(V.documents(spark, sf_dir))


@register
def words_per_line_hist(spark, sf_dir):
    return text_ops.words_per_line(V.documents(spark, sf_dir))


# --- packing, splits, balance -------------------------------------------------------------------


@register
def pack_compat(spark, sf_dir):
    return packing.pack_reports(V.documents(spark, sf_dir), 128, mode="compat")


@register
def pack_lossless(spark, sf_dir):
    return packing.pack_reports(V.documents(spark, sf_dir), 128, mode="lossless")


@register
def exact_split(spark, sf_dir):
    return sampling.exact_split(V.documents(spark, sf_dir), "report_id").select("report_id", "split")


@register
def stratified_folds(spark, sf_dir):
    labels = V.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sampling.stratified_folds(labels, "doc_id", "quality")


@register
def contiguous_folds(spark, sf_dir):
    return sampling.contiguous_folds(V.documents(spark, sf_dir).select("report_id"), "report_id")


@register
def balance_classes(spark, sf_dir):
    labels = V.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sampling.balance_classes(labels, "doc_id", "quality")


@register
def split_replay(spark, sf_dir):
    """A balanced 80/20 split of the labelled documents, replayed on every document by file key."""
    path = F.concat(F.lit("./reports/multiline_report"), F.col("doc_id"))
    labels = V.table(spark, sf_dir, "labels").select("doc_id", "quality")
    kept = sampling.classifier_split(labels, "doc_id", "quality")
    kept = kept.withColumn("key", X.file_key(F.concat(path, F.lit(".csv"))))
    index = V.table(spark, sf_dir, "documents").select("doc_id", X.file_key(path).alias("key"))
    replayed = sampling.replay_split(
        index, kept.filter("split = 'train'").select("key"), kept.filter("split = 'test'").select("key"), "key"
    )
    return replayed.select("doc_id", "key", "split")


# --- sub-words and model-ready corpora ----------------------------------------------------------


def vocabulary_of(spark, sf_dir):
    """The benchmark table stands in for the vocabulary file."""
    return corpora.hold(corpora.build_vocabulary(V.table(spark, sf_dir, "benchmark")))


@register
def vocabulary(spark, sf_dir):
    return corpora.build_vocabulary(V.table(spark, sf_dir, "benchmark"))


@register
def wordpiece(spark, sf_dir):
    pieces = corpora.word_pieces(V.documents(spark, sf_dir), vocabulary_of(spark, sf_dir))
    return pieces.select("word", "n", F.array_join("pieces", " ").alias("pieces"))


@register
def subtoken_runs(spark, sf_dir):
    pieces = corpora.word_pieces(V.documents(spark, sf_dir), vocabulary_of(spark, sf_dir))
    return corpora.subtoken_runs(pieces)


@register
def mlm_instances(spark, sf_dir):
    vocab = vocabulary_of(spark, sf_dir)
    instances = corpora.mlm_instances(corpora.tokenize(V.documents(spark, sf_dir), vocab), vocab)
    joined = {c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("tokens", "masked_positions", "masked_labels")}
    return instances.withColumns(joined)


@register
def mlm_pairs(spark, sf_dir):
    vocab = vocabulary_of(spark, sf_dir)
    instances = pairs.mlm_pairs(pairs.tokenized_sentences(V.documents(spark, sf_dir), vocab), vocab)
    joined = {c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("tokens", "segment_ids", "masked_positions", "masked_labels")}
    return instances.withColumns(joined)


@register
def oov_rate(spark, sf_dir):
    vocab = vocabulary_of(spark, sf_dir)
    return corpora.oov_rate(corpora.mlm_instances(corpora.tokenize(V.documents(spark, sf_dir), vocab), vocab))


def _finetune(spark, sf_dir):
    docs = sampling.exact_split(V.labelled_documents(spark, sf_dir), "report_id")
    return corpora.finetune_set(docs, 128)


@register
def finetune_set(spark, sf_dir):
    return _finetune(spark, sf_dir)


@register
def finetune_counts(spark, sf_dir):
    return corpora.example_counts(_finetune(spark, sf_dir))


@register
def encode_examples(spark, sf_dir):
    coded = corpora.encode_examples(_finetune(spark, sf_dir), vocabulary_of(spark, sf_dir), 128)
    joined = {c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("input_ids", "input_mask", "segment_ids")}
    return coded.withColumns(joined)


# --- features -----------------------------------------------------------------------------------


@register
def pool_mean_std(spark, sf_dir):
    pooled = features.pool_sequences(V.sequence_features(spark, sf_dir))
    return pooled.select("report_id", F.posexplode("features").alias("idx", "value")).withColumn("value", F.round("value", 6))


def _classifier_parts(spark, sf_dir):
    kept = sampling.classifier_split(V.vectors(spark, sf_dir), "report_id", "change_nominal")
    kept = materialize(kept, "classifier-parts")  # scaling, fitting and scoring all read it
    return kept.filter("split = 'train'").drop("split"), kept.filter("split = 'test'").drop("split")


@register
def standardize(spark, sf_dir):
    train, test = features.scale_split(*_classifier_parts(spark, sf_dir))
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select("report_id", "split", F.posexplode("features").alias("idx", "value")).withColumn("value", F.round("value", 6))


@register
def label_encode(spark, sf_dir):
    named = V.vectors(spark, sf_dir).select("report_id", "change_nominal")
    return features.encode_labels(named, "change_nominal")


def _steps(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("report_id"), F.col("turn").alias("step"), F.split("text", " ").alias("embedding")
    )


@register
def steps_hist(spark, sf_dir):
    return features.steps_histogram(features.step_counts(_steps(spark, sf_dir)))


@register
def longest_report(spark, sf_dir):
    return features.longest_report(features.step_counts(_steps(spark, sf_dir)))


@register
def length_batches(spark, sf_dir):
    return features.length_batches(_steps(spark, sf_dir))


# --- classifiers and curves ---------------------------------------------------------------------

K_NEIGHBOURS = 15


def _nb(train, test):
    return models.score_naive_bayes(models.fit_naive_bayes(train), test)


def _knn(train, test):
    return models.score_knn(train, test, K_NEIGHBOURS)


def _svm(train, test):
    options = {"gamma": 0.01, "n_inputs": _width(train)}
    model = models.fit_kernel_machine(train, n_rows=train.count(), **options)
    return models.score_kernel_machine(model, test, **options)


def _scored_nb(spark, sf_dir):
    return _nb(*features.scale_split(*_classifier_parts(spark, sf_dir)))


def _scored_knn(spark, sf_dir):
    return _knn(*features.scale_split(*_classifier_parts(spark, sf_dir)))


@register
def nb_predict(spark, sf_dir):
    return _scored_nb(spark, sf_dir).select("report_id", "y", "pred", F.round("score", 6).alias("score"))


@register
def knn_predict(spark, sf_dir):
    return _scored_knn(spark, sf_dir).select("report_id", "y", "pred", F.round("score", 6).alias("score"))


def _curve(df, x):
    return df.select(x, *[F.round(c, 6).alias(c) for c in df.columns if c != x])


@register
def nb_learning_curve(spark, sf_dir):
    return _curve(curves.nb_learning_curve(V.vectors(spark, sf_dir)), "train_sizes")


@register
def knn_learning_curve(spark, sf_dir):
    return _curve(curves.knn_learning_curve(V.vectors(spark, sf_dir), K_NEIGHBOURS), "train_sizes")


@register
def knn_validation_curve(spark, sf_dir):
    return _curve(curves.knn_validation_curve(V.vectors(spark, sf_dir)), "n_neighbors")


@register
def epoch_curve(spark, sf_dir):
    accuracy = F.col("value") / 500
    scores = V.table(spark, sf_dir, "events").groupBy(
        F.hour("ts").alias("epoch"), (F.col("user_id") % 5).alias("fold")
    ).agg(
        F.avg(F.when(F.col("event_id") % 2 == 0, accuracy)).alias("train"),
        F.avg(F.when(F.col("event_id") % 2 == 1, accuracy)).alias("valid"),
    )
    return _curve(curves.epoch_curve(scores), "epochs")


# --- evaluation and audit -----------------------------------------------------------------------


@register
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(_scored_nb(spark, sf_dir))


@register
def class_report(spark, sf_dir):
    return evaluation.class_report(_scored_nb(spark, sf_dir))


@register
def roc_points(spark, sf_dir):
    points = evaluation.roc_points(_scored_knn(spark, sf_dir))
    return points.select(*[F.round(c, 6).alias(c) for c in points.columns])


@register
def auc(spark, sf_dir):
    return evaluation.roc_auc(_scored_knn(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


def _named(df):
    cik = F.col("report_id") % 40
    return df.withColumns({
        "cik": cik, "ticker": F.concat(F.lit("T"), cik),
        "name": F.concat(F.lit("Company "), F.col("report_id") % 80),
    })


def _drift(spark, sf_dir, names=("nb", "knn")):
    """Drift audit of the named models; only those are trained and scored."""
    parts = _classifier_parts(spark, sf_dir)
    scaled = features.scale_split(*parts)
    known = {"nb": _nb, "knn": _knn, "svm": _svm}
    scored = [_named(known[name](*scaled)).select("cik", "y", "pred", F.lit(name).alias("model")) for name in names]
    train, test = (_named(d) for d in parts)
    return evaluation.company_drift(train, test, functools.reduce(DataFrame.unionByName, scored), tuple(names))


def _round_doubles(df):
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


@register
def company_drift(spark, sf_dir):
    return _round_doubles(evaluation.by_train_ratio(_drift(spark, sf_dir)))


@register
def company_drift_three(spark, sf_dir):
    """The audit with the kernel machine as third model."""
    return _round_doubles(evaluation.by_train_ratio(_drift(spark, sf_dir, ("nb", "knn", "svm"))))


@register
def similarity_points(spark, sf_dir):
    return _round_doubles(evaluation.similarity_points(_drift(spark, sf_dir, ("nb",)), "nb"))


@register
def company_direction_counts(spark, sf_dir):
    """Direction counts per company over all labelled filings, split 80/20."""
    labelled = labelled_reports(spark, sf_dir).select(
        "report_id", "cik", "ticker", F.concat(F.lit("Customer "), "cik").alias("name"), "change_nominal"
    )
    labelled = materialize(labelled, "labelled-index")
    parts = sampling.exact_split(labelled, "report_id", (0.8,), ("train", "test"))
    counts = evaluation.company_counts(parts.filter("split = 'train'"), parts.filter("split = 'test'"))
    return _round_doubles(counts)


# --- sinks, approximate models and streams ------------------------------------------------------


@register
def lines_by_word_count(spark, sf_dir):
    """Lines written to one folder per word count and read back."""
    path = work_dir(spark, "lines-by-count")
    sinks.write_lines_by_count(text_ops.lines_by_word_count(V.documents(spark, sf_dir)), path)
    back = spark.read.schema("value string, words_in_sequence long").text(path)
    return back.select("words_in_sequence", F.col("value").alias("line"))


@register
def ordered_index(spark, sf_dir):
    """The report index written in order of date and report, with the position of each row in the files."""
    path = work_dir(spark, "ordered-index")
    sinks.write_ordered(V.reports(spark, sf_dir), path, "filing_date", "report_id")
    return sinks.read_ordered(spark, path).select("position", "report_id", "ticker", _day("filing_date"))


@register
def frequent_runs(spark, sf_dir):
    """All runs of sub-word tokens, numbered by falling frequency, then by text."""
    runs = corpora.subtoken_runs(corpora.word_pieces(V.documents(spark, sf_dir), vocabulary_of(spark, sf_dir)))
    return corpora.ranked_runs(runs)


@register
def price_insert(spark, sf_dir):
    """Insert under a primary key: half the prices are stored, the whole table comes in again."""
    path = work_dir(spark, "trading-day")
    incoming = V.trading_day(spark, sf_dir)
    sinks.write_trading_days(incoming.filter(F.col("ticker") % 2 == 0), path)
    sinks.append_new(incoming, path, ["date", "ticker"])
    return spark.read.parquet(path).select("ticker", _day("date"), "open", "close")


@register
def corpus_metrics(spark, sf_dir):
    """Scalar metrics written as lines of the shared metrics table and read back."""
    path = work_dir(spark, "metrics")
    words = V.documents(spark, sf_dir).select(X.word_count(F.col("text")).alias("n"))
    row = text_ops.metrics_row(words, n_documents=F.count("*"), n_words=F.sum("n"), most_words=F.max("n"))
    sinks.append_metrics(row, path, "corpus")
    return spark.read.parquet(path)


def _width(vectors, column="features"):
    """Length of the feature vectors, read from one row."""
    first = vectors.select(F.size(column)).head()
    return first[0] if first else 0


@register
def svm_rff(spark, sf_dir):
    return _svm(*features.scale_split(*_classifier_parts(spark, sf_dir))).select("report_id", "y", "pred", "score")


RFF = {"gamma": 0.01, "width": 16}  # of the two queries that SQL rebuilds


@register
def rff_lift(spark, sf_dir):
    """Fourier features of every embedding, one row per number."""
    data = V.vectors(spark, sf_dir)
    scaled = features.scale(data, features.moments(data))
    lifted = kernel.lift_rows(scaled, n_inputs=_width(data), **RFF)
    return lifted.select("report_id", F.posexplode("lifted").alias("at", "value")).withColumn("value", F.round("value", 6))


@register
def svm_margin(spark, sf_dir):
    """Margins of the test reports after twelve steps of the kernel machine's descent."""
    train, test = features.scale_split(*_classifier_parts(spark, sf_dir))
    train = materialize(train.select("features", "y"), "scaled-train")
    n_inputs = _width(train)
    machine = kernel.fit_machine(train, n_inputs=n_inputs, n_rows=train.count(), max_iter=12, **RFF)
    scored = kernel.add_margin(test, machine, gamma=RFF["gamma"], n_inputs=n_inputs)
    return scored.select("report_id", "y", "pred", F.round("margin", 6).alias("margin"))


@register
def svm_validation_curve(spark, sf_dir):
    return _curve(curves.svm_validation_curve(vectors := V.vectors(spark, sf_dir), n_inputs=_width(vectors)), "gamma")


@register
def svm_learning_curve(spark, sf_dir):
    return _curve(curves.svm_learning_curve(vectors := V.vectors(spark, sf_dir), n_inputs=_width(vectors)), "train_sizes")


@register
def pca_points(spark, sf_dir):
    data = V.vectors(spark, sf_dir)
    scaled = materialize(features.scale(data, features.moments(data)), "scaled")
    points = features.project(scaled)
    return points.select("report_id", "change_nominal", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@register
def embed_hook(spark, sf_dir):
    """The embedding hook over all packed chunks, with a seeded projection of hashed words as network."""
    chunks = packing.pack_reports(V.documents(spark, sf_dir), 512)
    embedded = features.embed(chunks, features.hashed_projection(spark.sparkContext))
    return embedded.select("report_id", "step", F.posexplode("embedding").alias("at", "value"))


@register
def stream_clean(spark, sf_dir):
    """Documents cleaned as a file stream."""
    raw = intake.file_stream(spark, V.table(spark, sf_dir, "documents").schema, f"{sf_dir}/documents*.parquet")
    raw = raw.select(F.col("doc_id").alias("report_id"), "text")
    out = work_dir(spark, "clean")
    intake.stream_clean_reports(raw, out, work_dir(spark, "progress"), header="</head>", exhibit="<footer").awaitTermination()
    return spark.read.schema("report_id long, pos int, sentence string").parquet(out)


@register
def stream_prices(spark, sf_dir):
    """Vendor responses loaded as a file stream, in two batches that overlap."""
    landed = work_dir(spark, "landed")
    payloads = V.daily_payloads(spark, sf_dir)
    table, errors, progress = (work_dir(spark, n) for n in ("prices", "errors", "progress"))
    for part in (payloads.filter(F.col("ticker") % 2 == 0), payloads):
        part.write.mode("append").parquet(landed)
        stream = intake.file_stream(spark, payloads.schema, landed)
        intake.stream_prices(stream, table, errors, progress).awaitTermination()
    return spark.read.parquet(table).select(_day("date"), "ticker", "open", "close")


@register
def stream_labels(spark, sf_dir):
    """Reports and prices arriving in two batches, split at a calendar date."""
    landed = work_dir(spark, "landed")
    store, progress = work_dir(spark, "store"), work_dir(spark, "progress")
    report = V.reports(spark, sf_dir).select(
        F.lit("report").alias("kind"), "ticker", F.col("filing_date").alias("date"), "report_id",
        F.lit(None).cast("double").alias("open"), F.lit(None).cast("double").alias("close"),
    )
    price = V.trading_day(spark, sf_dir).select(
        F.lit("price").alias("kind"), "ticker", "date", F.lit(None).cast("long").alias("report_id"), "open", "close"
    )
    rows = report.unionByName(price)
    before = F.col("date") < "1998-06-01"
    again = price.filter(F.col("date").between("1998-01-01", "1998-05-31")).withColumn("close", F.col("close") + 1)
    for part in (rows.filter(before), rows.filter(~before).unionByName(again)):  # the second delivery repeats some days
        part.write.mode("append").parquet(landed)
        stream = intake.file_stream(spark, rows.schema, landed)
        intake.stream_labels(stream, store, progress).awaitTermination()
    labels = spark.read.parquet(f"{store}/labels")
    return labels.select("report_id", "ticker", F.round("change_ratio", 6).alias("change_ratio"), "change_nominal")


# --- keys, paths and step tables ----------------------------------------------------------------


@register
def file_paths(spark, sf_dir):
    """Windows paths of the data drive rewritten, with the report key and the file name."""
    path = F.concat(F.lit("D:\\Edgar\\"), "source", F.lit("\\multiline_report"), "doc_id", F.lit(".txt"))
    docs = V.table(spark, sf_dir, "documents").select("doc_id", X.local_path(path).alias("path"))
    return docs.withColumns({"key": X.file_key(F.col("path")), "name": X.file_name(F.col("path"))})


@register
def mean_features(spark, sf_dir):
    """The first half of the pooled features (the means)."""
    steps = V.sequence_features(spark, sf_dir)
    pooled = features.pool_sequences(steps)
    means = pooled.select("report_id", take_dims(F.col("features"), _width(steps, "embedding")).alias("features"))
    return means.select("report_id", F.posexplode("features").alias("idx", "value")).withColumn("value", F.round("value", 6))


@register
def scaled_steps(spark, sf_dir):
    """Sequence features of a report split, scaled with the raw train steps."""
    steps = V.sequence_features(spark, sf_dir)
    index = sampling.exact_split(steps.select("report_id").distinct(), "report_id", (0.8,), ("train", "test"))
    joined = features.attach_steps(index, steps).withColumnRenamed("embedding", "features")
    train, test = features.scale_split(joined.filter("split = 'train'"), joined.filter("split = 'test'"))
    cells = train.unionByName(test).select("report_id", "split", "step", F.posexplode("features").alias("idx", "value"))
    return cells.withColumn("value", F.round("value", 6))


@register
def sequence_total(spark, sf_dir):
    return text_ops.metrics_row(V.sequence_features(spark, sf_dir), n_sequences=F.count("*"))

"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Documents and benchmark items are fingerprinted alike: hash every run of ``GRAM`` words, keep the smallest
hash of each ``SPAN - GRAM + 1`` neighbours.  Any shared run of ``SPAN`` words then shares a fingerprint, so
the join of fingerprints finds every document that can hold one.  The found documents alone are extended:
their exact windows meet the windows of the items.

Defined results: null and empty texts have no words; an item of fewer than ``SPAN`` words is one window,
and every run of its length is fingerprinted; items without words match nothing; repeated items count once
per id, a null id as the empty one; rows with equal id and text get equal results; an empty benchmark
leaves every document clean, empty documents give an empty result; other columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclosure_spark.session import broadcast_if_small, materialize

SPAN, GRAM = 13, 5
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # Fixed value: ASCII characters between words, after lower-casing
CONTAMINATED_SHARE = 20  # one hit word in so many
MAX_BROADCAST = 200_000


def words(text: Column) -> Column:
    """Words with A-Z in lower case."""
    return F.filter(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), BREAKS), lambda w: w != "")


def folded_words(text: Column) -> Column:
    """Words in lower case throughout: equal words stay equal, and the built-in is faster than ``translate``."""
    return F.filter(F.split(F.lower(text), BREAKS), lambda w: w != "")


def grams(array: Column, n: Column, size: int) -> Column:
    """Hash of each run of ``size`` words, in order; needs n >= size."""
    return F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(array, i, size)))


def fingerprints(array: Column, n: Column, short: list[int]) -> Column:
    """Winnowed hashes of a text, and every run of the lengths that short items have."""
    none = F.array().cast("array<bigint>")
    width = SPAN - GRAM + 1
    # a one-element array carries the gram hashes, so that they are computed once
    minima = F.flatten(F.transform(
        F.array(grams(array, n, GRAM)),
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.array_min(F.slice(h, i, width))),
    ))
    parts = [F.when(n >= SPAN, minima).otherwise(none)]
    parts += [F.when(n >= size, grams(array, n, size)).otherwise(none) for size in short]
    return F.array_distinct(F.concat(*parts) if short else parts[0])


def windows(array: Column, n: Column, sizes: list[int]) -> Column:
    """Exact windows of the given lengths: first word, length and two hashes."""
    none = F.array().cast("array<struct<at:int,size:int,a:bigint,b:int>>")

    def run(size: int) -> Column:
        def window(i: Column) -> Column:
            part = F.slice(array, i, size)
            return F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(part).alias("a"), F.hash(part).alias("b"))

        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), window)).otherwise(none)

    return F.concat(*[run(size) for size in sizes])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document its words, the words inside windows of the benchmark, and the items with such windows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")
    )
    counted = items.select("item", words(F.col("text")).alias("words"), folded_words(F.col("text")).alias("folded")).withColumn("n", F.size("words"))
    counted = counted.filter("n > 0")
    short = sorted(r["n"] for r in counted.filter(F.col("n") < SPAN).select("n").distinct().collect())  # at most twelve lengths

    marks = counted.select(F.explode(
        F.when(F.col("n") >= SPAN, fingerprints(F.col("folded"), F.size("folded"), [])).otherwise(F.array(F.xxhash64("folded")))
    ).alias("mark")).distinct()
    whole = base.select("doc_id", "version", folded_words(F.col("text")).alias("words"))
    whole = whole.select("doc_id", "version", F.size("words").cast("long").alias("n_words"), fingerprints(F.col("words"), F.size("words"), short).alias("marks"))
    whole = materialize(whole, "fingerprints")
    touched = whole.select("doc_id", "version", F.explode("marks").alias("mark")).join(broadcast_if_small(marks, MAX_BROADCAST), "mark", "left_semi")
    touched = materialize(touched.select("doc_id", "version").distinct(), "touched")

    same = F.col("doc_id").eqNullSafe(F.col("touched_id")) & (F.col("version") == F.col("touched_version"))
    ids = touched.select(F.col("doc_id").alias("touched_id"), F.col("version").alias("touched_version"))
    near = base.join(broadcast_if_small(ids, MAX_BROADCAST), same, "left_semi")
    near = near.select("doc_id", "version", words(F.col("text")).alias("words"))
    sizes = [*short, SPAN]
    exact = near.select("doc_id", "version", F.inline(windows(F.col("words"), F.size("words"), sizes)))
    item_windows = counted.select("item", F.inline(
        F.when(F.col("n") >= SPAN, windows(F.col("words"), F.col("n"), [SPAN]))
        .otherwise(F.array(F.struct(F.lit(1).alias("at"), F.col("n").alias("size"), F.xxhash64("words").alias("a"), F.hash("words").alias("b"))))
    )).drop("at").distinct()
    hits = exact.join(broadcast_if_small(item_windows, MAX_BROADCAST), ["size", "a", "b"])
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(1).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(acc["end"], s["at"]))).alias("n"),
            F.greatest(acc["end"], s["at"] + s["size"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    found = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("version").alias("hit_version")).agg(
        F.collect_set(F.struct("at", "size")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    ).select("hit_id", "hit_version", covered.cast("long").alias("n_hit"), "items")
    joined = whole.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("version") == F.col("hit_version")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "version", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (CONTAMINATED_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all of their columns."""
    judged = decontaminate(docs, benchmark, id_col, text_col)
    bad = judged.filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version")).distinct()
    bad = broadcast_if_small(materialize(bad, "contaminated"), MAX_BROADCAST)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(row, F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_version"))
    same = F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_version") == F.col("bad_version"))
    return base.join(bad, same, "left_anti").select("row.*")


def contamination_summary(judged: DataFrame) -> DataFrame:
    """Number and digest of the items in place of their list."""
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )

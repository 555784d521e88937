"""Exact-size splits, balancing, folds and split replay.

A random order is the md5 of a unique key and a seed.  Instead of ranking all rows, the jobs look
up the few rows that sit exactly on a cut: a histogram over the first hex digits of the hash gives
the bucket that holds each cut, and only that bucket's keys are ranked.  The wide rows are then
labelled in one narrow pass, with no shuffle of their payload and no window over a whole table or
class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disclosure_spark.functions.order import SEED, hash_order
from disclosure_spark.session import broadcast_if_small, single_value

_HEX_DIGITS = 3  # 4,096 buckets


def _keyed(df: DataFrame, key: Column, seed: int, by: Sequence[str]) -> DataFrame:
    h = hash_order(key, seed)
    return df.select(*by, F.struct(h.alias("h"), key.alias("k")).alias("at"), F.substring(h, 1, _HEX_DIGITS).alias("b"))


def _histogram(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per (group, bucket) with the running and whole total; at most 4,096 rows per group."""
    counts = keyed.groupBy(*by, "b").agg(F.count("*").alias("n"))
    group = W.partitionBy(*by)
    return counts.select(
        *by, "b", "n",
        F.sum("n").over(group.orderBy("b")).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )


def hash_cuts(
    df: DataFrame, key: Column, ranks: Callable[[DataFrame], Column], *, by: Sequence[str] = (), seed: int = SEED
) -> DataFrame:
    """The rows standing exactly at the given ranks of each group's hash order.

    ``ranks`` gets the histogram (columns ``by``, ``total``) and returns an array of 1-based ranks.
    The result has one row per group: ``by`` and ``cuts``, an array with one ``(h, k)`` per rank in
    the same order; a rank of 0 has a cut of nulls, which every row is beyond.  ``key`` must be unique.
    """
    by = list(by)
    keyed = _keyed(df, key, seed, by)
    hist = _histogram(keyed, by)
    hist = hist.withColumn("_ranks", ranks(hist))
    wanted = hist.select(*by, "b", "n", "upto", F.posexplode("_ranks").alias("i", "rank"))
    here = (F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto"))
    none = (F.col("rank") <= 0) & (F.col("upto") == F.col("n"))  # said once, by the first bucket
    # one row per rank and group
    spots = broadcast_if_small(
        wanted.filter(here | none).select(*by, "b", "i", (F.col("rank") - F.col("upto") + F.col("n")).alias("local"))
    )
    targets = spots.filter(F.col("local") > 0)
    empty = spots.filter(F.col("local") <= 0).select(*by, "i")
    ranked = keyed.join(targets.select(*by, "b"), [*by, "b"], "left_semi").withColumn(
        "rn", F.row_number().over(W.partitionBy(*by, "b").orderBy("at"))
    )
    hits = ranked.join(targets, [*by, "b"]).filter(F.col("rn") == F.col("local")).select(*by, "i", "at")
    at_type = hits.schema["at"].dataType
    found = hits.unionByName(empty.withColumn("at", F.lit(None).cast(at_type)))
    ordered = F.sort_array(F.collect_list(F.struct("i", "at"))).getField("at")
    return found.groupBy(*by).agg(F.transform(ordered, lambda c: F.struct(c["h"].alias("h"), c["k"].alias("k"))).alias("cuts"))


def passed_cuts(key: Column, cuts: Column, seed: int = SEED) -> Column:
    """How many cuts a row lies beyond (0 for rows up to and including the first cut)."""
    here = F.array(F.struct(hash_order(key, seed).alias("h"), key.alias("k")))
    # the one-element array holds the digest, so it is taken once per row and not once per cut
    beyond = F.transform(here, lambda at: F.size(F.filter(cuts, lambda c: c["h"].isNull() | (at > c))))
    return F.get(beyond, F.lit(0))


def _attach(df: DataFrame, cuts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put each group's cuts beside its rows; one row per class, so normally a broadcast."""
    if not by:
        return df.withColumn("cuts", single_value(cuts))
    return df.join(broadcast_if_small(cuts), list(by), "left")


def exact_split(
    df: DataFrame,
    key: str,
    fractions: Sequence[float] = (0.6, 0.2),
    names: Sequence[str] = ("train", "validate", "test"),
    *,
    seed: int = SEED,
    out: str = "split",
) -> DataFrame:
    """Random split with exact sizes ``int(n * f)``; the last part takes the rest."""

    def ranks(_: DataFrame) -> Column:
        sizes = [F.floor(F.col("total") * F.lit(f)) for f in fractions]
        return F.array(*[sum(sizes[1 : i + 1], sizes[0]) for i in range(len(sizes))])

    cuts = hash_cuts(df, F.col(key), ranks, seed=seed)
    place = passed_cuts(F.col(key), F.col("cuts"), seed)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), place + 1)
    return _attach(df, cuts, ()).withColumn(out, label).drop("cuts")


def balance_classes(
    df: DataFrame, key: str, label: str, *, within: Sequence[str] = (), seed: int = SEED, classes: int | None = None
) -> DataFrame:
    """Cut every class to the size of the smallest, in hash order.

    Classes are compared inside each ``within`` group.  With ``classes`` given, a group that holds
    fewer distinct classes than that is emptied, as the smallest class then has no rows.
    """
    within = list(within)
    by = [*within, label]

    def ranks(_: DataFrame) -> Column:
        group = W.partitionBy(*within)
        least = F.min("total").over(group)
        if classes is not None:
            present = F.size(F.collect_set(label).over(group))
            least = F.when(present < classes, F.lit(0)).otherwise(least)
        return F.array(least)

    cuts = hash_cuts(df, F.col(key), ranks, by=by, seed=seed)
    kept = _attach(df, cuts, by).filter(passed_cuts(F.col(key), F.col("cuts"), seed) == 0)
    return kept.drop("cuts").select(*df.columns)


def _tile_ends(total: Column, k: int) -> Column:
    """Last rank of each of the first k-1 near-equal tiles (larger tiles first)."""
    q, r = F.floor(total / k), total % k
    return F.array(*[q * i + F.least(F.lit(i), r) for i in range(1, k)])


def stratified_folds(
    df: DataFrame, key: str, label: str, k: int = 5, *, seed: int = SEED, out: str = "fold"
) -> DataFrame:
    """Folds 0..k-1: each class is cut into k near-equal runs of the hash order."""
    cuts = hash_cuts(df, F.col(key), lambda _: _tile_ends(F.col("total"), k), by=[label], seed=seed)
    tiled = _attach(df, cuts, [label])
    return tiled.withColumn(out, passed_cuts(F.col(key), F.col("cuts"), seed)).drop("cuts").select(*df.columns, out)


_CELLS = 1 << 16  # value ranges counted in one pass of a narrowing
_RANK_AT_MOST = 100_000  # values that one task may rank


def values_at_ranks(df: DataFrame, order: str, ranks: Sequence[int]) -> list[int]:
    """The values standing at the given 1-based ranks of an integer column, found by counts alone.

    Every wanted rank keeps a range of values that holds it, at first from the least to the largest
    value.  A pass cuts each range into equal cells, counts the rows per cell (partial counts before the
    shuffle) and keeps the cell with the rank, until the ranges hold few rows or one value.  What is left is
    ranked, ``_RANK_AT_MOST`` rows a range at any table size.  Values may repeat; nulls are left out.
    A rank that no row holds raises.
    """
    value = F.col(order).cast("long")
    values = df.select(value.alias("v")).filter("v is not null")
    seen = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if any(not 1 <= r <= seen.n for r in ranks):
        raise ValueError(f"ranks {list(ranks)} are not all among {seen.n} rows")
    at = [{"low": seen.low, "high": seen.high, "rank": r, "rows": seen.n} for r in ranks]
    while wide := [i for i, a in enumerate(at) if a["rows"] > _RANK_AT_MOST and a["low"] < a["high"]]:
        cells = max(2, _CELLS // len(wide))
        width = {i: (at[i]["high"] - at[i]["low"]) // cells + 1 for i in wide}
        # a range may span more than a long holds, so distances are decimals
        place = [
            F.when(F.col("v").between(at[i]["low"], at[i]["high"]), F.struct(
                F.lit(i).alias("i"),
                F.expr(f"(cast(v as decimal(20,0)) - {at[i]['low']}bd) div {width[i]}bd").alias("cell"),
            ))
            for i in wide
        ]
        spots = values.select(F.explode(F.filter(F.array(*place), lambda p: p.isNotNull())).alias("p"))
        counts = spots.groupBy("p.i", "p.cell").agg(F.count("*").alias("n")).collect()  # at most _CELLS rows
        found: dict[int, list] = {i: [] for i in wide}
        for row in counts:
            found[row["i"]].append((row["cell"], row["n"]))
        for i in wide:
            before = 0
            for cell, n in sorted(found[i]):
                if before + n >= at[i]["rank"]:
                    low = at[i]["low"] + cell * width[i]
                    at[i] = {"low": low, "high": min(at[i]["high"], low + width[i] - 1), "rank": at[i]["rank"] - before, "rows": n}
                    break
                before += n
    open_ = [i for i, a in enumerate(at) if a["low"] < a["high"]]
    if open_:
        inside = [F.when(F.col("v").between(at[i]["low"], at[i]["high"]), F.lit(i)) for i in open_]
        band = values.select("v", F.explode(F.array_compact(F.array(*inside))).alias("i"))
        wanted = F.element_at(F.create_map(*[F.lit(x) for i in open_ for x in (i, at[i]["rank"])]), F.col("i"))
        ranked = band.withColumn("rn", F.row_number().over(W.partitionBy("i").orderBy("v"))).filter(F.col("rn") == wanted)
        for row in ranked.collect():  # one row per rank
            at[row["i"]]["low"] = row["v"]
    return [a["low"] for a in at]


def contiguous_folds(df: DataFrame, order: str, k: int = 5, *, out: str = "fold") -> DataFrame:
    """Folds 0..k-1 as near-equal runs of a unique integer order column (``ntile`` without its one task).

    The last value of each fold is found by :func:`values_at_ranks`, then every row is labelled where it
    lies.  Of fewer than k rows the last folds stay empty.  Equal values share the fold of the last one
    before the cut; a null has no fold.
    """
    n = df.filter(F.col(order).isNotNull()).count()
    ends = [n // k * i + min(i, n % k) for i in range(1, k)]
    at_ends = values_at_ranks(df, order, sorted({e for e in ends if e})) if n else []
    cuts = F.array(*[F.lit(c).cast("long") for c in at_ends]) if at_ends else F.array().cast("array<long>")
    place = F.size(F.filter(cuts, lambda c: F.col(order) > c))
    return df.withColumn(out, F.when(F.col(order).isNotNull(), place))


def hash_rank(df: DataFrame, key: Column, *, by: Sequence[str] = (), seed: int = SEED, out: str = "ord") -> DataFrame:
    """Exact 1-based rank of every row in its group's hash order.

    Rows are shuffled once by (group, bucket); the offset of a bucket comes from the histogram.
    """
    by = list(by)
    keyed = df.withColumn("_h", hash_order(key, seed)).withColumn("_k", key)
    keyed = keyed.withColumn("b", F.substring("_h", 1, _HEX_DIGITS))
    hist = _histogram(_keyed(df, key, seed, by), by)
    offsets = broadcast_if_small(hist.select(*by, "b", (F.col("upto") - F.col("n")).alias("_before")))
    local = F.row_number().over(W.partitionBy(*by, "b").orderBy("_h", "_k"))
    return keyed.join(offsets, [*by, "b"]).withColumn(out, (local + F.col("_before")).cast("long")).select(*df.columns, out)


def replay_split(index: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Rows of ``index`` whose key went to train or test before; train wins, others are dropped."""
    sides = (
        train.select(key, F.lit(0).alias("side"))
        .unionByName(test.select(key, F.lit(1).alias("side")))
        .groupBy(key)
        .agg(F.min("side").alias("side"))
    )
    return index.join(sides, key).withColumn("split", F.when(F.col("side") == 0, "train").otherwise("test")).drop("side")


def classifier_split(
    df: DataFrame, key: str, label: str, train: float = 0.8, *, seed: int = SEED
) -> DataFrame:
    """Exact train/test split, then classes balanced inside each part (column ``split``)."""
    parts = exact_split(df, key, (train,), ("train", "test"), seed=seed)
    return balance_classes(parts, key, label, within=["split"], seed=seed)

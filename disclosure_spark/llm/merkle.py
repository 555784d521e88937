"""Merkle manifest of a dataset: one root over all rows, and per row a witness that proves it belongs to that root.

Incremental witnesses.  The leaves of a tree arrive in order.  Every open subtree keeps the partial witnesses of
its leaves; when the next sibling of the same height completes, each side's witnesses take up the root
of the other and the two become one open subtree.  At the end the last subtrees close, alone (the digest is hashed by
itself) or with their left neighbour.  Leaves are dealt to aligned blocks of 2 ** ``BLOCK_LEVELS`` leaves, one append stream each;
block roots are appended in the same way, level by level, until one node is left per group, and the roots of the
groups are the leaves of the last tree.  So a row's witness is the one in its block, then the one of the
block, and so on up to the root.

Places.  Leaves are sorted by range partitions, numbered within them, and counts per partition give the offsets; no
task sees more than a partition or a block, whatever share of the rows a group holds.

Defined results: a null column is ``-`` in the leaf, an empty text ``0:``; a null group comes before all others, a null
id before all ids of its group; rows with equal ids follow in the order of their leaves, and equal rows each
have a leaf; an empty table has no rows and no root; columns that are not hashed are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disclosure_spark.session import broadcast_if_small, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 11  # a block holds 2 ** 11 leaves
ROWS_PER_PART = 400_000
MAX_BROADCAST = 20_000  # summaries of blocks, at most two kilobytes each
TAMPER_EVERY = 7
LEFT, RIGHT, ALONE = "<", ">", ""  # where the sibling of a witness step stands; its digest follows


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each value as byte count, colon and value, or ``-`` where it is null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered(id_col: Column) -> Column:
    """Whether the crc32 of the id as text is a multiple of seven; never for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Append:
    """A stream of nodes whose witnesses grow as their siblings complete."""

    def __init__(self) -> None:
        self.witnesses: list[list[str]] = []
        self.open: list[tuple[int, str, int, int]] = []  # height, root, first leaf, one past the last

    def _extend(self, first: int, last: int, step: str) -> None:
        for witness in self.witnesses[first:last]:
            witness.append(step)

    def _join(self, left: tuple[int, str, int, int], right: tuple[int, str, int, int]) -> tuple[int, str, int, int]:
        self._extend(left[2], left[3], RIGHT + right[1])
        self._extend(right[2], right[3], LEFT + left[1])
        return left[0] + 1, digest(left[1] + right[1]), left[2], right[3]

    def add(self, node: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        tree = (0, node, at, at + 1)
        while self.open and self.open[-1][0] == tree[0]:
            tree = self._join(self.open.pop(), tree)
        self.open.append(tree)

    def close(self, height: int = 0) -> str:
        """Root after all nodes came; at least ``height`` levels, as in a block that has others beside it."""
        tree = self.open.pop()
        while self.open or tree[0] < height:
            if self.open and self.open[-1][0] == tree[0]:
                tree = self._join(self.open.pop(), tree)
            else:
                self._extend(tree[2], tree[3], ALONE)
                tree = (tree[0] + 1, digest(tree[1]), tree[2], tree[3])
        self.open.append(tree)
        return tree[1]


def _appended(rows: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Witness of each node of a block, and the root of the block in the row of its first node."""
    rows = rows.sort_values("at", ignore_index=True)
    stream = Append()
    for node in rows["node"]:
        stream.add(node)
    root = stream.close(levels if rows["nodes"].iloc[0] > 1 << levels else 0)
    roots = [root] + [None] * (len(rows) - 1)
    return rows[["tree", "at", "id", "node", "forged"]].assign(steps=stream.witnesses, root=roots)


def _placed(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``at``, the place of a node in its tree, and ``nodes``, the size of the tree.

    The sorted rows are stored with the number of their partition; equal nodes keep apart by a hash of the row's
    number, so that a range never has to hold all copies of one row.
    """
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // ROWS_PER_PART))
    keys = [F.col("tree").asc_nulls_first(), *order, F.col("node"), F.col("salt")]
    salted = nodes.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = ranged.select("tree", F.col("id").cast("string").alias("id"), "node", "forged")  # a long with nulls would be a float in pandas

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = "", 0
        for batch in batches:
            if not len(batch):
                continue
            place = batch.groupby("tree", dropna=False, sort=False).cumcount()
            first = batch["tree"].isna() if last is None else batch["tree"] == last
            place = place + n * first
            end = batch["tree"].iloc[-1]
            last, n = None if pd.isna(end) else end, int(place.iloc[-1]) + 1
            yield batch.assign(place=place)

    schema = "tree string, id string, node string, forged string, place long"
    stored = materialize(ranged.mapInPandas(numbered, schema).withColumn("part", F.spark_partition_id()), "leaves")
    counts = stored.groupBy(F.col("tree").alias("of"), F.col("part").alias("in_part")).agg(F.count("*").alias("n"))
    before = W.partitionBy("of").orderBy("in_part")  # a row per range and tree
    offsets = counts.withColumn("offset", F.sum("n").over(before) - F.col("n")).withColumn("nodes", F.sum("n").over(W.partitionBy("of"))).drop("n")
    offsets = broadcast_if_small(offsets, MAX_BROADCAST)
    joined = stored.join(offsets, F.col("tree").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    return joined.withColumn("at", F.col("offset") + F.col("place")).drop("of", "part", "in_part", "place", "offset")


def trees(nodes: DataFrame, order: list[Column], levels: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame]:
    """Witness steps of every node within its tree, and the root of every tree.

    ``nodes`` has the strings ``tree``, ``node`` and ``forged`` and an ``id`` of any kind; a tree takes its nodes by ``order``.
    """
    kind = dict(nodes.dtypes)["id"]
    schema = "tree string, at long, id string, node string, forged string, steps array<string>, root string"

    def append(level: DataFrame, name: str) -> DataFrame:
        blocks = level.withColumn("block", F.shiftright("at", levels))
        return materialize(blocks.groupBy("tree", "block").applyInPandas(lambda rows: _appended(rows, levels), schema), name)

    first = append(_placed(nodes, order), "witnesses")
    above, last = [], first
    while True:
        roots = last.filter(F.col("root").isNotNull())
        if not roots.filter(F.col("at") > 0).limit(1).count():
            break
        number = F.shiftright("at", levels)
        sizes = roots.groupBy(F.col("tree").alias("of")).agg(F.count("*").alias("nodes"))
        blocks = roots.select("tree", number.alias("at"), "id", F.col("root").alias("node"), F.lit(None).cast("string").alias("forged"))
        last = append(blocks.join(sizes, F.col("tree").eqNullSafe(F.col("of"))).drop("of"), "block_witnesses")
        above.append(last)
    if not above:
        return first.select("tree", F.col("id").cast(kind).alias("id"), "node", "forged", "steps"), roots.select("tree", "root")
    upper = None
    for depth, level in enumerate(reversed(above), 1):  # from the top down, so that every join has one small side
        part = level.select(F.col("tree").alias("of"), F.col("at").alias("number"), F.col("steps").alias("more"))
        if upper is not None:
            joined = part.join(upper, F.col("of").eqNullSafe(F.col("up_of")) & (F.shiftright("number", levels) == F.col("up_number")))
            part = materialize(joined.select("of", "number", F.concat("more", "up_more").alias("more")), "block_paths")
        if depth < len(above):
            upper = broadcast_if_small(part.select(F.col("of").alias("up_of"), F.col("number").alias("up_number"), F.col("more").alias("up_more")), MAX_BROADCAST)
    part = broadcast_if_small(part, MAX_BROADCAST)
    whole = first.join(part, F.col("tree").eqNullSafe(F.col("of")) & (F.shiftright("at", levels) == F.col("number")))
    whole = whole.select("tree", F.col("id").cast(kind).alias("id"), "node", "forged", F.concat("steps", "more").alias("steps"))
    return whole, roots.select("tree", "root")


def folded(node: Column, steps: Column) -> Column:
    """Root that a node and its witness lead to."""

    def up(acc: Column, step: Column) -> Column:
        sibling = F.substring(step, 2, 64)
        pair = F.when(F.substring(step, 1, 1) == LEFT, F.concat(sibling, acc)).otherwise(F.concat(acc, sibling))
        return F.sha2(pair.cast("binary"), 256)

    return F.aggregate(steps, node, up)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", count_col: str = "n_chars", levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row its ``leaf``, the ``subroot`` of its group, the ``root``, its witness ``steps``, and ``forged``.

    ``forged`` is the leaf of the row with one more in ``count_col``, for the rows that ``tampered`` names.
    """
    own = [F.col(f"`{name}`") for name in fields]
    other = [c + 1 if name == count_col else c for name, c in zip(fields, own, strict=True)]
    key = F.col(f"`{id_col}`")
    nodes = docs.select(
        F.col(f"`{group_col}`").cast("string").alias("tree"), key.alias("id"), leaf(own).alias("node"),
        F.when(tampered(key), leaf(other)).alias("forged"),
    )
    leaves, subroots = trees(materialize(nodes, "hashed"), [F.col("id").asc_nulls_first()], levels)
    nothing = F.lit(None).cast("string")
    above = subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("node"), nothing.alias("forged"))
    groups, roots = trees(materialize(above, "subroots"), [F.col("id").asc_nulls_first()], levels)
    groups = groups.join(F.broadcast(roots.select(F.col("tree").alias("all"), "root")), F.col("tree") == F.col("all"))  # one row
    groups = groups.select(F.col("id").alias("of"), F.col("node").alias("subroot"), F.col("steps").alias("more"), "root")
    joined = leaves.join(broadcast_if_small(groups, MAX_BROADCAST), F.col("tree").eqNullSafe(F.col("of")))
    return joined.select(
        F.col("id").alias(id_col), F.col("node").alias("leaf"), "forged", "subroot", "root", F.concat("steps", "more").alias("steps")
    )


def verification_summary(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest of each witness, and whether the row as it is now (tampered with or not) still leads to the root."""
    siblings = F.array_join(F.transform("steps", lambda s: F.substring(s, 2, 64)), "")
    found = rows.select(
        F.col(id_col).alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("forged", "leaf"), F.col("steps")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Token sequences of one length filled from whole documents by sum-of-squares packing.

A document becomes the ids of a public vocabulary and one closing id.  Only a document longer than a
sequence is cut.  Each remaining piece goes where, after placing it, the sum over all residual gaps of the
squared number of open bins with that gap is smallest.  Pieces come longest first and a bin is opened only
if no open bin has room, which leaves next to no gaps at the end.

Pieces are dealt at random into groups of a bounded number of pieces that are packed independently, so
the work spreads over any number of tasks; a group loses at most a few sequences against one global packing.

Defined results: a null text counts as empty and gives the closing id alone; repeated rows and null ids are
packed like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclosure_spark.llm import tokens
from disclosure_spark.session import materialize

SEQUENCE = 2048
CLOSING_ID = 0
GROUP_PIECES = 50_000
VOCABULARY = "word_bpe_49k.json"


def tokenized_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, sequence: int = SEQUENCE
) -> DataFrame:
    """Pieces of at most ``sequence`` tokens per document: number, start, length and packed unsigned 32-bit ids."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    path = vocabulary or tokens.vocabulary_path(VOCABULARY)
    closing = np.array([CLOSING_ID], dtype="<u4").tobytes()

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = tokens.word_ids(path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in tokens.slices(texts):
                split = [tokens.words(t) for t in texts[a:b]]
                known = memory.learn(set().union(*split))
                doc, piece, start, length, ids = [], [], [], [], []
                for i, words in enumerate(split, a):
                    raw = b"".join(map(known.__getitem__, words)) + closing
                    for k, cut in enumerate(range(0, len(raw), 4 * sequence)):
                        part = raw[cut:cut + 4 * sequence]
                        doc.append(i)
                        piece.append(k)
                        start.append(cut // 4)
                        length.append(len(part) // 4)
                        ids.append(part)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[doc].array, "piece": piece, "start": start, "length": length, "ids": ids})

    kind = dict(base.dtypes)["doc_id"]
    return base.mapInPandas(tokenize, f"doc_id {kind}, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; every step costs one pass over the possible gaps."""
    never = 1 << 60
    count = np.zeros(capacity + 1, dtype=np.int64)
    leave = np.full(capacity + 1, never, dtype=np.int64)  # change of the sum when a bin of this gap goes
    enter = np.ones(capacity + 1, dtype=np.int64)  # change when one comes; a full bin no longer counts
    enter[0] = 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    n_bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        change = leave[size:capacity] + enter[:capacity - size]
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] < never // 2:
            gap = size + best
            bins[i] = open_bins[gap].pop()
            count[gap] -= 1
            leave[gap] = 1 - 2 * count[gap] if count[gap] else never
            enter[gap] = 2 * count[gap] + 1
        else:
            gap, bins[i] = capacity, n_bins
            n_bins += 1
        offsets[i] = capacity - gap
        rest = gap - size
        if rest:
            open_bins[rest].append(int(bins[i]))
            count[rest] += 1
            leave[rest] = 1 - 2 * count[rest]
            enter[rest] = 2 * count[rest] + 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces that has a ``length`` column.

    A group holds about ``group_pieces`` rows, whatever their documents; full pieces are sequences already
    and skip the shuffle.
    """
    n_open = pieces.filter(F.col("length") < sequence).count()
    groups = max(1, -(-n_open // group_pieces))
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    done = numbered.filter(F.col("length") >= sequence).select(
        *pieces.columns, F.shiftleft("row", 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    left = numbered.filter(F.col("length") < sequence).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        bins, offsets = sum_of_squares(group["length"].to_numpy(np.int64), sequence)
        named = (np.int64(group["group"].iloc[0]) << 32 | bins) << 1 | 1 if len(group) else bins
        return group.drop(columns=["row", "group"]).assign(sequence_id=named, offset=offsets)

    schema = ", ".join([*[f"`{c}` {k}" for c, k in pieces.dtypes], "sequence_id long", "offset long"])
    return done.unionByName(left.groupBy("group").applyInPandas(pack, schema))


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Placement and CRC of every piece of every document; the ids themselves stay out of the shuffle.

    The pieces are stored first, so that the row numbers that deal them into groups hold for every later task.
    """
    pieces = tokenized_pieces(docs, **options).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack_pieces(materialize(pieces, "pieces"), options.get("sequence", SEQUENCE))


def packed_sequences(docs: DataFrame, **options) -> DataFrame:
    """One row per sequence with the packed ids of all its pieces in order."""
    pieces = materialize(tokenized_pieces(docs, **options), "pieces")
    placed = pack_pieces(pieces, options.get("sequence", SEQUENCE))
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"))).alias("pieces"),
        F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("hex"),
    ).select("sequence_id", "pieces", F.unhex("hex").alias("ids"))

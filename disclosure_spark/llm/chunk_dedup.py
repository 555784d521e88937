"""Removal of repeated passages by content-defined chunks.

A gear hash over the last 32 bytes sets the chunk ends, so an insertion moves no end beyond it.  Chunks
meet by digest; all but the first (smallest document id, then position) are repeats.  A run of repeats is
extended byte by byte, at both ends, as long as what stands around its first occurrence agrees (at most ``FLANK`` bytes,
more than a chunk can hold), back to whole words.  It is removed where it then spans at least ``MIN_RUN`` bytes, so that
short common phrases stay.

Defined results: null and empty texts stay as they are (null becomes empty); rows with equal id and text
count as one document and get equal results; a null id sorts before all others; a removal never splits a
UTF-8 character; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclosure_spark.llm import packed
from disclosure_spark.session import materialize

MASK_BITS = 5  # chunks of 32 bytes beyond the least length, on average
LEAST, MOST = 16, 1024
MIN_RUN = 100
FLANK = MOST + 64
FLUSH_BYTES = 12_000_000
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_KINDS = {"digest": "V16", "doc": "<i8", "version": "<i8", "start": "<u4", "stop": "<u4"}
_REPEAT = "doc long, version long, start long, stop long, source long, source_version long, source_start long"
_WORD = np.array([bytes([x]).isalnum() for x in range(256)])
_SPACE = np.array([bytes([x]).isspace() for x in range(256)])


def chunk_starts(text: bytes) -> np.ndarray:
    """Starts of the chunks of a text, by the gear hash at every byte."""
    n = len(text)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    h = _GEAR[np.frombuffer(text, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):  # after these steps bit i holds what came at most 31 bytes earlier
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends = ends[np.diff(ends, prepend=-LEAST) >= LEAST]  # a trigger right after another one does not cut
    ends = ends[(ends >= LEAST) & (ends < n)]
    starts = np.concatenate(([0], ends))
    sizes = np.diff(starts, append=n)
    if sizes.max() > MOST:
        extra = [np.arange(s + MOST, s + z, MOST) for s, z in zip(starts[sizes > MOST].tolist(), sizes[sizes > MOST].tolist(), strict=True)]
        starts = np.sort(np.concatenate((starts, *extra)))
    return starts


def _cut(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Chunk records."""
    from xxhash import xxh3_128_digest

    digests, docs, versions, starts, ends, size = [], [], [], [], [], 0

    def flush() -> Iterator[pd.DataFrame]:
        counts = [len(s) for s in starts]
        columns = {
            "digest": np.frombuffer(b"".join(digests), dtype="V16"), "doc": np.repeat(np.array(docs, dtype="<i8"), counts),
            "version": np.repeat(np.array(versions, dtype="<i8"), counts), "start": np.concatenate(starts).astype("<u4"),
            "stop": np.array(ends, dtype="<u4"),
        }
        halves = columns["digest"].view("<u8")[::2]
        yield packed.send((halves % np.uint64(buckets)).astype(np.int64), columns, tuple(_KINDS))

    for batch in batches:
        for doc, version, text in zip(batch["doc"].tolist(), batch["version"].tolist(), batch["text"].tolist(), strict=True):
            raw = text.encode()
            at = chunk_starts(raw)
            if not len(at):
                continue
            stops = np.append(at[1:], len(raw)).tolist()
            digests.extend([xxh3_128_digest(raw[a:b]) for a, b in zip(at.tolist(), stops, strict=True)])
            docs.append(doc)
            versions.append(version)
            starts.append(at)
            ends.extend(stops)
            size += len(raw)
            if size >= FLUSH_BYTES:
                yield from flush()
                digests, docs, versions, starts, ends, size = [], [], [], [], [], 0
    if size:
        yield from flush()


def split_repeats(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come strictly later than the first of their digest, and that first one for each."""
    halves = columns["digest"].view("<u8").reshape(-1, 2)
    order = np.lexsort((columns["version"], columns["start"], columns["doc"], halves[:, 1], halves[:, 0]))
    a, b, doc, start = halves[order, 0], halves[order, 1], columns["doc"][order], columns["start"][order]
    new = packed.runs(a, b)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[head]) | (start != start[head])
    return order[later], order[head[later]]


def _repeats(rows: pd.DataFrame) -> pd.DataFrame:
    """All repeats of a bucket with their first occurrence."""
    columns = packed.receive(rows, _KINDS)
    later, first = split_repeats(columns)
    own = {k: columns[k][later].astype(np.int64) for k in ("doc", "version", "start", "stop")}
    return pd.DataFrame(own | {name: columns[k][first].astype(np.int64) for name, k in (("source", "doc"), ("source_version", "version"), ("source_start", "start"))})


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Every chunk whose digest comes earlier in the corpus, and where it comes first."""
    buckets = packed.bucket_count(docs)
    sent = docs.mapInPandas(lambda batches: _cut(batches, buckets), packed.schema(_KINDS))
    return sent.groupBy("bucket").applyInPandas(_repeats, _REPEAT)


def extend(raw: bytes, a: int, b: int, before: bytes, after: bytes) -> tuple[int, int]:
    """Span of a repeat with what agrees around its source, drawn in to whole words and characters but not below itself."""
    x = np.frombuffer(raw, dtype=np.uint8)
    n = min(a, len(before))
    differ = np.flatnonzero(x[a - n:a] != np.frombuffer(before, dtype=np.uint8)[len(before) - n:])
    start = a - n + (int(differ[-1]) + 1 if len(differ) else 0)
    n = min(len(x) - b, len(after))
    differ = np.flatnonzero(x[b:b + n] != np.frombuffer(after, dtype=np.uint8)[:n])
    stop = b + (int(differ[0]) if len(differ) else n)
    while 0 < start < a and _WORD[x[start - 1]] and _WORD[x[start]]:
        start += 1
    while 0 < start < a and _SPACE[x[start]]:
        start += 1
    while b < stop < len(x) and _WORD[x[stop - 1]] and _WORD[x[stop]]:
        stop -= 1
    while b < stop < len(x) and _SPACE[x[stop - 1]]:
        stop -= 1
    return start, stop


def removed_spans(raw: bytes, repeats: list, flanks: list | None, min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """Byte spans of long runs of repeats and what agrees around them, drawn in to whole characters."""
    around = {(f["at"], f["side"]): bytes(f["flank"]) for f in (flanks if flanks is not None else [])}
    merged: list[list[int]] = []
    for a, b in chunk_runs(repeats):
        a, b = extend(raw, a, b, around.get((a, 0), b""), around.get((b, 1), b""))
        if merged and a <= merged[-1][1]:
            merged[-1][0], merged[-1][1] = min(a, merged[-1][0]), max(b, merged[-1][1])
        else:
            merged.append([a, b])
    spans = []
    for a, b in merged:
        if b - a >= min_run:
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            spans.append((a, b))
    return spans


def chunk_runs(repeats: list) -> list[tuple[int, int]]:
    """Spans of adjoining repeats."""
    out: list[tuple[int, int]] = []
    for a, b in sorted({(c["start"], c["stop"]) for c in repeats}):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Both ends of every run of repeats, and the place in the source whose surroundings they need."""
    names = ["doc", "version", "at", "side", "source", "source_version", "place"]
    for batch in batches:
        rows = []
        for doc, version, repeats in zip(batch["of"], batch["v"], batch["repeats"], strict=True):
            first, last = {c["start"]: c for c in repeats}, {c["stop"]: c for c in repeats}
            for a, b in chunk_runs(repeats):
                c, e = first[a], last[b]
                rows.append((doc, version, a, 0, c["source"], c["source_version"], c["source_start"]))
                rows.append((doc, version, b, 1, e["source"], e["source_version"], e["source_start"] + e["stop"] - e["start"]))
        yield pd.DataFrame(rows, columns=names).astype("int64")


def _flanks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes before (side 0) or after (side 1) each wanted place of the source texts."""
    for batch in batches:
        rows = []
        for doc, version, text, places in zip(batch["doc"], batch["version"], batch["text"], batch["places"], strict=True):
            raw = text.encode()
            for p in places:
                at = p["place"]
                rows.append((doc, version, at, p["side"], raw[at:at + FLANK] if p["side"] else raw[max(0, at - FLANK):at]))
        yield pd.DataFrame(rows, columns=["s", "sv", "p", "sd", "flank"])


def with_repeats(identified: DataFrame) -> DataFrame:
    """Add ``repeats``, the repeated chunks, and ``flanks``, what stands around their sources, to rows of ``doc``, ``version`` and ``text``.

    Each place of a source is cut once; all lists are bounded by the length of one document.
    """
    texts = identified.select("doc", "version", "text")
    chunks = materialize(repeated_chunks(texts), "chunks")
    chunk = F.struct("start", "stop", "source", "source_version", "source_start")
    repeats = materialize(chunks.groupBy(F.col("doc").alias("of"), F.col("version").alias("v")).agg(F.collect_set(chunk).alias("repeats")), "repeats")
    edges = repeats.mapInPandas(_edges, "doc long, version long, at long, side long, source long, source_version long, place long")
    edges = materialize(edges, "edges")
    places = edges.groupBy(F.col("source").alias("s"), F.col("source_version").alias("sv")).agg(F.collect_set(F.struct("place", "side")).alias("places"))
    sources = texts.join(places, (F.col("doc") == F.col("s")) & (F.col("version") == F.col("sv"))).dropDuplicates(["doc", "version"])
    cut = sources.select("doc", "version", "text", "places").mapInPandas(_flanks, "s long, sv long, p long, sd long, flank binary")
    cut = materialize(cut, "flanks")
    same = (F.col("source") == F.col("s")) & (F.col("source_version") == F.col("sv")) & (F.col("place") == F.col("p")) & (F.col("side") == F.col("sd"))
    around = edges.join(cut, same).groupBy(F.col("doc").alias("d"), F.col("version").alias("dv")).agg(F.collect_list(F.struct("at", "side", "flank")).alias("flanks"))
    joined = identified.join(repeats, (F.col("doc") == F.col("of")) & (F.col("version") == F.col("v")), "left").drop("of", "v")
    return joined.join(around, (F.col("doc") == F.col("d")) & (F.col("version") == F.col("dv")), "left").drop("d", "dv")


def rewrite_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """The documents with all of their columns, repeated passages taken out of the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = with_repeats(packed.identified(docs.select(row), f"row.`{id_col}`", f"row.`{text_col}`", "row"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for text, repeats, flanks in zip(batch["text"], batch["repeats"], batch["flanks"], strict=True):
                if repeats is not None:
                    raw, at, pieces = text.encode(), 0, []
                    for a, b in removed_spans(raw, repeats, flanks, min_run):
                        pieces.append(raw[at:a])
                        at = b
                    text = (b"".join(pieces) + raw[at:]).decode()
                texts.append(text)
            yield batch.drop(columns=["text", "repeats", "flanks"]).assign(new_text=texts)

    others = [c for c in docs.columns if c != text_col]
    kinds = dict(docs.dtypes)
    flat = joined.select(*[F.col("row")[c].alias(f"c{i}") for i, c in enumerate(others)], "text", "repeats", "flanks")
    schema = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(others)], "new_text string"])
    done = flat.mapInPandas(cut, schema)
    named = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text_col: F.col("new_text")}
    return done.select(*[named[c].alias(c) for c in docs.columns])


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """Remaining text and removed spans of every document.

    Only chunk records are shuffled by digest; the texts cross once to give what stands around first occurrences,
    and once to meet their own repeats.
    """
    joined = with_repeats(packed.identified(docs, id_col, text_col))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"text": [], "n_bytes": [], "n_removed": [], "spans": []}
            for text, repeats, flanks in zip(batch["text"], batch["repeats"], batch["flanks"], strict=True):
                raw = text.encode()
                spans = removed_spans(raw, repeats, flanks, min_run) if repeats is not None else []
                at, pieces = 0, []
                for a, b in spans:
                    pieces.append(raw[at:a])
                    at = b
                out["text"].append((b"".join(pieces) + raw[at:]).decode() if spans else text)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["spans"].append([{"start": a, "stop": b} for a, b in spans])
            yield batch[["doc"]].assign(**out)

    done = joined.select("doc", "text", "repeats", "flanks").mapInPandas(
        cut, "doc long, text string, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>"
    )
    return done.select(packed.plain_id().alias("doc_id"), "text", "n_bytes", "n_removed", "spans")

"""Exact removal of repeated byte strings by prefix-free parsing.

Parse.  The rolling hash of ``TRIGGER`` bytes cuts every document into phrases: each string of ``length``
bytes has exactly one trigger, the smallest hash inside it, and the strings that share a trigger are the
suffixes of one phrase.  A phrase holds those suffixes to their full length, so what follows it in the parse is part of
it and no phrase is needed to order another.

Dictionary.  Equal phrases meet by hash; the first occurrence stays, every suffix of a later one repeats.

Corpus order.  Phrases that share a trigger with another, different phrase are put into suffix arrays: per
trigger the suffixes are sorted by their bytes to the length that counts, then by document and position,
and equal neighbours behind the first repeat it.  A trigger with very many phrases (a line that stands in
many documents) is not gathered: its suffixes meet one by one, by the hash of their bytes.

Defined results: null and empty texts have no bytes; rows that share an id are versions of one document, so
a string at the same start of two versions is no repeat of itself; a null id sorts before all others; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclosure_spark.llm import packed
from disclosure_spark.session import materialize

LENGTH, TRIGGER = 100, 32
HOT_PHRASES, HOT_IN_FLUSH = 64, 16
SLICE_BYTES, FLUSH_PHRASES = 250_000, 120_000
SAME, SORTED, SCATTERED = 1, 2, 3  # what a found row asks for: nothing more, the suffix array, the hash

_WIDE = np.random.default_rng(40)
_TABLES = _WIDE.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PHRASE = {"trigger": "<u8", "phrase": "<u8", "doc": "<i8", "version": "<i8", "start": "<u4", "more": "u1", "hot": "u1"}


@functools.cache
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class Hashed:
    """Polynomial hashes of any span of a buffer, two independent ones."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        room = 1 << max(19, n.bit_length())
        self.sums, self.inverse = [], []
        for which in (0, 1):
            power, inverse = _powers(which, room)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_TABLES[which][buffer] * power[:n], out=total[1:])
            self.sums.append(total)
            self.inverse.append(inverse)

    def span(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[which][stop] - self.sums[which][start]) * self.inverse[which][start]


def phrases(texts: list[bytes], length: int = LENGTH, trigger: int = TRIGGER) -> dict[str, np.ndarray]:
    """Phrases of a run of texts: text number, first and last start of its suffixes, trigger and phrase hashes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(buffer) < length:
        empty = np.empty(0, dtype=np.int64)
        return {"text": empty, "start": empty, "last": empty, "trigger": empty.astype(np.uint64), "phrase": empty.astype(np.uint64)}
    hashed = Hashed(buffer)
    at = np.arange(len(buffer) - trigger + 1)
    rolling = hashed.span(0, at, at + trigger)
    low = np.uint64((1 << 30) - 1)
    best = (rolling & ~low) | at.astype(np.uint64)  # the leftmost of equal hashes wins
    width, k = length - trigger + 1, 1
    while 2 * k <= width:
        best = np.minimum(best[:-k], best[k:])
        k *= 2
    if width > k:
        best = np.minimum(best[: len(best) - (width - k)], best[width - k:])
    chosen = (best & low).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)[: len(chosen)]
    inside = np.flatnonzero(np.arange(len(chosen)) + length <= (first + sizes)[text])
    chosen, text = chosen[inside], text[inside]
    new = packed.runs(chosen, text)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(inside)) - 1 if len(heads) else heads
    start, last, at, text = inside[heads], inside[tails], chosen[heads], text[heads]
    shape = ((at - start) * 256 + (last - start)).astype(np.uint64) * _MIX
    return {
        "text": text, "start": start - first[text], "last": last - first[text], "trigger": rolling[at],
        "phrase": hashed.span(1, start, last + length) ^ shape,
    }


def _first_of(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, document and start; in that order: whether a key is new, and whether a row comes strictly after the first of its key."""
    order = np.lexsort((start, doc, *reversed(keys)))
    new = packed.runs(*[k[order] for k in keys])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    doc, start = doc[order], start[order]
    return order, new, (doc != doc[head]) | (start != start[head])


def _parse(batches: Iterator[pd.DataFrame], buckets: int, length: int) -> Iterator[pd.DataFrame]:
    """Phrase records per bucket of the trigger.

    What a flush can settle goes aside at once: repeats of its own phrases, and the phrases of triggers
    that it holds in many forms, of which one marked record goes on.
    """
    held: list[dict[str, np.ndarray]] = []
    count = 0
    names = tuple(_PHRASE)

    def flush() -> Iterator[pd.DataFrame]:
        c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        order, new, later = _first_of((c["trigger"], c["phrase"]), c["doc"], c["start"])
        c = {k: v[order] for k, v in c.items()}
        c["hot"] = np.zeros(len(order), dtype=np.uint8)
        new_trigger = packed.runs(c["trigger"])
        forms = np.bincount(np.cumsum(new_trigger) - 1, weights=new)[np.cumsum(new_trigger) - 1] if len(order) else order
        hot = forms > HOT_IN_FLUSH
        c["hot"][hot] = 1
        bucket = (c["trigger"] % np.uint64(buckets)).astype(np.int64)
        for rows, state in ((~later & (~hot | new_trigger), None), (later, SAME), (~later & hot & ~new_trigger, SCATTERED)):
            if rows.any():
                yield packed.send(bucket[rows], {k: c[k][rows] for k in names}, names).assign(state=state or 0)

    def add(docs: list[int], versions: list[int], texts: list[bytes]) -> int:
        p = phrases(texts, length)
        held.append({
            "trigger": p["trigger"], "phrase": p["phrase"], "doc": np.array(docs, dtype="<i8")[p["text"]],
            "version": np.array(versions, dtype="<i8")[p["text"]], "start": p["start"].astype("<u4"), "more": (p["last"] - p["start"]).astype(np.uint8),
        })
        return len(p["text"])

    docs, versions, texts, size = [], [], [], 0
    for batch in batches:
        for doc, version, text in zip(batch["doc"].tolist(), batch["version"].tolist(), batch["text"].tolist(), strict=True):
            raw = text.encode()
            if len(raw) < length:
                continue
            docs.append(doc)
            versions.append(version)
            texts.append(raw)
            size += len(raw)
            if size >= SLICE_BYTES:
                count += add(docs, versions, texts)
                docs, versions, texts, size = [], [], [], 0
            if count >= FLUSH_PHRASES:
                yield from flush()
                held.clear()
                count = 0
    if texts:
        count += add(docs, versions, texts)
    if count:
        yield from flush()


def _dictionary(rows: pd.DataFrame) -> pd.DataFrame:
    """Found rows of a bucket: repeated phrases, and first phrases whose trigger has other forms."""
    parts = []
    for state in (SAME, SCATTERED):
        c = packed.receive(rows[rows["state"] == state], _PHRASE)
        parts.append((c["doc"], c["version"], c["start"], c["more"], np.full(len(c["doc"]), state)))
    c = packed.receive(rows[rows["state"] == 0], _PHRASE)
    if len(c["doc"]):
        order, new, later = _first_of((c["trigger"], c["phrase"]), c["doc"], c["start"])
        c = {k: v[order] for k, v in c.items()}
        number = np.cumsum(packed.runs(c["trigger"])) - 1
        forms = np.bincount(number, weights=new)[number]
        hot = (np.bincount(number, weights=c["hot"])[number] > 0) | (forms > HOT_PHRASES)
        state = np.where(later, SAME, np.where(hot, SCATTERED, np.where(forms > 1, SORTED, 0)))
        kept = state > 0
        parts.append(tuple(v[kept] for v in (c["doc"], c["version"], c["start"], c["more"], state)))
    doc, version, start, more, state = (np.concatenate([p[i] for p in parts]) for i in range(5))
    return pd.DataFrame({"doc": doc, "version": version, "start": start.astype(np.int64), "more": more.astype(np.int64), "state": state.astype(np.int64)})


def _portions(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Batches cut into runs of about ``most`` characters of text."""
    for batch in batches:
        sizes = batch["text"].str.len().to_numpy(np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        for _, rows in batch.groupby(part, sort=True):
            yield rows


_SUFFIX = {"doc": "<i8", "version": "<i8", "start": "<u4"}


def _suffixes(batches: Iterator[pd.DataFrame], buckets: int, length: int) -> Iterator[pd.DataFrame]:
    """Of each document's ambiguous phrases: the bytes (for the suffix arrays) or the hash of each suffix."""
    for batch in _portions(batches, 4 * SLICE_BYTES):
        slices: dict[int, list[tuple]] = {}
        keys, docs, versions, starts = [], [], [], []
        for doc, version, text, found in zip(batch["doc"].tolist(), batch["version"].tolist(), batch["text"], batch["found"], strict=True):
            raw = text.encode()
            hashed = Hashed(np.frombuffer(raw, dtype=np.uint8))
            for row in found:
                start, more = row["start"], row["more"]
                at = np.arange(start, start + more + 1)
                if row["state"] == SORTED:
                    best = hashed.span(0, w := np.arange(start + more, start + length - TRIGGER + 1), w + TRIGGER)
                    key = int(best[np.argmin(best >> np.uint64(30))])
                    slices.setdefault(key % buckets, []).append((key, doc, version, start, raw[start:start + more + length]))
                else:
                    keys.append(np.stack((hashed.span(0, at, at + length), hashed.span(1, at, at + length)), axis=1))
                    docs.append(np.full(len(at), doc))
                    versions.append(np.full(len(at), version))
                    starts.append(at)
        for bucket, rows in slices.items():
            yield pd.DataFrame({
                "bucket": [bucket], "key": [np.array([r[0] for r in rows], dtype="<u8").tobytes()],
                "doc": [np.array([r[1] for r in rows], dtype="<i8").tobytes()], "version": [np.array([r[2] for r in rows], dtype="<i8").tobytes()],
                "start": [np.array([r[3] for r in rows], dtype="<u4").tobytes()], "size": [np.array([len(r[4]) for r in rows], dtype="<u4").tobytes()],
                "bytes": [b"".join(r[4] for r in rows)],
            })
        if keys:
            key = np.concatenate(keys)
            c = {"key": np.ascontiguousarray(key).view("V16").ravel(), "doc": np.concatenate(docs).astype("<i8"), "version": np.concatenate(versions).astype("<i8"), "start": np.concatenate(starts).astype("<u4")}
            order, new, later = _first_of((key[:, 0], key[:, 1]), c["doc"], c["start"])
            for rows, settled in ((order[~later], False), (order[later], True)):
                if len(rows):
                    frame = packed.send((key[rows, 0] % np.uint64(buckets)).astype(np.int64), {k: v[rows] for k, v in c.items()}, ("key", "doc", "version", "start"))
                    yield frame.assign(size=None, bytes=None, key=b"" if settled else frame["key"])


def _suffix_array(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Starts of suffixes that an earlier suffix equals over ``length`` bytes."""
    parts = []
    scattered = rows["bytes"].isna()
    settled = scattered & (rows["key"].map(len) == 0)
    done = packed.receive(rows[settled], _SUFFIX)
    parts.append([done[k].astype(np.int64) for k in _SUFFIX])
    c = packed.receive(rows[scattered & ~settled], {"key": "V16", **_SUFFIX})
    halves = c["key"].view("<u8").reshape(-1, 2)
    order, _, later = _first_of((halves[:, 0], halves[:, 1]), c["doc"], c["start"])
    parts.append([c[k][order[later]].astype(np.int64) for k in _SUFFIX])
    c = packed.receive(rows[~scattered], {"size": "<u4", **_SUFFIX})
    if len(c["doc"]):
        buffer = np.frombuffer(b"".join(rows.loc[~scattered, "bytes"]), dtype=np.uint8)
        counts = c["size"].astype(np.int64) - length + 1
        begin = np.cumsum(c["size"].astype(np.int64)) - c["size"]
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place = np.repeat(begin, counts) + step
        doc, version, start = (np.repeat(c[k].astype(np.int64), counts) for k in _SUFFIX)
        start = start + step
        windows = np.lib.stride_tricks.sliding_window_view(buffer, length)[place]
        order = np.lexsort((start, doc, np.ascontiguousarray(windows).view(f"S{length}").ravel()))
        ordered = windows[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = order[(doc[order] != doc[order][head]) | (start[order] != start[order][head])]
        parts.append([doc[later], version[later], start[later]])
    return pd.DataFrame({k: np.concatenate([p[i] for p in parts]) for i, k in enumerate(_SUFFIX)})


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, version, start, more): strings of ``length`` bytes from ``start`` to ``start + more`` occur earlier."""
    buckets = packed.bucket_count(docs)
    records = docs.mapInPandas(lambda batches: _parse(batches, buckets, length), packed.schema(_PHRASE) + ", state int")
    kinds = "doc long, version long, start long, more long"
    found = materialize(records.groupBy("bucket").applyInPandas(_dictionary, kinds + ", state long"), "phrases")
    open_rows = found.filter(F.col("state") != SAME).groupBy(F.col("doc").alias("of"), F.col("version").alias("v")).agg(
        F.collect_list(F.struct("start", "more", "state")).alias("found")  # bounded by the length of one document
    )
    joined = docs.join(open_rows, (F.col("doc") == F.col("of")) & (F.col("version") == F.col("v"))).select("doc", "version", "text", "found")
    suffixes = joined.mapInPandas(
        lambda batches: _suffixes(batches, buckets, length),
        "bucket long, key binary, doc binary, version binary, start binary, size binary, bytes binary",
    )
    single = suffixes.groupBy("bucket").applyInPandas(lambda rows: _suffix_array(rows, length), "doc long, version long, start long")
    settled = found.filter(F.col("state") == SAME).select("doc", "version", "start", "more")
    return settled.unionByName(single.withColumn("more", F.lit(0).cast("long")))


def covered_spans(starts: np.ndarray, more: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Union of the bytes of all repeated strings."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], starts[order] + more[order] + length
    reach = np.maximum.accumulate(b)
    cut = np.flatnonzero(a[1:] > reach[:-1]) + 1
    heads, tails = np.concatenate(([0], cut)), np.concatenate((cut, [len(a)])) - 1
    return list(zip(a[heads].tolist(), reach[tails].tolist(), strict=True))


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remaining bytes and removed spans of every document."""
    base = packed.identified(docs, id_col, text_col)
    starts = repeated_starts(base, length).groupBy(F.col("doc").alias("of"), F.col("version").alias("v")).agg(
        F.collect_list("start").alias("starts"), F.collect_list("more").alias("more")  # bounded by the length of one document
    )
    joined = base.join(starts, (F.col("doc") == F.col("of")) & (F.col("version") == F.col("v")), "left").select("doc", "text", "starts", "more")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "kept": [], "kept_sha256": [], "spans": []}
            for text, starts, more in zip(batch["text"], batch["starts"], batch["more"], strict=True):
                raw = text.encode()
                spans = covered_spans(np.asarray(starts, dtype=np.int64), np.asarray(more, dtype=np.int64), length) if starts is not None else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join(kept) + raw[at:] if spans else raw
                out["n_bytes"].append(len(raw))
                out["kept"].append(left)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["spans"].append([{"start": a, "stop": b} for a, b in spans])
            yield batch[["doc"]].assign(**out)

    done = joined.mapInPandas(cut, "doc long, n_bytes long, kept binary, kept_sha256 string, spans array<struct<start:long,stop:long>>")
    return done.select(packed.plain_id().alias("doc_id"), "n_bytes", "kept", "kept_sha256", "spans")


def removal_summary(removed: DataFrame) -> DataFrame:
    """Counts and digest per document."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return removed.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

"""Maximal periodic runs of words, found with longest common extensions over a difference cover.

Words of a slice of documents become numbers in one array, each document behind a number of its own, so that no match
crosses documents.  Only the suffixes at places that a difference cover modulo ``CYCLE`` samples are
sorted: first by their next ``CYCLE`` words, then by doubling over steps of ``CYCLE``.  For any two places some
shift below ``CYCLE`` makes both of them samples, so their common extension is at most that many words compared one by
one and then a range minimum, by a sparse table, over the common prefixes of neighbouring samples.

A run of period q and length at least max(24, 3 q) holds max(2 q, 24 - q) places in a row whose words equal those q
later.  So probes on a grid of that width, harmonic in q, touch every run.  A probe whose next words
agree is extended to both sides, forwards by the structure on the words, backwards by the one on the
reversed words.  The same stretch comes up for multiples of its period; the smallest is kept.

Defined results: a null or empty text has no words and no runs; repeated rows are judged alike; a null id counts as the
empty text in its checksum, which is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclosure_spark.session import spread

CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)  # Fixed values: a perfect difference set, every distance once
LEAST, TIMES = 24, 3  # a run has at least so many words and repeats its period so often
PROBE = 4
SLICE_WORDS = 200_000
PROBES_AT_ONCE = 2_000_000
_SHIFT = np.zeros((CYCLE, CYCLE), dtype=np.int64)
for _i in range(CYCLE):
    for _j in range(CYCLE):
        _SHIFT[_i, _j] = next(s for s in range(CYCLE) if (_i + s) % CYCLE in COVER and (_j + s) % CYCLE in COVER)


def _dense(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of every key, equal keys alike, given the order that sorts them."""
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate(([0], (keys[order][1:] != keys[order][:-1]).astype(np.int64))))
    return out


class Extensions:
    """Longest common extensions of an array of numbers; nothing extends beyond its end."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        n = len(words)
        self.padded = np.concatenate((words, np.full(2 * CYCLE, -1, dtype=words.dtype)))
        self.places = np.concatenate([np.arange(r, n, CYCLE) for r in COVER])  # residue by residue, so that the next sample is the next entry
        last = np.zeros(len(self.places), dtype=bool)
        last[np.cumsum([len(range(r, n, CYCLE)) for r in COVER])[[len(range(r, n, CYCLE)) > 0 for r in COVER]] - 1] = True
        self._sort(last)
        self.number = np.full(n, -1, dtype=np.int64)
        self.number[self.places] = np.arange(len(self.places))

    def _sort(self, last: np.ndarray) -> None:
        m = len(self.places)
        windows = np.lib.stride_tricks.sliding_window_view(self.padded, CYCLE)[self.places]
        raw = np.ascontiguousarray((windows + 1).astype(">u4")).view(f"V{4 * CYCLE}")[:, 0]
        name = np.unique(raw, return_inverse=True)[1].astype(np.int64)
        ends = np.flatnonzero(last)
        levels, step = [name], 1
        stop = np.repeat(ends, np.diff(ends, prepend=-1)) if m else ends  # last sample of the own residue
        while m and name.max() + 1 < m:
            at = np.arange(m) + step
            second = np.where(at <= stop, name[np.minimum(at, m - 1)] + 1, 0)
            key = name * (m + 1) + second
            name = _dense(key, np.argsort(key, kind="stable"))
            levels.append(name)
            step *= 2
        self.rank = name
        order = np.argsort(name, kind="stable")
        common = np.zeros(m, dtype=np.int64)  # of a sample and the one before it in order
        if m > 1:
            a, b = order[:-1].copy(), order[1:].copy()
            length = np.zeros(m - 1, dtype=np.int64)
            for k in range(len(levels) - 1, -1, -1):
                inside = (a <= stop[np.minimum(order[:-1], m - 1)]) & (b <= stop[np.minimum(order[1:], m - 1)])
                same = inside & (levels[k][np.minimum(a, m - 1)] == levels[k][np.minimum(b, m - 1)])
                length += same * (CYCLE << k)
                a, b = a + same * (1 << k), b + same * (1 << k)
            common[1:] = length + self._compare(self.places[order[:-1]] + length, self.places[order[1:]] + length, np.full(m - 1, CYCLE))
        self.table = [common]
        while 1 << len(self.table) <= m:
            low, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(low[:-half], low[half:]))

    def _compare(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from both places, at most ``limit``, compared one by one."""
        out = np.zeros(len(i), dtype=np.int64)
        n = len(self.words)
        active = np.flatnonzero(limit > 0)
        k = 0
        while len(active):
            a, b = i[active] + k, j[active] + k
            same = (a < n) & (b < n) & (self.padded[np.minimum(a, n)] == self.padded[np.minimum(b, n)])
            active = active[same]
            k += 1
            out[active] = k
            active = active[limit[active] > k]
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from places i and j on; i and j differ."""
        shift = _SHIFT[i % CYCLE, j % CYCLE]
        out = self._compare(i, j, shift)
        n = len(self.words)
        whole = np.flatnonzero((out == shift) & (i + shift < n) & (j + shift < n))
        a = self.rank[self.number[i[whole] + shift[whole]]]
        b = self.rank[self.number[j[whole] + shift[whole]]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            use = level == k
            t = self.table[k]
            out[whole[use]] += np.minimum(t[low[use]], t[high[use] - (1 << int(k))])
        return out


def _grid(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size class, period) pairs and their grid width, for documents of the given sizes."""
    of = np.repeat(np.arange(len(sizes)), sizes // TIMES)
    first = np.cumsum(sizes // TIMES) - sizes // TIMES
    return of, np.arange(len(of)) - first[of] + 1


def _probes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and period of every grid point whose next ``PROBE`` words equal those a period later."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    of, period = _grid(np.where(sizes >= LEAST, sizes, 0))
    width = np.maximum(2 * period, LEAST - period) - (PROBE - 1)
    points = np.maximum(0, -(-(sizes[of] - period - (PROBE - 1)) // width))
    total = np.cumsum(points)
    a = 0
    while a < len(of):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PROBES_AT_ONCE, side="right")))
        n = points[a:b]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(period[a:b], n)
        x = np.repeat(starts[of[a:b]], n) + k * np.repeat(width[a:b], n)
        doc = np.repeat(of[a:b], n)
        for j in range(PROBE):
            same = words[x + j] == words[x + q + j]
            doc, x, q = doc[same], x[same], q[same]
        out.append((doc, x, q))
        a = b
    if not out:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def find_runs(documents: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of each document (arrays of word numbers): rows of start, length and period, by start, then period."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    none = np.empty((0, 3), dtype=np.int64)
    found = [none] * len(documents)
    if not len(documents) or not (sizes >= LEAST).any():
        return found
    starts = np.cumsum(sizes + 1) - sizes  # a wall before each document
    top = max((int(d.max()) for d in documents if len(d)), default=0) + 1
    words = np.empty(int((sizes + 1).sum()) + 1, dtype=np.int64)
    words[np.concatenate((starts - 1, [len(words) - 1]))] = top + np.arange(len(documents) + 1)
    for d, s in zip(documents, starts.tolist(), strict=True):
        words[s:s + len(d)] = d
    doc, x, q = _probes(words, starts, sizes)
    if not len(doc):
        return found
    # only documents with a hit go into the structures
    hit = np.unique(doc)
    if len(hit) < len(documents):
        for at, runs in zip(hit.tolist(), find_runs([documents[i] for i in hit.tolist()]), strict=True):
            found[at] = runs
        return found
    forwards = Extensions(words)(x, x + q)
    n = len(words)
    backwards = Extensions(words[::-1].copy())(n - x, n - x - q)
    long = forwards + backwards + q >= np.maximum(LEAST, TIMES * q)
    rows = np.stack((doc, x - backwards - starts[doc], forwards + backwards + q, q), axis=1)[long]
    rows = np.unique(rows, axis=0)  # by document, start, length and period
    if len(rows):
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        rows = rows[first]
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
        cuts = np.searchsorted(rows[:, 0], np.arange(len(documents) + 1))
        found = [rows[a:b, 1:] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return found


def repeated_tail(words: list[bytes], checksum: int) -> list[bytes]:
    """The words with a periodic tail where the checksum of the id asks for one, else as they are."""
    n, g = len(words), checksum // 10
    if checksum % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[:n - a]


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Places that no run holds after its first period."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(edge[:size]) == 0)


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """Run of the greatest exact exponent; ties by start, then period."""
    best: tuple[int, int, int] | None = None
    for start, length, period in runs.tolist():  # in order of start and period
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def _checksum(doc_id: object) -> int:
    return zlib.crc32(doc_id.encode()) if isinstance(doc_id, str) else 0


def _judge(ids: list[object], texts: list[object], plant: bool) -> Iterator[dict[str, object]]:
    documents = [t.encode().split() if isinstance(t, str) else [] for t in texts]
    if plant:
        documents = [repeated_tail(d, _checksum(i)) for i, d in zip(ids, documents, strict=True)]
    every = np.empty(sum(map(len, documents)), dtype=object)
    every[:] = list(chain.from_iterable(documents))
    coded = np.split(pd.factorize(every)[0].astype(np.int64), np.cumsum([len(d) for d in documents])[:-1])
    for doc_id, words, runs in zip(ids, documents, find_runs(coded), strict=True):
        best = strongest(runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
        kept = [words[i] for i in kept_words(len(words), runs).tolist()] if len(runs) else words
        collapsed = b" ".join(kept)
        yield {
            "id": doc_id, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2], "runs": [(int(s), int(n), int(q)) for s, n, q in runs.tolist()],
            "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed": collapsed,
        }


def _slices(batches: Iterator[pd.DataFrame], plant: bool, digest: bool) -> Iterator[pd.DataFrame]:
    """Documents in slices of about ``SLICE_WORDS`` words; a longer one makes a slice of its own."""
    for batch in batches:
        ids, texts = batch["id"].tolist(), batch["text"].tolist()
        a = size = 0
        for b, text in enumerate(texts, 1):
            size += len(text) // 6 if isinstance(text, str) else 0
            if size < SLICE_WORDS and b < len(texts):
                continue
            rows = pd.DataFrame(list(_judge(ids[a:b], texts[a:b], plant)))
            for name in ("start", "length", "period", "exponent_milli"):
                rows[name] = rows[name].astype("Int64")
            if digest:
                rows["collapsed_sha256"] = [hashlib.sha256(c).hexdigest() for c in rows.pop("collapsed")]
                del rows["runs"]
            else:
                rows["collapsed"] = [c.decode() for c in rows["collapsed"]]
                rows["runs"] = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in rows["runs"]]
            yield rows
            a, size = b, 0


_NUMBERS = "id string, n_runs long, start long, length long, period long, exponent_milli long"


def _applied(docs: DataFrame, id_col: str, text_col: str, schema: str, plant: bool, digest: bool) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ", 7)[:8]]
    base = spread(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")))
    found = base.mapInPandas(lambda batches: (rows[names] for rows in _slices(batches, plant, digest)), schema)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return found.select(F.col("id").cast(kind).alias("doc_id"), *names[1:])


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its runs, the strongest of them, and the text without the repeats, its words joined by one space."""
    schema = f"{_NUMBERS}, collapsed string, runs array<struct<start:long,length:long,period:long>>"
    return _applied(docs, id_col, text_col, schema, False, False)


def run_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """Digests in place of runs and collapsed text; ``plant`` gives a tenth of the documents a periodic tail first."""
    return _applied(docs, id_col, text_col, f"{_NUMBERS}, runs_sha256 string, collapsed_sha256 string", plant, True)

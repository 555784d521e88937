"""Log probabilities of whole texts by a small causal self-attention model over sub-word ids.

Words are cut into the ids of a public vocabulary.  Ids fall into classes with alike neighbours, by counts of
left and right neighbours over the whole training part of the corpus; one attention layer, trained in numpy, predicts
the class of the next id from the ids before it, and the share of an id within its class comes from counts as well.
The layer starts from a bounded number of windows; then ``ROUNDS`` steps follow, each with the gradient over another
part of the windows of all training texts, which lie one after the other over all ids at every size.  A text is scored in
overlapping windows, many at a time under a causal mask; every id is scored once, all but the first window with at
least ``WINDOW - STRIDE`` ids before it.  A word's probability mixes two ways to write it: id by id, or, for a
word of the training documents, as the class of its first id in this context times the word's share of the words of that class.

The unigram base counts every word and one end per text over all training documents.  Counts of the
``HEAD`` most frequent words are sent to all tasks, the rarer ones are joined, with the same score.

Defined results: null and empty texts are one end; without training documents all shares are even;
repeated rows score alike; an empty table gives an empty result; other columns are ignored.  The model sees
letters in lower case, so texts that differ in case alone share a score.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from disclosure_spark.llm import tokens
from disclosure_spark.llm.byte_cnn import remainder
from disclosure_spark.session import materialize

VOCABULARY = "word_bpe_49k.json"
WINDOW, STRIDE, WIDTH, CLASSES, CONTEXTS = 32, 24, 16, 48, 256
WARM = 40_000  # windows of the first STEPS steps
STEPS, BATCH, RATE = 600, 64, 0.01
ROUNDS, ROUND_RATE = 16, 0.003
GRADIENT_UNIT = 1 << 24  # sums of whole units do not depend on their order
FLUSH_CELLS = 2_000_000
HEAD = 1 << 19
SCORED_AT_ONCE, BLOCK = 160, 10  # windows, and of these in one product
SHARE = 0.1  # of spelling in the mixture
ALPHA = 0.1
FLUSH_WORDS = 400_000
END_HASH = 0


def product(z: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    """``z @ w`` in blocks of ``BLOCK`` windows of ``rows`` each, below the size from which BLAS starts threads that a task has no core for."""
    block = rows * BLOCK if len(z) % (rows * BLOCK) == 0 else rows
    return (z.reshape(-1, block, z.shape[1]) @ w).reshape(len(z), -1)


def summed(z: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``z.T @ d`` over windows, in the same blocks."""
    block = WINDOW * BLOCK if len(z) % (WINDOW * BLOCK) == 0 else WINDOW
    return (z.reshape(-1, block, z.shape[1]).transpose(0, 2, 1) @ d.reshape(-1, block, d.shape[1])).sum(axis=0)


def word_hash(word: str) -> int:
    return (xxh3_64_intdigest(word.encode().lower()) >> 1) | 1  # odd: never the hash of the end


@dataclass
class Attention:
    """Classes of all ids, the log share of each id in its class, log10 of words that start in each class, the share of each class that opens a word, which ids end a word, and the weights of the layer."""

    of: np.ndarray
    inside: np.ndarray
    starts: np.ndarray
    opens: np.ndarray
    final: np.ndarray
    end: int
    joined: float
    w: dict[str, np.ndarray]

    def log_probabilities(self, stream: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of the class of every id of a stream of whole documents, each closed by the end id.

        The second array holds them given that a word opens there.
        """
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        sizes = np.diff(first, append=len(stream))
        count = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
        which = np.repeat(np.arange(len(first)), count)
        number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        start = first[which] + number * STRIDE
        stop = (first + sizes)[which]
        classes = self.of[stream]
        before = np.concatenate(([self.of[self.end]], classes[:-1]))
        before[first] = self.of[self.end]
        query, key, value, plain, mixed, sums = self.tables
        out, opening = np.empty(len(stream), dtype=np.float32), np.empty(len(stream), dtype=np.float32)
        place = np.arange(WINDOW)
        for least, chosen in ((0, number == 0), (WINDOW - STRIDE, number > 0)):  # only places that a window scores ask
            starts, stops = start[chosen], stop[chosen]
            for a in range(0, len(starts), SCORED_AT_ONCE):
                at = starts[a:a + SCORED_AT_ONCE, None] + place
                real = at[:, least:] < stops[a:a + SCORED_AT_ONCE, None]
                np.minimum(at, len(stream) - 1, out=at)
                row = before[at] * WINDOW + place
                asks = row[:, least:]
                s = query.take(asks, axis=0) @ key.take(row, axis=0).transpose(0, 2, 1)
                np.exp(np.minimum(s, 60, out=s), out=s)
                s *= _BEFORE[least:]
                o = (s @ value.take(row, axis=0)).reshape(-1, WIDTH + 1)
                logits = plain.take(asks.ravel(), axis=0)
                logits += product(o[:, :WIDTH] / o[:, WIDTH:], mixed, WINDOW - least)
                at = at[:, least:].ravel()
                target = logits[np.arange(len(logits)), classes[at]]
                np.exp(np.minimum(logits, 60, out=logits), out=logits)
                both = target[:, None] - np.log(product(logits, sums, WINDOW - least))
                use = real.ravel()
                to = at[use]
                out[to], opening[to] = both[use, 0], both[use, 1]
        return out / np.log(10), (opening + np.log(self.opens[classes])) / np.log(10)

    @functools.cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """What each class gives at each place of a window: query, key, value with a one to sum by, and its own part of the logits."""
        w = self.w
        e = (w["embed"][:, None, :] + w["place"]).reshape(-1, WIDTH)
        scale = np.float32(WIDTH**-0.5)
        sums = np.stack((np.ones(CLASSES, dtype=np.float32), self.opens), axis=1)
        value = np.concatenate((e @ w["value"], np.ones((len(e), 1), dtype=np.float32)), axis=1)
        return e @ w["query"] * scale, e @ w["key"], value, e @ w["out"] + w["bias"], w["mix"] @ w["out"], sums

    def gradients(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Mean gradient over (windows, WINDOW + 1) classes; column 0 is what stands before the window."""
        w, scale = self.w, np.float32(WIDTH**-0.5)
        x, t = rows[:, :-1].ravel(), rows[:, 1:].ravel()
        each = np.arange(len(x))
        stacked = lambda z: z.reshape(-1, WINDOW, z.shape[-1])
        flat = lambda z: z.reshape(-1, z.shape[-1])
        e = flat(stacked(w["embed"].take(x, axis=0)) + w["place"])
        q, k, v = (stacked(product(e, z, WINDOW)) for z in (w["query"] * scale, w["key"], w["value"]))
        p = q @ k.transpose(0, 2, 1)
        np.exp(np.minimum(p, 60, out=p), out=p)
        p *= _BEFORE
        p /= p @ np.ones((WINDOW, 1), dtype=np.float32)
        o = flat(p @ v)
        y = e + product(o, w["mix"], WINDOW)
        d = product(y, w["out"], WINDOW)
        d += w["bias"]
        np.exp(np.minimum(d, 60, out=d), out=d)
        d /= product(d, np.ones((CLASSES, 1), dtype=np.float32), WINDOW)
        d[each, t] -= 1
        g = {"out": summed(y, d), "bias": stacked(d).sum(axis=0).sum(axis=0)}
        de = product(d, w["out"].T, WINDOW)
        g["mix"] = summed(o, de)
        do = product(de, w["mix"].T, WINDOW)
        own = np.einsum("ij,ij->i", do, o).reshape(-1, WINDOW, 1)
        do = stacked(do)
        dv = p.transpose(0, 2, 1) @ do
        ds = do @ v.transpose(0, 2, 1)
        ds -= own
        ds *= p
        for name, z in (("query", (ds @ k) * scale), ("key", ds.transpose(0, 2, 1) @ q), ("value", dv)):
            g[name] = summed(e, flat(z))
            de += product(flat(z), w[name].T, WINDOW)
        g["place"] = stacked(de).sum(axis=0)
        marks = np.zeros((len(x), CLASSES), dtype=np.float32)
        marks[each, x] = 1
        g["embed"] = summed(marks, de)
        return {name: z * np.float32(1 / len(t)) for name, z in g.items()}

    def step(self, g: dict[str, np.ndarray], m: dict[str, list[np.ndarray]], step: int, rate: float) -> None:
        """One step of Adam; ``m`` holds its running means."""
        for n, z in g.items():
            a, b = m[n]
            a += 0.1 * (z - a)
            b += 0.01 * (z * z - b)
            self.w[n] = self.w[n] - (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def fit(self, windows: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        m = {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in self.w.items()}
        for step in range(1, STEPS + 1):
            rows = windows[rng.integers(0, len(windows), BATCH)]
            self.step(self.gradients(rows), m, step, RATE * min(1.0, step / 20) * (1 - step / (STEPS + 1)))

    def refine(self, windows: DataFrame) -> None:
        """``ROUNDS`` steps, each by the summed gradient over its own part of all windows."""
        names = sorted(self.w)
        shapes = [self.w[n].shape for n in names]
        cuts = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
        m = {n: [np.zeros(v.shape), np.zeros(v.shape)] for n, v in self.w.items()}
        of = windows.sparkSession.sparkContext.broadcast(self.of)
        for number in range(ROUNDS):
            w = self.w

            def run(batches: Iterator[pd.DataFrame], w: dict[str, np.ndarray] = w) -> Iterator[pd.DataFrame]:
                model = Attention(of.value, of.value, of.value, of.value, of.value, 0, 0.0, w)
                for batch in batches:
                    rows = model.of[np.frombuffer(b"".join(batch["window"]), dtype="<u4").reshape(-1, WINDOW + 1)]
                    total = np.zeros(cuts[-1] + 1)
                    for k in range(0, len(rows), SCORED_AT_ONCE):
                        g, n = model.gradients(rows[k:k + SCORED_AT_ONCE]), len(rows[k:k + SCORED_AT_ONCE])
                        total += n * np.concatenate([*[g[x].ravel() for x in names], [1.0 / GRADIENT_UNIT]])
                    yield pd.DataFrame({"sums": [np.rint(total * GRADIENT_UNIT).astype(np.int64)]})

            sums = windows.filter(F.col("round") == number).select("window").mapInPandas(run, "sums array<long>")
            sums = sums.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")
            if not len(sums):
                continue
            x = sums["x"].to_numpy(np.float64)
            g = {n: (x[a:b] / GRADIENT_UNIT / x[-1]).reshape(s) for n, a, b, s in zip(names, cuts[:-1], cuts[1:], shapes, strict=True)}
            self.step(g, m, number + 1, ROUND_RATE * (1 - number / (ROUNDS + 1)))
        of.destroy()


_BEFORE = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))


def context_columns(counts: np.ndarray) -> np.ndarray:
    """Column of every id as a neighbour: the most frequent ids have their own, the others share the last."""
    context = np.full(len(counts), CONTEXTS)
    context[np.argsort(-counts, kind="stable")[:CONTEXTS]] = np.arange(min(CONTEXTS, len(counts)))
    return context


def cluster(cells: np.ndarray, roots: np.ndarray, counts: np.ndarray, final: np.ndarray, seed: int = 5) -> np.ndarray:
    """Class of every id: k-means of what stands before and after it in all training texts, by the most frequent ids.

    ``roots`` are the square roots of the counts of ``cells``, id times the number of columns plus column.
    """
    of = np.where(final, CLASSES - 1, CLASSES - 2)  # ids that no training text holds: by whether they end a word
    seen = np.flatnonzero(counts)
    if not len(seen):
        return of
    rng = np.random.default_rng(seed)
    wide = 2 * (CONTEXTS + 1)
    row = np.full(len(counts), -1)
    row[seen] = np.arange(len(seen))
    v = np.zeros((len(seen), wide), dtype=np.float32)
    v[row[cells // wide], cells % wide] = roots
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    weight = np.sqrt(counts[seen]).astype(np.float32)
    centers = v[rng.choice(len(seen), min(CLASSES - 2, len(seen)), replace=False, p=weight / weight.sum())]
    for _ in range(8):
        near = (v @ centers.T).argmax(axis=1)
        for c in range(len(centers)):
            if (mine := near == c).any():
                centers[c] = weight[mine] @ v[mine]
                centers[c] /= max(np.linalg.norm(centers[c]), 1e-9)
    of[seen] = near
    return of


class WordNumbers(dict):
    """Numbers of distinct words; arrays hold by number the hash and the bounds of the ids of each.

    The empty word stands for the end of a text.  All are forgotten when there are more than ``limit``.
    """

    def __init__(self, path: str, end: int, limit: int = tokens.REMEMBERED // 2):
        self.ids_of, self.end, self.limit = tokens.word_ids(path).ids, end, limit
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self[""] = 0
        self.hash, self.start = np.array([END_HASH]), np.array([0, 1])
        self.ids = np.array([self.end], dtype=np.int32)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        """Numbers of all words in their order."""
        if len(self) > self.limit:
            self._forget()
        known = len(self)
        out = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(texts)), dtype=np.int64, count=sum(map(len, texts)))
        if self.new:
            self.hash = _room(self.hash, known, len(self))
            self.hash[known:len(self)] = np.fromiter(map(word_hash, self.new), dtype=np.int64, count=len(self.new))
            ids, size = self.ids_of(self.new)
            first = int(self.start[known])
            self.start = _room(self.start, known + 1, len(self) + 1)
            self.start[known + 1:len(self) + 1] = first + np.cumsum(size)
            self.ids = _room(self.ids, first, first + len(ids))
            self.ids[first:first + len(ids)] = ids
            self.new = []
        return out

    def spelled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of these numbers, one after the other, and how many each has."""
        size = self.start[codes + 1] - self.start[codes]
        at = np.repeat(self.start[codes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.ids[at].astype(np.int64), size


def _room(held: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """An array for ``wanted`` values that begins with the used ones."""
    if wanted <= len(held):
        return held
    out = np.empty(max(wanted, 2 * len(held)), dtype=held.dtype)
    out[:used] = held[:used]
    return out


@functools.cache
def word_numbers(path: str, end: int) -> WordNumbers:
    """One memory per vocabulary and worker process."""
    return WordNumbers(path, end)


def _split(texts: list) -> list[list[str]]:
    """Words of every text and the empty word for its end."""
    return [[*tokens.words(t), ""] if isinstance(t, str) else [""] for t in texts]


def count_words(training: DataFrame, path: str, end: int) -> DataFrame:
    """(kind, key, n): word hashes (0), sub-word ids (1) and first ids of words (2) of all training texts, counted per task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, held, texts = word_numbers(path, end), Counter(), 0

        def flush() -> pd.DataFrame:
            n = np.fromiter(held.values(), dtype=np.int64, count=len(held))
            codes = memory.numbers([list(held)])
            ids, size = memory.spelled(codes)
            pieces = np.bincount(ids, weights=np.repeat(n, size), minlength=1).astype(np.int64)
            heads = ids[np.minimum(np.cumsum(size) - size, len(ids) - 1)] if len(ids) else ids
            starts = np.bincount(heads, weights=n[:len(heads)], minlength=1).astype(np.int64)
            used, begun = np.flatnonzero(pieces), np.flatnonzero(starts)
            key = np.concatenate((memory.hash[codes], [END_HASH], used, begun))
            kind = np.repeat([0, 1, 2], [len(held) + 1, len(used), len(begun)])
            return pd.DataFrame({"kind": kind, "key": key, "n": np.concatenate((n, [texts], pieces[used], starts[begun]))})

        for batch in batches:
            for text in batch["text"]:
                held.update(tokens.words(text) if isinstance(text, str) else ())
                texts += 1
                if len(held) >= FLUSH_WORDS:
                    yield flush()
                    held.clear()
                    texts = 0
        if texts:
            yield flush()

    rows = training.mapInPandas(run, "kind long, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def contexts_and_windows(training: DataFrame, path: str, end: int, context: np.ndarray, every: int = WINDOW) -> DataFrame:
    """(cell, n): neighbours of ids counted over all training texts; (window, round): ids of windows ``every`` so many ids.

    Windows lie over the whole of a text, the last one back from its end; a text shorter than one counts as if it came
    again and again.  So every id is to be predicted at least once, and no sum depends on partitions.
    """
    wide = 2 * (CONTEXTS + 1)
    sent = training.sparkSession.sparkContext.broadcast(context)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, column, held, size = word_numbers(path, end), sent.value, [], 0

        def flush() -> pd.DataFrame:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"cell": cell, "n": n, "window": None, "round": None})

        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in tokens.slices([t if isinstance(t, str) else "" for t in texts]):
                split = _split(texts[a:b])
                ids, spelled = memory.spelled(memory.numbers(split))
                sizes = np.add.reduceat(spelled, np.cumsum([0, *map(len, split[:-1])]))
                first = np.cumsum(sizes) - sizes
                before = np.concatenate(([end], ids[:-1]))
                before[first] = end
                held += [ids * wide + column[before], before * wide + CONTEXTS + 1 + column[ids]]
                size += 2 * len(ids)
                spare = np.maximum(sizes - WINDOW, 0)
                count = 1 + -(-spare // every)
                of = np.repeat(np.arange(b - a), count)
                number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                at = np.minimum(number * every, spare[of])[:, None] + np.arange(WINDOW)
                rows = np.empty((len(of), WINDOW + 1), dtype="<u4")
                rows[:, 1:] = ids[first[of, None] + at % sizes[of, None]]
                rows[:, 0] = before[first[of] + at[:, 0]]
                raw, width = rows.tobytes(), 4 * (WINDOW + 1)
                windows = [raw[k:k + width] for k in range(0, len(raw), width)]
                yield pd.DataFrame({"cell": None, "n": None, "window": windows, "round": [zlib.crc32(x) % ROUNDS for x in windows]})
                if size >= FLUSH_CELLS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return training.mapInPandas(run, "cell long, n long, window binary, round int")


def end_id(path: str) -> int:
    return max(tokens.word_ids(path).tokenizer.get_added_tokens_decoder())


def train(training: DataFrame, pieces: pd.DataFrame, n_words: int, n_texts: int, path: str) -> Attention:
    """Classes, shares and weights from all training texts; no more than ``WARM`` windows and one row per cell reach the driver."""
    memory, end = tokens.word_ids(path), end_id(path)
    size = memory.tokenizer.get_vocab_size()
    final = np.zeros(size, dtype=bool)
    for token, i in memory.tokenizer.get_vocab().items():
        final[i] = token.endswith("</w>")
    ids, firsts = pieces[pieces["kind"] == 1], pieces[pieces["kind"] == 2]
    seen = np.zeros(size, dtype=np.int64)
    seen[ids["key"].to_numpy(np.int64)] = ids["n"].to_numpy(np.int64)
    seen[end] += n_texts
    both = materialize(contexts_and_windows(training, path, end, context_columns(seen)), "contexts")
    cells = both.filter("cell is not null").groupBy(F.col("cell").cast("int").alias("cell")).agg(F.sqrt(F.sum("n")).cast("float").alias("root"))
    cells = materialize(cells, "cells").toArrow()
    of = cluster(cells["cell"].to_numpy(), cells["root"].to_numpy(), seen, final)
    counts = seen + 0.5
    begun = np.bincount(of[firsts["key"].to_numpy(np.int64)], weights=firsts["n"].to_numpy(np.float64), minlength=CLASSES)
    opens = (begun + 0.01) / (np.bincount(of, weights=counts, minlength=CLASSES) + 0.02)
    inside = np.log(counts / np.bincount(of, weights=counts, minlength=CLASSES)[of])
    ends = float(counts[final].sum())
    joined = min(max((ends - n_words) / ends, 1e-6), 0.9) if ends else 1e-6
    rng = np.random.default_rng(11)
    shapes = {
        "embed": (CLASSES, WIDTH), "place": (WINDOW, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH),
        "mix": (WIDTH, WIDTH), "out": (WIDTH, CLASSES),
    }
    w = {n: (rng.normal(0, 0.3, s)).astype(np.float32) for n, s in shapes.items()} | {"bias": np.zeros(CLASSES, dtype=np.float32)}
    model = Attention(of, inside, np.log10(begun + 1), opens.astype(np.float32), final, end, joined, w)
    windows = both.filter("window is not null").select("window", "round")
    warm = windows.orderBy(F.xxhash64("window"), "window").limit(WARM).toArrow()["window"].to_pylist()
    if warm:
        model.fit(of[np.frombuffer(b"".join(warm), dtype="<u4").reshape(-1, WINDOW + 1)])
        model.refine(windows)
    return model


def score_texts(texts: list, memory: WordNumbers, model: Attention, head: tuple[np.ndarray, np.ndarray], total: float) -> dict[str, list]:
    """Per text its tokens, what the head settles of the base, the rare words left to join, and the model's score without these."""
    split = _split(texts)
    sizes = np.array([len(ws) - 1 for ws in split])
    slot_code = memory.numbers(split)
    last = np.cumsum(sizes + 1) - 1
    is_word = np.ones(len(slot_code), dtype=bool)
    is_word[last] = False
    distinct, codes = np.unique(slot_code[is_word], return_inverse=True)
    key = memory.hash[distinct]
    at = np.minimum(np.searchsorted(head[0], key), len(head[0]) - 1)
    frequent = head[0][at] == key
    base = np.where(frequent, np.log10((head[1][at] + ALPHA) / total), 0.0)
    stream, slots = memory.spelled(slot_code)
    text = np.repeat(np.arange(len(texts)), sizes)
    slot_text = np.repeat(np.arange(len(texts)), sizes + 1)
    classed, opened = model.log_probabilities(stream, np.repeat(slot_text, slots))
    log10 = classed + model.inside[stream] / np.log(10)
    per_slot = np.bincount(np.repeat(np.arange(len(slots)), slots), weights=log10, minlength=len(slots))
    spelling, length = memory.spelled(distinct)
    finals = np.bincount(np.repeat(np.arange(len(distinct)), length), weights=model.final[spelling], minlength=len(distinct))
    opening = (np.cumsum(slots) - slots)[is_word]
    spelled = per_slot[is_word] + (opened - classed)[opening] + np.log10(1 - model.joined) + np.maximum(finals[codes] - 1, 0) * np.log10(model.joined)
    word = np.log10(SHARE) + spelled
    common = frequent[codes]
    start = model.starts[model.of[stream[opening]]]
    part = np.log10(1 - SHARE) + opened[opening]  # of a rare word the join adds its share
    whole = part + np.minimum(np.where(frequent, np.log10(head[1][at] + ALPHA), 0.0)[codes] - start, 0.0)
    word[common] = np.logaddexp(word[common] * np.log(10), whole[common] * np.log(10)) / np.log(10)
    end_count = head[1][0] if len(head[0]) and head[0][0] == END_HASH else 0
    end_base = np.log10((end_count + ALPHA) / total)
    end_score = np.logaddexp((per_slot[last] + np.log10(SHARE)) * np.log(10), (end_base + np.log10(1 - SHARE)) * np.log(10)) / np.log(10)
    n = len(texts)
    out: dict[str, list] = {
        "n_tokens": (sizes + 1).tolist(), "head_known": (np.bincount(text[common], minlength=n) + int(end_count > 0)).tolist(),
        "head_score": (np.bincount(text, weights=base[codes], minlength=n) + end_base).tolist(),
        "score": (np.bincount(text[common], weights=word[common], minlength=n) + end_score).tolist(),
    }
    rare = np.flatnonzero(~common)
    cuts = np.searchsorted(text[rare], np.arange(n + 1))
    for name, values in (("rare", key[codes[rare]]), ("spelled", word[rare]), ("part", part[rare]), ("start", start[rare])):
        out[name] = [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def frequent_words(words: DataFrame, most: int = HEAD) -> DataFrame:
    """At most ``most`` words, the most frequent ones by steps of an eighth of a doubling, and the end.

    Only the counts per step reach the driver, some hundred rows at any size.
    """
    step = F.floor(8 * F.log2("n")).alias("step")
    sizes = sorted(words.groupBy(step).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"])
    least, held = None, 0
    for r in sizes:
        held += r["words"]
        if held >= most:
            break
        least = r["step"]
    enough = F.lit(False) if least is None else F.floor(8 * F.log2("n")) >= least
    return words.filter(enough | (F.col("key") == END_HASH))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, most_sent: int = HEAD) -> DataFrame:
    """Base and model scores of every document; training documents are those whose crc32 mod 10 is not 0."""
    path = vocabulary or tokens.vocabulary_path(VOCABULARY)
    end = end_id(path)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    training = base.filter(remainder(F.col("doc_id"), 10) != 0)
    counts = materialize(count_words(training, path, end), "counts")
    words = counts.filter("kind = 0 and n > 0").select("key", "n")
    n_all, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    total = n_all + ALPHA * (n_distinct + 1)
    head = frequent_words(words, most_sent).toArrow().to_pandas().sort_values("key", ignore_index=True)
    texts = words.filter(F.col("key") == END_HASH).head()
    model = train(training, counts.filter("kind > 0").toArrow().to_pandas(), n_all - (texts["n"] if texts else 0), texts["n"] if texts else 0, path)
    keys = head["key"].to_numpy(np.int64) if len(head) else np.array([-1])
    ns = head["n"].to_numpy(np.float64) if len(head) else np.array([0.0])
    sent = docs.sparkSession.sparkContext.broadcast((model, keys, ns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = word_numbers(path, end)
        shared, hashes, n = sent.value
        for batch in batches:
            column = batch["text"].tolist()
            for a, b in tokens.slices([t if isinstance(t, str) else "" for t in column]):
                yield batch[["doc_id"]].iloc[a:b].reset_index(drop=True).assign(**score_texts(column[a:b], memory, shared, (hashes, n), total))

    kind = dict(base.dtypes)["doc_id"]
    scored = base.mapInPandas(
        run, f"doc_id {kind}, n_tokens long, head_known long, head_score double, score double, rare array<long>, spelled array<double>, part array<double>, start array<double>"
    )
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "spelled", "part", "start")).alias("z")).select("row", "z.*")
    rare = rare.join(words, F.col("rare") == F.col("key"), "left")
    c = F.coalesce("n", F.lit(0))
    whole = F.col("part") + F.least(F.log10(c + ALPHA) - F.col("start"), F.lit(0.0))
    high, low = F.greatest("spelled", whole), F.least("spelled", whole)
    mixed = F.when(c > 0, high + F.log10(1 + F.pow(F.lit(10.0), low - high))).otherwise(F.col("spelled"))
    rest = rare.groupBy(F.col("row").alias("of")).agg(
        F.sum(F.log10((c + ALPHA) / total)).alias("rest"), F.count_if(c > 0).alias("rest_known"), F.sum(mixed).alias("rest_score")
    )
    return scored.join(rest, F.col("row") == F.col("of"), "left").select(
        "doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
    )

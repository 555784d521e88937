"""Text quality by a byte-level convolutional network, trained and applied in numpy.

The UTF-8 bytes of a whole document are read by filters of eight bytes at every second byte.  Chunks of
``POSITIONS`` filter positions overlap by the filter's reach and cover the document to its last byte; each
chunk is max-pooled per filter and passes a small hidden layer, and the mean over all chunks gives one
probability.  Training takes a bounded, documented number of labelled documents, chosen by the hash of
their ids; scoring is one narrow pass over all rows.

Defined results: a null or empty text is scored as a chunk of padding; repeated rows score alike; with
labels of one class only, every score is the smoothed share of label 1; an empty table gives an empty
result; only the text column feeds a score, whatever else the table holds.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, STRIDE, EMBEDDING, FILTERS, HIDDEN = 8, 2, 8, 16, 12
POSITIONS = 60
CHUNK_BYTES = STRIDE * (POSITIONS - 1) + WIDTH
SAMPLE_PER_CLASS = 1500
TRAIN_CHUNKS = 8
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 10, 250, 64, 0.006, 1e-4
BLOCK_POSITIONS = POSITIONS * 2000
ACCEPT = 0.7


@dataclass
class Network:
    """Weights; ``constant`` replaces the network where there was nothing to learn."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    @functools.cached_property
    def tables(self) -> list[np.ndarray]:
        """What each pair of bytes adds to every filter, for the four pairs under a filter."""
        w = self.weights
        parts = [w["embed"] @ w["filter"][j * EMBEDDING:(j + 1) * EMBEDDING] for j in range(WIDTH)]
        return [(parts[j][None, :, :] + parts[j + 1][:, None, :]).reshape(65536, FILTERS).astype(np.float32) for j in range(0, WIDTH, 2)]

    def pooled(self, text: bytes) -> np.ndarray:
        """Largest response of each filter in each chunk, block by block, so that long texts need no long arrays."""
        if len(text) < CHUNK_BYTES:
            text = text + bytes(CHUNK_BYTES - len(text))
        codes = np.frombuffer(text + bytes(len(text) % 2), dtype="<u2")
        n = len(codes) - WIDTH // 2 + 1
        out = []
        for a in range(0, n, BLOCK_POSITIONS):
            b = min(n, a + BLOCK_POSITIONS)
            if b - a < POSITIONS:
                a = b - POSITIONS  # the last chunk reaches back
            z = self.tables[0][codes[a:b]]
            for k in range(1, WIDTH // 2):
                z += self.tables[k][codes[a + k:b + k]]
            whole = (b - a) // POSITIONS * POSITIONS
            out.append(z[:whole].reshape(-1, POSITIONS, FILTERS).max(axis=1))
            if whole < b - a:
                out.append(z[-POSITIONS:].max(axis=0, keepdims=True))
        return np.concatenate(out)

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        w = self.weights
        h = np.tanh(np.maximum(self.pooled(text) + w["filter_bias"], 0) @ w["hidden"] + w["hidden_bias"])
        return float(1 / (1 + np.exp(-np.clip(h.mean(axis=0, dtype=np.float64) @ w["out"] + w["out_bias"][0], -30, 30))))


def sample_chunks(text: bytes, count: int = TRAIN_CHUNKS) -> bytes:
    """Chunks at even distances over the whole text, padded as scoring pads."""
    if len(text) < CHUNK_BYTES:
        text = text + bytes(CHUNK_BYTES - len(text))
    starts = np.linspace(0, len(text) - CHUNK_BYTES, count).astype(np.int64) // STRIDE * STRIDE
    return b"".join(text[s:s + CHUNK_BYTES] for s in starts)


def train(chunks: np.ndarray, labels: np.ndarray, seed: int = 7) -> Network:
    """Fit by Adam on (documents, chunks, bytes) with cross entropy, the classes weighted alike."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(np.unique(labels)) < 2:
        return Network(constant=float(share))
    rng = np.random.default_rng(seed)
    shapes = {
        "embed": (256, EMBEDDING), "filter": (WIDTH * EMBEDDING, FILTERS), "filter_bias": (FILTERS,),
        "hidden": (FILTERS, HIDDEN), "hidden_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,),
    }
    w = {k: (rng.normal(0, 0.5 if k == "embed" else 1 / np.sqrt(s[0]), s) * ("bias" not in k)).astype(np.float32) for k, s in shapes.items()}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    windows = STRIDE * np.arange(POSITIONS)[:, None] + np.arange(WIDTH)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    per_epoch = -(-len(labels) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    step, steps = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            rows = order[a:a + BATCH]
            n, c = len(rows), chunks.shape[1]
            bytes_ = chunks[rows].reshape(n * c, -1)
            at = bytes_[:, windows]
            x = w["embed"][at].reshape(n * c, POSITIONS, -1)
            z = x @ w["filter"] + w["filter_bias"]
            top = z.argmax(axis=1)
            a1 = np.maximum(np.take_along_axis(z, top[:, None, :], 1)[:, 0], 0)
            h = np.tanh(a1 @ w["hidden"] + w["hidden_bias"])
            doc = h.reshape(n, c, -1).mean(axis=1)
            p = 1 / (1 + np.exp(-(doc @ w["out"] + w["out_bias"][0])))
            d = ((p - labels[rows]) * weight[rows] / n).astype(np.float32)
            g = {"out": doc.T @ d, "out_bias": d.sum(keepdims=True)}
            dh = np.repeat(d[:, None] * w["out"] / c, c, axis=0) * (1 - h * h)
            g["hidden"], g["hidden_bias"] = a1.T @ dh, dh.sum(axis=0)
            da = dh @ w["hidden"].T * (a1 > 0)
            g["filter_bias"] = da.sum(axis=0)
            i = np.arange(n * c)[:, None]
            g["filter"] = np.einsum("nf,nfk->kf", da, x[i, top])
            de = (da[:, :, None] * w["filter"].T[None]).reshape(n * c, FILTERS, WIDTH, EMBEDDING)
            g["embed"] = np.zeros_like(w["embed"])
            np.add.at(g["embed"], at[i, top], de)
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps))
            for k, grad in g.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w[k] -= (rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * w[k])).astype(np.float32)
    return Network(w)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def _bytes(text: object) -> bytes:
    return text.encode() if isinstance(text, str) else b""


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Network:
    """Train on at most ``per_class`` documents of each label whose crc32 mod 4 is not 2.

    The ids come first, by the order of their hashes; only those documents are cut into chunks, and
    about a kilobyte of each reaches the driver.
    """
    pool = labels.select(F.col(id_col).alias("sample_id"), F.col(label_col).alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("sample_id").isNotNull() & (remainder(F.col("sample_id"), 4) != 2)
    )
    order = F.md5(F.concat(F.lit("sample:"), F.col("sample_id").cast("string")))
    chosen = pool.filter("label = 0").orderBy(order).limit(per_class).unionByName(pool.filter("label = 1").orderBy(order).limit(per_class))
    base = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "sample_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["sample_id"].astype(str), "label": batch["label"], "chunks": [sample_chunks(_bytes(t)) for t in batch["text"]]})

    rows = base.mapInPandas(cut, "key string, label int, chunks binary").limit(2 * per_class).toPandas()
    rows = rows.sort_values(["key", "label", "chunks"], ignore_index=True)
    data = np.frombuffer(b"".join(rows["chunks"]), dtype=np.uint8).reshape(len(rows), TRAIN_CHUNKS, CHUNK_BYTES)
    return train(data, rows["label"].to_numpy(np.float32))


def score_quality(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score of every document; ``keep`` names columns to carry along."""
    base = docs.select(F.col(id_col).alias("doc_id"), *[c for c in keep if c != "doc_id"], F.col(text_col).alias("_scored_text"))
    columns = [c for c in base.columns if c != "_scored_text"]
    weights = Network(network.weights, network.constant)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[columns].assign(score=[weights.score(_bytes(t)) for t in batch["_scored_text"]])

    kinds = dict(base.dtypes)
    return base.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "score double"]))


def keep_accepted(docs: DataFrame, network: Network, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows whose text scores at least ``accept``, with all of their columns."""
    weights = Network(network.weights, network.constant)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[np.array([weights.score(_bytes(t)) >= accept for t in batch[text_col]], dtype=bool)]

    return docs.mapInPandas(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Train on the labels and score all documents."""
    scored = score_quality(docs, fit(docs, labels))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= accept, 1).otherwise(0).alias("predicted")
    )

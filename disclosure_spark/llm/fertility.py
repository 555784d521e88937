"""Quality rules on tokeniser fertility, with rejection bands per language or script.

A public vocabulary with byte fallback measures how well a text fits written language: characters per
token, the share of tokens that stand for single bytes, and the entropy of tokens in windows of fixed
size.  Each language (the script, where no language is given) has a band per measure, taken from the
quartiles over all of its documents; a text outside any band is rejected.  Counts of words, marks, equal
lines and repeated three-word windows come along as the plain rules.

Defined results: null and empty texts have no words and fail the plain rules; repeated rows are judged
alike; a language with few documents has a band of its own as well, wider the fewer they are; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclosure_spark.llm import tokens
from disclosure_spark.session import broadcast_if_small, materialize

VOCABULARY = "piece_bpe_32k.model"
WINDOW = 128
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPREAD = 3.0  # quartile distances beyond the quartiles
LEAST_DOCUMENTS = 200
LEAST_WIDTH = {"chars_per_token": 0.05, "byte_share": 0.02, "entropy": 0.01}
MARKS = "#*$%&|<>"

# First and last code points of common scripts.
SCRIPTS = {"cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽ", "arabic": "؀-ۿ", "hebrew": "֐-׿", "devanagari": "ऀ-ॿ", "hangul": "가-힣", "kana": "぀-ヿ", "han": "一-鿿"}
_SCRIPT = {name: re.compile(f"[{span}]") for name, span in SCRIPTS.items()}

MEASURES = ("chars_per_token", "byte_share", "entropy")
_COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_tokens": "long",
    "chars_per_token": "double", "byte_share": "double", "entropy": "double", "script": "string",
}


class PieceIds:
    """Ids of distinct words by a sentencepiece vocabulary, two generations of them remembered."""

    def __init__(self, path: str, limit: int = tokens.REMEMBERED):
        import sentencepiece

        self.model, self.limit = sentencepiece.SentencePieceProcessor(model_file=path), limit
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, distinct: set[str]) -> dict[str, bytes]:
        """A memory that holds every given word."""
        if len(self.young) > self.limit // 2:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for word in distinct - young.keys():
            if word in old:
                young[word] = old[word]
            else:
                new.append(word)
        for i in range(0, len(new), 10_000):
            part = new[i:i + 10_000]
            for word, ids in zip(part, self.model.encode(part, num_threads=1), strict=True):
                young[word] = array("I", ids).tobytes()
        return young


@functools.cache
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


def repeated_words(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks words inside a three-word window that its document holds at least twice."""
    n = len(codes)
    hit = np.zeros(n, dtype=bool)
    at = np.flatnonzero(doc[2:] == doc[:-2]) if n > 2 else np.empty(0, dtype=np.int64)
    if not len(at):
        return hit
    key = codes.astype(np.int64)
    width = int(key.max()) + 1
    pair = key[:-1] * width + key[1:]
    if width >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * width + key[2:]
    order = at[np.lexsort((triple[at], doc[at]))]
    same = (triple[order[1:]] == triple[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(3):
        hit[twice + k] = True
    return hit


def window_entropy(ids: np.ndarray, window: int = WINDOW) -> float:
    """Mean entropy of token windows as a share of the largest possible; the last window reaches back from the end, so every token counts."""
    if len(ids) < 2:
        return 0.0
    rows = ids[: len(ids) // window * window].reshape(-1, window) if len(ids) >= window else ids[None, :]
    if len(ids) > window and len(ids) % window:
        rows = np.concatenate((rows, ids[None, -window:]))
    rows = np.sort(rows, axis=1)
    n = rows.shape[1]
    start = np.ones(rows.shape, dtype=bool)
    start[:, 1:] = rows[:, 1:] != rows[:, :-1]
    first = np.flatnonzero(start.ravel())
    runs = np.diff(first, append=rows.size)
    return float(1 - (runs * np.log2(runs)).sum() / (rows.size * np.log2(n)))


def script_of(text: str) -> str:
    """Script with most letters among the known ones; Latin if none occurs."""
    if text.isascii():
        return "latin"
    counts = {name: len(p.findall(text)) for name, p in _SCRIPT.items()}
    name = max(counts, key=counts.get)
    return name if 2 * counts[name] > sum(map(str.isalpha, text)) else "latin"


def measure_texts(texts: list[str], memory: PieceIds) -> dict[str, list]:
    """All columns for a run of whole texts."""
    split = [tokens.words(t) for t in texts]
    distinct = set().union(*split)
    known = memory.learn(distinct)
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    sizes = np.array([len(w) for w in split])
    codes = np.fromiter((number[w] for ws in split for w in ws), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    repeats = np.bincount(doc[repeated_words(codes, doc)], minlength=len(texts))
    out: dict[str, list] = {c: [] for c in _COLUMNS}
    for text, words, n_repeat in zip(texts, split, repeats.tolist(), strict=True):
        lines = [x for x in text.split("\n") if tokens.words(x)]
        ids = np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4")
        chars, n = sum(map(len, words)), len(ids)
        for column, value in zip(_COLUMNS, (
            len(words), chars, sum(map(text.count, MARKS)), len(lines) - len(set(lines)), n_repeat, n,
            chars / n if n else 0.0, float(memory.is_byte[ids].mean()) if n else 0.0, window_entropy(ids), script_of(text),
        ), strict=True):
            out[column].append(value)
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary: str | None = None) -> DataFrame:
    """One row of measures per document.  A narrow pass."""
    path = vocabulary or tokens.vocabulary_path(VOCABULARY)
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = piece_ids(path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in tokens.slices(texts):
                out = batch[["doc_id", "lang"]].iloc[a:b].reset_index(drop=True)
                yield out.assign(**measure_texts(texts[a:b], memory))

    kind = dict(base.dtypes)["doc_id"]
    return base.mapInPandas(run, ", ".join([f"doc_id {kind}", "lang string", *[f"{c} {k}" for c, k in _COLUMNS.items()]]))


def bands(measured: DataFrame, group_col: str = "band", spread: float = SPREAD) -> DataFrame:
    """Lower and upper limit of each measure per group, from its own documents alone.

    Below ``LEAST_DOCUMENTS`` the spread grows with the root of what is missing, as the error of quartiles does.
    """
    limits = []
    wide = F.lit(spread) * F.sqrt(F.greatest(F.lit(1.0), F.lit(LEAST_DOCUMENTS) / F.count("*")))
    for m in MEASURES:
        q = F.percentile_approx(m, [0.25, 0.5, 0.75], 2000)
        width = F.greatest(q[2] - q[0], F.lit(LEAST_WIDTH[m]))
        limits += [(q[0] - wide * width).alias(f"{m}_low"), (q[2] + wide * width).alias(f"{m}_high")]
    worded = measured.filter("n_tokens > 0")
    return worded.groupBy(group_col).agg(F.count("*").alias("documents"), *limits)


def apply_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, spread: float = SPREAD, **options) -> DataFrame:
    """Measures, plain verdict ``base_failed`` and final verdict ``kept`` of every document."""
    measured = measure(docs, **options)
    measured = measured.withColumn("band", F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.concat(F.lit("script "), F.col("script"))))
    measured = materialize(measured, "fertility")
    limits = materialize(bands(measured, spread=spread), "bands")
    names = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    judged = measured.join(broadcast_if_small(limits.select("band", *names)), "band", "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(True))).alias("kept"), "band", "n_tokens", *MEASURES,
    )

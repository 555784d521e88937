"""Words and sub-word ids of whole texts, with the ids of each distinct word remembered per worker.

Public vocabularies never merge across white space, so the ids of a text are those of its words in order.
"""

from __future__ import annotations

import functools
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

WORD_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
REMEMBERED = 600_000


def words(text: str) -> list[str]:
    """Runs of characters other than space and the controls 9 to 13."""
    if _OTHER_SPACE.search(text):
        return [w for w in WORD_SPACE.split(text) if w]
    return text.split()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: Iterable[str | None], max_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts of about ``max_chars`` characters, so that working arrays stay small."""
    first = size = i = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > max_chars:
            yield first, i
            first, size = i, 0
        size += len(text or "") + 1
    if size:
        yield first, i + 1


class WordIds:
    """Ids of distinct words of the lower-casing word vocabulary, as packed little-endian unsigned 32-bit integers.

    A word of Latin letters, digits and ASCII marks is cut into letter runs, single digits and runs of marks,
    and each run goes through the merges of the vocabulary's own ranks.  Any other word goes through the whole
    tokenizer.  Two generations of words are remembered: a word that comes back moves to the younger one, and
    the older one is dropped when the younger is full.
    """

    PLAIN = re.compile(r"[!-&(-;=?-~À-ÖØ-öø-ÿ]+")  # neither the apostrophe nor the brackets of special tokens
    RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    END = b"\xff"  # stands for the end of a word; UTF-8 text never holds it
    MARK = "\x01"  # the same among words in one string; no plain word holds it
    RUNS_OF_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 ]+")

    def __init__(self, path: str, limit: int = REMEMBERED):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=self._ranks(self.END), special_tokens={})._encode_single_piece

    def _ranks(self, end: bytes) -> dict[bytes, int]:
        """Ids of the vocabulary's tokens as bytes, ``end`` closing those that end a word."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # byte-level vocabularies show the others as 256 and up
        value = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if i not in special:
                core = token.removesuffix("</w>")
                ranks[bytes(value[c] for c in core) + (end if core != token else b"")] = i
        return ranks

    @functools.cached_property
    def merges(self) -> tuple[object, int]:
        """The merges for many words in one string, each run closed by ``MARK``, and the id of the space between them."""
        import tiktoken

        ranks = self._ranks(self.MARK.encode())
        space = max(ranks.values()) + 1
        ranks[b" "] = space
        return tiktoken.Encoding("runs", pat_str="[^ \x01]+\x01| ", mergeable_ranks=ranks, special_tokens={}), space

    def _ids(self, word: str) -> bytes:
        if not self.PLAIN.fullmatch(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        if low.isalpha():
            return array("I", self.merge(low.encode() + self.END)).tobytes()
        return array("I", [i for run in self.RUNS.findall(low) for i in self.merge(run.encode() + self.END)]).tobytes()

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other and how many each has, remembering none; plain words go through the merges together."""
        plain = np.fromiter((self.PLAIN.fullmatch(w) is not None for w in words), dtype=bool, count=len(words))
        text = " ".join(itertools.compress(words, plain)).lower()
        merges, space = self.merges
        found = merges.encode_to_numpy(self.RUNS_OF_WORDS.sub("\\g<0>" + self.MARK, text) + " ", disallowed_special=())
        closes = np.flatnonzero(found == space)[:int(plain.sum())]
        others = [self._ids(w) for w in itertools.compress(words, ~plain)]
        size = np.empty(len(words), dtype=np.int64)
        size[plain] = np.diff(closes, prepend=-1) - 1
        size[~plain] = [len(p) // 4 for p in others]
        out = np.empty(int(size.sum()), dtype="<u4")
        of_plain = np.repeat(plain, size)
        out[of_plain] = found[found != space]
        out[~of_plain] = np.frombuffer(b"".join(others), dtype="<u4")
        return out, size

    def learn(self, distinct: set[str]) -> dict[str, bytes]:
        """A memory that holds every given word."""
        if len(self.young) > self.limit // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        for word in distinct - young.keys():
            young[word] = old.get(word) or self._ids(word)
        return young


@functools.cache
def word_ids(path: str) -> WordIds:
    """One memory per vocabulary and worker process."""
    return WordIds(path)

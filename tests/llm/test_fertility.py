"""Entropy over whole texts, and bands of small groups."""

import random

import numpy as np
import pytest

from disclosure_spark.llm import fertility


def test_every_token_counts_for_entropy():
    clean, repeated = np.arange(128), np.zeros(120, dtype=np.int64)
    assert fertility.window_entropy(clean) == pytest.approx(1)
    assert fertility.window_entropy(np.concatenate((clean, repeated))) < 0.6
    assert fertility.window_entropy(np.concatenate((clean, clean[:1]))) == pytest.approx(1)


def test_a_rare_language_has_a_band_of_its_own(spark):
    r = random.Random(7)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 8)))
    common = ["the", "of", "and", "house", "water", "people", "which", "through", "first", "other", "number", "there", "about", "would"]
    data = [(i, " ".join(r.choice(common) for _ in range(150)), "en") for i in range(300)]
    data += [(1000 + i, " ".join(word("абвгдежзиклмнопрст") for _ in range(150)), "xx") for i in range(12)]
    got = {x.doc_id: x for x in fertility.apply_rules(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[1000 + i].kept for i in range(12))

"""Suffix, chunk and shingle operators against brute force, with the edge cases of their docstrings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from disclosure_spark.llm import chunk_dedup, set_join, suffix_dedup

from ..conftest import rows
from .reference import jaccard_components, jaccard_links, repeated_strings

SCHEMA = "doc_id long, text string"


def strings():
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(2500))
    texts = [
        base, base[:500] + "X" + base[500:], None, "", "a" * 600, "ab" * 400, base[100:199], base[100:200], base[100:201],
        "q" * 99 + "é" * 60, "q" * 99 + "é" * 60 + "tail", base + base, "Und " * 300, "zz" + "Und " * 200,
    ]
    line = base[1000:1060]  # stands in many texts, too short to be removed
    texts += [f"{r.random()} " * 3 + line + f" {r.random()} " * 4 for _ in range(120)]
    texts += [f"{i % 3}" * 40 + base[500:620] + f"{r.random()}" * 3 for i in range(60)]
    return list(enumerate(texts))


def test_repeated_strings_equal_brute_force(spark):
    data = strings()
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = suffix_dedup.removal_summary(suffix_dedup.remove_repeated_strings(frame))
    assert rows(got) == sorted(repeated_strings(data), key=repr)


def test_versions_of_one_id_and_other_columns(spark):
    data = [(1, "x" * 40 + "abc" * 50, "p"), (1, "x" * 40 + "abc" * 50, "p"), (1, "other " * 40, "q"), (None, None, "r")]
    frame = spark.createDataFrame(data, "doc_id long, text string, version string")
    got = suffix_dedup.removal_summary(suffix_dedup.remove_repeated_strings(frame))
    assert got.count() == 4 and got.filter("doc_id is null").head().n_bytes == 0
    assert rows(got.filter("n_bytes = 190"))[0] == rows(got.filter("n_bytes = 190"))[1]


@pytest.mark.parametrize("run", [
    lambda d: suffix_dedup.remove_repeated_strings(d), lambda d: chunk_dedup.remove_repeated_passages(d), lambda d: set_join.similar_groups(d),
])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_resist_shifts_and_short_phrases_stay(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, phrase = text(80), text(5)
    data = [(1, text(50) + " " + passage + " " + text(50)), (2, text(33) + "é! " + passage + " " + text(20)), (3, text(60) + phrase), (4, phrase + text(60)), (5, None)]
    got = {d.doc_id: d for d in chunk_dedup.remove_repeated_passages(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[1].n_removed == got[3].n_removed == got[4].n_removed == 0 and got[5].text == ""
    assert 0.6 * len(passage) < got[2].n_removed <= len(passage)
    again = chunk_dedup.rewrite_documents(spark.createDataFrame(data, SCHEMA).withColumn("starts", F.lit("own")))
    assert again.columns == ["doc_id", "text", "starts"]
    assert {d.doc_id: d.text for d in again.collect()} == {i: d.text for i, d in got.items()}


def test_passages_are_removed_to_their_ends(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [text(50) for _ in range(40)]
    data = [(i, f"{text(30)} {p} {text(30)}") for i, p in enumerate(passages)]
    data += [(100 + i, f"{text(20)} 0 {p} 1 {text(20)}") for i, p in enumerate(passages)]
    got = {d.doc_id: d for d in chunk_dedup.remove_repeated_passages(spark.createDataFrame(data, SCHEMA)).collect()}
    whole = [got[100 + i].n_removed == len(p) and p not in got[100 + i].text for i, p in enumerate(passages)]
    assert sum(whole) >= 38  # before: none to its ends


def shingled():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    out = [" ".join(text(r.choice([1, 2, 3, 4, 5, 9, 10, 15, 40, 100]))) for _ in range(40)]
    for base in [text(n) for n in (6, 9, 10, 14, 20, 60, 150)]:
        for _ in range(25):
            b = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                k = r.randrange(len(b))
                b[k:k + 1] = r.choice([[r.choice(vocabulary)], [b[k], r.choice(vocabulary)], []]) if len(b) > 1 else b[k:k + 1]
            out.append(" ".join(b))
    b = text(100)
    for _ in range(40):  # a chain that drifts
        b = list(b)
        b[r.randrange(len(b))] = r.choice(vocabulary)
        out.append(" ".join(b))
    for _ in range(30):  # one template, bodies that differ, each body twice
        c = text(90)
        c[:75] = b[:75]
        out += [" ".join(c), " ".join(c[:-1] + ["zz"])]
    data = list(enumerate([*out, None, "", "  \n", "A b", "a B"]))
    r.shuffle(data)
    return data


@pytest.mark.parametrize(("words", "percent", "counted"), [(4, 85, True), (5, 80, False)])
def test_components_equal_brute_force(spark, words, percent, counted):
    data = shingled()
    frame = spark.createDataFrame(data, SCHEMA).withColumn("class", F.lit("own")).repartition(3)
    got = set_join.similar_groups(frame, words, percent, counted=counted).select("doc_id", "n_shingles", "component_id")
    assert rows(got) == sorted(jaccard_components(data, words, percent), key=repr)


@pytest.mark.parametrize("block", [1500, 40])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(set_join, "SPOKE_BLOCK", block)
    r = random.Random(6)
    base = [f"t{i}" for i in range(160)]
    near = []
    for i in range(150):  # one template; each text has a word of its own, most also one that others share
        b = list(base)
        b[r.randrange(160)] = f"own{i}"
        b[r.randrange(160)] = f"some{i % 7}"
        b += [f"end{i % 5}"] * (i % 3)
        near.append((10_000 + i, " ".join(b)))
    data = shingled() + near
    got = set_join.similar_groups(spark.createDataFrame(data, SCHEMA).repartition(3)).select("doc_id", "n_links")
    assert rows(got) == sorted(jaccard_links(data), key=repr)


def test_one_of_each_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    data = [(4, a), (2, a + " end"), (2, a + " end"), (7, b), (8, None), (9, "")]
    kept = set_join.keep_one_each(spark.createDataFrame(data, SCHEMA).withColumn("row", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8, 9] and kept.columns == ["doc_id", "text", "row"]


@pytest.mark.parametrize(("percent", "first"), [(85, 6), (80, 4)])
def test_allocation_covers_every_band(percent, first):
    for band in range(12):
        low, high = set_join.bands(percent)[band], set_join.bands(percent)[band + 1] - 1
        most = (100 - percent) * (high + 100 * high // percent) // (100 + percent)
        segments, deletions, empty, costly = set_join.allocate(band, percent)
        assert segments + deletions - empty - costly >= most + 1 and low >= first


@pytest.mark.parametrize("percent", [85, 80])
def test_linked_sets_share_as_many_signatures_as_told(percent):
    r = np.random.default_rng(4)
    edges, told = set_join.bands(percent), []
    sizes = sorted({n + d for n in edges[2:11] for d in (-1, 0, 1, 7)} - {0})
    for size in sizes * 3:
        x = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        apart = 2 * (100 - percent) * size // (100 + percent)
        out = int(r.integers(0, apart + 1))
        y = np.unique(np.concatenate((x[out:], r.integers(0, 1 << 63, apart - out, dtype=np.uint64))))
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        signature, of, band, shared = set_join.signatures([x, y], percent)
        enough = []
        for b in set(band.tolist()):
            one, two = ((of == i) & (band == b) for i in range(2))
            if one.any() and two.any():
                enough.append(len(np.intersect1d(signature[one], signature[two])) - max(shared[one].max(), shared[two].max()))
        told.append(max(enough) if enough else -1 if size >= edges[1] else 0)
    assert len(told) > 50 and min(told) >= 0


def test_texts_with_little_in_common_are_no_candidates(spark, monkeypatch):
    """Of 120 unrelated texts some segments are empty in many, and all have a phrase in common."""
    r = random.Random(8)
    low = next(n for n in set_join.bands() if n > 500)
    phrase = [f"all{i}" for i in range(6)]
    texts = [phrase + [f"w{r.randrange(10**9)}" for _ in range(low - 2)] for _ in range(120)]
    texts += [[*texts[0][:-1], "end"], [*texts[1][:-2], "end"]]
    moved, with_texts = [], set_join._with_texts

    def spy(work, texts, percent):
        moved.append(work.count())
        return with_texts(work, texts, percent)

    monkeypatch.setattr(set_join, "_with_texts", spy)
    got = set_join.similar_groups(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA).repartition(2))
    assert sorted(r.doc_id for r in got.collect() if r.component_id != r.doc_id) == [120, 121] and sum(moved) < 10


def family(r, texts, size=300, changed=(22, 45)):
    """Texts of one template, each with words of its own at drawn places, so that some pairs are linked and most are not."""
    base = [f"f{i}" for i in range(size)]
    out = []
    for i in range(texts):
        at = r.sample(range(size), r.randint(*changed) // 4)
        out.append(" ".join(f"x{i}y{k}" if k in at else w for k, w in enumerate(base)))
    return out


@pytest.mark.parametrize("counted", [True, False])
@pytest.mark.parametrize("block", [2000, 25])
def test_a_family_near_the_threshold_leaves_few_candidates(spark, monkeypatch, block, counted):
    """Five times as many texts of a template leave no more candidates per text than a bound, and every link counts."""
    monkeypatch.setattr(set_join, "GROUP_BLOCK", block)
    monkeypatch.setattr(set_join, "SPOKE_BLOCK", block)
    data = list(enumerate(family(random.Random(2), 100)))
    moved, with_texts = [], set_join._with_texts

    def spy(work, texts, percent):
        moved.append(work.count())
        return with_texts(work, texts, percent)

    monkeypatch.setattr(set_join, "_with_texts", spy)
    got = set_join.similar_groups(spark.createDataFrame(data, SCHEMA).repartition(2), counted=counted)
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == sorted(jaccard_components(data, 4, 85), key=repr)
    if counted:
        assert rows(got.select("doc_id", "n_links")) == sorted(jaccard_links(data), key=repr)
    assert len(moved) == 1


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(3)
    for size in (3, 40, 600, 5000):
        x = r.integers(0, 1 << 63, size, dtype=np.uint64)
        for out in (0, 1, size // 10, size // 2, size):
            y = np.concatenate((x[out:], r.integers(0, 1 << 63, out + size // 20, dtype=np.uint64)))
            apart = set_join._folded([set_join.sketch(x), set_join.sketch(y)], min(len(set_join.sketch(x)), len(set_join.sketch(y))))
            differ = int(np.bitwise_count(apart[0] ^ apart[1]).sum())
            assert differ <= len(np.setxor1d(x, y)) and (out < size or differ > 0)


def test_a_cover_holds_every_pair():
    r = np.random.default_rng(5)
    for share in (0.02, 0.3, 0.9, 1.0):
        near = np.triu(r.random((60, 60)) < share, 1)
        near |= near.T
        hub, spoke, star = set_join._cover(near.copy())
        held = np.zeros_like(near)
        held[hub, spoke] = held[spoke, hub] = True
        assert (near | ~held).all()  # nothing but near pairs
        for h in np.unique(hub[star]):
            of = spoke[star & (hub == h)]
            held[np.ix_(of, of)] = True
        assert (held | ~near).all() and (share < 1 or len(hub) == 59)

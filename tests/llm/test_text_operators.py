"""Packing, pages, scoring, rules, decontamination and archives on small inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from disclosure_spark.llm import attention_lm, byte_cnn, fertility, html_extract, packing, tokens, warc, winnowing

from ..conftest import rows
from .reference import text_rules, unigram_scores

SCHEMA = "doc_id long, text string"
ODD = ["Foo's it's 's", "a\x1cb\x85c\xa0d", "İstanbul ΟΔΟΣ ΣΑΣ é é", "", None, "日本 語😀 x1y22", "geßau größe", "<|endoftext|>", "the " * 3000]


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path(packing.VOCABULARY)
    whole, memory = Tokenizer.from_file(path), tokens.WordIds(path, limit=4)
    for text in [t or "" for t in ODD]:
        words = tokens.words(text)
        known = memory.learn(set(words))
        got = np.frombuffer(b"".join(known[w] for w in words), dtype="<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless_and_tight(spark):
    r = random.Random(1)
    data = [(i, " ".join(r.choice(["the", "and", "xyzzy"]) for _ in range(r.choice([0, 5, 300, 900, 3000])))) for i in range(150)]
    data += [(None, None), (3, "again"), (3, "again")]
    frame = spark.createDataFrame(data, SCHEMA)
    got = packing.pack_documents(frame).toPandas()
    assert len(got[got["piece"] == 0]) == len(data) and got["length"].max() == 2048
    total = 0
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_["offset"].tolist() == [0, *bin_["length"].cumsum().tolist()[:-1]]
        assert bin_["length"].sum() <= 2048
        total += 1
    bins: list[int] = []  # best fit, longest first
    for size in sorted(got["length"], reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= size]
        at = min(fits, key=bins.__getitem__) if fits else len(bins)
        bins[at:at + 1] = [(bins[at] if fits else 2048) - size]
    assert total <= len(bins) + 1
    closing = got[got["doc_id"].isna()].iloc[0]
    assert closing["length"] == 1 and closing["ids_crc32"] == zlib.crc32(b"\0" * 4)
    sequences = packing.packed_sequences(frame.limit(40))
    assert sequences.select(F.max(F.length("ids"))).head()[0] <= 4 * 2048


def test_sum_of_squares_takes_the_gap_of_the_smallest_sum():
    bins, offsets = packing.sum_of_squares(np.array([6, 6, 5, 4, 4]), 10)
    assert bins.tolist()[:2] == [0, 1] and sorted(offsets.tolist()) == [0, 0, 0, 6, 6]  # each 4 takes a gap of 4: -3, then -1, against 0 for the gap of 5


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Site name</header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and you accept it.</div>
<article><header><h1>Head &amp; title</h1></header><p>First  paragraph<br>of the
text.<p>Of.<div class="ad">Buy it now for less than you have ever paid.</div><p class=x>zzz qqq &eacute;<script>var t="</p>"</script></p>
<footer>by someone</footer></article><section id="comments"><p>I think that this is the best of all the things I have read.</p></section>
<aside>About us</aside><footer>&copy; all</footer>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE) == "Head & title\nFirst paragraph of the text.\nOf.\nzzz qqq é"
    for empty in (None, "", "<!-- open", "<script>x"):
        assert html_extract.main_text(empty) == ""


def test_ambiguous_blocks_follow_their_neighbours():
    long = "It was the best of times and it was the worst of times, and we had all of it before us and none of it behind. " * 3
    page = f"<div><a href=x>menu of links</a></div><div>Short one</div><div>{long}</div><div>Between</div><div>{long}</div>"
    assert html_extract.main_text(page).split("\n")[-2] == "Between"
    assert "menu" not in html_extract.main_text(page)


def test_pages_keep_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    assert sorted(r.n_chars for r in html_extract.extract_main_text(frame).collect()) == [0, 55, 55]


def test_base_scores_are_exact_and_the_model_reads_context(spark):
    r = random.Random(2)
    data = [(i, " ".join(r.choice(["alpha beta", "gamma delta"][i % 2].split()) + r.choice(["", ","]) for _ in range(60))) for i in range(150)]
    data += [(1000, None), (1001, ""), (1002, "Alpha unseenword ÉÉ"), (1003, "alpha " * 400)]
    got = attention_lm.score_documents(spark.createDataFrame(data, SCHEMA).withColumn("score", F.lit(0))).collect()
    expected = unigram_scores(data)
    for row in got:
        n, known, training, base = expected[row.doc_id]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n, known, training)
        assert row.base_score == pytest.approx(base)
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 10 == 0) and row.score < 0
    held = [row for row in got if row.held_out and row.n_tokens > 50]
    assert sum(row.score for row in held) > sum(row.base_score for row in held)


def test_scores_do_not_depend_on_the_words_sent(spark):
    r = random.Random(3)
    data = [(i, " ".join(r.choice(["alpha", "beta", "gamma", f"rare{r.randrange(60)}", f"w{i}"]) for _ in range(40))) for i in range(80)]
    frame = spark.createDataFrame(data, SCHEMA)
    few, all_ = ({x.doc_id: x for x in attention_lm.score_documents(frame, most_sent=n).collect()} for n in (1, 1 << 19))
    for i, _ in data:
        assert few[i].score == pytest.approx(all_[i].score, rel=1e-6) and few[i].base_score == pytest.approx(all_[i].base_score)
        assert few[i].n_known == all_[i].n_known


def test_classes_and_weights_learn_from_every_training_text(spark):
    path, end = tokens.vocabulary_path(attention_lm.VOCABULARY), 5
    data = [(i, " ".join(["red", "green", "blue"][(i + k) % 3] for k in range(2500))) for i in range(6)]
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    column = attention_lm.context_columns(np.zeros(60_000, dtype=np.int64))
    got = attention_lm.contexts_and_windows(frame, path, end, column, 16).toPandas()
    memory = tokens.word_ids(path)
    n = sum(len(v) // 4 for _, t in data for w in t.split() for v in [memory.learn({w})[w]])
    assert got["n"].sum() == 2 * (n + len(data))  # all neighbours on both sides, beyond the first 1,024 ids of a text as well
    assert abs(got["window"].notna().sum() - n / 16) <= 4 * len(data)


@pytest.mark.parametrize("texts", [1, 40])
def test_training_windows_hold_every_id_at_every_size(spark, texts):
    path = tokens.vocabulary_path(attention_lm.VOCABULARY)
    end, memory = attention_lm.end_id(path), tokens.word_ids(path)
    data = [(i, " ".join(f"w{i}x{k}" for k in range(50 * i))) for i in range(texts)] + [(texts, "tiny text"), (texts + 1, None)]
    column = attention_lm.context_columns(np.zeros(60_000, dtype=np.int64))
    got = attention_lm.contexts_and_windows(spark.createDataFrame(data, SCHEMA).repartition(2), path, end, column).filter("window is not null").toPandas()
    rows = [np.frombuffer(w, dtype="<u4").tolist() for w in got["window"]]
    assert {len(r) for r in rows} == {attention_lm.WINDOW + 1} and got["round"].between(0, attention_lm.ROUNDS - 1).all()
    asked = {(a, b) for r in rows for a, b in zip(r[:-1], r[1:], strict=True)}
    n = 0
    for _, text in data:
        ids = [end, *(i for w in (text or "").split() for i in np.frombuffer(memory.learn({w})[w], dtype="<u4").tolist()), end]
        assert asked >= set(zip(ids[:-1], ids[1:], strict=True))
        n += max(1, -(-(len(ids) - 1) // attention_lm.WINDOW))
    assert len(rows) == n  # one after the other, whatever the number of ids


def test_word_numbers_give_the_ids_of_words():
    path = tokens.vocabulary_path(attention_lm.VOCABULARY)
    words = ["Alpha", "a\x01b", "\x01", "Ünï12cöde!?", "don't", "[UNK]", "<s>", "日本語", "x\x00y", "ÿß÷×", "a\xa0b", "12345", "q" * 300, "\xff", "--a--"]
    memory, ids = attention_lm.WordNumbers(path, 7, limit=4), tokens.word_ids(path)
    for part in (words[:3], words[3:], words, words[::-1], []):
        spelled, size = memory.spelled(memory.numbers([[*part, ""]]))
        expected = [np.frombuffer(ids.learn({w})[w], dtype="<u4").tolist() for w in part] + [[7]]
        assert [x.tolist() for x in np.split(spelled, np.cumsum(size)[:-1])] == expected
    codes = memory.numbers([words])
    assert memory.hash[codes].tolist() == [attention_lm.word_hash(w) for w in words]


@pytest.mark.parametrize("windows", [1, 10, 23])
def test_products_in_blocks_give_the_gradient(windows):
    rng, m = np.random.default_rng(windows), attention_lm
    z, w = rng.normal(size=(windows * m.WINDOW, m.WIDTH)).astype(np.float32), rng.normal(size=(m.WIDTH, m.CLASSES)).astype(np.float32)
    assert np.allclose(m.product(z, w, m.WINDOW), z @ w, atol=1e-4) and np.allclose(m.summed(z, z), z.T @ z, atol=1e-3)
    assert m.BLOCK * m.WINDOW * m.WIDTH * m.CLASSES <= 1 << 18  # one thread in BLAS
    shapes = {"embed": (m.CLASSES, m.WIDTH), "place": (m.WINDOW, m.WIDTH), **dict.fromkeys(("query", "key", "value", "mix"), (m.WIDTH, m.WIDTH)), "out": (m.WIDTH, m.CLASSES), "bias": (m.CLASSES,)}
    weights = {n: rng.normal(0, 0.3, s) for n, s in shapes.items()}
    rows = rng.integers(0, m.CLASSES, (windows, m.WINDOW + 1))

    def loss(w):
        e = w["embed"][rows[:, :-1]] + w["place"]
        s = np.einsum("bik,bjk->bij", e @ w["query"], e @ w["key"]) / m.WIDTH**0.5
        p = np.exp(s) * np.tril(np.ones((m.WINDOW, m.WINDOW)))
        logits = (e + p / p.sum(axis=2, keepdims=True) @ (e @ w["value"]) @ w["mix"]) @ w["out"] + w["bias"]
        logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
        return -np.take_along_axis(logits, rows[:, 1:, None], 2).mean()

    ids = np.zeros(1, dtype=np.int64)
    got = m.Attention(ids, ids, ids, ids, ids, 0, 0.0, {n: x.astype(np.float32) for n, x in weights.items()}).gradients(rows)
    for name, x in weights.items():
        way = rng.normal(size=x.shape)
        up, down = (loss(weights | {name: x + step * way}) for step in (1e-4, -1e-4))
        assert (up - down) / 2e-4 == pytest.approx(float((got[name] * way).sum()), rel=1e-3, abs=1e-5)


def test_classifier_separates_held_out_texts(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randint(2, 8)))
    data, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        data.append((i, " ".join(word() + ("" if good else r.choice(["$$$", "###"])) for _ in range(r.randint(30, 300)))))
        labels.append((i, int(good)))
    data += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(data, SCHEMA).withColumn("quality", F.lit(1))
    got = byte_cnn.classify_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    held = [x for x in got.collect() if x.held_out and x.doc_id < 400]
    assert np.mean([x.predicted == int(x.doc_id % 3 > 0) for x in held]) > 0.9
    assert got.count() == len(data)
    one = byte_cnn.classify_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert {round(x.score, 3) for x in one.collect()} == {round(2 / 3, 3)}


def test_rule_counts_equal_brute_force(spark):
    texts = [*ODD, "a b c a b c\na b\n\na b\n x", "# * $ % & | < >", "the cat sat on the mat " * 20, "u v w x y z"]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id: r for r in fertility.apply_rules(frame).collect()}
    for i, text in enumerate(texts):
        expected = text_rules(text)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert got[i].base_failed == failed and not (failed and got[i].kept)


def test_decontamination_of_short_and_long_items(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = [(10, item), (9, "Tiny Item"), (8, None), (7, "..."), (9, "Tiny Item")]
    docs = [(1, "start " + item.upper() + " end"), (2, "a tiny, ITEM!"), (3, " ".join(f"w{i}" for i in range(12))), (4, None), (5, " ".join(f"w{i}" for i in range(13))), (5, "x")]
    judged = winnowing.decontaminate(
        spark.createDataFrame(docs, SCHEMA).withColumn("item", F.lit(1)), spark.createDataFrame(bench, "item_id long, text string")
    )
    got = rows(judged.select("doc_id", "n_words", "n_hit", F.array_join("items", ",").alias("i"), "contaminated"))
    assert got == sorted([(1, 22, 20, "10", True), (2, 3, 2, "9", True), (3, 12, 0, "", False), (4, 0, 0, "", False), (5, 13, 13, "10", True), (5, 1, 0, "", False)], key=repr)
    none = winnowing.decontaminate(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("contaminated").count() == 0 and none.count() == 6
    kept = winnowing.keep_clean(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_archive_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 90
    data = [(1, "http://a/b?c#d", big), (5, "http://a/", big), (3, None, big), (4, "http://x\r\ny/", "small"), (6, "http://z/", "small"), (7, "u", None), (5, "http://a/", big)]
    frame = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    path = str(tmp_path / "warc")
    warc.write_archives(frame, path)
    captures = warc.assemble_captures(warc.read_records(spark, path))
    got = rows(warc.capture_summary(captures).select("page_id", "payload_bytes", "record_type", "refers_to"))
    n = len(big.encode())
    assert got == sorted([(1, n, "revisit", 5), (5, n, "response", None), (5, n, "response", None), (3, n, "revisit", 5), (4, 5, "response", None), (6, 5, "response", None), (7, 0, "response", None)], key=repr)
    stored = captures.filter("record_type = 'response' and payload_bytes > 1000").head()
    assert bytes(stored.response.payload).decode() == big and stored.request.http_header.startswith("GET / HTTP/1.1")


@pytest.mark.parametrize("tag", ["article", "div"])
def test_paragraphs_stay_whatever_their_words_and_wrapper(tag):
    prose = "It was the best of times and it was the worst of times, and we had all of it before us and none of it behind. " * 2
    names = "Quarterly revenue rose sharply; analysts expected weaker demand across Asian semiconductor markets."
    foreign = "Komisja Europejska przedstawiła wczoraj nowe przepisy dotyczące ochrony danych osobowych obywateli."
    frame = "<nav><a href=/>Home</a></nav>{}<div><a href=x>More of what others have read today</a></div><footer>All rights of this site are kept by its owner and by nobody else.</footer>"
    for paragraphs in ([names, prose, names, names], [foreign] * 3, [names, prose]):
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        assert html_extract.main_text(frame.format(f"<{tag} class=content>{body}</{tag}>")) == "\n".join(" ".join(p.split()) for p in paragraphs)


def test_scores_without_training_documents(spark):
    held_out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    frame = spark.createDataFrame([(i, "some words here") for i in held_out], SCHEMA)
    got = attention_lm.score_documents(frame).collect()
    assert sorted(r["doc_id"] for r in got) == held_out
    for r in got:  # nothing known: every token has the least share, 0.1 of 0.1 * (0 + 1)
        assert r["held_out"] and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (4, 0, 0)
        assert r["base_score"] == pytest.approx(0.0) and np.isfinite(r["score"])
    assert attention_lm.score_documents(frame.limit(0)).count() == 0

"""The five stages on a small corpus, against brute force stage by stage."""

import random

import corpus_pipeline
from disclosure_spark.llm import byte_cnn, tokens

from .reference import jaccard_components


def _windows(text, size=13):
    words = tokens.words("".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in text))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}, words


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randint(2, 8)))
    items = [" ".join(word() for _ in range(30)) for _ in range(3)]
    docs, labels = [], []
    for i in range(260):
        good = i % 4 > 0
        text = " ".join(word() + ("" if good else r.choice(["$$$", "###"])) for _ in range(r.randint(40, 120)))
        if good and i % 13 == 1:
            text += " " + items[i % 3]
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    for i in range(260, 300):  # copies of good texts, some with a word more
        text = docs[1 + 4 * (i % 7)][1] + ("" if i % 2 else " more")
        docs.append((i, text, "en", "s0", len(text)))
    docs += [(300, None, "en", "s0", 0), (301, "", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, frame in (
        ("documents", spark.createDataFrame(docs, schema)), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame(list(enumerate(items)), "item_id long, text string")),
    ):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    network = byte_cnn.fit(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [(d[0], d[1]) for d in docs if network.score((d[1] or "").encode()) >= byte_cnn.ACCEPT]
    assert sum(i % 4 > 0 for i, _ in kept if i < 260) > 185 and sum(i % 4 == 0 for i, _ in kept if i < 260) < 6
    one_each = {doc for doc, _, component in jaccard_components(kept, size=5, percent=80) if doc == component}

    current, seen = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, current, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
        assert current.columns == table.columns
        seen.append({x.doc_id: x.text for x in current.collect()})
    assert set(seen[0]) == {i for i, _ in kept} and set(seen[1]) == one_each == set(seen[2])
    windows = set().union(*[_windows(t)[0] for t in items])
    clean = set()
    for doc, text in seen[2].items():
        own, words = _windows(text)
        hit = {i + k for i in range(len(words) - 12) if tuple(words[i:i + 13]) in windows for k in range(13)}
        if not hit or 20 * len(hit) < len(words):
            clean.add(doc)
    assert set(seen[3]) == clean and len(clean) < len(one_each)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed["doc_id"]) == clean and packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_near_duplicates_of_the_stage_share_five_words_at_80_percent(spark):
    words = [f"w{i}" for i in range(1000)]
    other = [f"x{i}" if i % 45 == 20 and i < 22 * 45 else w for i, w in enumerate(words)]
    assert sum(a != b for a, b in zip(words, other, strict=True)) == 22
    data = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(other[:700]))]
    kept = corpus_pipeline.keep_one_each(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    one_each = {doc for doc, _, component in jaccard_components(data, size=5, percent=80) if doc == component}
    assert {x.doc_id for x in kept.collect()} == one_each == {1, 3}

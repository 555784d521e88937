"""Merkle manifest, periodic runs and URL filter against brute force on small inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from disclosure_spark.llm import merkle, periodic, url_filter

from ..conftest import rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, tree string, at int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """Root and, per node, its siblings from the bottom up as (side, digest)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            if k ^ 1 < len(nodes):
                paths[i].append((k & 1, nodes[k ^ 1]))
            else:
                paths[i].append((None, ""))
        nodes = [sha(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return nodes[0], paths


def plain_manifest(data):
    """(doc_id, leaf, subroot, root, proof, folded, verified) per row."""
    groups = {}
    for doc, text, lang, source, n, *_ in data:
        own = plain_leaf(doc, source, lang, n, text)
        bad = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        now = plain_leaf(doc, source, lang, n if n is None or not bad else n + 1, text)
        groups.setdefault(lang, []).append((doc, own, now))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    low = {name: plain_tree([r[1] for r in groups[name]]) for name in names}
    root, high = plain_tree([low[name][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for (doc, own, now), path in zip(groups[name], low[name][1], strict=True):
            whole, acc = path + high[k], now
            for side, other in whole:
                acc = sha(other, acc) if side == 1 else sha(acc, other)
            out.append((doc, own, low[name][0], root, sha(*[d for _, d in whole]), acc, acc == root))
    return sorted(out, key=repr)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [1, 2, merkle.BLOCK_LEVELS])
def test_manifest_equals_brute_force(spark, levels):
    r = random.Random(levels)
    data = [(i * 3, "wörd " * r.randrange(4), r.choice(["en", "en", "en", "fr", "é", None]), r.choice(["a", None]), r.choice([7, None]), "x", "y", 1) for i in range(37)]
    data += [(5, None, "de", "s", None, "x", "y", 1), (None, "", "fr", None, 0, "x", "y", 1), (None, "z", "", None, 0, "x", "y", 1)]
    data += [(6, "same", "en", "s", 4, "x", "y", 1)] * 5 + [(6, "other", "en", "s", 4, "x", "y", 1)]
    frame = spark.createDataFrame(data, DOCS)
    got = merkle.verification_summary(merkle.manifest(frame, levels=levels))
    assert got.columns == list(MANIFEST)
    want = plain_manifest(data)
    assert rows(got) == want
    assert not all(w[-1] for w in want) and sum(w[-1] for w in want) > 30


def test_manifest_of_one_row_and_of_none(spark):
    one = [(1, "text", "en", "s", 4, "x", "y", 1)]
    got = merkle.verification_summary(merkle.manifest(spark.createDataFrame(one, DOCS)))
    assert rows(got) == plain_manifest(one) and got.head()["proof_sha256"] == sha("")
    assert merkle.verification_summary(merkle.manifest(spark.createDataFrame([], DOCS))).count() == 0


def test_manifest_of_a_long_text_and_text_ids(spark):
    long = [("a", "w " * 1_500_000, "en", "s", 3_000_000), ("b", "x", "en", "s", 1)]
    got = merkle.manifest(spark.createDataFrame(long, "doc_id string, text string, lang string, source string, n_chars long"))
    assert sorted(r["leaf"] for r in got.select("leaf").collect()) == sorted(plain_leaf(d, s, g, n, t) for d, t, g, s, n in long)


def test_append_extends_witnesses_as_siblings_complete():
    stream = merkle.Append()
    for node in "abc":
        stream.add(node)
    assert [len(w) for w in stream.witnesses] == [1, 1, 0] and [t[0] for t in stream.open] == [1, 0]
    assert stream.close() == sha(sha("a", "b"), sha("c"))
    assert stream.witnesses[2] == [merkle.ALONE, merkle.LEFT + sha("a", "b")]


def plain_runs(words):
    """(start, length, smallest period) of every maximal run, by every period and place."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(24, 3 * q):
                found.setdefault((s, length), q)
            i += i == s
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_run_summary(doc, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(("" if doc is None else str(doc)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(kept))


def periodic_text(r):
    n = r.randrange(0, 260)
    words = [r.choice("abcd"[: r.randrange(1, 5)]) for _ in range(n)]
    for _ in range(r.randrange(3)):
        if n > 40:
            a, p = r.randrange(n - 30), r.randrange(1, 30)
            words[a:] = [words[a + k % min(p, n - a)] for k in range(n - a)]
            words[r.randrange(n)] = "x"
    return " ".join(words)


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(60):
        documents = [periodic_text(r).split() for _ in range(r.randrange(1, 6))]
        got = periodic.find_runs([np.array([ord(w) for w in d], dtype=np.int64) for d in documents])
        assert [[tuple(x) for x in g.tolist()] for g in got] == [plain_runs(d) for d in documents]


def test_run_query_equals_brute_force(spark):
    r = random.Random(4)
    data = [(i, periodic_text(r)) for i in range(120)]
    data += [(None, None), (None, "w " * 30), (200, ""), (201, " \t\n"), (202, "é\x85a b\x0bc " * 40), (203, "a b " * 12), (203, "a b " * 12), (204, "a\x1cb c " * 9)]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, runs string, start int")
    got = periodic.run_summary(frame)
    assert rows(got) == sorted((plain_run_summary(d, t) for d, t in data), key=repr)
    assert periodic.run_summary(frame.limit(0)).count() == 0
    kept = {row["doc_id"]: row for row in periodic.detect_runs(frame.filter("doc_id = 203")).collect()}
    assert kept[203]["collapsed"] == "a b" and [tuple(x) for x in kept[203]["runs"]] == [(0, 24, 2)]


def test_runs_of_a_very_long_text():
    line = np.arange(70)
    words = np.concatenate((np.arange(1000, 1500), np.tile(line, 5000), np.full(150_000, 99)))
    runs = periodic.find_runs([words])[0].tolist()
    assert runs == [[500, 350_000, 70], [350_500, 150_000, 1]]


@pytest.mark.parametrize("seed", range(3))
def test_extensions_equal_a_plain_comparison(seed):
    r = np.random.default_rng(seed)
    words = np.resize(r.integers(0, 2, 9), 300) if seed else r.integers(0, 3, 300)
    words[200] = 7
    i, j = r.integers(0, 300, 2000), r.integers(0, 300, 2000)
    i, j = i[i != j], j[i != j]
    got = periodic.Extensions(words)(i, j)
    for a, b, n in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        want = 0
        while max(a, b) + want < 300 and words[a + want] == words[b + want]:
            want += 1
        assert n == want


def plain_rule(host, path):
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_score(model, host, path):
    """Evidence of a URL, one n-gram at a time."""
    total = 0.0
    for salt, text in ((1, host), (2, path)):
        raw = re.sub(rb"[0-9]+", b"0", b"\x01" + text.encode() + b"\x02")
        for n in url_filter.SIZES:
            for at in range(len(raw) - n + 1):
                h = salt * 0x9E3779B97F4A7C15 % 2**64
                for byte in raw[at:at + n]:
                    h = (h ^ byte) * 0x100000001B3 % 2**64
                total += model.weights[((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % url_filter.BUCKETS]
    return 1 / (1 + math.exp(-(url_filter.SCALE * total + model.bias)))


URLS = [
    "https://a.example.net/en/1", "http://EXAMPLE.net/EN/1", "http://net/x", "http://net", "http://net?x=/", "https://b.net/en/", "http://xnet/", "ftp://example.com/de/",
    "http://m.example.com/de", "http://example.org/fr/1?x#y", "http://org/fr/", "http://org/frx", "no url", "", None, "://", "http://a://b.net/", "HTTP://İ.Org/fr/é",
    "http://www.casino-win.example.org/en/14", "http://blog.gardens.example.org/en/14", "http://example.net:80/en/", "http://..net/a", "http://h.com/" + "x/" * 400_000,
]


def test_urls_equal_brute_force(spark):
    model = url_filter.fit(url_filter.labelled_urls(spark))
    data = [(i if i % 5 else None, u, "x", "y") for i, u in enumerate(URLS + URLS[:3])]
    frame = spark.createDataFrame(data, "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(frame, url_filter.rule_table(spark), model)
    want = []
    for page, url, *_ in data:
        host, path = plain_split(url)
        rule, verdict = plain_rule(host, path)
        score = plain_score(model, host, path)
        want.append((page, host, path, rule, verdict or ("block" if score >= 0.5 else "allow"), round(score, 6)))
    assert rows(got.withColumn("score", F.round("score", 6))) == sorted(want, key=repr)
    verdicts = {r["host"]: r["verdict"] for r in got.collect()}
    assert verdicts["www.casino-win.example.org"] == "block" and verdicts["blog.gardens.example.org"] == "allow"
    assert url_filter.filter_urls(frame.limit(0), url_filter.rule_table(spark), model).count() == 0


def test_urls_without_rules_or_labels(spark):
    frame = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = url_filter.rule_table(spark).limit(0)
    labelled = url_filter.labelled_urls(spark)
    assert url_filter.filter_urls(frame, none, url_filter.fit(labelled.limit(0))).head()["verdict"] == "allow"
    assert url_filter.filter_urls(frame, none, url_filter.fit(labelled.filter("blocked"))).head()["verdict"] == "block"
    odd = labelled.unionByName(spark.createDataFrame([(None, True), ("http://x/", None)], "url string, blocked boolean"))
    assert np.allclose(url_filter.fit(odd).weights, url_filter.fit(labelled).weights)


def test_labels_of_names_left_out_are_mostly_found(spark):
    table = sorted((r["url"], r["blocked"]) for r in url_filter.labelled_urls(spark).collect())
    parts = [plain_split(u) for u, _ in table]
    names = [p[0].split(".")[-3] for p in parts]
    fold = np.array([zlib.crc32(n.encode()) % 5 for n in names])
    blocked = np.array([b for _, b in table])
    right = {True: [], False: []}
    for k in range(5):
        use = np.flatnonzero(fold != k)
        model = url_filter.train([parts[i][0] for i in use], [parts[i][1] for i in use], blocked[use])
        out = np.flatnonzero(fold == k)
        said = model.score([parts[i][0] for i in out], [parts[i][1] for i in out]) >= 0.5
        for b in (True, False):
            right[b] += (said == blocked[out])[blocked[out] == b].tolist()
    assert np.mean(right[True]) > 0.35 and np.mean(right[False]) > 0.97

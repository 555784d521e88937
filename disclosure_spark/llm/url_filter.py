"""URL filter: rules of host and path first, then logistic regression on hashed character n-grams of host and path.

Rules.  A rule fits its host and all subdomains where the path starts with the rule's; the longest one wins.
The distinct hosts meet the rules once, by their suffixes; every URL then takes its host's short list, so that the
work on rules grows with hosts and a hot host costs no more than any other.

Model.  N-grams of three to five bytes of host and path, each with marks at its ends and a run of digits as one sign, are hashed
into ``BUCKETS`` weights, whose sum is a URL's evidence.  The weights are
fitted in numpy on a small table of labelled URLs, at most ``MAX_LABELLED`` of them, and applied batch by batch.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the model; of
two rules of equal length the one with the longer host wins, then the block; repeated rows are judged alike;
an empty rule table leaves all to the model; labels of one kind only give that verdict to all, no labels
allow all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disclosure_spark.session import broadcast_if_small, materialize, spread

ALLOW, BLOCK = "allow", "block"
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))  # Fixed values: the contract's rules
SIZES = (3, 4, 5)
BUCKETS = 1 << 17
MAX_LABELLED = 20_000
STEPS, RATE, SHRINK, SCALE = 400, 0.3, 1e-4, 0.25
MAX_BROADCAST = 200_000
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Names of hosts for the labelled table: unwanted kinds of sites, and ordinary ones
UNWANTED = (
    "casino", "casino-bonus", "online-casino", "slots-win", "win-jackpot", "poker-win", "free-spins", "sports-bets", "bets-online", "free-poker",
    "pills", "buy-pills", "cheap-meds", "cheap-viagra", "pharmacy-discount", "diet-pills", "replica-watches", "cheap-bags", "cheap-loans", "payday-loans",
    "adult", "adult-video", "xxx-cams", "sex-chat", "hot-adult", "porn-free", "spam", "spam-links", "link-farm", "seo-farm",
    "ads", "ads-click", "ad-track", "click-track", "banner-ads", "popup-ads", "track-clicks", "warez-crack", "keygen-free", "free-money",
)
ORDINARY = (
    "library", "museum", "garden", "history", "science", "journal", "university", "school", "city-hall", "weather", "travel-notes", "recipes", "music",
    "theatre", "football", "railway", "maps", "radio", "books", "poetry", "software", "python-docs", "open-data", "health", "hospital", "court", "law-review",
    "economy", "finance", "farmers", "forest", "river", "mountain", "cycling", "chess", "astronomy", "physics", "chemistry", "biology", "mathematics",
    "languages", "dictionary", "newspaper", "weekly", "village", "community", "parish", "archive", "photo-club", "crafts", "kitchen", "bakery", "brewery",
    "architecture", "bridge", "harbour", "island", "news", "forum", "wiki", "teacher", "student", "research", "institute", "north", "southern", "winter",
    "summer", "green", "other", "thing", "the-times", "mother", "father", "weathered", "gathering", "rather", "northern", "another", "station", "nation",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (``url``, ``blocked``): each name three times, under subdomains, endings and paths that both kinds share alike."""
    fronts, ends = ("", "www.", "blog.", "m."), ("example.com", "example.org", "example.net", "site.com", "home.org")
    paths = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/en/{}.html", "/en/{}/")
    rows = []
    for names, blocked in ((UNWANTED, True), (ORDINARY, False)):
        for n in range(3 * len(names)):
            rows.append((f"http://{fronts[n // 3 % 4]}{names[n // 3]}.{ends[n % 5]}{paths[n % 6].format(n)}", blocked))
    return spark.createDataFrame(rows, "url string, blocked boolean")


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(of_host, fitting): the rules that fit a host, longest first; only hosts with any."""
    rules = rules.select("verdict", F.translate("host", ascii_uppercase, ascii_lowercase).alias("rule_host"), F.col("path").alias("rule_path"))
    rules = rules.filter("verdict is not null and rule_host is not null and rule_path is not null").distinct()
    labels = rules.agg(F.max(F.size(F.split("rule_host", "[.]"))).alias("n")).head()["n"] or 0
    if not labels:
        return hosts.select(F.col("host").alias("of_host"), F.lit(None).cast("array<struct<rule:string,verdict:string,path:string>>").alias("fitting")).limit(0)
    parts = F.split("host", "[.]")
    last = F.reverse(F.slice(F.reverse(parts), 1, labels))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, labels), "."))
    each = hosts.select("host", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    met = each.join(broadcast_if_small(rules, MAX_BROADCAST), F.col("suffix") == F.col("rule_host"))
    size = F.length("rule_host") + F.length("rule_path")
    ordered = F.struct(
        (-size).alias("size"), (-F.length("rule_host")).alias("host_size"), F.when(F.col("verdict") == BLOCK, 0).otherwise(1).alias("second"),
        F.concat("rule_host", "rule_path").alias("rule"), "verdict", F.col("rule_path").alias("path"),
    )
    listed = met.groupBy(F.col("host").alias("of_host")).agg(F.array_sort(F.collect_list(ordered)).alias("fitting"))
    return listed.select("of_host", F.transform("fitting", lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"), r["path"].alias("path"))).alias("fitting"))


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of many URLs, hashed over one run of bytes."""
    rows, buckets = [], []
    for salt, texts in ((1, hosts), (2, paths)):
        parts = [b"\x01" + t.encode() + b"\x02" for t in texts]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        row = np.repeat(np.arange(len(parts)), sizes)
        digit = (data >= 48) & (data <= 57)
        data = np.where(digit, 48, data).astype(np.uint64)
        first = np.ones(len(data), dtype=bool)
        first[1:] = ~(digit[1:] & digit[:-1])
        data, row = data[first], row[first]
        h = np.full(len(data), salt, dtype=np.uint64) * _MIX
        for n in range(1, max(SIZES) + 1):
            h = (h[:len(data) - n + 1] ^ data[n - 1:]) * _PRIME
            if n in SIZES and len(h):
                inside = row[:len(h)] == row[n - 1:]
                mixed = (h + np.uint64(n)) * _MIX
                rows.append(row[:len(h)][inside])
                buckets.append((mixed[inside] >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(rows), np.concatenate(buckets)


class Model:
    """Weights of the buckets and a bias; ``constant`` where the labels were of one kind."""

    def __init__(self, weights: np.ndarray | None, bias: float, constant: float | None = None) -> None:
        self.weights, self.bias, self.constant = weights, bias, constant

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that each URL is to be blocked."""
        if self.constant is not None or not hosts:
            return np.full(len(hosts), self.constant or 0.0)
        row, bucket = grams(hosts, paths)
        total = np.bincount(row, weights=self.weights[bucket], minlength=len(hosts))
        return 1 / (1 + np.exp(-np.clip(SCALE * total + self.bias, -30, 30)))


def train(hosts: list[str], paths: list[str], blocked: np.ndarray) -> Model:
    """Logistic regression by accelerated gradient descent; the bias keeps the shares of the labels."""
    y = blocked.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(None, 0.0, float(y[0]) if len(y) else 0.0)
    row, bucket = grams(hosts, paths)
    weights, bias = np.zeros(BUCKETS), 0.0
    ahead, ahead_bias = weights.copy(), bias
    for step in range(1, STEPS + 1):
        total = SCALE * np.bincount(row, weights=ahead[bucket], minlength=len(y)) + ahead_bias
        error = (1 / (1 + np.exp(-total)) - y) / len(y)
        new = ahead - RATE * (SCALE * np.bincount(bucket, weights=error[row], minlength=BUCKETS) + SHRINK * ahead)
        new_bias = ahead_bias - RATE * error.sum()
        pull = (step - 1) / (step + 2)
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias = new, new_bias
    return Model(weights, float(bias))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", limit: int = MAX_LABELLED) -> Model:
    """Train on the labelled URLs; of more than ``limit`` those with the least hashes."""
    host, path = host_and_path(F.col(url_col))
    known = labelled.filter(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.select(F.xxhash64(url_col).alias("order"), host.alias("host"), path.alias("path"), F.col(label_col).cast("boolean").alias("blocked"))
    rows = known.orderBy("order", "host", "path", "blocked").limit(limit).collect()
    return train([r["host"] for r in rows], [r["path"] for r in rows], np.array([r["blocked"] for r in rows], dtype=bool))


def filter_urls(pages: DataFrame, rules: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, fitting rule and verdict of every URL; ``score`` is the model's probability of a block."""
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    fitting = materialize(rules_of_hosts(split.select("host").distinct(), rules), "host_rules")
    fitting = broadcast_if_small(fitting, MAX_BROADCAST)
    ruled = spread(split).join(fitting, F.col("host") == F.col("of_host"), "left")
    own = F.get(F.filter("fitting", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    ruled = ruled.select("page_id", "host", "path", own["rule"].alias("rule"), own["verdict"].alias("ruled"))
    kind = dict(ruled.dtypes)["page_id"]
    ruled = ruled.withColumn("page_id", F.col("page_id").cast("string"))  # a long with nulls would be a float in pandas

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=model.score(batch["host"].tolist(), batch["path"].tolist()))

    judged = ruled.mapInPandas(scored, "page_id string, host string, path string, rule string, ruled string, score double")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return judged.select(F.col("page_id").cast(kind).alias("page_id"), "host", "path", "rule", verdict.alias("verdict"), "score")

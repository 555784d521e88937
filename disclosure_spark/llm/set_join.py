"""Groups of documents whose word-shingle sets have a Jaccard similarity of at least a threshold, exactly.

Universe partition.  Two sets of sizes a and b reach the threshold only if they differ in at most
H = (a + b) (1 - t) / (1 + t) shingles.  The hash of a shingle puts it into one of m segments, m set by the
size band.  With m above H, some segment holds the same subset in both sets; a segment that also
sends its one-deletion neighbours tolerates one difference and so counts twice.  ``allocate`` sets per band
how many segments are of which kind by their cost in rows and in chance matches.  Empty segments
say nothing, so each band has a few segments to spare for them; a set with more empty ones sends those too,
unless it is so small that its partners must agree in many other segments.

Candidates.  Equal sets are one class from the start.  A linked pair agrees in at least as many segments as
``signatures`` tells for both of its sets; classes that share fewer groups are left out before any text moves.
A sketch of each class, the parity of its shingles per bit, tells more: two sets differ in at least as many shingles as
their sketches in bits.  Pairs of small groups beyond the threshold by their sketches are left out, and within a large
group all pairs of sketches are compared, in blocks of bounded size.  What may be linked there is covered by single pairs and by
stars: a hub and spokes that may all be linked with it.  A star stands for the pairs among its spokes as well, so a group
of near copies leaves a row per class and not one per pair.

Stars.  Hub and spokes are verified on their texts.  The differences to the hub tell the distance of any two
spokes exactly, |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|.  Two spokes that are both linked to the hub are connected; pairs of which
one is not are compared by these differences in salted blocks (``_spoke_pairs``), which leave a spanning forest of the links.

Numbers of links.  If links are counted, the same blocks compare all pairs of spokes of a hub and count each linked pair
once, at the least of the hubs of which both are spokes; every other link is an edge of its own.

Defined results: a null or empty text has an empty set and is linked with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat or share an id are compared like any other; a null id never
names a component unless all of it are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disclosure_spark.llm import packed
from disclosure_spark.session import broadcast_if_small, materialize

WORDS, PERCENT = 4, 85
SMALL_GROUP = 6
SPOKE_BLOCK = 1500  # spokes of a hub on either side of a block of pairs
DENSE = 24  # classes from which on an element is counted by a matrix product
HUB_PARTS = 64  # copies of a hub's text at most
ROWS_PER_PART = 2000
GROUP_BLOCK = 2000  # classes of a large group on either side of a block of sketches
MEMBERS_PER_PART = 20_000
SKETCH_BITS = 64, 65_536  # least and most
SLICE_BYTES, FLUSH_SIGNATURES = 500_000, 250_000
MAX_BROADCAST = 200_000
BAND_RATIO = 1.63
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; A-Z count as lower case."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    out = h[: max(1, n - size + 1)].copy()
    for k in range(1, min(size, n)):
        out = out * _MIX[0] + h[k:k + len(out)]
    return np.unique(mix(out + np.uint64(min(n, size))))


@functools.cache
def bands(percent: int = PERCENT, limit: int = 1 << 40) -> list[int]:
    """First sizes of the bands; smaller sets can only be linked with equal ones."""
    first = 1
    while (100 - percent) * (first + 100 * first // percent) < 100 + percent:
        first += 1
    out = [first]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND_RATIO)))
    return out


@functools.cache
def allocate(band: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """Segments, how many of them send one-deletion neighbours, and segments to spare for empty and for costly ones.

    The cost is the number of rows of a set plus, per row, the chance that unrelated sets agree, which
    halves with each shingle of a segment and weighs ``chance`` rows.
    """
    low, high = bands(percent)[band], bands(percent)[band + 1] - 1
    most = (100 - percent) * (high + 100 * high // percent) // (100 + percent)
    if most > 2:
        empty, costly = 1 + most // 20, 1 + most // 8
        return most + 1 + empty + costly, 0, empty, costly
    chance, best = 100.0, None
    for deletions in range((most + 1) // 2 + 1):
        segments = most + 1 - deletions
        held = low / segments
        rows = segments + deletions * held
        cost = rows + chance * (segments * 0.5**held + deletions * held * 0.5 ** max(held - 1, 0))
        if deletions <= segments and (best is None or cost < best[0]):
            best = (cost, segments, deletions)
    return best[1], best[2], 0, 0


def schemes(size: int, percent: int = PERCENT) -> list[int]:
    """Bands in which a set sends signatures: its own, and the one below if a smaller partner can lie there."""
    edges = bands(percent)
    own = int(np.searchsorted(edges, size, side="right")) - 1
    if own < 0:
        return []
    return [own, own - 1] if own and -(-percent * size // 100) < edges[own] else [own]


def most_differences(size: int, band: int, percent: int = PERCENT) -> int:
    """Shingles in which a set and a linked one differ at most, the smaller of them in this band."""
    high = bands(percent)[band + 1] - 1
    return (100 - percent) * (size + (high if size > high else 100 * size // percent)) // (100 + percent)


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature hashes, the number of the set each belongs to, the band it was made for, and how many a linked set shares at least.

    Linked sets differ in at most ``most_differences`` segments.  Of the others at most the set's own empty ones are
    not sent; where that leaves too few, the set sends its empty ones too and counts on the band's own spare.
    """
    plan = [(i, band, *allocate(band, percent)) for i, s in enumerate(sets) for band in schemes(len(s), percent)]
    if not plan:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    segments = np.array([p[2] for p in plan])
    sizes = np.array([len(sets[p[0]]) for p in plan])
    base = np.cumsum(segments) - segments
    tokens = np.concatenate([sets[p[0]] for p in plan])
    row = np.repeat(np.arange(len(plan)), sizes)
    slot = base[row] + (mix(tokens ^ _MIX[0]) >> np.uint64(20)).astype(np.int64) % segments[row]
    total = int(segments.sum())
    value = mix(tokens + _MIX[2])
    low = np.bincount(slot, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(np.uint64)
    high = np.bincount(slot, weights=(value >> np.uint64(32)).astype(np.float64), minlength=total).astype(np.uint64)
    content = low + (high << np.uint64(32))
    count = np.bincount(slot, minlength=total)
    owner = np.repeat(np.arange(len(plan)), segments)
    number = np.arange(total) - base[owner]
    band = np.array([p[1] for p in plan])
    place = ((band[owner] << 32) + number).astype(np.uint64) * _MIX[0]
    empty = count == 0
    least = 1 + np.array([p[5] for p in plan])
    most = np.array([most_differences(len(sets[p[0]]), p[1], percent) for p in plan])
    deletions = np.array([p[3] for p in plan])
    empties = np.bincount(owner, weights=empty, minlength=len(plan)).astype(np.int64)
    plain = np.array([p[4] > 0 for p in plan])  # bands with segments to spare
    agree = segments - most - empties
    crowded = np.where(plain, agree < least, empties > 0)
    shared = np.where(plain & ~crowded, agree, least)
    sent = ~empty | crowded[owner]
    out, of = [mix(content[sent] ^ place[sent])], [owner[sent]]
    if deletions.any():
        at = np.flatnonzero(slot - base[row] < deletions[row])
        out.append(mix((content[slot[at]] - value[at]) ^ place[slot[at]]))
        of.append(row[at])
    at = np.concatenate(of)
    return np.concatenate(out), np.array([p[0] for p in plan])[at], band[at], shared[at]


_SIGNED = {"signature": "<u4", "class": "<i8", "band": "u1", "shared": "<u2"}
_CLASSED = {"doc": "<i8", "version": "<i8", "class": "<i8", "size": "<i8"}
DOCUMENT, PAIR, MEMBER = 0, 1, 2


def _class_id(s: np.ndarray) -> int:
    """64-bit name of a set, never negative."""
    total = int(mix(s + _MIX[1]).sum(dtype=np.uint64)) + len(s) * int(_MIX[0])
    return total & ((1 << 63) - 1)


def _sign(batches: Iterator[pd.DataFrame], buckets: int, words: int, percent: int) -> Iterator[pd.DataFrame]:
    """Signature records per bucket, once per class and flush; the class of each document goes along."""
    pending: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> Iterator[pd.DataFrame]:
        signature, name, band, shared = (np.concatenate([p[i] for p in pending]) for i in range(4))
        order = np.lexsort((name, signature))
        order = order[packed.runs(signature[order], name[order])]
        signature, name, band, shared = signature[order], name[order], band[order], shared[order]
        bucket = (signature % np.uint64(buckets)).astype(np.int64)
        columns = {
            "signature": (signature >> np.uint64(32)).astype("<u4"), "class": name, "band": band.astype(np.uint8),
            "shared": np.minimum(shared, 0xFFFF).astype("<u2"),
        }
        yield packed.send(bucket, columns, tuple(_SIGNED)).assign(doc=None, version=None, size=None)

    for batch in batches:
        texts = batch["text"].tolist()
        a = size = 0
        for b in range(len(texts)):
            size += len(texts[b])
            if size < SLICE_BYTES and b + 1 < len(texts):
                continue
            sets = [shingles(t, words) for t in texts[a:b + 1]]
            names = np.array([_class_id(s) for s in sets], dtype="<i8")
            columns = {
                "doc": batch["doc"].to_numpy(np.int64)[a:b + 1], "version": batch["version"].to_numpy(np.int64)[a:b + 1],
                "class": names, "size": np.array([len(s) for s in sets], dtype="<i8"),
            }
            yield packed.send(names % buckets, columns, tuple(_CLASSED)).assign(signature=None, band=None, shared=None)
            _, first = np.unique(names, return_index=True)
            signature, of, band, shared = signatures([sets[i] for i in first], percent)
            pending.append((signature, names[first][of], band, shared))
            count += len(signature)
            a, size = b + 1, 0
            if count >= FLUSH_SIGNATURES:
                yield from flush()
                pending.clear()
                count = 0
    if count:
        yield from flush()


def _small_pairs(name: np.ndarray, band: np.ndarray, shared: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """All pairs of groups of at most ``SMALL_GROUP`` members, laid out by the distance of their places.

    Per pair and band the number of groups it must share at least and of those that it shares here.
    """
    left, right = [], []
    for d in range(1, SMALL_GROUP):
        n = sizes - d
        ok = n > 0
        if ok.any():
            steps = np.arange(n[ok].sum()) - np.repeat(np.cumsum(n[ok]) - n[ok], n[ok])
            at = np.repeat(starts[ok], n[ok]) + steps
            left.append(at)
            right.append(at + d)
    if not left:
        return (np.empty(0, dtype=np.int64),) * 5
    at, to = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((band[at], name[to], name[at]))
    at, to = at[order], to[order]
    first = np.flatnonzero(packed.runs(name[at], name[to], band[at]))
    wanted = np.maximum.reduceat(np.maximum(shared[at], shared[to]), first) if len(first) else first
    return name[at[first]], name[to[first]], band[at[first]], wanted, np.diff(first, append=len(at))


def _collide(rows: pd.DataFrame) -> pd.DataFrame:
    """Classes of documents, candidate pairs of small groups, and members of large ones.

    Pairs and members come with the number of groups of a band that a link needs, pairs with that of groups they share here.
    """
    classed = rows["signature"].isna()
    c = packed.receive(rows[classed], _CLASSED)
    parts = [(np.full(len(c["doc"]), DOCUMENT), c["class"], c["doc"], c["version"], c["size"], np.zeros(len(c["doc"]), np.int64))]
    s = packed.receive(rows[~classed], _SIGNED)
    if len(s["class"]):
        order = np.lexsort((s["class"], s["signature"]))
        order = order[packed.runs(s["signature"][order], s["class"][order])]
        signature, name, band, shared = s["signature"][order], s["class"][order].astype(np.int64), s["band"][order], s["shared"][order]
        starts = np.flatnonzero(packed.runs(signature))
        sizes = np.diff(starts, append=len(name))
        small = (sizes > 1) & (sizes <= SMALL_GROUP)
        pairs = _small_pairs(name, band, shared, starts[small], sizes[small])
        parts.append((np.full(len(pairs[0]), PAIR), *pairs))
        large = np.repeat(sizes > SMALL_GROUP, sizes)
        group = signature[large].astype(np.int64) << 31 | (int(rows["bucket"].iloc[0]) & 0x7FFFFFFF)
        n = int(large.sum())
        parts.append((np.full(n, MEMBER), name[large], group, band[large], shared[large], np.zeros(n, np.int64)))
    return pd.DataFrame({k: np.concatenate([np.asarray(p[i], dtype=np.int64) for p in parts]) for i, k in enumerate(("kind", "a", "b", "c", "d", "n"))})


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles per bit, at least two bits a shingle up to the most."""
    least, most = SKETCH_BITS
    bits = min(most, max(least, 1 << (2 * len(s)).bit_length()))
    at = (mix(s + _MIX[0]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of 64-bit words; longer ones are folded, as their bits are numbered by the same hash."""
    lengths = np.array([len(x) for x in sketches])
    out = np.empty((len(sketches), width // 8), dtype=np.uint64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        parts = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), dtype=np.uint64).reshape(len(at), -1, width // 8)
        out[at] = np.bitwise_xor.reduce(parts, axis=1)
    return out


def _may_link(apart: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be linked, whose sketches differ in ``apart`` bits."""
    close = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    return close & ((100 + percent) * apart <= (100 - percent) * (a + b))


def _near_pairs(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """The pairs that may be linked by their sketches."""
    for batch in batches:
        one, two = batch["sketch_a"].tolist(), batch["sketch_b"].tolist()
        width = np.array([min(len(x), len(y)) for x, y in zip(one, two, strict=True)], dtype=np.int64)
        apart = np.zeros(len(batch), dtype=np.int64)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            x, y = (_folded([side[i] for i in at.tolist()], w) for side in (one, two))
            apart[at] = np.bitwise_count(x ^ y).sum(axis=1)
        keep = _may_link(apart, batch["size_a"].to_numpy(np.int64), batch["size_b"].to_numpy(np.int64), percent)
        yield batch.loc[keep, ["hub", "class", "star"]]


def _may_link_all(sketches: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a block may be linked by their sketches, as a symmetric matrix."""
    n = len(sizes)
    words = _folded(sketches, min(map(len, sketches)))
    out = np.empty((n, n), dtype=bool)
    step = max(1, 2_000_000 // (n * words.shape[1]))
    for at in range(0, n, step):
        part = slice(at, at + step)
        apart = np.bitwise_count(words[part, None] ^ words[None]).sum(axis=2, dtype=np.int64)
        out[part] = _may_link(apart, sizes[part, None], sizes[None], percent)
    np.fill_diagonal(out, False)
    return out


def _cover(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (hub, spoke, whether of a star) such that every near pair is one of them or lies between two spokes of a star.

    Each place in turn is a hub for the near ones still open.  Where these have few open pairs among themselves, its pairs stand alone.
    """
    hubs, spokes, stars = [], [], []
    for h in np.flatnonzero(near.any(axis=1)).tolist():
        of = np.flatnonzero(near[h])
        if not len(of):
            continue
        among = np.ix_(of, of)
        star = len(of) > 2 and int(np.count_nonzero(near[among])) > 4 * len(of)  # each pair counts twice
        if star:
            near[among] = False
        near[h, of] = near[of, h] = False
        hubs.append(np.full(len(of), h))
        spokes.append(of)
        stars.append(np.full(len(of), star))
    if not hubs:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
    return np.concatenate(hubs), np.concatenate(spokes), np.concatenate(stars)


def _cover_groups(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """The covers of blocks of large groups, whose rows follow one another; one block is held at a time."""
    key: tuple[int, ...] | None = None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
    out: list[tuple[np.ndarray, ...]] = []

    def cover() -> None:
        name, degree, size = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((name, degree))[::-1]  # the same hubs in all groups
        sketches = [x for h in held for x in h[3]]
        near = _may_link_all([sketches[i] for i in order.tolist()], size[order], percent)
        if near.any():
            hub, spoke, star = _cover(near)
            a, b = name[order[hub]], name[order[spoke]]
            swap = ~star & (a > b)
            out.append((np.where(swap, b, a), np.where(swap, a, b), star))
        held.clear()

    def covered() -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("hub", "class", "star"))})
            out.clear()

    for batch in batches:
        columns = [batch[c].to_numpy(np.int64) for c in ("group", "lower", "upper")]
        values = [batch[c].to_numpy(np.int64) for c in ("class", "degree", "size")]
        sketches = batch["sketch"].tolist()
        starts = np.flatnonzero(packed.runs(*columns)).tolist()
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            here = tuple(int(c[a]) for c in columns)
            if here != key and held:
                cover()
            key = here
            held.append((*[v[a:b] for v in values], sketches[a:b]))
        yield from covered()
    if held:
        cover()
    yield from covered()


def _absent(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Elements of a sorted set that another one lacks."""
    return x[h[np.minimum(np.searchsorted(h, x), len(h) - 1)] != x] if len(h) else x


def _verify(batches: Iterator[pd.DataFrame], words: int, percent: int) -> Iterator[pd.DataFrame]:
    """Whether hub and class are linked, and of a spoke its difference to the hub."""
    known: dict[int, np.ndarray] = {}

    def shingled(name: int, text: str) -> np.ndarray:
        if name not in known:
            if len(known) >= 2000:
                known.clear()
            known[name] = shingles(text, words)
        return known[name]

    for batch in batches:
        linked, differences, sizes = [], [], []
        for hub, hub_text, name, text, star in zip(batch["hub"], batch["hub_text"], batch["class"], batch["text"], batch["star"], strict=True):
            h, x = shingled(hub, hub_text), shingled(name, text)
            new = _absent(x, h)
            linked.append(100 * (len(x) - len(new)) >= percent * (len(h) + len(new)))
            differences.append(np.concatenate((new, _absent(h, x))).view(np.int64) if star else None)
            sizes.append(len(x))
        yield batch[["hub", "class", "star"]].assign(linked=linked, difference=differences, size=sizes)


def _candidates(pairs: DataFrame, members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(hub, class, star): what is to be verified so that every pair that may be linked is covered.

    A large group is cut into blocks of pairs by a hash of the class, so no task takes all of its pairs.
    """
    sketched = texts.select("class", "size", "text").mapInPandas(
        lambda batches: (b[["class", "size"]].assign(sketch=[sketch(shingles(t, words)) for t in b["text"]]) for b in batches), "class long, size long, sketch binary"
    )
    sketched = materialize(sketched, "sketches")
    met = pairs.select(F.col("a").alias("hub"), F.col("b").alias("class"), F.lit(False).alias("star"))
    for side, name in (("a", "hub"), ("b", "class")):
        of = sketched.select(F.col("class").alias("of"), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        met = met.join(of, F.col(name) == F.col("of")).drop("of")
    schema = "hub long, class long, star boolean"
    near = met.mapInPandas(lambda batches: _near_pairs(batches, percent), schema)

    sized = members.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("n")).filter("n > 1")
    known = members.join(sized, F.col("group") == F.col("g")).select("group", "class", "n")
    degree = known.groupBy(F.col("class").alias("of")).agg(F.sum(F.col("n") - 1).alias("degree"))
    known = known.join(degree, F.col("class") == F.col("of")).drop("of").withColumn("parts", F.ceil(F.col("n") / GROUP_BLOCK).cast("int"))
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part")))
    cut = known.withColumn("part", part).select("group", "class", "degree", "part", F.explode(others).alias("with"))
    cut = cut.select("group", F.least("part", "with").alias("lower"), F.greatest("part", "with").alias("upper"), F.col("class").alias("member"), "degree")
    whole = cut.join(sketched, F.col("member") == F.col("class")).select("group", "lower", "upper", "class", "degree", "size", "sketch")
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, -(-members.count() // MEMBERS_PER_PART))
    dealt = whole.repartition(tasks, "group", "lower", "upper").sortWithinPartitions("group", "lower", "upper")
    covers = dealt.mapInPandas(lambda batches: _cover_groups(batches, percent), schema)
    return near.unionByName(covers).groupBy("hub", "class").agg(F.max("star").alias("star"))


def _with_texts(work: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The texts beside every hub and class, in parts of even numbers of rows.

    A hub's text goes once to each of up to ``HUB_PARTS`` parts of its spokes.
    """
    sized = work.select("hub", "class", "star", F.pmod(F.xxhash64("class"), F.lit(HUB_PARTS)).alias("part"))
    parts = max(work.sparkSession.sparkContext.defaultParallelism, -(-work.count() // ROWS_PER_PART))
    one = texts.select(F.col("class").alias("one"), "text")
    two = texts.select(F.col("class").alias("two"), F.col("text").alias("hub_text"))
    hubs = sized.select("hub", "part").distinct().join(two, F.col("hub") == F.col("two")).select(F.col("hub").alias("of"), F.col("part").alias("of_part"), "hub_text")
    spokes = sized.join(one, F.col("class") == F.col("one")).select("hub", "part", "class", "star", "text").repartition(parts, "hub", "part")
    return spokes.join(hubs, (F.col("hub") == F.col("of")) & (F.col("part") == F.col("of_part"))).select("hub", "class", "star", "text", "hub_text")


def links(pairs: DataFrame, members: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) of hubs and of single pairs, and the spokes of all stars with their differences to the hub.

    A linked pair that is no link of the first frame has a star in the second one of which both are spokes.
    ``texts`` holds class, size and text.
    """
    work = materialize(_candidates(pairs, members, texts, words, percent), "candidates")
    verified = _with_texts(work, texts, percent).mapInPandas(
        lambda batches: _verify(batches, words, percent), "hub long, class long, star boolean, linked boolean, difference array<long>, size long"
    )
    verified = materialize(verified, "verified")
    out = verified.filter("linked").select(F.least("hub", "class").alias("a"), F.greatest("hub", "class").alias("b")).distinct()
    return out, verified.filter("star").select("hub", "class", "linked", "size", "difference")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of elements that each of the left sets shares with each of the right ones."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    values = np.concatenate([*left, *right])
    if not len(values):
        return out
    number = np.unique(values, return_inverse=True)[1]
    cut = sum(map(len, left))
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    a, b = number[:cut], number[cut:]
    size = int(number.max()) + 1
    in_a, in_b = np.bincount(a, minlength=size), np.bincount(b, minlength=size)
    both = (in_a > 0) & (in_b > 0)
    dense = both & (np.maximum(in_a, in_b) >= DENSE)
    few = both & ~dense
    columns = np.flatnonzero(dense)
    place = np.full(size, -1)
    for k in range(0, len(columns), 2048):
        part = columns[k:k + 2048]
        place[:] = -1
        place[part] = np.arange(len(part))
        marks = []
        for row, held, n in ((rows[0], a, len(left)), (rows[1], b, len(right))):
            use = place[held] >= 0
            mark = np.zeros((n, len(part)), dtype=np.float32)
            mark[row[use], place[held[use]]] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    if few.any():
        use_a, use_b = few[a], few[b]
        order = np.argsort(b[use_b], kind="stable")
        held, row_b = b[use_b][order], rows[1][use_b][order]
        first = np.searchsorted(held, a[use_a])
        times = in_b[a[use_a]]
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        cells = np.repeat(rows[0][use_a], times) * len(right) + row_b[at]
        out += np.bincount(cells, minlength=out.size).reshape(out.shape)
    return out


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that connect what a symmetric matrix connects, at most one per place."""
    new, out = np.ones(len(linked), dtype=bool), []
    for start in np.flatnonzero(linked.any(axis=1)).tolist():
        if not new[start]:
            continue
        new[start], queue = False, [start]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(linked[i] & new).tolist()
            new[found] = False
            queue += found
            out += [(i, j) for j in found]
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 2).T)


def _linked_between(left: pd.DataFrame, right: pd.DataFrame, own: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs ``own`` are linked and have no lesser hub in common."""
    own = own & (_shared(left["lesser"].tolist(), right["lesser"].tolist()) == 0)
    rows, columns = np.flatnonzero(own.any(axis=1)), np.flatnonzero(own.any(axis=0))
    out = np.zeros(own.shape, dtype=bool)
    if len(rows):
        left, right = left.iloc[rows], right.iloc[columns]
        d = [np.array(list(map(len, part["difference"]))) for part in (left, right)]
        apart = d[0][:, None] + d[1] - 2 * _shared(left["difference"].tolist(), right["difference"].tolist()).astype(np.int64)
        both = left["size"].to_numpy(np.int64)[:, None] + right["size"].to_numpy(np.int64)
        at = np.ix_(rows, columns)
        out[at] = own[at] & (100 * (both - apart) >= percent * (both + apart))
    return out


def _spoke_block(rows: pd.DataFrame, percent: int, counted: bool) -> pd.DataFrame:
    """Links between the two sides of a block: a forest (of, to) of those with a spoke that the hub is not linked to, and numbers of all (of, n)."""
    same = bool(rows["lower"].iloc[0] == rows["upper"].iloc[0])
    rows = rows.sort_values(["side", "linked"], ignore_index=True)  # spokes that the hub is not linked to come first
    side, open_ = rows["side"].to_numpy(), ~rows["linked"].to_numpy(bool)
    name, linked = rows["class"].to_numpy(np.int64), np.zeros((len(rows), len(rows)), dtype=bool)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
    sides = [(left, right)] if counted else [(left[open_[left]], right), (left[~open_[left]], right[open_[right]])]
    for x, y in sides:
        if len(x) and len(y):
            at = np.ix_(x, y)
            linked[at] |= _linked_between(rows.iloc[x], rows.iloc[y], x[:, None] != y, percent)
    linked |= linked.T
    a, b = _forest(linked & (open_[:, None] | open_))
    n = linked.sum(axis=1) if counted else np.zeros(len(rows), dtype=np.int64)
    parts = [pd.DataFrame({"of": name[a], "to": name[b], "n": 0}), pd.DataFrame({"of": name[n > 0], "to": -1, "n": n[n > 0]})]
    return pd.concat(parts).astype("int64")


def _spoke_pairs(spokes: DataFrame, percent: int, counted: bool) -> tuple[DataFrame, DataFrame]:
    """Further links (a, b) between spokes, and (of, n): links of each class with classes of which a hub is common.

    A hub with many spokes is cut into blocks of pairs by a hash of the class, so no task takes all of its pairs.
    Where links are not counted, hubs that are linked to all of their spokes have nothing open.
    """
    hubs = spokes.groupBy(F.col("class").alias("node")).agg(F.collect_list("hub").alias("hubs"))
    parts = spokes.groupBy(F.col("hub").alias("h")).agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("open"))
    parts = parts.filter("n > 1" if counted else "n > 1 and open > 0")
    parts = parts.select("h", F.ceil(F.col("n") / SPOKE_BLOCK).cast("int").alias("parts"))
    cut = spokes.join(parts, F.col("hub") == F.col("h")).join(hubs, F.col("class") == F.col("node"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    lesser = F.filter("hubs", lambda x: x < F.col("hub"))
    cut = cut.select("hub", "class", "linked", "size", "difference", lesser.alias("lesser"), "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    blocks = cut.select(
        "hub", F.least("part", "with").alias("lower"), F.greatest("part", "with").alias("upper"),
        F.when(F.col("part") <= F.col("with"), 0).otherwise(1).alias("side"), "class", "linked", "size", "difference", "lesser",
    )
    found = blocks.groupBy("hub", "lower", "upper").applyInPandas(lambda rows: _spoke_block(rows, percent, counted), "of long, to long, n long")
    found = materialize(found, "spoke-links")
    edges = found.filter("n = 0").select(F.least("of", "to").alias("a"), F.greatest("of", "to").alias("b"))
    return edges, found.filter("n > 0").select("of", "n")


def link_counts(edges: DataFrame, spokes: DataFrame, counts: DataFrame) -> DataFrame:
    """(of, n_links): number of classes that each class is linked with; ``counts`` holds those that have a hub in common with it."""
    hubs = materialize(spokes.groupBy(F.col("class").alias("node")).agg(F.collect_list("hub").alias("hubs")), "hubs")
    two = hubs.select(F.col("node").alias("node_b"), F.col("hubs").alias("hubs_b"))
    met = edges.join(hubs, F.col("a") == F.col("node"), "left").join(two, F.col("b") == F.col("node_b"), "left")
    alone = met.filter(~F.coalesce(F.arrays_overlap("hubs", "hubs_b"), F.lit(False)))  # the others count at a hub
    alone = alone.select(F.explode(F.array("a", "b")).alias("of"), F.lit(1).cast("long").alias("n"))
    return alone.unionByName(counts).groupBy("of").agg(F.sum("n").alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: the smallest node of its component, by alternating large and small stars.

    Each step takes the least neighbour of a node and hands it to the others, which shortens every path by
    about half; a node with very many neighbours is a sum over partial minima and a join that AQE can split.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("low")).withColumn("low", F.least("of", "low"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
        large = materialize(large.distinct(), "large")
        low = large.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("low"))
        met = large.join(low, F.col("u") == F.col("of"))
        small = met.select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").unionByName(low.select(F.col("of").alias("u"), F.col("low").alias("v")))
        edges = materialize(small.distinct(), "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _enough_shared(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of small groups that may share as many groups of a band as a link needs, all common large ones of both counted in."""
    met = pairs.groupBy("a", "b", "band").agg(F.sum("n").alias("n"), F.max("shared").alias("shared"))
    held = members.groupBy("class", "band").agg(F.count("*").alias("held"))
    for side in ("a", "b"):
        of = held.select(F.col("class").alias("of"), F.col("band").alias("of_band"), F.col("held").alias(f"held_{side}"))
        met = met.join(of, (F.col(side) == F.col("of")) & (F.col("band") == F.col("of_band")), "left").drop("of", "of_band")
    large = F.least(F.coalesce("held_a", F.lit(0)), F.coalesce("held_b", F.lit(0)))
    return met.filter(F.col("n") + large >= F.col("shared")).select("a", "b").distinct()


def _costly_dropped(members: DataFrame) -> DataFrame:
    """Members of large groups; every class leaves its largest groups of a band, one fewer than a linked class shares with it.

    Pairs that share a small group are candidates already; any other linked pair shares that many large ones.  The
    smallest of them, by size and name, is among the largest of neither class, so both stay in it.
    """
    of_class = W.partitionBy("class", "band")  # the segments of one set
    known = members.withColumn("held", F.count("*").over(of_class)).filter("held >= shared").drop("held")
    sizes = known.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("n")).filter("n > 1")
    largest = of_class.orderBy(F.desc("n"), "group")
    ranked = known.join(sizes, F.col("group") == F.col("g")).withColumn("rank", F.row_number().over(largest))
    return ranked.filter("rank >= shared").select("class", "group")


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", counted: bool = True) -> DataFrame:
    """Set size and component of every document, and the number of links of its class (null unless ``counted``)."""
    base = packed.identified(docs, id_col, text_col)
    buckets = packed.bucket_count(base)
    columns = {**_SIGNED, **_CLASSED}
    signed = base.mapInPandas(
        lambda batches: (b[["bucket", *columns]] for b in _sign(batches, buckets, words, percent)), packed.schema(columns)
    )
    rows = materialize(signed.groupBy("bucket").applyInPandas(_collide, "kind long, a long, b long, c long, d long, n long"), "collisions")
    classed = rows.filter(F.col("kind") == DOCUMENT).select(F.col("a").alias("class"), F.col("b").alias("doc"), F.col("c").alias("version"), F.col("d").alias("n_shingles"))
    pairs = rows.filter(F.col("kind") == PAIR).select("a", "b", F.col("c").alias("band"), F.col("d").alias("shared"), "n")
    members = rows.filter(F.col("kind") == MEMBER).select(F.col("a").alias("class"), F.col("b").alias("group"), F.col("c").alias("band"), F.col("d").alias("shared"))
    pairs = materialize(_enough_shared(pairs, members), "pairs")
    members = materialize(_costly_dropped(members), "members")

    wanted = members.select("class").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("class"))).distinct()
    speakers = classed.groupBy("class").agg(F.min(F.struct("doc", "version", "n_shingles")).alias("s")).join(wanted, "class", "left_semi")
    speakers = speakers.select("class", F.col("s.doc").alias("of"), F.col("s.version").alias("v"), F.col("s.n_shingles").alias("size"))
    speakers = broadcast_if_small(materialize(speakers, "speakers"), MAX_BROADCAST)
    texts = base.join(speakers, (F.col("doc") == F.col("of")) & (F.col("version") == F.col("v"))).select("class", "size", "text")
    texts = materialize(texts, "texts")
    edges, spokes = links(pairs, members, texts, words, percent)
    edges = materialize(edges, "links")
    more, counts = _spoke_pairs(spokes, percent, counted)

    roots = materialize(components(edges.unionByName(more)), "roots")
    named = classed.join(roots, F.col("class") == F.col("node"), "left")
    n_links = F.lit(None).cast("long")
    if counted:
        degree = materialize(link_counts(edges, spokes, counts), "degree")
        named = named.join(degree, F.col("class") == F.col("of"), "left")
        n_links = F.coalesce("n_links", F.lit(0).cast("long"))
    named = named.select("doc", "version", "class", "n_shingles", F.coalesce("root", "class").alias("root"), n_links.alias("n_links"))
    named = materialize(named, "named")
    least = named.filter(F.col("doc") != packed.NO_ID).groupBy(F.col("root").alias("r")).agg(F.min("doc").alias("component"))
    joined = named.join(materialize(least, "least"), F.col("root") == F.col("r"), "left")
    component = F.when(F.col("n_shingles") == 0, packed.plain_id()).otherwise(F.col("component"))
    return joined.select(packed.plain_id().alias("doc_id"), "version", "n_shingles", component.alias("component_id"), "root", "n_links")


def keep_one_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all of their columns, one (that of the smallest id) of each component.

    Documents without words are no copies of each other and stay.
    """
    groups = similar_groups(docs, words, percent, id_col, text_col, counted=False)
    ids = groups.select(F.coalesce("doc_id", F.lit(packed.NO_ID)).alias("doc"), "version", "n_shingles", "root")
    first = ids.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc", "version")).alias("s")).select("s.doc", "s.version")
    kept = first.unionByName(ids.filter("n_shingles = 0").select("doc", "version").distinct())
    kept = materialize(kept.select(F.col("doc").alias("of"), F.col("version").alias("v")), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = packed.identified(docs.select(row), f"row.`{id_col}`", f"row.`{text_col}`", "row")
    left = base.join(kept, (F.col("doc") == F.col("of")) & (F.col("version") == F.col("v")), "left_semi")
    if docs.count() > base.select("doc", "version").distinct().count():
        left = left.filter(F.length(F.trim("text")) > 0).dropDuplicates(["doc", "version"]).unionByName(left.filter(F.length(F.trim("text")) == 0))
    return left.select("row.*")

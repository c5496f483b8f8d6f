"""Problem 6: near-duplicate records with small edits.

Method: universal hash minima over word shingles, banding, verification by
signature, an exact check of what the signatures leave open, and connected
components by alternating large-star and small-star.

Scale and skew: exact copies (equal shingle sets) are one class, with a partial
aggregate before banding, so that a text with a third of all rows meets nobody as
itself; classes, not documents, are the nodes of everything after it, so that a
page_id with two texts is in two classes and no row is chosen among them.  Bands
meet in an equi-join, which adaptive execution splits where a band is hot; a pair
that meets in several bands becomes one in the mapper.  Signatures of one byte a
slot go through the shuffle: SLOTS of them throw out most candidates, all of them
decide what lies four standard deviations beyond the threshold.  Only documents of
pairs between are read again, turned into shingle hashes once each.  Tables of classes
and pairs are joined by sorting, never by broadcast, however small they seem: a
broadcast is built on the driver, and many of them at once do not fit it.  No pair of
different texts that a band brings together is dropped, and there is no cap on
partners.

Recall: a pair of similarity s meets in a band with 1 - (1 - s**5)**64: 0.994 at
0.6, 0.99996 at 0.68, all but surely from 0.7 on.  A pair is accepted or thrown out
by signature alone only beyond four standard deviations (an error in some 30 000).

Defined cases: null texts and texts under `least_words` words have no pairs and
are groups of their own; repeated rows count once; rows without page_id are left
out; texts are read whole; a page_id with different texts has the pairs and groups
of each of them.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_arrow, maybe_among, saved

ROWS, BANDS, SLOTS = 5, 64, 64
_word = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20240601)
# Multiply-shift universal hashing: odd multiplier, any offset, the upper half of the product.
_A = _rng.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_M = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_hashes: dict[str, int] = {}


def shingles(text: str | None, size: int = 3, least_words: int = 0) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of the text's word sequences; null if it has fewer words than least_words."""
    words = _word.findall(text.lower()) if text else []
    if len(words) < max(least_words, size):
        return None
    if len(_hashes) > 500_000:
        _hashes.clear()
    get, h = _hashes.get, []
    for w in words:
        v = get(w)
        if v is None:
            v = _hashes[w] = xxhash.xxh64_intdigest(w)
        h.append(v)
    a = np.array(h, np.uint64)
    n = len(a) - size + 1
    s = a[:n] * _C[0]
    for k in range(1, size):
        s += a[k : k + n] * _C[k]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    """The 32-bit universal hash minima of a set, in slices that fit the processor's cache whatever the set's size."""
    best = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        best = np.minimum(best, (s[i : i + 512, None] * _A + _B).min(0))
    return best >> np.uint64(32)


def _same(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def sketches(docs: DataFrame, key: str, text: str, size: int, least_words: int) -> DataFrame:
    """(id, same, bands, sig): hash of the shingle set, band keys, one byte of each of the minima."""

    def rows(ids, texts):
        for i, t in zip(ids, texts):
            s = shingles(t, size, least_words) if i is not None else None
            if s is not None:
                m = minima(s)
                bands = (m.reshape(BANDS, ROWS) * _M).sum(1, dtype=np.uint64)
                bands ^= bands >> np.uint64(31)
                bands = bands * _C[0] + np.arange(BANDS, dtype=np.uint64)
                yield i, _same(s), bands.astype(np.int64), (m & np.uint64(255)).astype(np.uint8).tobytes()

    return map_arrow(docs.select(key, text), rows, "id long, same long, bands array<long>, sig binary")


def _estimates(sa: list[bytes], sb: list[bytes]) -> np.ndarray:
    """Estimated similarities; one in 256 slots agrees by chance."""
    n = len(sa[0])
    x = np.frombuffer(b"".join(sa), np.uint8).reshape(-1, n) == np.frombuffer(b"".join(sb), np.uint8).reshape(-1, n)
    return (x.mean(1) - 1 / 256) / (1 - 1 / 256)


def _merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that takes nothing to the driver, whatever spark.sql.autoBroadcastJoinThreshold is."""
    return left.join(right.hint("merge"), on, how)


def _both(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """pairs (a, b) with the column of both of their classes, as name_a and name_b."""
    left = of.select(F.col("same").alias("a"), F.col(name).alias(f"{name}_a"))
    right = of.select(F.col("same").alias("b"), F.col(name).alias(f"{name}_b"))
    return _merge(_merge(pairs, left, "a"), right, "b")


def similar(docs: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, same) puts each document into the class of its exact copies; pairs (a, b, similarity) has the
    classes, a < b, of at least the threshold; similarity is an estimate where the signature decides."""
    sk = saved(sketches(docs, key, text, size, least_words))
    members = sk.select("id", "same").distinct()
    bands = sk.groupBy("same").agg(F.min("bands").alias("bands")).select(F.explode("bands").alias("k"), F.col("same").alias("a"))
    met = _merge(bands, bands.withColumnRenamed("a", "b"), "k").where("a < b").select("a", "b").distinct()
    spread = lambda slots: 4 * (threshold * (1 - threshold) / slots) ** 0.5

    def likely(a, b, sa, sb):
        if a:
            for i in np.flatnonzero(_estimates(sa, sb) >= threshold - spread(SLOTS)):
                yield a[i], b[i]

    def decided(a, b, sa, sb):
        if a:
            est, edge = _estimates(sa, sb), spread(ROWS * BANDS)
            for i in np.flatnonzero(est >= threshold - edge):
                yield a[i], b[i], float(est[i]), bool(est[i] < threshold + edge)

    few = sk.groupBy("same").agg(F.min(F.substring("sig", 1, SLOTS)).alias("sig"))
    left = saved(map_arrow(_both(met, few, "sig").select("a", "b", "sig_a", "sig_b"), likely, "a long, b long"))
    nodes = left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct()
    whole = maybe_among(sk.select("same", "sig"), "same", nodes).groupBy("same").agg(F.min("sig").alias("sig"))
    left = saved(map_arrow(_both(left, whole, "sig").select("a", "b", "sig_a", "sig_b"), decided, "a long, b long, similarity double, open boolean"))
    unsure = left.where("open").select("a", "b")
    # what signatures leave open: its documents are read again and turned into shingle hashes, once each
    classes = unsure.select(F.col("a").alias("same")).union(unsure.select(F.col("b").alias("same"))).distinct()
    wanted = _merge(members, classes, "same").groupBy("same").agg(F.min("id").alias("id"))
    thin = maybe_among(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), "id", wanted.select("id"))

    def hashes(ids, texts):
        for i, t in zip(ids, texts):
            s = shingles(t, size, least_words)
            if s is not None:
                yield i, _same(s), s.tobytes()

    sets = _merge(map_arrow(thin.select("id", "t"), hashes, "id long, same long, s binary"), wanted, ["id", "same"], "left_semi").groupBy("same").agg(F.min("s").alias("s"))

    def exact(a, b, xs, ys):
        for i, j, x, y in zip(a, b, xs, ys):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            sim = both / (len(p) + len(q) - both)
            if sim >= threshold:
                yield i, j, sim

    checked = map_arrow(_both(unsure, sets, "s").select("a", "b", "s_a", "s_b"), exact, "a long, b long, similarity double")
    return members, left.where("not open").select("a", "b", "similarity").union(checked)


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id_a, page_id_b) of the documents themselves, copies expanded."""
    ma = members.select(F.col("same").alias("a"), F.col("id").alias("x"))
    mb = members.select(F.col("same").alias("b"), F.col("id").alias("y"))
    across = _merge(_merge(pairs.select("a", "b"), ma, "a"), mb, "b").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    within = _merge(ma, mb, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    out = across.union(within)
    # a pair comes twice only through a page_id that has two texts
    twice = members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id").limit(1).count()
    return (out.distinct() if twice else out).select(F.col("x").alias("page_id_a"), F.col("y").alias("page_id_b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (a, b), root the least id of its component: alternating large-star and small-star.

    Each round is written to the checkpoint folder; it ends when a round changes no edge.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _merge(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _merge(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def groups(docs: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, least_words: int = 0) -> DataFrame:
    """(page_id, group_id, links): every document once, its group's least id, and its number of links to other texts."""
    members, pairs = similar(docs, key, text, size, threshold, least_words)
    members, pairs = saved(members), saved(pairs.select("a", "b"))
    # texts of one page_id belong together as well
    first = members.groupBy("id").agg(F.min("same").alias("b"), F.count("*").alias("n"))
    own = _merge(members, first.where("n > 1").select("id", "b"), "id").select(F.col("same").alias("a"), "b")
    root = components(pairs.union(own)).select(F.col("id").alias("same"), "root")
    links = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "same")
    in_group = _merge(_merge(members, root, "same", "left"), links, "same", "left").select("id", F.coalesce("root", "same").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    per = in_group.groupBy("id").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    least = per.groupBy("root").agg(F.min("id").alias("group_id"))
    ids = docs.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct()
    out = _merge(ids, _merge(per, least, "root"), "id", "left")
    return out.select(F.col("id").alias("page_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))

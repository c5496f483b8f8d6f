"""Uniqueness and similarity: first by key, visible text, SimHash, Jaccard, path tries, first-come representatives."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from ..functions import urls as U
from ..plans.lineage import saved


def first_by(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """Of each key the first row; order is a unique key of the rows.

    A partial minimum and a semi join, not a window: a key that a third of all rows has is one row after the mapper.
    """
    winners = df.groupBy(*[U.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*order)).alias("_o")).select("_o.*")
    return df.join(winners, order, "left_semi")


def content_key(body: str | Column) -> Column:
    return F.md5(F.encode(U.text(body), "UTF-8"))


def visible_text(body: str | Column) -> Column:
    """Text without scripts, styles, navigation, headers, footers and tags; tags leave no blank behind."""
    t = U.text(body)
    for tag in ("script", "style", "nav", "footer", "header"):
        t = F.regexp_replace(t, rf"(?is)<{tag}.*?</{tag}>", " ")
    return F.replace(F.regexp_replace(t, r"<[^>]*>?", ""), F.lit(">"), F.lit(""))


def tokens(c: str | Column) -> Column:
    """Lower-case runs of letters and digits of over one byte, in order."""
    return F.filter(F.split(F.lower(U.text(c)), r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: F.octet_length(x) > 1)


def fnv1a(c: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed number, in two limbs so that nothing overflows."""
    octets = F.transform(F.filter(F.split(F.hex(F.encode(c, "UTF-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))

    def step(a: Column, y: Column) -> Column:
        h = a.bitwiseXOR(y)
        low = h.bitwiseAND(F.lit(4294967295)) * F.lit(435)
        high = (F.shiftrightunsigned(h, 32) * F.lit(435) + F.shiftrightunsigned(low, 32) + h.bitwiseAND(F.lit(16777215)) * F.lit(256)).bitwiseAND(F.lit(4294967295))
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(4294967295)))

    return F.aggregate(octets, F.lit(-3750763034362895579).cast("long"), step)


def _fnv_all(parts: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each byte string, all of them a byte at a time: the longest first, so that those done fall away."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(-sizes, kind="stable")
    starts = np.r_[0, np.cumsum(sizes)[:-1]][order]
    data = np.frombuffer(b"".join(parts), np.uint8)
    left = len(parts) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), "right")
    h = np.full(len(parts), 14695981039346656037, np.uint64)
    for p, n in enumerate(left):
        h[:n] = (h[:n] ^ data[starts[:n] + p]) * np.uint64(1099511628211)
    out = np.empty_like(h)
    out[order] = h
    return out


def simhashes(texts: list[list[str]]) -> np.ndarray:
    """64-bit SimHashes over windows of three tokens; 0 for under five tokens."""
    out = np.zeros(len(texts), np.int64)
    some = [i for i, w in enumerate(texts) if len(w) >= 5]
    if not some:
        return out
    parts: list[bytes] = []
    ends = []
    for i in some:
        w = [x.encode() for x in texts[i]]
        parts += [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
        ends.append(len(parts))
    h = _fnv_all(parts)
    begins = np.array([0, *ends[:-1]], np.int64)
    sizes = np.diff(np.array([0, *ends], np.int64))
    v = np.zeros(len(some), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), begins)
        v |= (ones * 2 > sizes).astype(np.uint64) << np.uint64(bit)
    out[some] = v.view(np.int64)
    return out


def simhash_of(words: list[str]) -> int:
    return int(simhashes([words])[0])


@F.pandas_udf(LongType())
def simhash(words: pd.Series) -> pd.Series:
    """SimHash of arrays of tokens, a whole Arrow batch at a time."""
    return pd.Series(simhashes([list(w) if w is not None else [] for w in words]))


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(U.col(a).bitwiseXOR(U.col(b)))


def close_hashes(df: DataFrame, key: str, value: str, distance: int = 3) -> DataFrame:
    """(a, b, distance) of distinct hash values within the distance, a the one that comes first by key.

    The 64 bits are cut into distance + 3 blocks: two hashes within the distance agree in three of them, so that a join on
    each choice of three blocks is exact, and a table's key has 192 / (distance + 3) bits (32 for a distance of 3), which keeps
    its buckets small where there are billions of hashes.  A pair is taken from the first of its choices only.  Equal hashes
    are one row before they meet.  The join is told to merge: the optimizer takes the tables to be as large as the hashes, not
    as many times that as there are choices, and would broadcast millions of rows through the driver.
    """
    first = df.groupBy(value).agg(F.min(key).alias("_key"))
    n = distance + 3
    edges = [64 * i // n for i in range(n + 1)]
    sizes = [edges[i + 1] - edges[i] for i in range(n)]
    bits = [((1 << sizes[i]) - 1) << edges[i] for i in range(n)]
    signed = [b - (1 << 64) if b >= 1 << 63 else b for b in bits]
    choices = list(combinations(range(n), 3))
    width = max(sum(sizes[i] for i in c) for c in choices)

    def place(number: int, choice: tuple[int, ...]) -> Column:
        """The three blocks side by side under the number of their choice, as one number, which is short to ship and quick to sort."""
        out, low = F.lit(number << width).cast("long"), 0
        for i in choice:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, edges[i]).bitwiseAND(F.lit((1 << sizes[i]) - 1).cast("long")), low))
            low += sizes[i]
        return out

    t = first.select("_key", value, F.explode(F.array(*[place(k, c) for k, c in enumerate(choices)])).alias("at"))
    a = t.select("at", F.col("_key").alias("a"), F.col(value).alias("va"))
    b = t.select("at", F.col("_key").alias("b"), F.col(value).alias("vb"))
    x = F.col("va").bitwiseXOR(F.col("vb"))
    # blocks that agree, in order: the first three of them name the choice
    agree = F.filter(F.array(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)).otherwise(F.lit(-1)) for i, m in enumerate(signed)]), lambda i: i >= 0)
    choice = F.create_map(*[y for k, c in enumerate(choices) for y in (F.lit(",".join(map(str, c))), F.lit(k))])
    number = F.shiftrightunsigned("at", width) if len(choices) > 1 else F.lit(0)
    own = F.try_element_at(choice, F.array_join(F.transform(F.slice(agree, 1, 3), lambda i: i.cast("string")), ",")) == number
    met = a.hint("merge").join(b, "at").where((F.col("a") < F.col("b")) & (hamming("va", "vb") <= distance))
    return met.where(own).select("a", "b", hamming("va", "vb").alias("distance"))


#: So many open pairs are settled by one task, in their order; more are thinned by rounds first.
ONE_TASK = 100_000


def _settle(frames):
    """(n) of the rows dropped among all pairs (a, b) of one task: each row after all its earlier neighbours."""
    pairs = pd.concat([*frames, pd.DataFrame({"a": [], "b": []}, dtype=object)])
    later: dict = {}
    waits: dict = {}
    for a, b in zip(pairs["a"], pairs["b"]):
        later.setdefault(a, []).append(b)
        waits[b] = waits.get(b, 0) + 1
    todo = [a for a in later if a not in waits]
    dropped: set = set()
    done = 0
    while todo:
        x = todo.pop()
        for y in later.get(x, ()):
            done += 1
            if x not in dropped:
                dropped.add(y)
            waits[y] -= 1
            if not waits[y]:
                todo.append(y)
    if done < len(pairs):
        raise ValueError("pairs go in a circle")
    yield pd.DataFrame({"n": list(dropped)}, dtype=pairs["b"].dtype if len(dropped) else object)


def first_come(ids: DataFrame, key: str, pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(key) of the representatives a first-come filter keeps: a row is kept if no kept earlier row is its neighbour.

    Rounds instead of a scan: a round keeps the rows with no earlier neighbour left and drops their neighbours, until no
    pair is open; it settles at least the earliest open row.  The number of rounds is the longest chain of neighbours, not
    of rows, so what is open is settled in order by one task as soon as it is no more than one_task pairs.  pairs: (a, b),
    a the earlier; pairs that go in a circle are an error.
    """
    p = saved(pairs.select("a", "b").where("a <> b").distinct())
    kind = p.schema["b"].dataType.simpleString()
    dropped, rounds, left = p.select(F.col("b").alias("n")).limit(0), 0, p.count()
    while left > one_task:
        first = p.select("a").distinct().join(p.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = saved(p.join(first, "a", "left_semi").select(F.col("b").alias("n")).distinct())
        p = saved(p.join(gone.select(F.col("n").alias("a")), "a", "left_anti").join(gone.select(F.col("n").alias("b")), "b", "left_anti").select("a", "b"))
        before, left, rounds = left, p.count(), rounds + 1
        if left == before:
            raise ValueError("pairs go in a circle")
        dropped = dropped.union(gone)
        if rounds % 20 == 0:
            dropped = saved(dropped)
    if left:
        dropped = dropped.union(saved(p.repartition(1).mapInPandas(_settle, f"n {kind}")))
    return ids.select(key).distinct().join(dropped.select(F.col("n").alias(key)), key, "left_anti")


def simhash_filter(df: DataFrame, key: str, value: str, distance: int = 3) -> DataFrame:
    """(key) of the rows that are within the distance of no accepted earlier row."""
    first = df.groupBy(value).agg(F.min(key).alias(key)).select(key)
    return first_come(first, key, close_hashes(df, key, value, distance))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(U.col(a), U.col(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(U.col(a), U.col(b))) / union)


def _bitmap(words: str) -> list[Column]:
    """Four words of 64 bits, a bit for the hash of each token of a set."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    put = lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, 2).bitwiseAND(F.lit(63)).cast("int")))

    def one(k: int) -> Column:
        return F.aggregate(F.filter(h, lambda x: x.bitwiseAND(F.lit(3)) == k), F.lit(0).cast("long"), put)

    return [one(k) for k in range(4)]


def jaccard_pairs(df: DataFrame, key: str, words: str, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) of rows whose token sets have at least the threshold, a < b.

    Exact and without all pairs: tokens are put in order of rarity, and only rows that share one of the first
    |s| - ceil(threshold |s|) + 1 tokens meet.  Where they meet, bounds of what they can have in common throw out most: their
    sizes, what is left after the places of the shared token (the first one of a pair that is alike keeps to that bound), and
    the bits in which bitmaps of 256 hashed tokens differ.  Only the sets of pairs that pass go through the shuffle.  Rows with
    equal sets meet through one representative.
    """
    sets = df.select(key, F.array_sort(F.array_distinct(words)).alias("_set")).withColumn("_same", F.xxhash64("_set"))
    reps = saved(sets.groupBy("_same").agg(F.min(key).alias("_k"), F.first("_set").alias("_set")))
    tokens_ = reps.select("_k", F.explode(F.transform("_set", lambda w: F.xxhash64(w))).alias("w"))
    count = tokens_.groupBy("w").agg(F.count("*").alias("n"))
    ranked = tokens_.join(count, "w").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("o"))
    size = F.size("o")
    keep = size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    heads = ranked.select("_k", size.alias("m"), F.posexplode(F.slice("o", F.lit(1), keep)).alias("i", "h")).select("_k", "m", "i", "h.w")
    bits = [f"_b{k}" for k in range(4)]
    heads = heads.join(reps.select("_k", *[c.alias(n) for c, n in zip(_bitmap("_set"), bits)]), "_k")
    x = heads.select("w", *[F.col(c).alias(f"{n}a") for c, n in (("_k", "_k"), ("m", "m"), ("i", "i"), *zip(bits, bits))])
    y = heads.select("w", *[F.col(c).alias(f"{n}b") for c, n in (("_k", "_k"), ("m", "m"), ("i", "i"), *zip(bits, bits))])
    both = F.col("ma") + F.col("mb")
    need = both * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)
    differ = sum((F.bit_count(F.col(f"{n}a").bitwiseXOR(F.col(f"{n}b"))) for n in bits), F.lit(0))
    fit = (
        (F.col("_ka") < F.col("_kb"))
        & (F.least("ma", "mb") >= F.greatest("ma", "mb") * F.lit(threshold) - F.lit(1e-9))
        & (F.least(F.col("ma") - F.col("ia"), F.col("mb") - F.col("ib")) >= need)
        & ((both - differ) / 2 >= need)
    )
    met = x.join(y, "w").where(fit).select(F.col("_ka").alias("a"), F.col("_kb").alias("b")).distinct()
    full = met.join(reps.select(F.col("_k").alias("a"), F.col("_set").alias("sa")), "a").join(reps.select(F.col("_k").alias("b"), F.col("_set").alias("sb")), "b")
    across = full.select("a", "b", jaccard("sa", "sb").alias("similarity")).where(F.col("similarity") >= threshold)
    copies = sets.select(F.col(key).alias("b"), "_same").join(reps.select("_same", F.col("_k").alias("a")), "_same").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.union(copies)


def jaccard_clusters(df: DataFrame, key: str, words: str, threshold: float = 0.8) -> DataFrame:
    """(key, representative, place): rows put to the earliest kept row they are like, place 1 the representative itself."""
    pairs = saved(jaccard_pairs(df, key, words, threshold))
    copies = pairs.where("similarity = 1.0")
    # a copy is like whatever its representative is like
    copy_of = copies.groupBy("b").agg(F.min("a").alias("r"))
    distinct = df.select(key).join(copy_of.select(F.col("b").alias(key)), key, "left_anti")
    across = pairs.join(copy_of.select("b"), "b", "left_anti")
    kept = saved(first_come(distinct, key, across))
    near = across.join(kept.select(F.col(key).alias("a")), "a").groupBy("b").agg(F.min("a").alias("r"))
    to = kept.select(F.col(key).alias("n"), F.col(key).alias("r")).union(near.join(kept.select(F.col(key).alias("b")), "b", "left_anti").select(F.col("b").alias("n"), "r"))
    all_ = to.union(copy_of.join(to.withColumnRenamed("r", "rr"), F.col("r") == F.col("n")).select("b", "rr"))
    place = F.row_number().over(Window.partitionBy("r").orderBy("n"))
    return all_.select(F.col("n").alias(key), F.col("r").alias("representative"), place.alias("place"))


def trie_paths(df: DataFrame, key: str, host: str, segs: str, threshold: int = 10) -> DataFrame:
    """(key, segments): on each level of a host's path tree, from the row on that brings the (threshold + 1)-th distinct child, children
    become {param}.

    One round a level, in order of key; the table is written only where a level has a node that turns.  The turning point of a node is the (threshold + 1)-th smallest first sight of its
    children, found in salts first, so that a node with very many children is no single task.
    """
    at = saved(df.select(key, F.col(host).alias("_h"), F.col(segs).alias("_s"), F.array().cast("array<string>").alias("_done")))
    depth = at.agg(F.max(F.size("_s"))).first()[0] or 0
    for level in range(depth):
        here = at.where(F.size("_s") > level).withColumn("_seg", F.element_at("_s", level + 1)).withColumn("_node", F.xxhash64("_h", "_done"))
        sight = here.groupBy("_node", "_seg").agg(F.min(key).alias("f"))
        salt = sight.withColumn("_salt", F.pmod(F.xxhash64("_seg"), F.lit(16)))
        low = salt.withColumn("rn", F.row_number().over(Window.partitionBy("_node", "_salt").orderBy("f"))).where(F.col("rn") <= threshold + 1)
        turn = low.withColumn("rn", F.row_number().over(Window.partitionBy("_node").orderBy("f"))).where(F.col("rn") == threshold + 1).select("_node", F.col("f").alias("t"))
        turn = saved(turn)
        if turn.isEmpty():
            # no node of this level has so many children: the level's segments stay, and nothing is written
            more = F.when(F.size("_s") > level, F.array(F.element_at("_s", F.least(F.size("_s"), F.lit(level + 1))))).otherwise(F.array().cast("array<string>"))
            at = at.withColumn("_done", F.concat("_done", more))
            continue
        seg = F.when(F.col("t").isNotNull() & (F.col(key) >= F.col("t")), "{param}").otherwise(F.col("_seg"))
        moved = here.join(turn, "_node", "left").select(key, "_h", "_s", F.concat("_done", F.array(seg)).alias("_done"))
        at = saved(moved.union(at.where(F.size("_s") <= level)))
    return at.select(key, F.col("_done").alias("segments"))

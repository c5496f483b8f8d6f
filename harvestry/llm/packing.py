"""Problem 8: filling fixed-capacity containers with items.

Method: pattern packing by non-negative least squares.  Lengths go into at most
BINS bins; patterns of up to three bins that fill a container are enumerated; the
repeat counts that best fit the histogram solve a non-negative least squares
problem; they are rounded down and made exact (each pattern takes the longest items
of its bins, then the longest that still fit).  The histogram of what is left is
fitted again, until no pattern repeats, and the rest is packed from the longest
down, filling each container with the longest items that fit.  This is done with
bins over a tenth and over a quarter of the capacity, with half of the repeats, and
with no fitted pattern; the plan of the fewest containers is taken, so that the
patterns never cost a container.

Everything but sizes and places works on the histogram of lengths, whose size is
the capacity's, not the data's.  Items get their places by rank within their
length: ranks are counted in buckets of bounded size, whose offsets are prefix
sums, so that a length that a third of all items has is no single task.

Defined cases: a document over the capacity is split into full parts and a rest;
no other is split; null and empty texts have 0 tokens and go into container 0
without taking room; repeated rows count once; no document, no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import map_arrow, saved
from .tokens import VOCABULARY, token_sizes

BINS = 128
BUCKET = 50_000


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |ax - b| with x >= 0, by the active set method on the normal equations, to the end.

    Every step lowers the residual, so that no active set comes twice; a step that does not, for want of precision, ends it.
    """
    gram, rhs = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    active: list[int] = []
    least, tiny = np.inf, 1e-9 * max(1.0, abs(rhs).max(initial=0.0))
    while True:
        grad = rhs - gram @ x
        grad[active] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= tiny:
            return x
        active.append(j)
        best = x.copy()
        while active:
            k = np.array(active)
            z = np.linalg.lstsq(gram[np.ix_(k, k)], rhs[k], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[k] = z
                break
            neg = z <= 0
            ratio = x[k][neg] / np.maximum(x[k][neg] - z[neg], 1e-300)
            x[k] += ratio.min() * (z - x[k])
            active = [int(i) for i in k if x[i] > 1e-12]
            x[[i for i in range(len(x)) if i not in set(active)]] = 0
        now = float(x @ gram @ x - 2 * rhs @ x)
        if now >= least - 1e-12 * max(1.0, abs(least) if np.isfinite(least) else 1.0):
            return best
        least = now


def patterns(bins: int, most: int = 3) -> list[tuple[int, ...]]:
    """Ways to fill `bins` with up to `most` bins, longest first."""
    out = [(bins,)]
    if most >= 2:
        out += [(a, bins - a) for a in range((bins + 1) // 2, bins)]
    if most >= 3:
        out += [(a, b, bins - a - b) for a in range(bins - 2, 0, -1) for b in range(min(a, bins - a - 1), 0, -1) if 1 <= bins - a - b <= b]
    return out


class _Stock:
    """Counts of lengths, with the longest length in stock that is at most x."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()
        self.low = list(range(len(counts)))  # next candidate at or under each length

    def longest(self, x: int) -> int:
        path, low = [], self.low
        while x > 0 and self.n[x] == 0:
            path.append(x)
            x = low[x] if low[x] != x else x - 1
        for p in path:
            low[p] = x
        return x


class _Packer:
    """A packing under way: the items left, and the exact patterns so far."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.stock, self.capacity = _Stock(counts), capacity
        self.out: list[tuple[dict[int, int], int]] = []

    def take(self, first: list[tuple[int, int]], repeats: int) -> int:
        """One exact pattern, as often as stock and repeats allow; the bins' ranges are tried first, then whatever fits."""
        stock, left = self.stock, self.capacity
        pattern: dict[int, int] = {}

        def best(limit: int, least: int = 1) -> int:
            x = stock.longest(limit)
            while x >= least and stock.n[x] <= pattern.get(x, 0):
                x = stock.longest(x - 1)
            return x if x >= least else 0

        for lo, hi in first:
            x = best(min(hi, left), lo)
            if not x:
                return 0
            pattern[x] = pattern.get(x, 0) + 1
            left -= x
        while left > 0 and (x := best(left)):
            k = min(left // x, int(stock.n[x]) - pattern.get(x, 0))
            pattern[x] = pattern.get(x, 0) + k
            left -= k * x
        if not pattern:
            return 0
        times = min([repeats, *(int(stock.n[x]) // k for x, k in pattern.items())])
        for x, k in pattern.items():
            stock.n[x] -= k * times
        self.out.append((pattern, times))
        return times

    def fit(self, least: int, part: float = 1.0) -> bool:
        """Patterns of bins over `least` fitted to the histogram of the items left, `part` of their repeats taken; whether any was."""
        bins = min(BINS, self.capacity)
        edge = [self.capacity * b // bins for b in range(bins + 1)]  # bin b holds lengths edge[b-1]+1 .. edge[b]
        hist = np.add.reduceat(np.r_[self.stock.n[1 : self.capacity + 1], 0], edge[:-1])[:bins].astype(float)
        wide = [p for p in patterns(bins) if all(b > least for b in p) and all(hist[b - 1] > 0 for b in p)]
        if not wide:
            return False
        a = np.zeros((bins, len(wide)))
        for j, p in enumerate(wide):
            for b in p:
                a[b - 1, j] += 1
        # long items matter most: they are the hardest to place
        weight = np.sqrt(np.arange(1, bins + 1) / bins)
        x = np.floor(nnls(a * weight[:, None], hist * weight) * part + 1e-6).astype(np.int64)
        some = False
        for j in np.argsort([-max(p) for p in wide], kind="stable"):
            repeats = int(x[j])
            while repeats > 0:
                # the last bin gives way to the longest item that fits
                took = self.take([(edge[b - 1] + 1, edge[b]) for b in wide[j][:-1]], repeats)
                if not took:
                    break
                repeats -= took
                some = True
        return some


def plans(counts: np.ndarray, capacity: int) -> list[list[tuple[dict[int, int], int]]]:
    """Ways to use up counts[1..capacity]: patterns of bins over a tenth and over a quarter of the capacity, half of the repeats
    of the latter, and no fitted pattern at all."""
    bins, ways = min(BINS, capacity), []
    for least, part in ((bins // 10, 1.0), (bins // 4, 1.0), (bins // 4, 0.5), (bins, 0.0)):
        p = _Packer(counts, capacity)
        while part and p.fit(least, part) and part == 1.0:
            pass
        while p.stock.longest(capacity) > 0:
            p.take([], 1 << 60)
        ways.append(p.out)
    return ways


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: times} with their repeats: the plan of the fewest containers, fitted patterns first where plans are equal."""
    return min(plans(counts, capacity), key=lambda out: sum(times for _, times in out))


def packed(docs: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_id, doc_id, part, tokens, container_id) of every document under every specification."""
    sizes = saved(token_sizes(docs, (), vocabulary))
    # The specifications are parameters: a handful of rows, checked.
    wanted = {r.spec_id: int(r.capacity_tokens) for r in specs.select("spec_id", "capacity_tokens").where("spec_id is not null and capacity_tokens > 0").limit(1001).collect()}
    if len(wanted) > 1000:
        raise ValueError("over 1000 specifications")
    out = [_packed(sizes, s, c) for s, c in sorted(wanted.items())]
    if not out:
        return sizes.limit(0).select(F.lit(0).alias("spec_id"), "doc_id", F.lit(0).alias("part"), "tokens", F.lit(0).cast("long").alias("container_id"))
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole


def _packed(sizes: DataFrame, spec: int, capacity: int) -> DataFrame:
    parts = F.greatest(F.ceil(F.col("tokens") / F.lit(capacity)).cast("int"), F.lit(1))
    items = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select(
        "doc_id", "part", F.least(F.col("tokens") - F.col("part") * F.lit(capacity), F.lit(capacity)).cast("int").alias("length")
    )
    # Histogram: at most capacity + 1 rows, whatever the data's size.
    rows = items.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows:
        counts[r["length"]] = r["count"]
    total = int(counts.sum())
    slots, base = [], 0
    taken = np.zeros(capacity + 1, np.int64)
    for pattern, times in plan(counts, capacity):
        for x, k in pattern.items():
            for _ in range(k):
                slots.append((x, int(taken[x]), base))
                taken[x] += times
        base += times
    slots.sort()
    # Place of an item: the slot of its length that its rank falls in.  As many slots as patterns have items.
    lengths = np.array([s[0] for s in slots], np.int64)
    froms = np.array([s[1] for s in slots], np.int64)
    bases = np.array([s[2] for s in slots], np.int64)
    step = int(counts.max(initial=0)) + 1
    keys = lengths * step + froms

    buckets = max(1, -(-total // BUCKET))
    b = F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)).cast("int")
    items = items.withColumn("bucket", b)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "part")) - 1
    ranked = items.withColumn("r", rank).join(offsets, ["length", "bucket"]).select("doc_id", "part", "length", (F.col("r") + F.col("offset")).alias("rank"))

    def place(ids, part, length, rank):
        if ids:
            length_, rank_ = np.array(length, np.int64), np.array(rank, np.int64)
            at = np.searchsorted(keys, length_ * step + rank_, "right") - 1
            where = np.where(length_ == 0, 0, bases[at] + rank_ - froms[at]) if len(keys) else np.zeros(len(ids), np.int64)
            yield from zip([spec] * len(ids), ids, part, length, where.tolist())

    return map_arrow(ranked, place, "spec_id int, doc_id long, part int, tokens int, container_id long")


def fill(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, tokens, fill, overfull) of a packing: how full the containers are."""
    per = placed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    s = specs.select("spec_id", "capacity_tokens")
    return (
        per.join(s, "spec_id")
        .groupBy("spec_id")
        .agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity_tokens")).alias("fill"), F.sum((F.col("tokens") > F.col("capacity_tokens")).cast("long")).alias("overfull"))
    )

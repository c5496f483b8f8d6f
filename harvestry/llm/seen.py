"""Problem 7: has this key been seen before?

Method: Golomb-coded sets.  A key's 64-bit hash is reduced to a target range of
2**(range bits), range bits = log2(number of keys) + fp_bits; a set is the sorted
reduced hashes as compressed gaps (Golomb-Rice coded, parameter 2**fp_bits) in
blocks of 128 values, with the first value of each block as directory.  A probe
looks up the directory and decodes one block.

The range is cut into shards, so that a set grows with the cluster, not with a
task.  A shard takes its rows in order (earlier keys first, then the batches of
tasks in order of arrival): each batch's keys are probed against the sets of all
that came before, and those not seen become a set of their own.  Rows come sorted,
so that a set is coded as it streams by, CHUNK values at a time.  What a shard
keeps in memory is one chunk and compressed sets of about fp_bits + 1.5 bits a key.

Order inside a batch, and skew: before the shuffle, the rows of a key in a batch
become one (key, its first row by (arrived_at, task_id)) with a partial
aggregate, so that a key with a third of all rows weighs no more than another.
All rows are answered by difference: a row is new only if it is the first of its
key and the key was in no set; every other row with a key has been seen.

A set has no false negatives.  A false positive makes a new key "seen".  The sets
are disjoint parts of one range, so that a probe errs with the number of keys in
them over 2**(range bits), whatever the number of sets; that rate, over the keys
in the sets at the time of each probe, is reported beside the audited one.

Defined cases: rows without url or task_id are no cases; rows with one task_id
are one row; equal arrival times are told apart by task_id; null arrived_at comes
first; an empty history or batch gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128
#: Batches of arrivals: the more, the more rows the sets decide, not the first row of a key in its batch.
EPOCHS = 8


def key_of(url: Column) -> Column:
    """The url as a key: trimmed, without fragment, scheme and host in lower case, default port left out."""
    u = F.regexp_replace(url, r"(?s)^[\s\p{Z}]+|#.*|[\s\p{Z}]+$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    tail = F.substring(rest, F.length(authority) + 1, F.length(rest))
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    port = F.when(scheme == "http", F.regexp_replace(host, r":(?:80)?$", "")).when(scheme == "https", F.regexp_replace(host, r":(?:443)?$", "")).otherwise(host)
    return F.when(scheme == "", u).otherwise(F.concat(scheme, F.lit("://"), user, port, tail))


class GolombSet:
    """Sorted distinct integers as Golomb-Rice coded gaps in blocks; parameter 2**bits.

    A block has the remainders of its gaps, bits wide each, then their quotients in unary (ones ended by a zero); both
    parts start on a byte.
    """

    def __init__(self, values: np.ndarray, bits: int):
        v = np.asarray(values, np.uint64)
        self.n, self.bits = len(v), bits
        self.heads = v[::BLOCK].copy()
        blocks = len(self.heads)
        self.at = np.zeros(blocks + 1, np.int64)
        self.data = b""
        if not self.n:
            return
        gaps = np.diff(v, prepend=v[:1])
        gaps[::BLOCK] = 0
        quotient = (gaps >> np.uint64(bits)).astype(np.int64)
        block = np.arange(self.n) // BLOCK
        members = np.bincount(block)
        rem_bytes = (members * bits + 7) // 8
        ends = np.cumsum(quotient + 1)  # of each value's code in the unary stream of all blocks
        last = ends[np.minimum(np.arange(1, blocks + 1) * BLOCK, self.n) - 1]
        before = np.r_[0, last[:-1]]
        self.at[1:] = np.cumsum(rem_bytes + (last - before + 7) // 8)
        out = np.zeros(int(self.at[-1]) * 8, np.uint8)
        slot = 8 * self.at[:-1][block] + (np.arange(self.n) % BLOCK) * bits
        for k in range(bits):
            out[slot + k] = ((gaps >> np.uint64(bits - 1 - k)) & np.uint64(1)).astype(np.uint8)
        unary = 8 * (self.at[:-1] + rem_bytes)[block] - before[block] + ends - quotient - 1
        inner = np.arange(int(quotient.sum())) - np.repeat(np.cumsum(quotient) - quotient, quotient)
        out[np.repeat(unary, quotient) + inner] = 1
        self.data = np.packbits(out).tobytes()

    @property
    def nbytes(self) -> int:
        return len(self.data) + self.heads.nbytes + self.at.nbytes

    def block(self, b: int) -> np.ndarray:
        """The values of block b."""
        n, k = min(BLOCK, self.n - b * BLOCK), self.bits
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, int(self.at[b + 1] - self.at[b]), int(self.at[b])))
        rem = bits[: n * k].reshape(n, k) @ (np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64))
        zeros = np.flatnonzero(bits[(n * k + 7) // 8 * 8 :] == 0)[:n]
        quot = np.diff(zeros, prepend=-1) - 1
        return np.cumsum((quot.astype(np.uint64) << np.uint64(k)) + rem.astype(np.uint64)) + self.heads[b]

    def values(self) -> np.ndarray:
        return np.concatenate([self.block(b) for b in range(len(self.heads))]) if self.n else np.zeros(0, np.uint64)

    def contains(self, probes: np.ndarray) -> np.ndarray:
        """For sorted probes, whether each is in the set; only the blocks they fall in are decoded."""
        found = np.zeros(len(probes), bool)
        if not self.n or not len(probes):
            return found
        b = np.searchsorted(self.heads, probes, "right") - 1
        inside = b >= 0
        edges = np.flatnonzero(np.diff(b, prepend=-2))
        for i, e in enumerate(edges):
            if inside[e]:
                z = edges[i + 1] if i + 1 < len(edges) else len(probes)
                v = self.block(int(b[e]))
                p = probes[e:z]
                at = np.minimum(np.searchsorted(v, p), len(v) - 1)
                found[e:z] = v[at] == p
        return found


#: Values of a set that are held before they are coded.
CHUNK = 65_536


class SeenKeys:
    """Golomb-coded sets of all keys so far, in ranges of CHUNK values; a batch of sorted values becomes a set as it streams by."""

    def __init__(self, bits: int):
        self.bits = bits
        self.sets: list[list[GolombSet]] = []  # each in ascending ranges
        self.open: list[GolombSet] = []
        self.rest = np.zeros(0, np.uint64)

    def seen(self, probes: np.ndarray) -> np.ndarray:
        """For sorted probes, whether each is in a closed set."""
        out = np.zeros(len(probes), bool)
        for chunks in self.sets:
            starts = np.array([c.heads[0] for c in chunks], np.uint64)
            where = np.searchsorted(starts, probes, "right") - 1
            edges = np.flatnonzero(np.diff(where, prepend=-2))
            for i, e in enumerate(edges):
                z = edges[i + 1] if i + 1 < len(edges) else len(probes)
                if where[e] >= 0:
                    out[e:z] |= chunks[int(where[e])].contains(probes[e:z])
        return out

    def add(self, values: np.ndarray) -> None:
        """Sorted distinct values over all added since the last close()."""
        self.rest = np.r_[self.rest, values] if len(self.rest) else values
        while len(self.rest) >= CHUNK:
            self.open.append(GolombSet(self.rest[:CHUNK], self.bits))
            self.rest = self.rest[CHUNK:]

    def close(self) -> None:
        """The values added become a set."""
        if len(self.rest):
            self.open.append(GolombSet(self.rest, self.bits))
        if self.open:
            self.sets.append(self.open)
        self.open, self.rest = [], np.zeros(0, np.uint64)


def _shard_rows(fp_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (shard, epoch, r): the ids of keys that were not seen before.  Epoch -1 is the history."""
        names, kinds = ["task_id", "h"], [pa.int64(), pa.int64()]
        now, seen, last = None, None, None
        for b in batches:
            shard, epoch = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            r = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            t = b.column(3).to_numpy(zero_copy_only=False)
            h = b.column(4).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(epoch) != 0)) + 1
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(shard)]):
                if s == e:
                    continue
                at = (int(shard[s]), int(epoch[s]))
                if at != now:
                    if now is None or at[0] != now[0]:
                        seen = SeenKeys(fp_bits)
                    else:
                        seen.close()
                    now, last = at, None
                part = r[s:e]
                # two keys with one reduced hash are one key to the set: the later one counts as seen
                first = np.r_[last is None or part[0] != last, part[1:] != part[:-1]]
                last = part[-1]
                if at[1] >= 0:
                    first[first] = ~seen.seen(part[first])
                    if first.any():
                        yield pa.RecordBatch.from_arrays([pa.array(t[s:e][first], kinds[0]), pa.array(h[s:e][first], kinds[1])], names=names)
                seen.add(part[first])

    return run


def range_bits(rows: int, fp_bits: int) -> int:
    return min(62, math.ceil(math.log2(max(2, rows))) + fp_bits)


def first_seen(history: DataFrame, tasks: DataFrame, fp_bits: int = 24, epochs: int = EPOCHS, shards: int | None = None, rows: int | None = None) -> DataFrame:
    """(task_id, h): the rows whose key is new, by the sets.  history: (key); tasks: (task_id, key, arrived_at).

    rows bounds the number of keys from above; where the caller has none, the rows are counted.
    """
    spark = history.sparkSession
    bits = range_bits(history.count() + tasks.count() if rows is None else rows, fp_bits)
    shards = shards or 8 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    h = F.xxhash64("key")
    # the top bits are the reduced hash; shard and value both come from it, so that a shard is a range of the whole
    reduced = F.shiftrightunsigned("h", 64 - bits)
    cuts = tasks.select(F.percentile_approx(F.unix_micros(F.col("arrived_at").cast("timestamp")), [i / epochs for i in range(1, epochs)], 1000).alias("c")).first()[0] or [] if epochs > 1 else []
    stamp = F.coalesce(F.unix_micros(F.col("arrived_at").cast("timestamp")), F.lit(-(1 << 62)))
    epoch = F.lit(0)
    for c in sorted(set(cuts)):
        epoch = epoch + F.when(stamp > F.lit(int(c)), 1).otherwise(0)
    firsts = (
        tasks.select("task_id", h.alias("h"), stamp.alias("stamp"), epoch.alias("epoch"))
        .groupBy("h", "epoch")
        .agg(F.min(F.struct("stamp", "task_id")).alias("first"))
        .select("epoch", "h", F.col("first.task_id").alias("task_id"))
    )
    old = history.select(h.alias("h")).distinct().select(F.lit(-1).alias("epoch"), "h", F.lit(None).cast("long").alias("task_id"))
    # A shard is a range of the hashes: a set's gaps stay as small as in one set of all keys.
    shard = F.shiftright(F.shiftrightunsigned("h", 40) * F.lit(shards), 24).cast("int")
    both = old.union(firsts).select(shard.alias("shard"), "epoch", reduced.alias("r"), F.coalesce("task_id", F.lit(-1)).alias("task_id"), "h")
    return both.repartition("shard").sortWithinPartitions("shard", "epoch", "r").mapInArrow(_shard_rows(fp_bits), "task_id long, h long")


def history_of(items: DataFrame) -> DataFrame:
    return items.where("url is not null and method = 'GET'").select(key_of(F.col("url")).alias("key"))


def tasks_of(tasks: DataFrame) -> DataFrame:
    return tasks.where("url is not null and task_id is not null").select("task_id", key_of(F.col("url")).alias("key"), "arrived_at")


def _rows(items: DataFrame, tasks: DataFrame) -> int:
    """Rows of both tables, which parquet has in its footers."""
    return items.count() + tasks.count()


def seen_before(items: DataFrame, tasks: DataFrame, fp_bits: int = 24, epochs: int = EPOCHS) -> DataFrame:
    """task_id of every row whose key came up before."""
    t = tasks_of(tasks)
    new = first_seen(history_of(items), t, fp_bits, epochs, rows=_rows(items, tasks)).select("task_id")
    return t.select("task_id").distinct().join(new, "task_id", "left_anti")


def wrong_answers(items: DataFrame, tasks: DataFrame, fp_bits: tuple[int, ...] = (24, 8), epochs: int = EPOCHS) -> DataFrame:
    """(fp_bits, history_keys, task_keys, new_in_truth, new_by_sets, false_positives, theoretical_rate, audited_rate), a row for each
    of fp_bits: at the 24 bits in use no false positive is to be seen in a table of this size, at 8 there are enough to count.

    The theoretical rate is the expected number of false positives a new key: a new key errs with the keys before it, history
    and half of the new ones on the average, over the range.
    """
    hist, t = history_of(items), tasks_of(tasks)
    n = _rows(items, tasks)
    truth = (
        hist.select("key", F.lit(1).alias("old"))
        .union(t.select("key", F.lit(0).alias("old")))
        .groupBy("key")
        .agg(F.max("old").alias("old"), F.min("old").alias("task"))
        .agg(
            F.sum(F.when(F.col("old") == 1, 1).otherwise(0)).alias("history_keys"),
            F.sum(F.when(F.col("task") == 0, 1).otherwise(0)).alias("task_keys"),
            F.sum(F.when(F.col("old") == 0, 1).otherwise(0)).alias("new_in_truth"),
        )
    )
    none = F.lit(None).cast("long")
    # Every side is one row.
    both = truth.select(F.lit(0).alias("fp_bits"), "history_keys", "task_keys", "new_in_truth", none.alias("new_by_sets"))
    for b in fp_bits:
        new = first_seen(hist, t, b, epochs, rows=n).agg(F.countDistinct("h").alias("new_by_sets"))
        both = both.union(new.select(F.lit(b).alias("fp_bits"), none, none, none, "new_by_sets"))
    counts = {r.fp_bits: r for r in both.collect()}
    c, rows = counts[0], []
    old, task, new = (int(x or 0) for x in (c.history_keys, c.task_keys, c.new_in_truth))
    for b in fp_bits:
        wrong = new - counts[b].new_by_sets
        rows.append((b, old, task, new, counts[b].new_by_sets, wrong, (old + new / 2) / 2.0 ** range_bits(n, b) if new else 0.0, wrong / max(1, new)))
    return items.sparkSession.createDataFrame(rows, "fp_bits int, history_keys long, task_keys long, new_in_truth long, new_by_sets long, false_positives long, theoretical_rate double, audited_rate double")

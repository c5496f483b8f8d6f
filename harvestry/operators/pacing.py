"""Rate limits, backoff and running counts over arrival times, as prefix scans in blocks.

A limiter with burst 1 and interval d starts the i-th arrival at
max over j <= i of (arrival_j - j d) + i d, a running maximum; a throttle counter
that never falls under 0 is the running sum less its running minimum.  Sums, minima
and maxima of prefixes are associative, so that no host's rows have to be in one
task: arrivals are cut into blocks of time (`in_blocks`), each block of a host is
scanned by itself, what the blocks before it come to is carried in from one row a
block, and the two are put together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block, about; no result depends on it.
BLOCK_ROWS = 1_000_000


def per_second(per_minute: int) -> int:
    return math.ceil(per_minute / 60)


def in_blocks(df: DataFrame, time: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with _block, an ascending number of the stretch of time a row is in; stretches have about block_rows rows of all hosts."""
    n = min(10_000, -(-df.count() // block_rows))
    cuts = []
    if n > 1:
        cuts = df.select(F.percentile_approx(F.col(time).cast("double"), [i / n for i in range(1, n)], 20_000).alias("c")).first()[0] or []
    block = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))])
        block = F.aggregate(bounds, F.lit(0), lambda k, c: k + (F.col(time).cast("double") > c).cast("int"))
    return df.withColumn("_block", block)


def _windows(by: list[str], order: list[str]):
    """Window of a block's rows up to the current one, and of a host's blocks before the current one."""
    rows = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return rows, before


def _carried(df: DataFrame, by: list[str], sums: DataFrame) -> DataFrame:
    """df with the columns of sums (one row a block of a host), null hosts included."""
    keys = [*by, "_block"]
    more = [c for c in sums.columns if c not in keys]
    right = sums.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], *more)
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    return df.join(right, same).select(*df.columns, *more)


def schedule(df: DataFrame, time: str, order: list[str], interval_ms: float, by: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with start_ms: when each row's request may go out; time in milliseconds."""
    d = F.lit(interval_ms)
    w, before = _windows(by, [time, *order])
    out = in_blocks(df, time, block_rows).withColumn("_i", F.row_number().over(w) - 1)
    out = out.withColumn("_top", F.max(F.col(time) - F.col("_i") * d).over(w))
    sums = out.groupBy(*by, "_block").agg(F.count("*").alias("_n"), F.max("_top").alias("_m"))
    sums = sums.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = sums.withColumn("_high", F.max(F.col("_m") - F.col("_at") * d).over(before)).select(*by, "_block", "_at", "_high")
    out = _carried(out, by, sums)
    top = F.greatest(F.col("_high"), F.col("_top") - F.col("_at") * d)
    return out.withColumn("start_ms", top + (F.col("_at") + F.col("_i")) * d).drop("_i", "_top", "_at", "_high", "_block")


def backoff(df: DataFrame, throttled: Column, time: str, order: list[str], by: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with throttle (counter after the row: +1 when throttled, else -1, not under 0) and delay_s (min(2**(counter-1), 30))."""
    w, before = _windows(by, [time, *order])
    out = in_blocks(df, time, block_rows).withColumn("_s", F.sum(F.when(throttled, 1).otherwise(-1)).over(w)).withColumn("_l", F.min("_s").over(w))
    sums = out.groupBy(*by, "_block").agg(F.sum(F.when(throttled, 1).otherwise(-1)).alias("_t"), F.min("_l").alias("_m"))
    sums = sums.withColumn("_at", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    sums = sums.withColumn("_low", F.min(F.col("_m") + F.col("_at")).over(before)).select(*by, "_block", "_at", "_low")
    out = _carried(out, by, sums)
    low = F.least(F.col("_low"), F.col("_l") + F.col("_at"), F.lit(0))
    out = out.withColumn("throttle", F.col("_s") + F.col("_at") - low).drop("_s", "_l", "_at", "_low", "_block")
    return out.withColumn("delay_s", F.when(F.col("throttle") > 0, F.least(F.pow(F.lit(2.0), F.col("throttle") - 1), F.lit(30.0))).otherwise(F.lit(0.0)))


def failure_runs(df: DataFrame, failed: Column, time: str, order: list[str], by: list[str], limit: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with run (failures in a row up to the row, 0 on success) and stopped (a run of `limit` has been reached)."""
    w, before = _windows(by, [time, *order])
    out = in_blocks(df, time, block_rows).withColumn("_f", F.when(failed, 1).otherwise(0)).withColumn("_g", F.sum(1 - F.col("_f")).over(w))
    v = Window.partitionBy(*by, "_block", "_g").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_r", F.sum("_f").over(v))
    # of a block: whether it has a success, and the run at its end
    sums = out.groupBy(*by, "_block").agg(F.max("_g").alias("_ok"), F.max_by("_r", F.struct(time, *order)).alias("_v"))
    host = Window.partitionBy(*by).orderBy("_block")
    sums = sums.withColumn("_c", F.sum((F.col("_ok") > 0).cast("int")).over(host))
    part = Window.partitionBy(*by, "_c").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_t", F.sum("_v").over(part)).withColumn("_in", F.coalesce(F.lag("_t").over(host), F.lit(0))).select(*by, "_block", "_in")
    out = _carried(out, by, sums).withColumn("run", F.col("_r") + F.when(F.col("_g") == 0, F.col("_in")).otherwise(0))
    out = out.withColumn("_hit", F.max((F.col("run") >= limit).cast("int")).over(w))
    ends = out.groupBy(*by, "_block").agg(F.max("_hit").alias("_m"))
    ends = ends.withColumn("_was", F.coalesce(F.max("_m").over(before), F.lit(0))).select(*by, "_block", "_was")
    out = _carried(out, by, ends)
    return out.withColumn("stopped", F.greatest("_hit", "_was") == 1).drop("_f", "_g", "_r", "_in", "_hit", "_was", "_block")


def running_counts(df: DataFrame, time: str, order: list[str], counted: dict[str, Column], by: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with running counts by host: of each name, the rows so far that its test holds for."""
    w, before = _windows(by, [time, *order])
    out = in_blocks(df, time, block_rows)
    for name, test in counted.items():
        out = out.withColumn(name, F.sum(F.when(test, 1).otherwise(0)).over(w))
    sums = out.groupBy(*by, "_block").agg(*[F.max(name).alias(f"_n{i}") for i, name in enumerate(counted)])
    sums = sums.select(*by, "_block", *[F.coalesce(F.sum(f"_n{i}").over(before), F.lit(0)).alias(f"_at{i}") for i in range(len(counted))])
    out = _carried(out, by, sums)
    for i, name in enumerate(counted):
        out = out.withColumn(name, F.col(name) + F.col(f"_at{i}"))
    return out.drop("_block", *[f"_at{i}" for i in range(len(counted))])

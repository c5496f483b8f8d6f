"""Problem 9: mixing sources to target weights.

Method: entropy balancing.  Every document starts at rate 1; the rates nearest to
that in relative entropy whose tokens meet each source's target are tilted
exponentially, rate = min(cap, exp(l * tokens / scale)), one multiplier l a
source.  The convex dual is solved by distributed Newton iterations: each is one
aggregate over (source, tokens) that gives gradient and curvature of all sources
at once; a bracket guards the steps, because the cap makes the dual bend.  Rates
are rounded into copies against a hash of the document, and one threshold a
source, found in the aggregated gaps, makes the rounded tokens meet the target.

Nothing but sums a source (and, for the threshold, sums a source and bin) goes to
the driver; the number of sources is that of mix_targets.

Defined cases: sources are compared trimmed, in lower case, blanks and hyphens as
underscores; documents of null or unlisted sources are not used; null and empty
texts weigh nothing; repeated rows are one document; a source without tokens
reaches share 0.  The total is `fill` times the largest total that the repeat caps
allow, or `total` tokens if given and allowed.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import saved
from .tokens import VOCABULARY, token_sizes

BINS = 4096


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def _case(column: Column, values: dict[str, float]) -> Column:
    """A literal a source; the sources are those of mix_targets."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.element_at(F.create_map(*pairs), column)


def mixed(docs: DataFrame, targets: DataFrame, total: float | None = None, fill: float = 0.95, rounds: int = 60, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents used at least once."""
    want = {}
    rows = targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null and target_share > 0 and max_repeats > 0").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("over 10000 sources")
    for r in rows:
        want[r.s] = (float(r.target_share), int(r.max_repeats))
    sized = token_sizes(docs, ("source",), vocabulary).withColumn("source", source_name(F.col("source")))
    sized = saved(sized.where(F.col("source").isin(list(want))) if want else sized.limit(0))
    hist = saved(sized.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    have = {r.source: r for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens"), F.sum("n").alias("docs")).collect()}
    want = {s: v for s, v in want.items() if s in have and have[s].tokens > 0}
    if not want:
        return sized.limit(0).select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
    share = sum(v[0] for v in want.values())
    goal_share = {s: v[0] / share for s, v in want.items()}
    cap = {s: v[1] for s, v in want.items()}
    most = min(cap[s] * have[s].tokens / goal_share[s] for s in want)
    size = min(total, most) if total else fill * most
    goal = {s: goal_share[s] * size for s in want}
    scale = {s: have[s].tokens / have[s].docs for s in want}

    # Newton on the dual, all sources at once
    l = dict.fromkeys(want, 0.0)
    low, high = dict.fromkeys(want, -math.inf), dict.fromkeys(want, math.inf)
    src, t = F.col("source"), F.col("tokens")
    worst = 0.0
    for _ in range(rounds):
        rate = F.least(_case(src, cap), F.exp(F.least(_case(src, l) * t / _case(src, scale), F.lit(600.0))))
        free = rate < _case(src, cap)
        sums = hist.groupBy("source").agg(
            F.sum(F.col("n") * t * rate).alias("got"), F.sum(F.when(free, F.col("n") * t * rate * t / _case(src, scale)).otherwise(0.0)).alias("slope")
        )
        worst = 0.0
        for r in sums.collect():
            if r.source not in want:
                continue
            s, gap = r.source, r.got - goal[r.source]
            worst = max(worst, abs(gap) / goal[s])
            if gap > 0:
                high[s] = min(high[s], l[s])
            else:
                low[s] = max(low[s], l[s])
            step = l[s] - gap / r.slope if r.slope > 0 else math.nan
            if not low[s] < step < high[s]:
                if math.isinf(high[s]):
                    step = max(l[s], 0.01) * 2
                elif math.isinf(low[s]):
                    step = min(l[s], -0.01) * 2
                else:
                    step = (low[s] + high[s]) / 2
            if abs(gap) > 1e-9 * goal[s]:
                l[s] = step
        if worst < 1e-7:
            break
    else:
        warnings.warn(f"the mix is within {worst:.1e} of its targets after {rounds} rounds", stacklevel=2)

    rate = F.least(_case(src, cap), F.exp(F.least(_case(src, l) * t / _case(src, scale), F.lit(600.0))))
    u = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))
    rated = sized.where(src.isin(list(want))).select("doc_id", "source", "tokens", F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate) - u).alias("lead"))
    # lead > threshold: one copy more.  The threshold of a source comes from two rounds of sums in bins of the lead.
    cut, width = dict.fromkeys(want, -1.0), dict.fromkeys(want, 2.0)
    need = {r.source: goal[r.source] - float(r.tokens) for r in rated.groupBy("source").agg(F.sum(F.col("base") * F.col("tokens")).alias("tokens")).collect()}
    for _ in range(3):
        inside = F.col("lead") - _case(src, cut)
        b = F.floor(inside / _case(src, width) * F.lit(BINS)).cast("int")
        bins = rated.where((F.col("base") < _case(src, cap)) & (inside >= 0) & (inside < _case(src, width))).groupBy("source", b.alias("b")).agg(F.sum("tokens").alias("tokens"))
        by: dict[str, list[tuple[int, int]]] = {}
        for r in bins.collect():
            by.setdefault(r.source, []).append((r.b, r.tokens))
        for s, xs in by.items():
            step = width[s] / BINS
            found = False
            for k, tokens in sorted(xs, reverse=True):
                if tokens > need[s]:
                    cut[s], width[s], found = cut[s] + k * step, step, True
                    break
                need[s] -= tokens
            if not found:
                width[s] = 0.0  # all of this source's leads fit
        for s in want:
            if s not in by:
                width[s] = 0.0
        if not any(width.values()):
            break
    # Of the last bin either none or all, whichever is nearer; it holds leads within 2 / BINS**3 of each other.
    edge = {s: cut[s] + width[s] for s in want}
    copies = F.col("base") + F.when((F.col("base") < _case(src, cap)) & (F.col("lead") >= _case(src, edge)), 1).otherwise(0)
    return rated.select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_copies, tokens, actual_share) of a mix."""
    per = mix.groupBy("source").agg(F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    # as many rows as sources
    out = t.join(per, "source", "left").withColumn("whole", F.sum("tokens").over(Window.partitionBy()))
    return out.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
    )

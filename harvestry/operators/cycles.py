"""Addresses that repeat themselves: traps of endless paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An address is a cycle if it is longer than this many bytes, or its best repetition is a unit of over UNIT bytes, TIMES times.
LONGEST, TIMES, UNIT = 2_097_152, 10, 10
#: Necessary for a repetition that makes a cycle; most addresses are done with it, in the JVM.
HINT = r"(?s)(.{11,}?)\1{9}"


def best_repetition(text: str, least_times: int = 2) -> tuple[str, int] | None:
    """(unit, times) of the repetition with most times in a row; of equal ones the longer unit, then the first place.

    Runs of bytes equal to the byte one unit later are measured for each length of a unit at once: a run of r bytes is
    r // unit + 1 times.
    """
    a = np.frombuffer(text.encode(), np.uint8)
    n, best, unit = len(a), 1, b""
    for size in range(1, n // least_times + 1):
        same = np.r_[False, a[size:] == a[:-size], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        if not len(edge):
            continue
        start, run = edge[::2], edge[1::2] - edge[::2]
        k = int(np.argmax(run // size))
        times = int(run[k]) // size + 1
        if times > 1 and times >= best:
            best, unit = times, a[start[k] : start[k] + size].tobytes()
    return (unit.decode(errors="replace"), best) if best > 1 else None


def is_cycle(text: str) -> bool:
    if len(text.encode()) > LONGEST:
        return True
    # a unit repeated TIMES times is at most a TIMES-th of the text
    found = best_repetition(text, TIMES)
    return found is not None and found[1] >= TIMES and len(found[0].encode()) > UNIT


def without_cycles(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose address is no cycle; null stays.  Only addresses with the hint go through Python."""
    hint = F.coalesce(F.col(url).rlike(HINT) | (F.octet_length(url) > LONGEST), F.lit(False))
    at = df.columns.index(url)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not is_cycle(x) for x in b.column(at).to_pylist()], pa.bool_()))

    return df.where(~hint).union(df.where(hint).mapInArrow(run, df.schema))

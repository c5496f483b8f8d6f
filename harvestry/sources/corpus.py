"""Sources: a stored corpus in place of live fetches, inputs, resume files, configuration."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U


def responses(spark: SparkSession, path: str, body_limit: int | None = None) -> DataFrame:
    """Stored answers, one row each; bodies cut after body_limit bytes, broken characters replaced."""
    df = spark.read.parquet(path)
    if body_limit is not None:
        df = df.withColumn("body", cap_body("body", body_limit))
    return df


def cap_body(body: str | Column, limit: int) -> Column:
    """At most `limit` bytes of UTF-8; a character cut in two becomes the replacement character."""
    raw = F.encode(U.text(body), "UTF-8")
    cut = F.substring(raw, 1, limit)
    return F.when(F.octet_length(raw) <= limit, U.text(body)).otherwise(F.make_valid_utf8(cut.cast("string")))


def inputs(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ord, url) of input lines: trimmed, empty ones dropped, each once at its first place.  lines has an `ord` column."""
    t = lines.select("ord", F.trim(F.col(column)).alias("url")).where("url <> ''")
    return t.groupBy("url").agg(F.min("ord").alias("ord")).select("ord", "url")


def comma_list(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(U.text(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def seeds(df: DataFrame, column: str = "url") -> DataFrame:
    return df.withColumn(column, U.with_scheme(F.trim(F.col(column))))


def resume(text: str) -> list[str]:
    """Addresses in flight of a saved state, in either form."""
    state = json.loads(text)
    found = state.get("in_flight_urls", state.get("InFlightUrls", []))
    return list(found) if isinstance(found, dict) else [str(x) for x in found]


def save_state(urls: list[str]) -> str:
    return json.dumps({"in_flight_urls": urls})


def flags(text: str) -> dict[str, str]:
    """A configuration file of "flag: value" lines; # starts a comment."""
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if ":" in line:
            k, v = line.split(":", 1)
            out[k.strip()] = v.strip().strip("\"'")
    return out


def headers(lines: list[str]) -> dict[str, str]:
    """"Key: Value" lines; the last of a name wins."""
    return {k.strip(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}


def with_fallback(dynamic: DataFrame, static: DataFrame, key: str, column: str = "body") -> DataFrame:
    """Rendered bodies, and the plain ones where rendering gave none."""
    d = dynamic.select(key, F.col(column).alias("_dynamic"))
    return static.join(d, key, "left").withColumn(column, F.coalesce(F.nullif("_dynamic", F.lit("")), F.col(column))).drop("_dynamic")

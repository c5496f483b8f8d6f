"""Small text and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import saved  # noqa: F401 - used by the operators

CODE = re.compile(r"^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z)|(?<!`)(`+)(?!`)[^\n]*?[^`\n]\1(?!`)", re.S | re.M)


def without_code(text: str) -> str:
    """text with fenced blocks and inline code taken out."""
    return CODE.sub(" ", text) if "`" in text else text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Rows through fn(*columns as lists) -> rows, batch by batch, over Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(fn(*(c.to_pylist() for c in b.columns)))
            cols = list(zip(*rows)) if rows else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    return df.mapInArrow(run, schema)


def site_of(url: str | Column) -> Column:
    """Host of a url: lower case, without user, port and a leading www.; null where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))



def maybe_among(df: DataFrame, key: str, ids: DataFrame, bits: int = 22) -> DataFrame:
    """Rows of df whose key may be among ids (one column, `id`): a hashed bitmap of 2**bits bits thins df before a join.

    The bitmap is a table of 2**bits / 32768 rows of 4 KB (half a megabyte by default), whatever the data's size; that is
    the bound of the broadcast.  Where ids are so many that it fills up, all rows pass: the join after it is exact.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    maps = ids.select(place("id").alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("_map"))
    rows = df.withColumn("_p", place(key)).withColumn("_bucket", F.expr("bitmap_bucket_number(_p)")).withColumn("_at", F.expr("bitmap_bit_position(_p)"))
    octet = F.conv(F.hex(F.substring(F.col("_map"), (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = octet.bitwiseAND(F.pow(F.lit(2), F.col("_at") % 8).cast("int")) != 0
    return rows.join(F.broadcast(maps), "_bucket").where(hit).drop("_bucket", "_map", "_p", "_at")

"""The test tables as the engine reads them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def once(df: DataFrame) -> DataFrame:
    """One row for each value of the first column.  It comes after the projection: what is shuffled is the result, not the body."""
    return df.dropDuplicates([df.columns[0]])


def each(df: DataFrame, key: str, values: Column, *names: str) -> DataFrame:
    """(key, value) or (key, place, value) of arrays, repeated rows taken once as whole arrays."""
    arrays = once(df.select(key, values.alias("_v")))
    return arrays.select(key, (F.posexplode if len(names) == 2 else F.explode)("_v").alias(*names))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers with an address.  Rows are repeated as they are; see once()."""
    return read(spark, d, "responses").where("response_id is not null and url is not null")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "page_ir").where("page_id is not null")


def items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "queue_items").where("item_id is not null and url is not null")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("doc_id is not null")


RESPONSES = "(SELECT DISTINCT ON (response_id) * FROM responses WHERE response_id IS NOT NULL AND url IS NOT NULL)"
PAGES = "(SELECT DISTINCT ON (page_id) * FROM page_ir WHERE page_id IS NOT NULL)"
ITEMS = "(SELECT DISTINCT ON (item_id) * FROM queue_items WHERE item_id IS NOT NULL AND url IS NOT NULL)"
DOCUMENTS = "(SELECT DISTINCT ON (doc_id) * FROM documents WHERE doc_id IS NOT NULL)"

"""Queries of the problems: name -> function of (spark, directory of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import furniture, markup, mixing, neardup, packing, repeated, residue, seen, sentences, stuffing
from .text import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.template_residue(read(spark, d, "page_ir"))


def p1_evidence(spark: SparkSession, d: str) -> DataFrame:
    return residue.evidence(read(spark, d, "page_ir"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.keyword_pages(read(spark, d, "page_ir"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated.repeated_lines(read(spark, d, "page_ir")).select("site", "line")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeated.without_repeated(read(spark, d, "page_ir"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture.furniture_lines(read(spark, d, "page_ir"))


def p4_main_body(spark: SparkSession, d: str) -> DataFrame:
    return furniture.main_bodies(read(spark, d, "page_ir"))


def p4_response_body(spark: SparkSession, d: str) -> DataFrame:
    return furniture.response_bodies(read(spark, d, "responses"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_kinds(read(spark, d, "page_ir"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_pages(read(spark, d, "page_ir"))


def p5_response_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_responses(read(spark, d, "responses"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.all_pairs(*neardup.similar(read(spark, d, "page_ir"), "page_id", "markdown_ir", 3, 0.6, 100))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(read(spark, d, "page_ir"), "page_id", "markdown_ir", 3, 0.6, 100)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(read(spark, d, "queue_items"), read(spark, d, "crawl_tasks"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return seen.wrong_answers(read(spark, d, "queue_items"), read(spark, d, "crawl_tasks"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(read(spark, d, "documents"), read(spark, d, "pack_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d), read(spark, d, "pack_specs"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), read(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(read(spark, d, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}

"""The queries of this subpackage, with production parameters, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), with_text=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_digest

    return contamination_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe

    return bpe(_read(spark, sf_dir, "documents"), common.tokenizer_file("byte_bpe_50k.json"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_read(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_read(spark, sf_dir, "pages"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest_neighbours

    return nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), common.tokenizer_file("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(_read(spark, sf_dir, "documents"), common.tokenizer_file("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_suffix_dedup, op3_decontamination, op4_bpe, op5_warc, op6_neighbours, op7_near_duplicates, op8_license_scan, op9_token_counts, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    from . import licenses

    return {"op8_license_scan": licenses.oracle()}

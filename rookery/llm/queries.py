"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .bpe import encode_documents
from .common import table
from .decontam import contamination
from .htmlextract import extract
from .langid import languages
from .licenses import license_scan
from .quality import quality
from .simhash import simhash_groups
from .suffixdedup import repeated_bytes
from .toxicity import toxicity
from .urlfilter import filter_urls


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle_words=3, radius=2)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_license_scan,
        op3_simhash_near_dedup,
        op4_bpe,
        op5_html_extraction,
        op6_toxicity,
        op7_decontamination,
        op8_language_id,
        op9_suffix_array_dedup,
        op10_quality_rules,
    )
}
ORACLE_SQL = {
    "op1_url_filters": sql.OP1,
    "op5_html_extraction": sql.OP5,
    "op7_decontamination": sql.OP7,
    "op9_suffix_array_dedup": sql.OP9,
}

"""The registered queries of the corpus operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import oracle
from lorespark.llm.bpe import encode_decode, token_counts
from lorespark.llm.common import read_table, vocabulary
from lorespark.llm.decontaminate import contamination
from lorespark.llm.embedding_dedup import near_duplicates
from lorespark.llm.html_extract import extract
from lorespark.llm.jaccard_join import jaccard_components
from lorespark.llm.language_id import identified
from lorespark.llm.license_scan import scan_licenses
from lorespark.llm.mixing import mixed
from lorespark.llm.pii import pseudonymised, session_key
from lorespark.llm.spelling import spelling_groups
from lorespark.llm.token_histogram import length_histogram
from lorespark.llm.toxicity import scored
from lorespark.llm.whitening import whitened


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(read_table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_counts(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(read_table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark), extra=["doc_id"])


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read_table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_html_extraction": op4_html_extraction,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_whitening": op11_whitening,
    "op12_spelling": op12_spelling,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": oracle.JACCARD,
    "op7_decontamination": oracle.DECONTAMINATION,
    "op12_spelling": oracle.SPELLING,
}

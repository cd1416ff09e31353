"""The queries op1 to op13: each applies its operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, licenses, media, mixing, negatives, pieces, pii, quality, repeats, secrets, simhash, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store_texts(table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("text_key")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


#: Where the vocabulary files of public tokenizers are: the package `public_tokenizers` if it can be imported, else this folder.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    try:
        from public_tokenizers import path
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return path(name)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_report(table(spark, sf_dir, "documents"), pieces.read_vocabulary(tokenizer_path("piece_bpe_32k.model")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_media_columns, op3_suffix_dedup, op4_secret_scan, op5_decontaminate, op6_license_scan, op7_personal_data, op8_quality_classifier, op9_simhash, op10_mix_sources, op11_sentencepiece, op12_hard_negatives, op13_vector_codes)}

ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate.SQL,
    "op6_license_scan": licenses.SQL,
    "op10_mix_sources": mixing.MIX_SQL.format(docs="documents") + mixing.MIX_SELECT,
    "op12_hard_negatives": negatives.SQL,
    "op13_vector_codes": codes.SQL,
}

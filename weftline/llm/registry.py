"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, conversations, grid_join, language, licenses, main_text, minhash, mixing, quality, search, sql, token_shards, toxicity, warc
from .common import table

VOCAB = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, public_tokenizers.path(VOCAB), public_tokenizers.PATTERN)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return rated.drop("text_digest", "lang")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).drop("text_digest")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), end_id=1)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_fertility": op2_fertility,
        "op3_licenses": op3_licenses,
        "op4_language": op4_language,
        "op5_grid_join": op5_grid_join,
        "op6_minhash": op6_minhash,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_warc": op8_warc,
        "op9_mixing": op9_mixing,
        "op10_main_text": op10_main_text,
        "op11_search": op11_search,
        "op12_token_shards": op12_token_shards,
        "op13_conversations": op13_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licenses": sql.op3(licenses.KNOWN, licenses.ALIKE, licenses.TITLE, licenses.COPYRIGHT, licenses.NUMBER, licenses.NOT_WORD),
        "op5_grid_join": sql.OP5,
        "op6_minhash": sql.OP6,
        "op8_warc": sql.OP8,
        "op9_mixing": sql.OP9,
        "op11_search": sql.OP11,
        "op13_conversations": sql.op13(),
    }

"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, jaccard_join, language, mixing, pii, pseudo_likelihood, secrets, sentencepiece_bpe, spans, tiff, token_store
from .common import table

#: Vocabulary files are a parameter of the operators; these are their production values.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), PIECES))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), percent=85, width=4)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digests(secrets.scan(table(spark, sf_dir, "documents")), secrets.KINDS)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digests(pii.scan(table(spark, sf_dir, "documents")), pii.KINDS)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), BYTES)


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.store_documents(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_mixing, op3_pseudo_likelihood, op4_jaccard_join, op5_secrets, op6_embedding_dedup, op7_language, op8_pii, op9_token_store, op10_tiff)}
SQL: dict[str, str] = {}

"""A corpus pipeline of five stages, each of which writes Parquet that the next one reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, mixing, neardup, pii, quality
from tessella.llm.common import shared_folder
from tessella.llm.registry import pattern, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the robust distances reject go, those without text among them; repeated rows share a
    verdict, a null language or source is one of its own. An empty table stays empty; extra columns of any name stay."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity of 0.8 or more.
    The least id stays (of equal rows one); rows without words or id are in no group and stay. An empty table stays empty;
    extra columns of any name stay."""
    return neardup.keep_one(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows the text. Null and empty texts, repeated
    rows and extra columns of any name stay as they are; an empty table stays empty."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents are repeated, cut or left out (those without
    words always). A null source is one source. Reruns agree, equal keys too. An empty table stays empty; extra columns of
    any name stay."""
    return mixing.take(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (packed little-endian unsigned 32-bit integers), number of tokens and whether
    decoding gives the text back. A null text has no token. Columns of `docs` that are called as the new ones or `decoded`
    are replaced; repeated rows and all other columns stay; an empty table stays empty."""
    docs = docs.drop("token_ids", "n_tokens", "round_trip", "decoded")
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode(docs, path, pattern(), back="decoded")
    own = [f"`{c}`" for c in docs.columns]
    return done.selectExpr(*own, "token_ids", "CAST(length(token_ids) / 4 AS BIGINT) AS n_tokens", "decoded = CAST(coalesce(text, '') AS BINARY) AS round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("encoding", encoding),
]

#: Robust estimates, the forest and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{where}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

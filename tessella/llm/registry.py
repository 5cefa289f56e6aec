"""The queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, chat, licenses, mixing, neardup, pii, quality, secrets, token_counts, transport
from tessella.llm.common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; tokenizers are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License and holder of every row of `documents`, at paths that a view gives them. A null or empty text has no license
    of its own and inherits; ties of similarity go to the first template by name; no extra column is read."""
    return licenses.license_report(spark, sf_dir)


def op2_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`; see `pii.pii_digest` for nulls, empty texts and repeated rows.
    Texts of any length are decoded in linear time; decoding is deterministic, so reruns agree."""
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op3_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` stored as a transport stream and read back; a null text is empty (64 zero bytes),
    equal texts give equal values, repeated rows stay, extra columns are not read."""
    return transport.media_digest(table(spark, sf_dir, "documents"))


def op4_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every row of `documents`; see `quality.quality_report`. A null text has no words and is
    rejected by the base rule; equal texts of one language and source get equal verdicts."""
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op5_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text of `documents` as hashes; a null text is empty and has no token. Equal ranks can't
    occur; of equal pairs the leftmost merges first. Repeated rows stay, extra columns are not read."""
    return bpe.encode_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates among all `documents`, shingles of two words; see `neardup.near_duplicates`. A null or
    blank text is linked with nothing, rows without id stay, repeated rows share a component."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op7_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of `documents`; see `secrets.secret_digest`. A null text is empty; of formats of equal
    likelihood the first as listed stands; repeated rows stay."""
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all `documents`; see `mixing.mix_digest`. A null text has size 0, a null source comes last; equal keys are
    ordered by id, then by a hash of the row."""
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of `documents`; a null text is empty and has 0 tokens. Texts of any length are
    counted chunk by chunk; repeated rows stay, extra columns are not read."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every pair of `conversations` and for what stays alone; see `chat.preference_report`. Turns of equal number
    are ordered by role and text; an empty table gives an empty result."""
    return chat.preference_report(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_pii_semi_markov, op3_transport_streams, op4_robust_quality, op5_bpe_merge_replay, op6_minhash_forest, op7_secret_automata, op8_source_mix, op9_token_counts, op10_preference_pairs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.ORACLE, "op6_minhash_forest": neardup.ORACLE, "op8_source_mix": mixing.ORACLE}

"""Normalised records, corpus statistics and token weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import similarity as S
from tessella.functions import text as T

MIN_LEN = 3


def normalise(records: DataFrame) -> DataFrame:
    """Rows (entity_id, source, id_num, country, nc, nd, addr_toks, numbers, nsq, latin) from source records
    (entity_id, business_name, business_address, country); nulls count as ''."""
    name, address, country = (F.coalesce(F.col(c), F.lit("")) for c in ("business_name", "business_address", "country"))
    as_set = lambda c: F.sort_array(F.array_distinct(c))
    folded = records.select(
        "entity_id",
        F.substring("entity_id", 2, 1).try_cast("tinyint").alias("source"),
        F.regexp_extract("entity_id", "^S[0-9]-([0-9]+)$", 1).try_cast("bigint").alias("id_num"),
        country.alias("country"),
        T.fold(name).alias("name"),
        T.fold(address).alias("address"),
        T.is_latin(name).alias("latin"),
    )
    # each step is used several times by the next, so it is computed once
    cored = folded.withColumn("core", T.let(T.tokens(F.col("name")), T.core_of))
    return cored.select(
        "entity_id",
        "source",
        "id_num",
        "country",
        as_set(F.col("core")).alias("nc"),
        as_set(T.distinctive_of(F.col("core"))).alias("nd"),
        as_set(T.address_tokens_of(F.col("address"), F.col("country"))).alias("addr_toks"),
        T.numeric_tokens_of(F.col("address")).alias("numbers"),
        T.name_squash_of(F.col("name")).alias("nsq"),
        "latin",
    )


def channel_tokens(norm: DataFrame, least: int = MIN_LEN) -> DataFrame:
    """Rows (entity_id, channel, token): distinct name (n) and address (a) tokens of at least `least` characters."""
    both = F.concat(F.transform("nc", lambda t: F.struct(F.lit("n").alias("channel"), t.alias("token"))), F.transform("addr_toks", lambda t: F.struct(F.lit("a").alias("channel"), t.alias("token"))))
    return norm.select("entity_id", F.explode(both).alias("x")).select("entity_id", "x.channel", "x.token").filter(F.length("token") >= least)


def corpus_stats(norm: DataFrame, sample_every: int = 1) -> tuple[DataFrame, DataFrame]:
    """(channel, token, df) and one row (n_docs) of the sources to be searched; `sample_every` keeps ids divisible by it."""
    pool = norm.filter("source <> 1")
    if sample_every > 1:
        pool = pool.filter(F.pmod("id_num", F.lit(sample_every)) == 0)
    return channel_tokens(pool).groupBy("channel", "token").agg(F.count("*").alias("df")), pool.agg(F.count("*").alias("n_docs"))


def document_count(n_docs: DataFrame) -> int:
    """The one number that weights need from a corpus; at least 1."""
    return max(1, n_docs.first()[0])


def idf(df: DataFrame, n_docs: int) -> DataFrame:
    """Rows (channel, token, df, idf); tokens that are not in it weigh ln(n_docs)."""
    return df.withColumn("idf", F.log(F.lit(float(n_docs)) / (F.col("df") + 1)))


def weigh(norm: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """`norm` with, for each channel c of n (name) and a (address): rare_c (tokens of MIN_LEN or more, rarest first,
    ties by token, as structs of df and token), tag_c (every token with its df before it), sum_c and square_c.

    Tokens under MIN_LEN characters are in no statistics and so weigh most.
    """
    joined = channel_tokens(norm, 1).join(idf(df, n_docs), ["channel", "token"], "left")
    ceiling = math.log(n_docs)
    entry = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", F.coalesce("idf", F.lit(ceiling)).alias("idf"))
    by = joined.groupBy("entity_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("channel") == c, entry))).alias(f"all_{c}") for c in "na"))
    cols = []
    for c in "na":
        every = F.coalesce(f"all_{c}", F.array().cast("array<struct<df:bigint,token:string,idf:double>>"))
        cols += [
            F.transform(F.filter(every, lambda x: F.length(x["token"]) >= MIN_LEN), lambda x: F.struct(x["df"].alias("df"), x["token"].alias("token"))).alias(f"rare_{c}"),
            F.transform(every, lambda x: S.tagged(x["df"], x["token"])).alias(f"tag_{c}"),
            F.aggregate(every, F.lit(0.0), lambda s, x: s + x["idf"]).alias(f"sum_{c}"),
            F.aggregate(every, F.lit(0.0), lambda s, x: s + x["idf"] * x["idf"]).alias(f"square_{c}"),
        ]
    return norm.join(by, "entity_id", "left").select(*norm.columns, *cols)


def country_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("country").agg(F.count("*").alias("n_records"))


def keep_every(id_num: Column, n: int) -> Column:
    """The holdout predicate: ids divisible by n; ids that are no numbers fail."""
    return F.coalesce(F.pmod(id_num, F.lit(n)) == 0, F.lit(False))


def chunk_of(id_num: Column, k: int, n_chunks: int, outer_every: int = 1) -> Column:
    """Ids divisible by `outer_every` whose quotient leaves rest k by `n_chunks`; everything if both are 1 or less."""
    if n_chunks <= 1 and outer_every <= 1:
        return F.lit(True)
    outer = max(1, outer_every)
    return keep_every(id_num, outer) & F.coalesce(F.pmod(F.floor(id_num / outer), F.lit(max(1, n_chunks))) == k, F.lit(False))

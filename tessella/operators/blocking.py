"""Candidate pairs: blocking keys, capped postings and the probe join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Blocking:
    """Tokens rarer than `df_cap` are keys by themselves; keys with more than `max_posting` reference records go."""

    df_cap: int = 60
    n_addr_keys: int = 3
    n_name_keys: int = 2
    max_posting: int = 200


KEY = "struct<family:string,t1:string,t2:string>"


def _key(family: str, t1: Column, t2: Column | None = None) -> Column:
    return F.struct(F.lit(family).alias("family"), t1.alias("t1"), (t2 if t2 is not None else F.lit("")).alias("t2"))


def keys(weighed: DataFrame, how: Blocking = Blocking()) -> DataFrame:
    """Rows (entity_id, source, country, family, t1, t2), one for each distinct key of a record.

    a, n: a rare address or name token; x: name and address token; y: the two rarest address tokens in that order;
    z: the two rarest name tokens; d: one of the first two numbers with the rarest address token.
    """
    top_a, top_n = F.slice("rare_a", 1, how.n_addr_keys), F.slice("rare_n", 1, how.n_name_keys)
    single = lambda family, top: F.transform(F.filter(top, lambda x: x["df"] <= how.df_cap), lambda x: _key(family, x["token"]))
    x = F.flatten(F.transform(F.slice(top_n, 1, 2), lambda n: F.transform(F.slice(top_a, 1, 2), lambda a: _key("x", n["token"], a["token"]))))
    none = F.array().cast(f"array<{KEY}>")
    two = lambda family, rare: F.when(F.size(rare) >= 2, F.array(_key(family, F.get(F.col(rare), F.lit(0))["token"], F.get(F.col(rare), F.lit(1))["token"]))).otherwise(none)
    d = F.when(F.size("rare_a") > 0, F.transform(F.slice("numbers", 1, 2), lambda m: _key("d", m, F.get("rare_a", F.lit(0))["token"]))).otherwise(none)
    every = F.array_distinct(F.concat(single("a", top_a), single("n", top_n), x, two("y", "rare_a"), two("z", "rare_n"), d))
    return weighed.select("entity_id", "source", "country", F.explode(every).alias("k")).select("entity_id", "source", "country", "k.family", "k.t1", "k.t2")


PARTS = ["country", "family", "t1", "t2"]


def postings(keyed: DataFrame, how: Blocking = Blocking(), chunk: str | None = None) -> DataFrame:
    """Rows (country, family, t1, t2, s1_id) of the reference source, without keys over the cap. With `chunk`, a column
    of `keyed`, the cap holds for each chunk by itself."""
    own = keyed.filter("source = 1")
    by = PARTS + ([chunk] if chunk else [])
    full = own.groupBy(*by).agg(F.count("*").alias("posting")).filter(F.col("posting") <= how.max_posting).drop("posting")
    return own.join(full, by, "left_semi").select(*PARTS, F.col("entity_id").alias("s1_id"))


def candidate_pairs(keyed: DataFrame, how: Blocking = Blocking(), chunk: str | None = None) -> DataFrame:
    """Distinct rows (s1_id, target_id) that share a key. Frequent keys are gone before the join, so that none of its
    groups has more than `max_posting` times the records that look for it."""
    return probe(keyed, postings(keyed, how, chunk))


def probe(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct rows (s1_id, target_id) of the targets in `keyed` that share a key with `index`, made by `postings`."""
    looked = keyed.filter("source <> 1").select(*PARTS, F.col("entity_id").alias("target_id"))
    return looked.join(index, PARTS).select("s1_id", "target_id").distinct()


def index_stats(keyed: DataFrame, how: Blocking = Blocking()) -> DataFrame:
    """Rows (family, n_keys, dropped_keys, postings) of the reference source."""
    n = keyed.filter("source = 1").groupBy(*PARTS).agg(F.count("*").alias("posting"))
    kept = F.col("posting") <= how.max_posting
    return n.groupBy("family").agg(F.count_if(kept).alias("n_keys"), F.count_if(~kept).alias("dropped_keys"), F.coalesce(F.sum(F.when(kept, F.col("posting"))), F.lit(0)).alias("postings"))

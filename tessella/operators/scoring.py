"""The rule score of candidate pairs, the gate before it, and choices by score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import similarity as S
from tessella.functions.text import gram_codes, sorted_text

#: A pair whose name and address similarities both lie below is dropped.
GATE = 0.10
PREFILTER = 0.34
TOP_K = 40


@dataclass(frozen=True)
class Weights:
    """Weights within and between channels; `trust` scales a score by its evidence (name 1, address 2, number 4)."""

    name_idf: float = 0.45
    name_contained: float = 0.20
    name_grams: float = 0.35
    addr_idf: float = 0.60
    addr_grams: float = 0.40
    name: float = 0.45
    addr: float = 0.42
    num: float = 0.13
    cos_low: float = 0.70
    cos_high: float = 0.95
    trust: tuple[float, ...] = (0.00, 0.45, 0.90, 1.00, 0.25, 0.55, 0.95, 1.00)


RECORD = ("tag_n", "nd", "tag_a", "numbers", "latin", "sum_n", "sum_a", "square_n", "square_a")


def with_records(pairs: DataFrame, weighed: DataFrame) -> DataFrame:
    """`pairs` (s1_id, target_id, ...) with both records' columns, prefixed p_ (reference) and q_ (target). Tokens come
    with their frequencies, character n-grams (ng of names, ag of addresses) as 16-bit numbers: made once for a record,
    before the join, and not at all where nothing asks for them."""
    w = weighed.withColumns({"ng": gram_codes(F.col("nsq")), "ag": gram_codes(sorted_text(F.col("addr_toks")))})
    one = w.filter("source = 1").select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"p_{c}") for c in (*RECORD, "ng", "ag")))
    two = w.filter("source <> 1").select(F.col("entity_id").alias("target_id"), *(F.col(c).alias(f"q_{c}") for c in (*RECORD, "ng", "ag")))
    return pairs.join(one, "s1_id").join(two, "target_id")


def once(d: DataFrame, made: dict[str, Column]) -> DataFrame:
    """`d` with the columns `made`, computed once for a row. Catalyst takes a filter below a projection, and with it all that
    the filtered columns are computed from, once more for each mention; it doesn't take one below a generator."""
    return d.select(*(F.col(c) for c in d.columns if c not in made), F.inline(F.array(F.struct(*(c.alias(k) for k, c in made.items())))))


def overlaps(joined: DataFrame) -> DataFrame:
    """`joined` with what the sets of tokens and n-grams share: in_n and in_a (tagged tokens), in_nd, and the numbers of
    shared n-grams, in_ng and in_ag. Every similarity follows from these and the sets' sizes."""
    both = lambda c: F.array_intersect(f"p_{c}", f"q_{c}")
    return once(joined, {"in_n": both("tag_n"), "in_a": both("tag_a"), "in_nd": F.size(both("nd")).cast("double"), "in_ng": F.size(both("ng")).cast("double"), "in_ag": F.size(both("ag")).cast("double")})


def of(measure, shared: str, c: str) -> Column:
    """A measure of similarity.py over a set's columns and what they share (tokens, or their number)."""
    i = F.size(shared).cast("double") if shared in ("in_n", "in_a") else F.col(shared)
    return measure(F.col(f"p_{c}"), F.col(f"q_{c}"), i)


def gated(joined: DataFrame, w: Weights = Weights(), cos: str | None = None) -> DataFrame:
    """Pairs that pass the gate, with `overlaps` and their token similarities jn and ja. A cosine lets a non-Latin target
    pass."""
    d = overlaps(joined).withColumns({"jn": of(S.jaccard, "in_n", "tag_n"), "ja": of(S.jaccard, "in_a", "tag_a")})
    keep = (F.col("jn") >= GATE) | (F.col("ja") >= GATE)
    if cos:
        keep |= ~F.col("q_latin") & F.coalesce(F.col(cos) >= w.cos_low, F.lit(False))
    return d.filter(keep)


def similarities(n_docs: int) -> dict[str, Column]:
    """Expressions of pairs with `overlaps` that scores and features share."""
    num = S.numeric_agreement(F.col("p_numbers"), F.col("q_numbers"))
    return {
        "n_wjac": S.weighted_jaccard(F.col("in_n"), S.weight_sum(F.col("in_n"), n_docs), F.col("p_sum_n"), F.col("q_sum_n")),
        "nd_cont": of(S.containment, "in_nd", "nd"),
        "n_gram_dice": of(S.dice, "in_ng", "ng"),
        "a_wjac": S.weighted_jaccard(F.col("in_a"), S.weight_sum(F.col("in_a"), n_docs), F.col("p_sum_a"), F.col("q_sum_a")),
        "a_gram_dice": of(S.dice, "in_ag", "ag"),
        "num_score": num["score"],
        "has_num": num["evidence"],
    }


def scored(gate: DataFrame, n_docs: int, w: Weights = Weights(), cos: str | None = None) -> DataFrame:
    """Gated pairs with `score` in [0, 1]: channels with evidence, blended and scaled by trust in their combination.
    `n_docs` is the number of records that the frequencies come from."""
    d = once(gate, similarities(n_docs))
    has_addr, has_num, latin = (F.size("p_tag_a") > 0) & (F.size("q_tag_a") > 0), F.col("has_num"), F.col("q_latin")
    zero = F.lit(0.0)
    addr = w.addr_idf * F.col("a_wjac") + w.addr_grams * F.col("a_gram_dice")
    name = w.name_idf * F.col("n_wjac") + w.name_contained * F.col("nd_cont") + w.name_grams * F.col("n_gram_dice")
    acc = F.when(has_addr, w.addr * addr).otherwise(zero) + F.when(has_num, w.num * F.col("num_score")).otherwise(zero)
    tot = F.when(has_addr, F.lit(w.addr)).otherwise(zero) + F.when(has_num, F.lit(w.num)).otherwise(zero)
    mask = F.when(has_addr, F.lit(2)).otherwise(F.lit(0)) + F.when(has_num, F.lit(4)).otherwise(F.lit(0))
    trust = lambda m: F.element_at(F.array(*map(F.lit, w.trust)), m + 1)
    without = F.when(tot > 0, acc / tot * trust(mask)).otherwise(zero)
    named = lambda s: (acc + w.name * s) / (tot + w.name) * trust(mask + 1)
    other = without
    if cos:
        band = F.least(F.lit(1.0), (F.col(cos) - w.cos_low) / (w.cos_high - w.cos_low))
        other = F.when(F.coalesce(F.col(cos) >= w.cos_low, F.lit(False)), F.greatest(named(band), without)).otherwise(without)
    return d.withColumn("score", F.when(latin, named(name)).otherwise(other))


def rounded(d: DataFrame, digits: int = 6) -> DataFrame:
    """Scores rounded before they are compared, so that thresholds don't depend on the order of additions."""
    return d.withColumn("score", F.round("score", digits))


def top_k(d: DataFrame, k: int = TOP_K, least: float | None = PREFILTER, score: str = "score") -> DataFrame:
    """The k best rows of each s1_id with rank from 1, ties by target_id; rows under `least` go first."""
    d = d if least is None else d.filter(F.col(score) >= least)
    by = W.partitionBy("s1_id").orderBy(F.desc(score), "target_id")
    return d.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def threshold_select(ranked: DataFrame, threshold: float, max_k: int | None = None) -> DataFrame:
    """Rows of `top_k` with at least the threshold, at most `max_k` for each s1_id."""
    d = ranked.filter(F.col("score") >= threshold)
    return d if max_k is None else d.filter(F.col("rank") <= max_k)


def sweep(ranked: DataFrame, truth: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Rows (threshold, macro_f, best): the metric of each threshold over all entities of `truth` (s1_id, matched), and
    the first one that is best. Scores are gathered for each entity first, at most TOP_K of them."""
    from tessella.operators.metrics import f_beta

    mine = ranked.join(truth.select("s1_id", "matched"), "s1_id").select("s1_id", F.struct("score", F.array_contains("matched", F.col("target_id")).alias("hit")).alias("x")).groupBy("s1_id").agg(F.collect_list("x").alias("xs"))
    per = truth.join(mine, "s1_id", "left").select(F.size("matched").alias("t"), F.coalesce("xs", F.array().cast("array<struct<score:double,hit:boolean>>")).alias("xs"), F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold"))
    p = F.size(F.filter("xs", lambda x: x["score"] >= F.col("threshold")))
    tp = F.size(F.filter("xs", lambda x: (x["score"] >= F.col("threshold")) & x["hit"]))
    out = per.groupBy("threshold").agg(F.round(F.avg(f_beta(tp, p, F.col("t"))), 9).alias("macro_f"))
    top = W.partitionBy(F.lit(1))
    first = F.min(F.struct(-F.col("macro_f"), F.col("threshold").alias("at"))).over(top)["at"]
    return out.withColumn("best", F.col("threshold") == first)

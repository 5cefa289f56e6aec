"""How many of an entity's ranked candidates to keep: the set of best expected F_0.5."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.metrics import BETA2

#: Candidates of an entity that are looked at.
MOST = 24


def count_distribution(probs: Sequence[float]) -> list[float]:
    """Probabilities of 0, 1, ... successes among independent events."""
    d = [1.0]
    for p in probs:
        d = [(d[i] if i < len(d) else 0.0) * (1 - p) + (d[i - 1] * p if i else 0.0) for i in range(len(d) + 1)]
    return d


def expected_curve(probs: Sequence[float], most: int = MOST) -> list[float]:
    """Expected F_0.5 of keeping the n likeliest, for n = 0, 1, ..."""
    p = sorted(probs, reverse=True)[:most]
    out = [count_distribution(p)[0]]
    for n in range(1, len(p) + 1):
        kept, left = count_distribution(p[:n]), count_distribution(p[n:])
        out.append((1 + BETA2) * sum(x * y * a / (BETA2 * (a + b) + n) for a, x in enumerate(kept) if a for b, y in enumerate(left)))
    return out


def best_count(probs: Sequence[float], most: int = MOST) -> int:
    """The n of the highest expected score, the smallest among equals."""
    curve = expected_curve(probs, most)
    return max(range(len(curve)), key=lambda n: (round(curve[n], 12), -n))


def expected_select(ranked: DataFrame, prob: str = "prob") -> DataFrame:
    """Rows of `ranked` (s1_id, target_id, rank, prob) that belong to their s1_id's best set.

    Likelier candidates come first, ties by `rank`. An Arrow UDF over arrays of at most MOST numbers for an entity.
    """
    @F.pandas_udf("int")
    def n_best(probs: pd.Series) -> pd.Series:
        return probs.map(lambda x: best_count(list(x))).astype("int32")

    order = W.partitionBy("s1_id").orderBy(F.desc(prob), "rank", "target_id")
    placed = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MOST)
    sizes = placed.groupBy("s1_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(prob).alias("p")))), lambda x: x["p"]).alias("ps")).select("s1_id", n_best("ps").alias("n_best"))
    return placed.join(sizes, "s1_id").filter(F.col("place") <= F.col("n_best")).drop("n_best")


def ratio_counts(ranked: DataFrame, prob: str = "prob") -> DataFrame:
    """Rows (s1_id, n_best, best) of the ratio of expectations, in its place a diagnostic: n = 0 is kept unless some n is
    strictly better."""
    order = W.partitionBy("s1_id").orderBy(F.desc(prob), "rank", "target_id")
    d = ranked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MOST)
    whole = W.partitionBy("s1_id")
    run = F.sum(prob).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    d = d.withColumn("f", F.round((1 + BETA2) * run / (BETA2 * F.sum(prob).over(whole) + F.col("n")), 9))
    none = F.round(F.aggregate(F.sort_array(F.collect_list(prob)), F.lit(1.0), lambda s, p: s * (1 - p)), 9)
    one = d.groupBy("s1_id").agg(none.alias("none"), F.min(F.struct((-F.col("f")).alias("minus"), F.col("n").alias("n"))).alias("top"))
    better = -F.col("top.minus") > F.col("none")
    return one.select("s1_id", F.when(better, F.col("top.n")).otherwise(0).cast("int").alias("n_best"), F.when(better, -F.col("top.minus")).otherwise(F.col("none")).alias("best"))

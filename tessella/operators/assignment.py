"""One owner for each record: repeated choice until no record is claimed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.selection import expected_select
from tessella.sources.shared import shared

PASSES = 12


def claims(chosen: DataFrame) -> DataFrame:
    """Rows (target_id, n_claims)."""
    return chosen.groupBy("target_id").agg(F.count("*").alias("n_claims"))


def lost(chosen: DataFrame, prob: str = "prob") -> DataFrame:
    """Rows (s1_id, target_id) of contested records that go to a likelier claimant, then to the smaller s1_id."""
    by = W.partitionBy("target_id").orderBy(F.desc(prob), "s1_id")
    return chosen.withColumn("claim", F.row_number().over(by)).filter("claim > 1").select("s1_id", "target_id")


def assign(ranked: DataFrame, prob: str = "prob", passes: int = PASSES) -> tuple[DataFrame, int, int]:
    """Rows (s1_id, target_id, prob) of `ranked` (s1_id, target_id, rank, prob) chosen for good, the passes in which
    somebody lost, and the number of records that are still contested (0 unless `passes` ran out).

    An entity that loses a record never gets it again and chooses anew from what it has left. Only losers are computed
    again. Each pass is checkpointed, so plans stay short; the driver sees one count a pass.
    """
    ranked = shared(ranked.select("s1_id", "target_id", "rank", prob))
    current = shared(expected_select(ranked, prob).select("s1_id", "target_id", prob))
    banned = None
    for k in range(passes):
        gone = shared(lost(current, prob))
        if not gone.count():
            return current, k, 0
        banned = gone if banned is None else shared(banned.unionByName(gone).distinct())
        losers = gone.select("s1_id").distinct()
        again = ranked.join(losers, "s1_id", "left_semi").join(banned, ["s1_id", "target_id"], "left_anti")
        current = shared(current.join(losers, "s1_id", "left_anti").unionByName(expected_select(again, prob).select("s1_id", "target_id", prob)))
    return current, passes, claims(current).filter("n_claims > 1").count()

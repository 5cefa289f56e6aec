"""Evaluation: F_0.5 by entity, macro and micro figures, recall and the best reachable score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETA2 = 0.25


def f_beta(tp: Column, p: Column, t: Column) -> Column:
    """F_0.5 from true positives, predictions and truths; an entity without truths scores 1 if nothing is predicted."""
    return F.when(t == 0, F.when(p == 0, 1.0).otherwise(0.0)).when((p == 0) | (tp == 0), 0.0).otherwise((1 + BETA2) * tp / (BETA2 * t + p))


def per_entity(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rows (s1_id, country, tp, p, t, f) for every entity of `truth` (s1_id, country, matched); `predicted` has
    (s1_id, ids). An entity without a prediction counts as predicted empty; predictions of others are of no account."""
    d = truth.join(predicted.select("s1_id", "ids"), "s1_id", "left").withColumn("ids", F.array_distinct(F.coalesce("ids", F.array().cast("array<string>"))))
    d = d.select("s1_id", "country", F.size(F.array_intersect("ids", "matched")).alias("tp"), F.size("ids").alias("p"), F.size(F.array_distinct("matched")).alias("t"))
    return d.withColumn("f", f_beta(F.col("tp"), F.col("p"), F.col("t")))


def macro_f(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return per_entity(truth, predicted).agg(F.coalesce(F.round(F.avg("f"), 9), F.lit(0.0)).alias("macro_f"))


def breakdown(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row over all (country null) and one for each country: macro F, micro precision and recall, links, singletons."""
    e = per_entity(truth, predicted).withColumn("country", F.when(F.coalesce("country", F.lit("")) == "", "?").otherwise(F.col("country")))
    single = F.col("t") == 0
    div = lambda a, b: F.when(b > 0, F.round(a / b, 9)).otherwise(F.lit(0.0))
    s = lambda c: F.sum(c).cast("long")
    g = e.groupingSets([[], ["country"]], "country").agg(F.count("*").alias("entities"), F.round(F.avg("f"), 9).alias("macro_f"), s("tp").alias("tp"), s("p").alias("links_predicted"), s("t").alias("links_true"), F.count_if(single).alias("singletons"), F.count_if(single & (F.col("p") == 0)).alias("singletons_empty"))
    return g.select("country", "entities", "macro_f", div(F.col("tp"), F.col("links_predicted")).alias("micro_precision"), div(F.col("tp"), F.col("links_true")).alias("micro_recall"), "links_predicted", "links_true", "singletons", "singletons_empty")


def links(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.explode(F.array_distinct("matched")).alias("target_id"))


def candidate_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row (true_links, found_links, recall) of `candidates` (s1_id, target_id)."""
    real = links(truth)
    hit = real.join(candidates.select("s1_id", "target_id").distinct().withColumn("found", F.lit(1)), ["s1_id", "target_id"], "left")
    d = hit.agg(F.count("*").alias("true_links"), F.count("found").alias("found_links"))
    return d.withColumn("recall", F.when(F.col("true_links") > 0, F.round(F.col("found_links") / F.col("true_links"), 9)).otherwise(F.lit(0.0)))


def oracle_score(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Macro F of choosing exactly the true candidates."""
    best = candidates.select("s1_id", "target_id").join(links(truth), ["s1_id", "target_id"], "left_semi").groupBy("s1_id").agg(F.collect_set("target_id").alias("ids"))
    return macro_f(truth, best).withColumnRenamed("macro_f", "oracle_f")


def as_lists(chosen: DataFrame) -> DataFrame:
    """Rows (s1_id, ids) from rows (s1_id, target_id)."""
    return chosen.groupBy("s1_id").agg(F.sort_array(F.collect_set("target_id")).alias("ids"))

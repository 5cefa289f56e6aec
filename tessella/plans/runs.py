"""Whole runs over tab-separated files: held-out evaluation, training, and output with its checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import assignment, metrics, model, records, scoring, validate
from tessella.plans.matching import Matching
from tessella.sources import tables
from tessella.sources.shared import shared

SWEEP = tuple(x / 100 for x in range(34, 91, 2))
RULE_THRESHOLD = 0.725


def read_all(spark: SparkSession, paths: list[str], s1_every: int = 1) -> DataFrame:
    """All sources' records; of the reference only ids divisible by `s1_every`."""
    d = reduce(DataFrame.unionByName, (tables.read_source(spark, p) for p in paths))
    if s1_every <= 1:
        return d
    number = F.regexp_extract("entity_id", "([0-9]+)$", 1).try_cast("bigint")
    return d.filter((F.substring("entity_id", 1, 2) != "S1") | records.keep_every(number, s1_every))


def vectors(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The table of name embeddings at `path`; a path without a table raises ValueError."""
    found = None if path is None else tables.read_embeddings(spark, path)
    if path is not None and found is None:
        raise ValueError(f"{path}: no embeddings")
    return found


def truths(spark: SparkSession, source: DataFrame, path: str) -> DataFrame:
    """Rows (s1_id, country, matched) for the reference records of `source`."""
    s1 = source.filter("entity_id like 'S1-%'").select(F.col("entity_id").alias("s1_id"), "country")
    return s1.join(tables.read_truth(spark, path), "s1_id", "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))


def evaluate(spark: SparkSession, paths: list[str], truth_path: str, s1_every: int = 20, cache: str | None = None, embeddings: str | None = None) -> dict:
    """Recall, best threshold and breakdown of the rule score on a sample of the reference against all targets."""
    source = read_all(spark, paths, s1_every)
    m, truth = Matching(source, embeddings=vectors(spark, embeddings)), shared(truths(spark, source, truth_path))
    sweep = scoring.sweep(m.ranked, truth, SWEEP).orderBy("threshold").collect()
    best = next((r.threshold for r in sweep if r.best), RULE_THRESHOLD)
    if cache:
        tables.write_cached(m.ranked, cache, threshold=best, s1_every=s1_every)
    picked = metrics.as_lists(scoring.threshold_select(m.ranked, best))
    return {
        "recall": metrics.candidate_recall(truth, m.pairs).first().asDict(),
        "sweep": {r.threshold: r.macro_f for r in sweep},
        "threshold": best,
        "breakdown": [r.asDict() for r in metrics.breakdown(truth, picked).orderBy(F.col("country").asc_nulls_first()).collect()],
        "oracle_f": metrics.oracle_score(truth, m.ranked).first()[0],
    }


def train(spark: SparkSession, paths: list[str], truth_path: str, out: str, s1_every: int = 1, embeddings: str | None = None, **how) -> list[tuple[str, float]]:
    """Learn from files and save the model; gives the most important features."""
    source = read_all(spark, paths, s1_every)
    m = Matching(source, embeddings=vectors(spark, embeddings))
    data = shared(model.split(model.label(m.featured, metrics.links(truths(spark, source, truth_path)))))
    fitted = model.train(data, **how)
    model.save(fitted, out, True)
    tables.write_cached(m.stats[0], f"{out}/statistics", n_docs=m.stats[1])
    return model.importances(fitted)


def submit(spark: SparkSession, paths: list[str], out: str, model_path: str | None = None, threshold: float = RULE_THRESHOLD, limit: int | None = None, embeddings: str | None = None) -> list[dict]:
    """Write matching_results and candidate_pairs, one line for each reference record in file order; gives the checks'
    report. With a model sets are chosen by expected F_0.5 and every target gets one owner, else by the threshold; tokens
    then weigh in scores and features what they did in training. What is still claimed twice is reported as an error."""
    first, *rest = (tables.read_source(spark, p) for p in paths)
    if limit is not None:
        first = tables.first_rows(first, limit)
    first = shared(first)
    rating, left = None, 0
    if model_path:
        df, meta = tables.read_cached(spark, f"{model_path}/statistics")
        rating = (df, meta["n_docs"])
    m = Matching(reduce(DataFrame.unionByName, rest, first).drop("ordinal"), embeddings=vectors(spark, embeddings), rating=rating)
    if model_path:
        fitted, _ = model.load(model_path)
        scored = model.apply(fitted, m.featured).select("s1_id", "target_id", (F.col("rank") + 1).cast("int").alias("rank"), "prob")
        chosen, _, left = assignment.assign(scored)
    else:
        chosen = scoring.threshold_select(m.ranked, threshold)
    results = shared(tables.complete(first, metrics.as_lists(chosen)))
    candidates = shared(tables.complete(first, metrics.as_lists(m.ranked)))
    tables.check_complete(first, results, candidates)
    tables.write_id_lists(results, f"{out}/matching_results", tables.TRUTH_HEADER)
    tables.write_id_lists(candidates, f"{out}/candidate_pairs", tables.CANDIDATE_HEADER)
    rows = results.select("s1_id", "ids", F.lit(False).alias("malformed"))
    known = reduce(DataFrame.unionByName, rest).select(F.col("entity_id").alias("target_id"))
    report = validate.validate(rows, first.select(F.col("entity_id").alias("s1_id")), known, candidates)
    contested = [{"rule": "contested", "severity": "error", "offenders": left, "examples": ""}] if left else []
    return [r.asDict() for r in report.collect()] + contested

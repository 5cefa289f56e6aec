"""Checks of an output of id lists; each rule gives the number of offenders and up to five examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


def header_error(line: str | None, expected: tuple[str, str]) -> str | None:
    """What is wrong with a header line; case and spaces around names are of no account."""
    if line is None or not line.strip():
        return "empty file"
    if "\t" not in line:
        return "header is not tab-separated"
    if [x.strip().lower() for x in line.split("\t")] != [x.lower() for x in expected]:
        return f"header is {line!r}"
    return None


def parse(lines: DataFrame) -> DataFrame:
    """Rows (s1_id, ids, malformed) from rows (value); blank lines go, ids are trimmed and blank ones dropped."""
    f = F.split("value", "\t", -1)
    ids = F.filter(F.transform(F.split(F.coalesce(F.get(f, F.lit(1)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.filter(F.trim("value") != "").select(F.trim(F.get(f, F.lit(0))).alias("s1_id"), ids.alias("ids"), (F.instr("value", "\t") == 0).alias("malformed"))


def _report(rule: str, severity: str, offenders: DataFrame, key: str) -> DataFrame:
    """One row (rule, severity, offenders, examples): the least EXAMPLES of the offenders, as a top-k that is combined
    before the shuffle."""
    n = offenders.agg(F.count("*").alias("offenders"))
    least = offenders.select(F.col(key).alias("x")).distinct().orderBy("x").limit(EXAMPLES).agg(F.sort_array(F.collect_list("x")).alias("examples"))
    return n.join(least, F.lit(True)).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "offenders", F.array_join("examples", ",").alias("examples"))


def validate(rows: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Rows (rule, severity, offenders, examples) from `rows` of `parse`, required ids (s1_id), and optionally all
    target ids (target_id) and candidate lists (s1_id, ids). Only errors make an output fail."""
    good = rows.filter("not malformed")
    any_id = lambda p: F.exists("ids", p)
    prefix = lambda x: x.startswith("S2-") | x.startswith("S3-")

    def rule(name: str, cond: Column) -> DataFrame:
        return _report(name, "error", good.filter(cond), "s1_id")

    out = [
        _report("malformed", "error", rows.filter("malformed"), "s1_id"),
        _report("duplicate_row", "error", good.groupBy("s1_id").agg(F.count("*").alias("n")).filter("n > 1"), "s1_id"),
        rule("repeated_id", F.size("ids") != F.size(F.array_distinct("ids"))),
        rule("self_match", any_id(lambda x: x.startswith("S1-"))),
        rule("prefix", any_id(lambda x: ~x.startswith("S1-") & ~prefix(x))),
        _report("missing", "error", required.select("s1_id").distinct().join(good, "s1_id", "left_anti"), "s1_id"),
        _report("unexpected", "error", good.select("s1_id").distinct().join(required, "s1_id", "left_anti"), "s1_id"),
    ]
    if known is not None:
        used = good.select(F.explode("ids").alias("target_id")).filter(prefix(F.col("target_id"))).distinct()
        out.append(_report("unknown_id", "error", used.join(known.select("target_id"), "target_id", "left_anti"), "target_id"))
    if candidates is not None:
        c = candidates.select("s1_id", F.col("ids").alias("allowed"))
        outside = good.join(c, "s1_id", "left").filter(F.size(F.array_except("ids", F.coalesce("allowed", F.array().cast("array<string>")))) > 0)
        out.append(_report("not_a_candidate", "warning", outside, "s1_id"))
    return reduce(DataFrame.unionByName, out)


def passed(report: DataFrame) -> bool:
    return report.filter("severity = 'error' and offenders > 0").limit(1).count() == 0

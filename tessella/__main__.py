"""python -m tessella evaluate|train|submit S1 S2 S3 ...: runs over tab-separated files; prints JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tessella.plans import runs


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tessella", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("evaluate", "train", "submit"):
        s = sub.add_parser(name)
        s.add_argument("sources", nargs="+", help="the reference first")
        s.add_argument("--embeddings", help="a table (entity_id, embedding) of names' unit vectors")
        if name != "submit":
            s.add_argument("--truth", required=True)
            s.add_argument("--s1-every", type=int, default=20 if name == "evaluate" else 1)
        if name != "evaluate":
            s.add_argument("--out", required=True)
        if name == "evaluate":
            s.add_argument("--cache")
        if name == "submit":
            s.add_argument("--model")
            s.add_argument("--threshold", type=float, default=runs.RULE_THRESHOLD)
            s.add_argument("--s1-limit", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if a.what == "evaluate":
        print(json.dumps(runs.evaluate(spark, a.sources, a.truth, a.s1_every, a.cache, a.embeddings)))
        return 0
    if a.what == "train":
        print(json.dumps(runs.train(spark, a.sources, a.truth, a.out, a.s1_every, a.embeddings)))
        return 0
    report = runs.submit(spark, a.sources, a.out, a.model, a.threshold, a.s1_limit, a.embeddings)
    print(json.dumps(report))
    return int(any(r["severity"] == "error" and r["offenders"] for r in report))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

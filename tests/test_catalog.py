import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.operators import boosting, features, metrics, model, scoring
from tessella.plans import adapters, catalog
from tessella.sources import tables

DATA = "/root/testdata/sf0.001"
TABLES = "part orders customer documents embeddings labels".split()


def plain(x):
    return "%.9g" % x if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["norm_fold", "norm_addr_tokens", "norm_trigrams", "corpus_idf", "blocking_keys", "posting_cap", "posting_cap_chunked", "candidate_pairs", "rule_score", "cross_source_features", "threshold_sweep", "expected_f_select", "breakdown_by_country", "validate_output", "validate_candidates", "id_predicates", "truth_file", "model_split"])
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(catalog.oracle_sql()[name])
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    assert len(cur.description) == len(cols)
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pairs_are_compared_once(spark):
    """Filters on the gate and on scores don't make the comparisons again below them, and features come of the same ones."""
    m = catalog.matching(spark, DATA)
    best = scoring.top_k(m.scored.select("s1_id", "target_id", "score"))
    assert best._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 6
    again = features.pair_features(scoring.with_records(best.select("s1_id", "target_id"), m.rated), m.n_docs)
    rows = lambda d: sorted(map(tuple, d.select("s1_id", "target_id", *features.PAIR).collect()))
    assert rows(m.featured) == rows(again) and rows(m.featured)
    assert sorted(m.ranked.collect()) == sorted(best.collect())
    assert "array_intersect" not in m.featured._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_labels_need_no_list_of_links(spark, tmp_path):
    """Candidates are labelled as the truth's links would, which grow with the square of a name's records and aren't made."""
    data = catalog.labelled(spark, DATA)
    links = {(r.s1_id, r.target_id) for r in metrics.links(adapters.truth(spark, DATA)).collect()}
    rows = data.select("s1_id", "target_id", "label").collect()
    assert {r.label for r in rows} == {0.0, 1.0} and all(r.label == ((r.s1_id, r.target_id) in links) for r in rows)
    plan = data._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "explode" not in plan

    names = ["A name that is long enough"] * 40 + ["Short"] * 4 + ["Another name of some length", "a name that is: LONG enough"]
    docs = [(i, f"{n}. {i}", "de" if i % 5 == 4 else "en") for i, n in enumerate(names)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [r[0] for r in adapters.records(spark, str(tmp_path)).select("entity_id").collect()]
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a[1] == "1" != b[1]], "s1_id string, target_id string")
    both = (adapters.linked(pairs, spark, str(tmp_path)), metrics.links(adapters.truth(spark, str(tmp_path))))
    got, want = (sorted((r.s1_id, r.target_id) for r in x.collect()) for x in both)
    assert got == want and len(got) > 100


def test_entry_without_optional_parts(tmp_path):
    """The entry module still imports where the optional subpackage and the pipeline are gone."""
    root = Path(__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        rel = p.relative_to(root)
        if "llm" not in rel.parts and rel.parts[0] != "tests" and rel.name != "corpus_pipeline.py":
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q if k[2:3].isdigit()) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_model_round_trip(spark, tmp_path):
    d = spark.range(400).select(F.concat(F.lit("S1-"), (F.col("id") % 100).cast("string")).alias("s1_id"), F.col("id").cast("string").alias("target_id"), *(((F.col("id") * (k + 3)) % 17 / 17).alias(c) for k, c in enumerate(features.FEATURES)))
    data = model.split(d.withColumn("label", (F.col("base_score") > 0.5).cast("double")))
    parts = data.groupBy("s1_id").agg(F.count_distinct("part").alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 1
    m = model.train(data, rounds=3, depth=3)
    model.save(m, str(tmp_path / "m"), True)
    again, meta = model.load(str(tmp_path / "m"))
    assert meta["cross_source"] and meta["features"] == list(features.FEATURES)
    a = {(r.s1_id, r.target_id): r.prob for r in model.apply(m, data).collect()}
    assert a == {(r.s1_id, r.target_id): r.prob for r in model.apply(again, data).collect()}
    assert len(model.importances(m)) == 15 and model.calibrate(model.apply(m, data)) is not None
    assert [c for c in features.FEATURES if c not in features.CROSS] == model.columns(False)


def test_validation_ends_training(spark):
    """More rounds than the former 20, fewer than the bound: the calibration part decides."""
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    d = spark.range(600).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("s1_id"), h.alias("h"), *(h.alias(c) for c in features.FEATURES))
    d = d.filter("h < 0.4 or h > 0.6")
    fitted = model.train(model.split(d.withColumn("label", (F.col("h") > 0.5).cast("double"))).coalesce(1).cache())
    assert 20 < fitted.stages[1].getNumTrees < model.MOST_ROUNDS


def test_training_tasks_follow_the_rows(spark):
    """However the rows lie: 600 of them are one task, 9,000 one for each core, and none is lost."""
    for n, parts in ((600, 1), (9000, 4)):
        d = spark.range(n).repartition(64)
        out = model.dealt(d)
        assert out.rdd.getNumPartitions() == parts and out.count() == out.distinct().count() == n
        out.unpersist()


def test_trees_of_one_task_are_sparks(spark):
    """Without draws they are the same trees; few rows are learned from in a few jobs, not some ten for each tree."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100003)) / 100003
    d = spark.range(3000).select("id", draw(0).alias("a"), F.round(draw(1), 1).alias("b"), draw(2).alias("c"), F.lit(0.0).alias("same"), (F.col("id") % 4 == 0).alias("held"))
    d = d.withColumn("label", (F.col("a") + F.col("b") * F.col("c") + draw(3) / 2 > 1).cast("double")).cache()
    trees = GBTClassifier(maxIter=40, maxDepth=5, stepSize=0.1, subsamplingRate=1.0, featureSubsetStrategy="1.0", minInstancesPerNode=5, seed=1, validationIndicatorCol="held")
    names = ["a", "b", "c", "same"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(d)
    mine, theirs = boosting.fit(trees, d.select(*names, "label", "held"), names), trees.fit(rows)
    prob = lambda m: [r.probability[1] for r in m.transform(rows).orderBy("id").select("probability").collect()]
    assert mine.getNumTrees == theirs.getNumTrees > 5 and prob(mine) == pytest.approx(prob(theirs), abs=1e-9)
    assert list(mine.featureImportances.toArray()) == pytest.approx(list(theirs.featureImportances.toArray()), abs=1e-9)

    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    x = spark.range(600).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("s1_id"), h.alias("h"), *(h.alias(c) for c in features.FEATURES)).filter("h < 0.4 or h > 0.6")
    x = model.split(x.withColumn("label", (F.col("h") > 0.5).cast("double")))
    spark.sparkContext.setJobGroup("training", "")
    try:
        n = model.train(x).stages[1].getNumTrees
        assert n > 20 and 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("training")) < 2 * n
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_parts_resume(spark, tmp_path):
    schema = "country string, chunk int, s1_id string"
    all_parts = spark.createDataFrame([("US", 0, "a"), ("US", 1, "b"), ("FR", 0, "c")], schema)
    tables.write_parts(all_parts.filter("chunk = 0"), str(tmp_path / "p"))
    written = spark.read.parquet(str(tmp_path / "p"))
    assert [tuple(r) for r in tables.missing_parts(all_parts, written).collect()] == [("US", 1)]
    tables.write_parts(all_parts.filter("chunk = 1"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3

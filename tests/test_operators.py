import itertools

import pytest
from pyspark.sql import functions as F

from tessella.operators import assignment, features, metrics, records, scoring, selection, validate
from tessella.plans.matching import Matching
from tessella.sources import tables

CURVES = [
    ([0.9], [0.1, 0.9], 1),
    ([0.5], [0.5, 0.5], 0),
    ([0.4], [0.6, 0.4], 0),
    ([0.6, 0.6], [0.16, 0.54, 0.626667], 2),
    ([0.9, 0.6], [0.04, 0.81, 0.773333], 1),
    ([0.9, 0.8, 0.3], [0.014, 0.745286, 0.840475, 0.704022], 2),
    ([0.95, 0.9, 0.85, 0.8, 0.2], [0.00012, 0.61879, 0.788651, 0.856285, 0.883992, 0.776115], 4),
    ([0.05] * 4, [0.814506, 0.048768, 0.05473, 0.057078, 0.058336], 0),
]


@pytest.mark.parametrize(("probs", "curve", "best"), CURVES)
def test_expected_curve(probs, curve, best):
    assert selection.expected_curve(probs) == pytest.approx(curve, abs=1e-6)
    assert selection.best_count(probs) == best


def test_expected_curve_is_enumeration():
    p = [0.83, 0.7, 0.41, 0.2, 0.11]
    for n in range(len(p) + 1):
        total = 0.0
        for labels in itertools.product([0, 1], repeat=len(p)):
            w = 1.0
            for x, q in zip(labels, p, strict=True):
                w *= q if x else 1 - q
            tp, t = sum(labels[:n]), sum(labels)
            total += w * ((1.0 if n == 0 else 0.0) if t == 0 else 0.0 if tp == 0 else 1.25 * tp / (0.25 * t + n))
        assert selection.expected_curve(p)[n] == pytest.approx(total)


@pytest.mark.parametrize(("tp", "p", "t", "f"), [(2, 3, 2, 0.714286), (1, 1, 4, 0.625), (3, 3, 4, 0.9375), (4, 5, 4, 0.833333), (0, 0, 0, 1), (0, 1, 0, 0), (0, 0, 2, 0)])
def test_f_beta(spark, tp, p, t, f):
    assert spark.range(1).select(metrics.f_beta(F.lit(tp), F.lit(p), F.lit(t))).first()[0] == pytest.approx(f, abs=1e-6)


def match(spark, rows, cos=None):
    m = Matching(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))
    pairs = spark.createDataFrame([("S1-1", "S2-1", cos)], "s1_id string, target_id string, cos double")
    d = scoring.scored(scoring.gated(scoring.with_records(pairs, m.rated), cos="cos"), m.n_docs, cos="cos").collect()
    return d[0]["score"] if d else 0.0


@pytest.mark.parametrize(
    ("name", "address", "cos", "score"),
    [
        (("Acme Bakery", "Acme Bakery"), ("Oak Road", ""), None, 0.45),
        (("Acme Bakery", "Acme Bakery"), ("Oak Road", "Oak Road"), None, 1.0),
        (("Acme Bakery", "Acme Bakery"), ("12 Oak Road", "12 Oak Road"), None, 1.0),
        (("Acme", "मेरीडियन"), ("Oak Road", "Oak Road"), None, 0.90),
        (("Acme", "मेरीडियन"), ("12 Oak Road", "12 Oak Road"), None, 0.95),
        (("Acme", "मेरीडियन"), ("12 Oak Road", "12 Oak Road"), 0.92, 0.95),
        (("Acme", "मेरीडियन"), ("", ""), 0.95, 0.45),
        (("Acme", "मेरीडियन"), ("", ""), 0.69, 0.0),
        (("Acme Bakery", "Zeta Tools"), ("Oak Road", "Elm Lane"), None, 0.0),
    ],
)
def test_rule_score(spark, name, address, cos, score):
    rows = [("S1-1", name[0], address[0], "US"), ("S2-1", name[1], address[1], "US"), ("S2-2", "Other Thing", "Far Street", "US"), ("S3-3", "Else", "Near", "US")]
    assert match(spark, rows, cos) == pytest.approx(score, abs=1e-6)


def test_chunks_and_holdout(spark):
    d = spark.createDataFrame([(40,), (41,), (None,)], "id bigint")
    row = d.select(records.keep_every(F.col("id"), 20), records.chunk_of(F.col("id"), 2, 4, 20)).collect()
    assert [tuple(r) for r in row] == [(True, True), (False, False), (False, False)]
    n = spark.range(1000).select(*(F.count_if(records.chunk_of(F.col("id"), k, 7)).alias(str(k)) for k in range(7))).first()
    assert sum(n) == 1000 and max(n) - min(n) <= 1


def test_cross_source_and_competition(spark):
    norm = spark.createDataFrame([("S2-1", ["a", "b", "c"], []), ("S3-1", ["a", "b", "d"], []), ("S3-2", ["x"], [])], "entity_id string, nc array<string>, addr_toks array<string>")
    c = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S3-1", 0.6), ("S1-1", "S3-2", 0.6)], "s1_id string, target_id string, score double")
    x = {r.target_id: [r[k] for k in features.CROSS] for r in features.cross_source(c, norm).collect()}
    assert x == {"S2-1": [0.5, 0.25, 1.0, 0.0], "S3-1": [0.5, 0.5, 1.0, 0.0], "S3-2": [0.0, 0.0, 0.0, 0.0]}
    r = {r.target_id: [round(r[k], 6) for k in features.RANK] for r in features.competition(c).collect()}
    assert r["S2-1"] == [0.9, 0, 0, 1, 3, 0.2] and r["S3-2"] == [0.6, 2, 0.3, 0.666667, 3, -0.1]


def test_rivals_meet_in_groups(spark):
    """As pairwise sets give it, also for groups over several batches, empty sets and targets without a record; and
    candidates are joined with no copy of themselves."""
    sets = {f"S{2 + i % 2}-{i}": [f"t{j}" for j in range(60) if (j * (i + 3) + i) % 7 < 3 and i % 11] for i in range(40)}
    norm = spark.createDataFrame([(k, v[::2], v) for k, v in sets.items()], "entity_id string, nc array<string>, addr_toks array<string>")
    rows = [(f"S1-{e}", f"S{2 + i % 2}-{i}", 0.5) for e in range(30) for i in range(e % 5, 42, 1 + e % 6)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = features.cross_source(spark.createDataFrame(rows, "s1_id string, target_id string, score double").coalesce(1), norm)
        got = {(r.s1_id, r.target_id): [round(r[k], 9) for k in features.CROSS] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sim(a, b):
        return len(set(sets[a]) & set(sets[b])) / max(1, len(set(sets[a]) | set(sets[b])))

    def brute(one, two):
        rest = [t for s, t, _ in rows if s == one and t != two and t in sets] if two in sets else []
        opp, same = ([sim(two, t) for t in rest if (t[1] == two[1]) == k] for k in (False, True))
        return [max(opp, default=0.0), round(sum(opp) / max(1, len(opp)), 9), float(sum(x >= 0.5 for x in opp)), max(same, default=0.0)]

    assert got == {(s, t): [round(x, 9) for x in brute(s, t)] for s, t, _ in rows}
    assert "array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_assignment(spark):
    rows = [("e1", "t1", 1, 0.9), ("e1", "t2", 2, 0.6), ("e2", "t1", 1, 0.8), ("e2", "t3", 2, 0.7)]
    d, passes, left = assignment.assign(spark.createDataFrame(rows, "s1_id string, target_id string, rank int, prob double"))
    assert sorted((r.s1_id, r.target_id) for r in d.collect()) == [("e1", "t1"), ("e2", "t3")] and (passes, left) == (1, 0)


def test_assignment_under_contention(spark):
    rows = [(f"e{i:02d}", f"t{j:02d}", 1 + k, 0.5 + ((i * 7 + j * 13) % 50) / 101) for i in range(20) for k, j in enumerate((i * 3 % 12, (i * 5 + 1) % 12, (i + 7) % 12))]
    d, _, left = assignment.assign(spark.createDataFrame(rows, "s1_id string, target_id string, rank int, prob double").dropDuplicates(["s1_id", "target_id"]))
    chosen = [r.target_id for r in d.collect()]
    assert left == 0 and len(chosen) == len(set(chosen))


def report(spark, lines, known=None, candidates=None):
    rows = validate.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    r = validate.validate(rows, required, known, candidates)
    return {x.rule for x in r.collect() if x.offenders}, validate.passed(r)


@pytest.mark.parametrize(
    ("lines", "rules"),
    [
        (["S1-1\tS2-1,S3-2", "S1-2\t"], set()),
        (["S1-1\tS2-1"], {"missing"}),
        (["S1-1\tS2-1", "S1-1\t", "S1-2\t"], {"duplicate_row"}),
        (["S1-1\tS2-1,S2-1", "S1-2\t"], {"repeated_id"}),
        (["S1-1\tS1-2", "S1-2\t"], {"self_match"}),
        (["S1-1\tX-9", "S1-2\t"], {"prefix"}),
        (["S1-1\t", "S1-2\t", "S1-9\t"], {"unexpected"}),
        (["S1-1\t", "S1-2\t", "junk", ""], {"malformed"}),
    ],
)
def test_validator(spark, lines, rules):
    assert report(spark, lines) == (rules, not rules)


def test_validator_options(spark):
    lines = ["S1-1\tS2-999", "S1-2\t"]
    known = spark.createDataFrame([("S2-1",)], "target_id string")
    assert report(spark, lines, known) == ({"unknown_id"}, False)
    none = spark.createDataFrame([("S1-1", ["S2-1"])], "s1_id string, ids array<string>")
    assert report(spark, lines, None, none) == ({"not_a_candidate"}, True)
    header = ("source1_entity_id", "matched_entity_ids")
    assert validate.header_error("Source1_Entity_ID \t matched_entity_ids", header) is None
    assert validate.header_error("source1_entity_id,matched_entity_ids", header)


def test_sources_and_sinks(spark, tmp_path):
    f = tmp_path / "s.tsv"
    f.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA \"b\"\tx\tUS\textra\nS1-2\tshort\nS1-3\tC\t\tFR\n")
    s1 = tables.read_source(spark, str(f))
    assert [r.entity_id for r in s1.orderBy("ordinal").collect()] == ["S1-1", "S1-3"]
    assert tables.read_source(spark, str(f), "FR").count() == 1
    bad = tmp_path / "bad.tsv"
    bad.write_text("id\tname\n")
    with pytest.raises(ValueError):
        tables.read_source(spark, str(bad))
    t = tmp_path / "t.tsv"
    t.write_text("h1\th2\nS1-1\tS2-1,,S2-1,S3-4\nS1-2\n\t\nS1-1\tS2-9\n")
    assert {r.s1_id: r.matched for r in tables.read_truth(spark, str(t)).collect()} == {"S1-1": ["S2-9"], "S1-2": []}
    out = tables.complete(s1, spark.createDataFrame([("S1-3", ["S2-1", "S3-2"])], "s1_id string, ids array<string>"))
    tables.write_id_lists(out, str(tmp_path / "out"), single_file=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-3\tS2-1,S3-2\n"
    with pytest.raises(ValueError):
        tables.check_complete(s1, out.limit(1))
    tables.write_cached(out, str(tmp_path / "cache"), threshold=0.5)
    again, meta = tables.read_cached(spark, str(tmp_path / "cache"))
    assert again.count() == 2 and meta == {"threshold": 0.5}
    assert tables.read_embeddings(spark, str(tmp_path / "none")) is None


def test_stream_matches_batch(spark, tmp_path):
    from tessella.streaming.incremental import match_stream

    schema = "entity_id string, business_name string, business_address string, country string"
    ref = spark.createDataFrame([("S1-1", "Acme Bakery", "12 Oak Road Springfield", "US"), ("S1-2", "Zeta Tools", "9 Elm Lane", "US")], schema)
    new = spark.createDataFrame([("S2-5", "Acme Bakery Inc", "12 Oak Rd Springfield", "US")], schema)
    new.write.parquet(str(tmp_path / "in"))
    df, n = records.corpus_stats(records.normalise(new))
    got = []
    q = match_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ref, df, records.document_count(n), lambda rows, _: got.extend(rows.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert [(r.s1_id, r.target_id) for r in got] == [("S1-1", "S2-5")]

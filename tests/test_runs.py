import random

import pytest

from tessella.plans import runs

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def write(tmp_path):
    r = random.Random(1)
    words = [f"w{a}{b}" for a in "bcdfgkl" for b in "aeiou"]
    s1, s2, s3, truth = [HEAD], [HEAD], [HEAD], ["source1_entity_id\tmatched_entity_ids\n"]
    for i in range(60):
        name, address = " ".join(r.sample(words, 3)), f"{r.randint(1, 999)} {' '.join(r.sample(words, 3))} Road"
        s1.append(f"S1-{i}\t{name} Ltd\t{address}\tUS\n")
        got = []
        if i % 3:
            s2.append(f"S2-{i}\t{name}\t{address.replace('Road', 'Rd')}\tUS\n")
            got.append(f"S2-{i}")
        if i % 2:
            s3.append(f"S3-{i}\t{name.upper()} Inc\t{address}\tUS\n")
            got.append(f"S3-{i}")
        truth.append(f"S1-{i}\t{','.join(got)}\n")
    for n, x in (("1", s1), ("2", s2), ("3", s3), ("t", truth)):
        (tmp_path / n).write_text("".join(x))
    return [str(tmp_path / n) for n in "123"], str(tmp_path / "t")


def test_evaluate_train_submit(spark, tmp_path):
    paths, truth = write(tmp_path)
    r = runs.evaluate(spark, paths, truth, 1, str(tmp_path / "cache"))
    assert r["recall"]["recall"] == 1 and r["breakdown"][0]["macro_f"] > 0.95 and r["oracle_f"] == 1
    top = runs.train(spark, paths, truth, str(tmp_path / "model"), rounds=3, depth=3)
    assert top[0][1] > 0
    for model_path in (None, str(tmp_path / "model")):
        out = tmp_path / f"out{bool(model_path)}"
        report = runs.submit(spark, paths, str(out), model_path)
        assert not any(x["offenders"] for x in report)
        lines = [x for p in sorted((out / "matching_results/rows").glob("part-*")) for x in p.read_text().splitlines()]
        assert [x.split("\t")[0] for x in lines] == [f"S1-{i}" for i in range(60)]
        assert sum(len(x.split("\t")[1]) > 0 for x in lines) > 40


def test_runs_use_embeddings(spark, tmp_path):
    """A target with a name that is not Latin and a weak address is only found by its cosine; the features have it."""
    paths, truth = write(tmp_path)
    with open(paths[0], "a") as f:
        f.write("S1-900\tZorvak Quellin\t77 Tamsel wbe\tUS\n")
    with open(paths[1], "a") as f:
        f.write("S2-900\tमेरीडियन\tTamsel wba wca wda wfa wga wka wla wbi wci wdi wfi wgi wki\tUS\n")
    emb = str(tmp_path / "emb")
    spark.createDataFrame([("S1-900", [0.6, 0.8]), ("S2-900", [0.6, 0.8]), ("S1-1", [1.0, 0.0]), ("S2-1", [1.0, 0.0])], "entity_id string, embedding array<float>").write.parquet(emb)
    source = runs.read_all(spark, paths)
    score = {}
    for e in (None, emb):
        m = runs.Matching(source, embeddings=runs.vectors(spark, e))
        assert m.pairs.filter("s1_id = 'S1-900' and target_id = 'S2-900'").count() == 1
        score[e] = {(r.s1_id, r.target_id): r.score for r in m.scored.collect()}
    assert score[emb].get(("S1-900", "S2-900"), 0) > max(0.5, score[None].get(("S1-900", "S2-900"), 0) + 0.1)
    assert {k: v for k, v in score[emb].items() if k[1] != "S2-900"} == {k: v for k, v in score[None].items() if k[1] != "S2-900"}
    f = {(r.s1_id, r.target_id): (r.emb_cos, r.emb_present) for r in m.featured.collect()}
    assert f["S1-900", "S2-900"][0] == pytest.approx(1, abs=1e-6) and f["S1-900", "S2-900"][1] == 1 and f["S1-1", "S2-1"] == (0, 0)
    assert not any(x["offenders"] for x in runs.submit(spark, paths, str(tmp_path / "o"), threshold=0.5, embeddings=emb))
    found = [x for p in (tmp_path / "o/matching_results/rows").glob("part-*") for x in p.read_text().splitlines()]
    assert "S1-900\tS2-900" in found
    with pytest.raises(ValueError):
        runs.vectors(spark, str(tmp_path / "nothing"))

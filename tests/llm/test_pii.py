"""The field's decoder against all segmentations, and dense, long and empty texts."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import pii

N = "0123456789"


def best_by_trial(model, tokens, blocked):
    """Every way to cut tokens into single outside tokens and labelled candidates; the score of the best and its entities."""
    shut = [x for _, x in pii.shut_tokens(tokens, blocked)]
    starts = {}
    for i in range(len(tokens)):
        for n in pii.lengths(tokens, shut, i):
            starts.setdefault(i + 1 - n, []).append(n)

    def walk(at, label):
        if at == len(tokens):
            return 0.0, ()
        s, rest = walk(at + 1, 0)
        ways = [(model.t[label, 0] + s, rest)]
        for n in starts.get(at, ()):
            w = model.w[[model.index.get(f, 0) for f in pii.features(tokens, at, at + n)]].sum(0)
            for k in range(1, len(pii.LABELS)):
                s, rest = walk(at + n, k)
                odds = w[k] + model.t[0, k] + model.t[k, 0] - (n + 1) * model.t[0, 0]
                ways.append((model.t[label, k] + w[k] + s, ((pii.LABELS[k], tokens[at][1], tokens[at + n - 1][2], odds), *rest)))
        return max(ways, key=lambda x: x[0])

    return [x[:3] for x in walk(0, 0)[1] if x[3] >= pii.MARGIN]


def test_decoder_by_trial():
    model, r = pii.field(), random.Random(2)
    n = lambda k: "".join(r.choices(N, k=k))
    bits = [lambda: n(3), lambda: n(4), lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"({n(3)})", lambda: "call", lambda: "und", lambda: "\n", lambda: f"{n(2)}/", lambda: "a dot b at c dot de"]
    for _ in range(60):
        text = " ".join(r.choice(bits)() for _ in range(r.randint(2, 5)))
        tokens = pii.tokens_of(text)
        if len(tokens) <= 14:
            blocked = [(2, 5)] if r.random() < 0.2 else []
            assert model.best(iter(tokens), blocked) == best_by_trial(model, tokens, blocked), text


def test_whole_texts_and_parts():
    """Windows around triggers give what the whole text's tokens give, whatever lies between them."""
    model, r = pii.field(), random.Random(4)
    n = lambda k: "".join(r.choices(N, k=k))
    far = [" und ".join(["lich"] * 40), "x" * 500, " . " * 30, "word " * 12]
    for _ in range(200):
        text = " ".join(r.choice([r.choice(far), f"call ({n(3)}) {n(3)}-{n(4)}", f"SSN {n(3)}-{n(2)}-{n(4)}", n(r.randint(1, 6)), "12\n", "anna at post dot com"]) for _ in range(r.randint(1, 8)))
        base = pii.base_spans(text)
        blocked = pii.disjoint((s, e) for _, s, e in base)
        assert model.added(text, base) == [x for x in model.best(pii.tokens_of(text), blocked) if x[0] in pii.ADDED], text


@pytest.mark.parametrize("kind", ["phone_local", "national_id", "account"])
@pytest.mark.parametrize("sep", [" ", ", ", "\n"])
def test_dense_texts_are_decoded_once(kind, sep, monkeypatch):
    r = random.Random(5)
    n = lambda k: "".join(r.choices(N, k=k))
    one = {"phone_local": lambda: f"({n(3)}) {n(3)}-{n(4)}", "national_id": lambda: f"{n(3)}-{n(2)}-{n(4)}", "account": lambda: "DE89 3704 0044 0532 0130 00"}[kind]
    parts = [one() for _ in range(600)]
    want, at = [], 0
    for p in parts:
        want.append((kind, at, at + len(p)))
        at += len(p) + len(sep)
    model, text = pii.field(), sep.join(parts)
    assert [x for x in pii.scan(model, text) if x[0] in pii.ADDED] == want
    monkeypatch.setattr(pii, "SETTLE", 20)  # entities given out early are the same
    assert [x for x in pii.scan(model, text) if x[0] in pii.ADDED] == want


def test_tables_of_numbers(spark):
    """Long dense texts end, in linear time; spans are distinct."""
    r = random.Random(6)
    texts = ["1 " * 20_000, " ".join(str(r.randrange(10**6)) for _ in range(10_000)), " ".join(f"{r.randrange(65536):04x}" for _ in range(10_000)), "7" * 200_000, "+1 (017) 555-7713 " * 3000, "", None, " \n\t"]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    for x in pii.pii_digest(docs).collect():
        assert len(set(x.spans.split(","))) == len(x.spans.split(","))
        assert x.n_phone == (3000 if x.doc_id == 4 else 0)
        assert x.doc_id < 5 or x.spans == ""
    clean = {x.doc_id: x.text for x in pii.redact(docs).collect()}
    assert clean[4] == "<phone> " * 3000 and clean[6] is None and clean[3] == texts[3]
    assert pii.redact(docs.limit(0)).count() == 0 and pii.redact(docs).columns == docs.columns
    assert pii.redact(docs.select("text", F.lit(1).alias("n_chars"))).filter("n_chars <> 1").count() >= 1

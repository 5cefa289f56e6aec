import unicodedata

import pytest
from pyspark.sql import functions as F

from tessella.functions import similarity as S
from tessella.functions import text as T


def value(spark, f, *args):
    cols = [F.lit(a) for a in args]
    return spark.range(1).select(f(*cols).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "args", "expected"),
    [
        (T.fold, ("@keystonechesapeake",), "keystonechesapeake"),
        (T.fold, ("Dréxkor",), "drexkor"),
        (T.fold, ("Bœuf™",), "b uf"),
        (T.fold, ("नमस्ते",), ""),
        (T.fold, ("",), ""),
        (T.name_squash, ("lumynoriental.com",), "lumynoriental"),
        (T.name_squash, ("Lumyn Oriental",), "lumynoriental"),
        (T.name_squash, ("us.com",), "uscom"),
        (T.name_squash, ("texaco",), "texa"),
        (T.name_core, ("C & G Homes LLC",), ["c", "g", "homes"]),
        (T.name_core, ("The Company Ltd",), ["the", "company", "ltd"]),
        (T.name_distinctive, ("Acme Services Inc",), ["acme"]),
        (T.name_tokens, ("",), []),
        (T.address_tokens, ("8526 Kensley Ln, Lakesite, TN", "US"), ["8526", "kensley", "lane", "lakesite", "tennessee"]),
        (T.address_tokens, ("8526 Kensley Ln, Lakesite, TN", "India"), ["8526", "kensley", "lane", "lakesite", "tamilnadu"]),
        (T.address_tokens, ("12 Oak Ct, Hartford, CT", "US"), ["12", "oak", "court", "hartford", "court"]),
        (T.address_tokens, ("Miami, FL", "US"), ["miami", "floor"]),
        (T.address_tokens, ("63 R. DE DIEPPE, LILLE", "France"), ["63", "rue", "de", "dieppe", "lille"]),
        (T.address_tokens, ("No 5 Main St", "US"), ["5", "main", "street"]),
        (T.numeric_tokens, ("12-B, Plot 100, 4thFloor, ID123456789",), ["100", "12", "4thfloor"]),
        (T.script_of, ("मेरीडियन",), "Devanagari"),
        (T.script_of, ("Москва",), "Latin"),
        (T.script_of, ("Café",), "Latin"),
        (T.ngrams, ("abcd",), ["abc", "bcd"]),
        (T.ngrams, ("cg",), ["cg"]),
        (T.ngrams, ("",), []),
    ],
)
def test_golden(spark, f, args, expected):
    assert value(spark, f, *args) == expected


def test_null_is_empty(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS x").select(T.fold(F.col("x")), T.script_of(F.col("x")), T.name_tokens(F.col("x"))).first()
    assert list(row) == ["", "Latin", []]


def test_fold_agrees_with_unicode(spark):
    """Every character with a compatibility form of letters or digits, and texts of several."""
    texts = ["ﬁn½ Ⅷ", "Ünï", "a_b", "Straße", "９９", "ﬁne Œuvre ½ ㎏ ①", "x²y", "e\u0301te\u0301", "№ 5 ℡ ㏂", "𝐚𝟗 🄁", "İstanbul"]
    texts += [chr(cp) for cp in range(0x80, 0x20000) if not 0xD800 <= cp < 0xE000 and any(x.isascii() and x.isalnum() for x in unicodedata.normalize("NFKD", chr(cp)))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold(F.col("t")).alias("x")).collect()
    assert len(rows) > 1900
    for r in rows:
        d = unicodedata.normalize("NFKD", r.t.lower())
        d = "".join(c for c in d if not unicodedata.combining(c))
        d = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in d)
        assert r.x == " ".join(d.split()), r.t


def test_gram_codes_are_ngrams(spark):
    texts = ["", "a", "ab", "abc", "a b", " ab", "12 oak road 12 oak", "zzzzz", "9", "a9 z0 0a"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.ngrams(F.col("t")).alias("g"), T.gram_codes(F.col("t")).alias("c")).collect()
    code = {}
    for r in d:
        assert len(r.g) == len(r.c)
        for g, c in zip(r.g, r.c, strict=True):
            assert code.setdefault(g, c) == c
    assert len(set(code.values())) == len(code)


def sets(spark, f, a, b):
    d = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    return d.select(f(F.col("a"), F.col("b")).alias("x")).first()["x"]


def test_similarities(spark):
    a, b = ["a", "b", "c"], ["b", "c", "d", "e"]
    assert sets(spark, S.jaccard, a, b) == pytest.approx(0.4)
    assert sets(spark, S.dice, a, b) == pytest.approx(4 / 7)
    assert sets(spark, S.containment, a, b) == pytest.approx(2 / 3)
    assert all(sets(spark, f, [], b) == 0 for f in (S.jaccard, S.dice, S.containment))
    assert sets(spark, lambda x, y: S.weighted_jaccard(F.array_intersect(x, y), F.lit(5.0), F.lit(6.0), F.lit(14.0)), a, b) == pytest.approx(1 / 3)
    assert sets(spark, lambda x, y: S.idf_cosine(F.lit(13.0), F.lit(14.0), F.lit(54.0)), a, b) == pytest.approx(0.472805, abs=1e-6)
    tags = F.array(*(S.tagged(F.lit(d), F.lit(t)) for d, t in ((9, "x"), (0, "a:b"))))
    assert spark.range(1).select(S.weight_sum(tags, 1000)).first()[0] == pytest.approx(4.605170 + 6.907755, abs=1e-5)
    assert spark.range(1).select(S.weight_sum(tags, 1000, 2)).first()[0] == pytest.approx(4.605170**2 + 6.907755**2, abs=1e-4)
    assert tuple(sets(spark, S.numeric_agreement, [], b)) == (0.0, False)
    assert tuple(sets(spark, S.numeric_agreement, ["x"], b)) == (0.0, True)

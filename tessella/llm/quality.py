"""Quality rules and robust multivariate outliers, in DataFrame functions only.

A text's statistics are transformed to a vector of five numbers. For each language and source, for each language and
for all rows the minimum-covariance-determinant estimate of centre and scatter is looked for: of all subsets of three
quarters of the rows the one whose scatter has the least determinant. Three starts (quartiles; spatial signs;
hyperbolic tangents) each take two concentration steps (keep the three quarters that lie nearest by Mahalanobis
distance, take their mean and scatter); the start of the least determinant goes on until no determinant falls any more.

Most components are exactly 0 in most texts, so plain determinants would be 0. The scatter is therefore that of the
regularised estimate (Boudt, Rousseeuw, Vanduffel and Verdonck, 2020): RIDGE parts of a diagonal target, and the rest of
the subset's covariance. A group's estimate is then drawn towards its language's and that towards all rows', with
weight n / (n + PRIOR) on its own; there is no size at which the rule changes. A row is rejected when its squared
distance from its group's estimate exceeds CUT.

No group meets in one task: each step is one aggregation of counts, sums and products by group and bin of the distance,
combined before the shuffle; the bin in which three quarters are reached counts in part. Each group's estimate is one
row of a small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import bounded_broadcast, shared, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Vector components, the standard deviations that the ridge alone leaves them (each component can exceed CUT by itself
#: within its range; clean texts vary as much), and the step of the bins for their quartiles.
DIMS = ("length", "word_length", "symbols", "dup_lines", "repeats")
LEAST = (0.5, 0.35, 0.06, 0.04, 0.04)
STEP = 0.02
#: Share of the target in the scatter, and its diagonal.
RIDGE = 0.1
TARGET = tuple(x * x / RIDGE for x in LEAST)
#: Share of rows in the subset, bins of a distance in one power of e, and what makes the subset's covariance consistent
#: for normal data: share / P(chi2 with 7 degrees <= 75 % quantile of chi2 with 5 degrees).
SHARE, BINS, CONSISTENT = 0.75, 16, 1.41
#: Steps of each start, the fall of a determinant that asks for another step, and a bound of steps that should not bind.
FIRST, FALL, MOST_STEPS = 2, 1e-3, 50
#: Rows that a group's pool counts for in its estimate.
PRIOR = 100
#: Squared distance from which a row is rejected: the 0.99999 quantile of chi2 with 5 degrees.
CUT = 30.86
BROADCAST_ROWS = 100_000
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(ws: Column) -> Column:
    """Words of `ws` that lie in a window of WINDOW words found twice or more. Windows are compared by 64-bit hashes."""

    def covered(win: Column) -> Column:
        def places(s: Column) -> Column:
            twice = lambda e, k: F.when((F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"])
            return F.array_sort(F.filter(F.transform(s, twice), lambda i: i.isNotNull()))

        pos = let(F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)
        reach = lambda p: F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(let(pos, reach), F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    def count(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(covered(win))

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) <= WINDOW, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), count))


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: Column) -> Column:
    """A struct of STATS; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda s: F.translate(s, SPACES, "") != "")
    counts = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeat_words(ws).alias("n_repeat_words")))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    rest = F.struct(F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"))
    return let(counts, lambda c: let(rest, lambda r: F.struct(c["n_words"].alias("n_words"), r["word_chars"].alias("word_chars"), r["n_symbols"].alias("n_symbols"), r["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"))))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (s["n_repeat_words"] * 100 > s["n_words"] * 30)


def vector(s: Column) -> list[Column]:
    """The transformed statistics, in the order of DIMS; texts without words are at 0."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return [F.log(n), s["word_chars"] / n, F.sqrt(s["n_symbols"] / n), F.sqrt(s["n_dup_lines"] / n), s["n_repeat_words"] / n]


D = range(len(DIMS))
LOWER = [(i, j) for i in D for j in range(i + 1)]


def _key(*cols: str) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}) if cols else F.lit("all")


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of one row for each group, kept once and broadcast if it has few rows (counted, if they aren't known)."""
    kept = shared(df)
    return bounded_broadcast(kept, kept.count() if rows is None else rows, BROADCAST_ROWS)


def _each(form: str, over=D) -> list[str]:
    """The SQL expression `form` for each i, or each (i, j) in `over`."""
    return [form.format(i=x) if isinstance(x, int) else form.format(i=x[0], j=x[1]) for x in over]


def _scales(used: DataFrame) -> DataFrame:
    """Rows (grp, m_i, s_i): medians, and quartile ranges as standard deviations, of each component."""
    binned = used.select("grp", F.posexplode(F.transform(F.array(_each("v{i}")), lambda x: F.floor(x / STEP).cast("int"))).alias("dim", "bin")).groupBy("grp", "dim", "bin").agg(F.count("*").alias("n"))
    run = binned.selectExpr("*", "sum(n) OVER (PARTITION BY grp, dim ORDER BY bin) AS upto", "sum(n) OVER (PARTITION BY grp, dim) AS total")
    q = lambda p: F.expr(f"min(CASE WHEN upto >= total * {p} THEN (bin + 0.5) * {STEP}D END)")
    one = run.groupBy("grp", "dim").agg(q(0.25).alias("a"), q(0.5).alias("b"), q(0.75).alias("c"))
    return one.groupBy("grp").agg(*(F.expr(f"max(CASE WHEN dim = {i} THEN b END)").alias(f"m{i}") for i in D), *(F.expr(f"greatest(max(CASE WHEN dim = {i} THEN (c - a) / 1.349D END), {LEAST[i]}D)").alias(f"s{i}") for i in D))


def _factored(df: DataFrame, *keep: str) -> DataFrame:
    """From centres m_i and scatters c_i_j: these, the inverse k_i_j of the scatter's lower Cholesky factor l_i_j, and the
    determinant. A regularised scatter is positive definite, so all pivots are above 0."""
    out = []
    for i, j in sorted(LOWER, key=lambda x: x[::-1]):
        rest = f"c_{i}_{j}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
        out.append(f"sqrt({rest}) AS l_{i}_{j}" if i == j else f"({rest}) / l_{j}_{j} AS l_{i}_{j}")
    for i, j in sorted(LOWER, key=lambda x: x[::-1]):
        inner = " + ".join(f"l_{i}_{k} * k_{k}_{j}" for k in range(j, i))
        out.append(f"1 / l_{i}_{i} AS k_{i}_{j}" if i == j else f"-({inner}) / l_{i}_{i} AS k_{i}_{j}")
    out.append("pow(" + " * ".join(_each("l_{i}_{i}")) + ", 2) AS det")  # later columns of a select may name earlier ones
    return df.selectExpr("*", *out).select(*keep, *_each("m{i}"), *_each("c_{i}_{j}", LOWER), *_each("k_{i}_{j}", LOWER), "det")


def _ridged(c: str, i: int, j: int) -> str:
    return f"({c}) * {1 - RIDGE}D" + (f" + {RIDGE * TARGET[i]}D" if i == j else "") + f" AS c_{i}_{j}"


#: Squared Mahalanobis distance of v_i from the estimate in columns m_i and k_i_j.
DISTANCE = " + ".join("pow(" + " + ".join(f"k_{i}_{j} * (v{j} - m{j})" for j in range(i + 1)) + ", 2)" for i in D)


def _starts(used: DataFrame) -> DataFrame:
    """Rows (grp, start, ...) of the three starts: the diagonal of the scales, the covariance of spatial signs and that of
    hyperbolic tangents, both of rows centred and scaled by quartiles; all around the medians."""
    scales = _small(_scales(used))
    norm = "sqrt(" + " + ".join(_each("z{i} * z{i}")) + ")"
    d = used.join(scales, "grp").selectExpr("grp", *_each("(v{i} - m{i}) / s{i} AS z{i}"))
    d = d.selectExpr("grp", *_each("z{i}"), f"{norm} AS norm").selectExpr("grp", *_each("tanh(z{i}) AS y{i}"), *_each("CASE WHEN norm > 0 THEN z{i} / norm ELSE 0D END AS u{i}"))
    mean = [f"avg(y{i}) AS a{i}" for i in D] + _each("avg(y{i} * y{j}) AS y_{i}_{j}", LOWER) + _each("avg(u{i} * u{j}) AS u_{i}_{j}", LOWER)
    both = d.groupBy("grp").agg(*map(F.expr, mean)).join(scales, "grp")
    ways = [
        lambda i, j: f"s{i} * s{j}" if i == j else "0D",
        lambda i, j: f"s{i} * s{j} * u_{i}_{j} * {len(DIMS)}",
        lambda i, j: f"s{i} * s{j} * (y_{i}_{j} - a{i} * a{j})",
    ]
    each = "inline(array(" + ", ".join("named_struct('start', " + str(k) + ", " + ", ".join(f"'c_{i}_{j}', {_ridged(way(i, j), i, j).split(' AS ')[0]}" for i, j in LOWER) + ")" for k, way in enumerate(ways)) + "))"
    return _small(_factored(both.selectExpr("grp", *_each("m{i}"), each), "grp", "start"))


def _concentrated(used: DataFrame, now: DataFrame, rows: int) -> DataFrame:
    """One concentration step for each (grp, start) of `now`, which has this many rows; with the determinant before."""
    far = f"CAST(floor(ln({DISTANCE} + 1e-9) * {BINS}) AS INT) AS bin"
    sums = _each("a{i}") + _each("b_{i}_{j}", LOWER)
    # about the last centre, so that squares stay small
    d = used.join(now, "grp").selectExpr("grp", "start", far, *_each("v{i} - m{i} AS x{i}"))
    binned = d.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *map(F.expr, _each("sum(x{i}) AS a{i}") + _each("sum(x{i} * x{j}) AS b_{i}_{j}", LOWER)))
    run = binned.selectExpr("*", "sum(n) OVER (PARTITION BY grp, start ORDER BY bin) AS upto", "sum(n) OVER (PARTITION BY grp, start) AS total")
    run = run.withColumn("part", F.expr(f"greatest(0D, least(1D, (total * {SHARE}D - (upto - n)) / n))")).filter("part > 0")
    subset = run.groupBy("grp", "start").agg(F.expr("sum(n * part) AS h"), *(F.expr(f"sum({c} * part) AS {c}") for c in sums))
    centred = subset.join(now.selectExpr("grp", "start", "det AS old", *_each("m{i} AS o{i}")), ["grp", "start"])
    cov = lambda i, j: f"(b_{i}_{j} / h - a{i} / h * a{j} / h) * {CONSISTENT}D"
    return _small(_factored(centred.selectExpr("grp", "start", "old", *_each("o{i} + a{i} / h AS m{i}"), *(_ridged(cov(i, j), i, j) for i, j in LOWER)), "grp", "start", "old"), rows)


def determinants(used: DataFrame) -> DataFrame:
    """Rows (grp, start, m_i, c_i_j, k_i_j, det): each group's minimum-covariance-determinant estimate, from rows
    (grp, v_i)."""
    now = _starts(used)
    rows = now.count()
    for _ in range(FIRST):
        now = _concentrated(used, now, rows)
    best = now.groupBy("grp").agg(F.expr("min(struct(round(ln(det), 9) AS det, start AS start)).start AS start"))
    now = _small(now.join(best, ["grp", "start"], "left_semi"))
    for _ in range(MOST_STEPS):
        now = _concentrated(used, now, rows)
        fall = now.agg(F.expr("max((old - det) / old)")).first()[0]
        if fall is None or fall <= FALL:
            break
    return now


def estimates(rows: DataFrame) -> DataFrame:
    """Rows (lang, source, m_i, k_i_j) from rows (lang, source, use, v_i); only rows with `use` count."""
    keys = [("own", _key("lang", "source")), ("by_lang", _key("lang")), ("whole", _key())]
    used = rows.filter("use").select(F.explode(F.array(*(k for _, k in keys))).alias("grp"), *_each("v{i}"))
    numbers = _each("m{i}") + _each("c_{i}_{j}", LOWER)
    now = determinants(used).select("grp", *numbers)
    d = rows.filter("use").groupBy("lang", "source").agg(F.count("*").alias("n_own")).withColumn("n_by_lang", F.sum("n_own").over(W.partitionBy("lang")))
    for name, key in keys:
        d = d.withColumn("grp", key).join(now.selectExpr("grp", *(f"{c} AS {name}_{c}" for c in numbers)), "grp").drop("grp")

    def drawn(d: DataFrame, name: str, pool: str) -> DataFrame:
        w = f"(n_{name} / (n_{name} + {PRIOR}))"
        mix = lambda c: f"{w} * {name}_{c} + (1 - {w}) * {pool}_{c}"
        gap = lambda i: f"({name}_m{i} - {pool}_m{i})"
        others = [c for c in d.columns if not c.startswith((f"{name}_", f"{pool}_"))]
        return d.selectExpr(*others, *(f"{mix(f'm{i}')} AS {name}_m{i}" for i in D), *(f"{mix(f'c_{i}_{j}')} + {w} * (1 - {w}) * {gap(i)} * {gap(j)} AS {name}_c_{i}_{j}" for i, j in LOWER))

    d = shared(drawn(drawn(d, "by_lang", "whole"), "own", "by_lang"))
    final = _factored(d.selectExpr("lang", "source", *(f"own_{c} AS {c}" for c in numbers)), "lang", "source")
    return _small(final.select("lang", "source", *_each("m{i}"), *_each("k_{i}_{j}", LOWER)))


def verdict(rows: DataFrame, now: DataFrame) -> DataFrame:
    """`rows` (lang, source, _q_use, v_i, ...) with _q_far, the squared distance; null without _q_use."""
    g = now.withColumnsRenamed({"lang": "_q_lang", "source": "_q_source"})
    return rows.join(g, F.col("_q_use") & F.col("lang").eqNullSafe(F.col("_q_lang")) & F.col("source").eqNullSafe(F.col("_q_source")), "left").withColumn("_q_far", F.expr(DISTANCE))


def quality_report(df: DataFrame) -> DataFrame:
    """Rows (doc_id, STATS, base_failed, distance, kept), one for each row of `df` (doc_id, text, lang, source).

    Rejected are texts of under 20 words, texts of which over 30 % lie in repeated windows, and outliers of their
    language and source (null is one language and one source). A null text has no words. Repeated rows get the same
    verdict each; an empty table gives an empty result.
    """
    s = F.col("s")
    v = [x.alias(f"v{i}") for i, x in enumerate(vector(s))]
    rows = shared(df.select("doc_id", "lang", "source", statistics(F.col("text")).alias("s")).select("doc_id", "lang", "source", "s", base_failed(s).alias("base_failed"), *v).withColumn("use", ~F.col("base_failed")))
    out = verdict(rows.withColumn("_q_use", F.col("use")), estimates(rows))
    far = F.when(F.col("use"), F.col("_q_far"))
    return out.select("doc_id", *(f"s.{c}" for c in STATS), "base_failed", F.round(far, 6).alias("distance"), (F.col("use") & ~F.coalesce(far > CUT, F.lit(False))).alias("kept"))


def keep_good(df: DataFrame) -> DataFrame:
    """The rows of `df` that `quality_report` keeps, with all columns of `df`, whatever their names; repeated rows stay
    repeated, a null text goes, an empty table stays empty. Statistics are taken twice, once for the estimates and once
    beside the rows, so that no text is shuffled."""
    mine = df.columns
    s = F.col("_q_s")
    named = [F.col(c).alias(f"_own{i}") for i, c in enumerate(mine)]  # columns of `df` can have any name
    base = df.select(*named).select("*", *(F.col(f"_own{mine.index(c)}").alias(c) for c in ("lang", "source", "text")))
    rows = base.select("lang", "source", statistics(F.col("text")).alias("_q_s")).select("lang", "source", (~base_failed(s)).alias("use"), *(x.alias(f"v{i}") for i, x in enumerate(vector(s))))
    now = estimates(shared(rows))
    e = base.withColumn("_q_s", statistics(F.col("text"))).withColumn("_q_use", ~base_failed(s))
    # one condition after the join: a filter on _q_use alone would be pushed below it, with the statistics once more
    good = F.when(F.col("_q_use"), F.coalesce(F.col("_q_far"), F.lit(0.0)) <= CUT).otherwise(F.lit(False))
    kept = verdict(e.select("*", *(x.alias(f"v{i}") for i, x in enumerate(vector(s)))), now).filter(good)
    return kept.select([F.col(f"_own{i}").alias(c) for i, c in enumerate(mine)])

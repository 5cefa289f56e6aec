"""Mixing sources to target weights, in DataFrame functions only.

Targets: sources in code point order weigh `weights`, repeating, and share `share` times all words; no target exceeds
`cap` times its source, and what is above is shared again by weight. The share of one weight at which this settles is
found from prefix sums over the sources, sorted by the share at which each reaches its cap.

Selection (Efraimidis-Spirakis): a row's key is -ln(u) / quality, with u from a hash of its contents, so reruns
agree. A source takes complete epochs first; the rest of its target goes to its rows in key order until the words are
used up, the last row in part. No source is sorted as a whole: words are summed by source and key bin (logarithmic
bins, a thousandth of the rows or less each), and only the bin in which the target is reached is put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import bounded_broadcast, shared, word_count

#: Bins of the key in one power of e; rows of the table of sources up to which it is broadcast.
BINS = 512
BROADCAST_ROWS = 100_000
OWN = ("size", "source_size", "target", "taken")


def quality(text: Column, size: Column) -> Column:
    """A weight in [0.1, 1]: words of a usual mean length weigh most. Texts without words weigh 0.1."""
    chars = F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", ""))
    return F.when(size == 0, F.lit(0.1)).otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - F.abs(chars / size - F.lit(5.5)) / F.lit(10.0)))


def keyed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight: Column | None = None) -> DataFrame:
    """`df` with _mix_size (words), _mix_key (exponential key) and _mix_tie (hash of the row) after its own columns. Null ids,
    sources and texts count as empty in the hash; `weight` must be above 0."""
    d = df.withColumn("_mix_size", word_count(F.col(text_col)))
    d = d.withColumn("_mix_tie", F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))))
    u = (F.conv(F.substring("_mix_tie", 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)
    return d.withColumn("_mix_key", -F.log(u) / (weight if weight is not None else quality(F.col(text_col), F.col("_mix_size"))))


def _bin(key: Column) -> Column:
    return F.floor(F.log(key) * BINS).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size), one for each source, null among them."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    d = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1))
    d = d.withColumn("full", F.col("source_size") * F.lit(cap) / F.col("weight"))
    by_full = W.orderBy("full", "rank")
    so_far = by_full.rowsBetween(W.unboundedPreceding, -1)
    rest = by_full.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1))
    d = d.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("source_size").over(so_far), F.lit(0)) * F.lit(cap)) / F.sum("weight").over(rest))
    d = d.withColumn("open", F.when(F.col("full") > F.col("level"), F.struct("full", "rank", "level")))
    d = d.withColumn("share", F.min("open").over(whole)["level"])
    return d.select("source", "source_size", F.when(F.col("full") <= F.coalesce("share", F.col("full")), F.col("source_size") * F.lit(cap)).otherwise(F.col("share") * F.col("weight")).alias("target"))


def plan(rows: DataFrame, source_col: str = "source", **how) -> DataFrame:
    """One row for each source: target, epochs, and where in key order its last words are taken."""
    sums = shared(rows.groupBy(F.col(source_col).alias("source"), _bin(F.col("_mix_key")).alias("bin")).agg(F.sum("_mix_size").alias("words")))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), **how)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.floor(F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")) + F.lit(0.5)).cast("long"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = sums.withColumn("before", before).alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("g.*", "bin", "before")
    last = F.max(F.when(F.col("before") < F.col("rest"), F.struct("bin", "before")))
    keep = ["source_size", "target", "epochs", "rest"]
    out = runs.groupBy("source").agg(*(F.first(c).alias(c) for c in keep), last.alias("last"))
    return shared(out.select("source", *keep, F.col("last.bin").alias("last_bin"), F.col("last.before").alias("before")))


def mix(rows: DataFrame, source_col: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """`rows` (of `keyed`) with size, source_size, target and taken: how many of a row's words the mix takes, repeats
    counted, at most twice its size; the four replace columns of these names. Every row stays, also those taken 0 times.

    A null text has size 0; a null source is one source, last in order; equal rows are taken one after the other, in
    no order that could be told; an empty table gives an empty result.
    """
    rows = rows.drop(*OWN)
    mine = [c for c in rows.columns if not c.startswith("_mix_")]
    p = plan(rows, source_col, **how)
    p = p.select([F.col(c).alias(f"_mix_p_{c}") for c in p.columns])
    d = rows.withColumn("_mix_bin", _bin(F.col("_mix_key"))).join(bounded_broadcast(p, p.count(), BROADCAST_ROWS), F.col(source_col).eqNullSafe(F.col("_mix_p_source")))
    size, rest, last = F.col("_mix_size"), F.col("_mix_p_rest"), F.col("_mix_p_last_bin")
    at_last = F.coalesce(F.col("_mix_bin") == last, F.lit(False))
    whole = d.filter(~at_last).withColumn("_mix_part", F.when(F.col("_mix_bin") < last, size).otherwise(F.lit(0).cast("long")))
    order = W.partitionBy(F.col(source_col)).orderBy("_mix_key", F.col(id_col), "_mix_tie").rowsBetween(W.unboundedPreceding, -1)
    left = rest - F.col("_mix_p_before") - F.coalesce(F.sum(size).over(order), F.lit(0))
    cut = d.filter(at_last).withColumn("_mix_part", F.greatest(F.lit(0).cast("long"), F.least(size, left)))
    return whole.unionByName(cut).select(*mine, size.alias("size"), F.col("_mix_p_source_size").alias("source_size"), F.col("_mix_p_target").alias("target"), (F.col("_mix_p_epochs") * size + F.col("_mix_part")).alias("taken"))


def mix_digest(df: DataFrame) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of `df` (doc_id, source, text); no other column
    is read. A null text has size 0 and is taken 0 times; a null source is one source, last in order; ids may be null or
    repeated; equal keys are ordered by id and contents. A source without words has target 0. An empty table gives none."""
    slim = shared(keyed(df.select("doc_id", "source", "text")).drop("text"))
    return mix(slim).select("doc_id", "size", "source_size", "target", "taken")


def _chars_of_words(text: Column, n: Column) -> Column:
    """Characters of a text up to the end of its n-th word. A walk over the pieces between single spaces: a repeated
    group in a Java pattern overflows the stack after some thousand words."""
    pieces = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1)
    step = lambda s, p: F.when(s["n"] < n, F.struct((s["n"] + (p != "").cast("long")).alias("n"), (s["c"] + F.length(p) + 1).cast("long").alias("c"))).otherwise(s)
    return F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c")), step)["c"] - 1


def take(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str | None = "n_chars", weight: Column | None = None, **how) -> DataFrame:
    """The mixed rows themselves, with the columns of `df`, whatever their names: a row taken k times and a part comes k
    times whole and once with its first words up to that part; rows taken 0 times go, so a null text and one without
    words do. Equal rows each count as a row; an empty table gives an empty result. `weight` is an expression over `df`.
    """
    mine = df.columns
    own = {c: f"_own{i}" for i, c in enumerate(mine)}  # columns of `df` can have any name
    named = [F.col(f"`{c}`").alias(o) for c, o in own.items()]
    rows = df.select(*named, *([] if weight is None else [weight.alias("_mix_weight")]))
    text = own[text_col]
    d = mix(keyed(rows, own[id_col], own[source_col], text, None if weight is None else F.col("_mix_weight")), own[source_col], own[id_col], **how)
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    d = d.withColumn("_mix_words", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), copies), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))))
    first = F.substring(F.col(text), F.lit(1), _chars_of_words(F.col(text), F.col("_mix_words")).cast("int"))
    d = d.withColumn(text, F.when(F.col("_mix_words") < 0, F.col(text)).otherwise(first))
    if chars_col and chars_col in mine:
        n = F.col(own[chars_col])
        d = d.withColumn(own[chars_col], F.when(F.col("_mix_words") < 0, n).otherwise(F.length(text)).cast(df.schema[chars_col].dataType))
    return d.select([F.col(o).alias(c) for c, o in own.items()])


#: The same rows in DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT doc_id, source, t, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), md5(t))) AS tie FROM d
), k AS (
  SELECT doc_id, source, size, tie,
         -ln((CAST(CAST('0x' || substr(tie, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
         / CASE WHEN size = 0 THEN 0.1 ELSE greatest(0.1, 1.0::DOUBLE - abs(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) / size::DOUBLE - 5.5::DOUBLE) / 10.0::DOUBLE) END AS key
  FROM s
), z AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM z
), w AS (
  SELECT *, [3, 1, 2][((rank - 1) % 3) + 1] AS weight FROM r
), f AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS full_at FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
            / sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f
), o AS (
  SELECT *, (SELECT l2.level FROM l AS l2 WHERE l2.full_at > l2.level ORDER BY l2.full_at, l2.rank LIMIT 1) AS share FROM l
), g AS (
  SELECT source, source_size, CASE WHEN full_at <= coalesce(share, full_at) THEN source_size * 2.0::DOUBLE ELSE share * weight END AS target FROM o
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g
), q AS (
  SELECT *, CAST(floor(greatest(0.0, target - epochs * source_size) + 0.5) AS BIGINT) AS rest FROM p
), j AS (
  SELECT k.doc_id, k.size, q.source_size, q.target, q.epochs, q.rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM j
"""

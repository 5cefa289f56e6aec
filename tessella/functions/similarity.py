"""Similarities of sets (arrays of distinct strings) as Column expressions; 0 where a set or the intersection is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def _ratio(over: Column, under: Column) -> Column:
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column, i: Column | None = None) -> Column:
    i = common(a, b) if i is None else i
    return _ratio(i, F.size(a) + F.size(b) - i)


def dice(a: Column, b: Column, i: Column | None = None) -> Column:
    i = common(a, b) if i is None else i
    return _ratio(i * 2, F.size(a) + F.size(b))


def containment(a: Column, b: Column, i: Column | None = None) -> Column:
    i = common(a, b) if i is None else i
    return _ratio(i, F.least(F.size(a), F.size(b)))


def tagged(df: Column, token: Column) -> Column:
    """A token with its document frequency before it, so that what tokens weigh travels with them and an intersection
    of two sets needs no second look at either."""
    return F.concat(df.cast("string"), F.lit(":"), token)


def weight_sum(toks: Column, n_docs: int, power: int = 1) -> Column:
    """Sum of the weights ln(n_docs / (df + 1)), or of their squares, of tagged tokens."""

    def one(t: Column) -> Column:
        w = F.log(F.lit(float(n_docs)) / (F.substring_index(t, ":", 1).cast("long") + 1))
        return w if power == 1 else F.pow(w, F.lit(power))

    return F.aggregate(toks, F.lit(0.0), lambda s, t: s + one(t))


def weighted_jaccard(both: Column, weight: Column, total_a: Column, total_b: Column) -> Column:
    """Weight of the intersection `both` over that of the union; `total_*` are the sets' weights, summed before the join."""
    return F.when((F.size(both) > 0) & (total_a + total_b - weight > 0), weight / (total_a + total_b - weight)).otherwise(F.lit(0.0))


def idf_cosine(squares: Column, square_a: Column, square_b: Column) -> Column:
    """Squared weights of the intersection over the product of the norms; `square_*` are the sets' squared weights."""
    return F.when(square_a * square_b > 0, squares / F.sqrt(square_a * square_b)).otherwise(F.lit(0.0))


def numeric_agreement(a: Column, b: Column) -> Column:
    """Struct of containment and whether both sides have numbers at all."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.struct(containment(a, b).alias("score"), both.alias("evidence"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors within [-1, 1]; null where one is missing."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))

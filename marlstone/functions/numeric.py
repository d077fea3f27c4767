"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; both arrays are as long."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector divided by its length; null when that is zero or not finite."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def diminishing(values: Column) -> Column:
    """1, 1/2 and 1/4 of the three largest positive values, summed."""
    top = F.slice(F.sort_array(F.filter(values, lambda x: x > 0), asc=False), 1, 3)
    return F.aggregate(F.transform(top, lambda x, i: x * F.element_at(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25)), i + 1)), F.lit(0.0), lambda s, x: s + x)


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a rate, cut to [0, 1]; nulls for n = 0."""
    size = n.cast("double")
    p = F.try_divide(successes.cast("double"), size)
    middle = (p + z * z / (2 * size)) / (1 + z * z / size)
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / (1 + z * z / size)
    zero = n == 0
    return F.when(~zero, F.greatest(middle - half, F.lit(0.0))), F.when(~zero, F.least(middle + half, F.lit(1.0)))


def exact_binomial(b: Column, c: Column) -> Column:
    """Two-sided exact test that b and c discordant pairs are a fair coin's; 1 without any.

    The tail's terms follow from one another, C(n, i + 1) = C(n, i) (n - i) / (i + 1), in log space.
    """
    n, low = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("tail"))
    steps = F.when(low > 0, F.sequence(F.lit(0), low - 1)).otherwise(F.array().cast("array<int>"))

    def grow(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i) / (i + 1.0))
        return F.struct(term.alias("term"), (s["tail"] + F.exp(term)).alias("tail"))

    tail = F.aggregate(steps, start, grow, lambda s: s["tail"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))

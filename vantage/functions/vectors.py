"""Vector arithmetic as higher-order functions. Inputs may be arrays of any number; everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def pairwise_sum(a: Column, b: Column, term) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), term))


def dot(a: Column, b: Column) -> Column:
    return pairwise_sum(a, b, lambda x, y: x * y)


def sqnorm(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x)


def l2sqr(a: Column, b: Column) -> Column:
    """Squared Euclidean distance through the inner product; rounding never makes it negative."""
    return F.greatest(F.lit(0.0), sqnorm(a) + sqnorm(b) - 2 * dot(a, b))


def l1(a: Column, b: Column) -> Column:
    return pairwise_sum(a, b, lambda x, y: F.abs(x - y))


def chi2(a: Column, b: Column) -> Column:
    """Sum of (x - y)^2 / (x + y), terms with x + y = 0 left out."""
    return pairwise_sum(a, b, lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), x + y), F.lit(0.0)))


def signed_chi2(a: Column, b: Column) -> Column:
    """As chi2 with |x| + |y| below, for components of either sign."""
    return pairwise_sum(a, b, lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), F.abs(x) + F.abs(y)), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(sqnorm(a)) * F.sqrt(sqnorm(b)))


DISTANCES = {1: l1, 2: l2sqr, 3: chi2, 4: signed_chi2, 16: cosine}


def scale(v: Column, by: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def add_scaled(w: Column, by: Column, v: Column) -> Column:
    return F.zip_with(w, doubles(v), lambda a, x: a + by * x)


def norm(v: Column, p: float = 2.0) -> Column:
    if p == 2.0:
        return F.sqrt(sqnorm(v))
    return F.pow(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + F.pow(F.abs(x), F.lit(p))), F.lit(1.0 / p))


def normalize(v: Column, p: float = 2.0) -> Column:
    """v over its norm; a zero vector gives NaN in every component."""
    n = norm(v, p)
    return F.transform(doubles(v), lambda x: F.coalesce(F.try_divide(x, n), F.lit(float("nan"))))


def power_l1(v: Column) -> Column:
    """Square roots of the components, divided by their sum; a zero vector gives NaN."""
    root = F.transform(doubles(v), F.sqrt)
    return F.transform(root, lambda x: F.coalesce(F.try_divide(x, total(root)), F.lit(float("nan"))))


def argmax(v: Column) -> Column:
    """0-based place of the first largest component."""
    return F.array_position(v, F.array_max(v)) - 1


def k_largest(v: Column, k: int) -> Column:
    """The k largest components as (value, place), place from 0; of equal ones the earlier comes first."""
    pairs = F.transform(doubles(v), lambda x, i: F.struct((-x).alias("o"), i.alias("i"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p.value.alias("value"), p.i.alias("place")))


def k_smallest(v: Column, k: int) -> Column:
    pairs = F.transform(doubles(v), lambda x, i: F.struct(x.alias("o"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p.o.alias("value"), p.i.alias("place")))


def bits(v: Column) -> Column:
    """Each byte as 8 numbers 0 or 1, lowest bit first."""
    return F.flatten(F.transform(v, lambda b: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit(b.cast("int"), i).cast("int"))))


def sub_vector(v: Column, part: Column, of: int) -> Column:
    """The part-th (from 0) of `of` equal pieces."""
    d = (F.size(v) / of).cast("int")
    return F.slice(v, part * d + 1, d)


def label_colour(label: Column, n: int) -> Column:
    """(red, green, blue) from 0 to 1 of a label among n, evenly around the colour wheel."""
    at = (label % n) * 6.0 / n
    wave = lambda turn: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs((at + turn) % 6 - 3) - 1))
    return F.struct(wave(0).alias("red"), wave(4).alias("green"), wave(2).alias("blue"))

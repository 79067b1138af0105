"""Training windows of an exemplar: shifted positives and random negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions import geometry


def positive_shifts(queries: DataFrame, shifts: tuple[int, ...], width: Column, height: Column) -> DataFrame:
    """queries' windows x1, x2, y1, y2 moved by every pair of shifts and cut at the page (width, height), with dx, dy and whether
    the cut window has to be resized."""
    s = F.array(*map(F.lit, shifts))
    moved = queries.withColumn("__w", F.col("x2") - F.col("x1")).withColumn("__h", F.col("y2") - F.col("y1")).withColumn("dx", F.explode(s)).withColumn("dy", F.explode(s))
    for c, d in (("x1", "dx"), ("x2", "dx"), ("y1", "dy"), ("y2", "dy")):
        moved = moved.withColumn(c, F.col(c) + F.col(d))
    cut = geometry.clamp(moved, width, height)
    return cut.withColumn("resized", (F.col("x2") - F.col("x1") != F.col("__w")) | (F.col("y2") - F.col("y1") != F.col("__h"))).drop("__w", "__h")


def draw(*places: Column) -> Column:
    """A number in [0, 1) from integers, in arithmetic that any SQL engine shares."""
    mixed = F.lit(12345).cast("long")
    for i, p in enumerate(places):
        mixed = (mixed * 48271 + p.cast("long") * (7919 + 2 * i) + 11) % 2147483647
    return (mixed % 10007) / F.lit(10007.0)


def negative_windows(queries: DataFrame, pages: DataFrame, per_page: int) -> DataFrame:
    """(query_id, doc_id, n, r, c): per_page random window starts on every page for every query (bh, bw cells), whatever the page
    shows. round() of a uniform number over the starts but the last: end starts have half the weight, the last one none."""
    met = queries.select("query_id", F.col("bh").alias("th"), F.col("bw").alias("tw")).join(pages.select("doc_id", "bh", "bw"), F.expr("bh >= th AND bw >= tw"))
    n = met.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(per_page - 1))))
    start = lambda size, t, salt: F.floor(F.greatest(F.lit(0), F.col(size) - F.col(t) - 1) * draw(F.col("query_id"), F.col("doc_id"), F.col("n"), F.lit(salt)) + 0.5).cast("int")
    return n.select("query_id", "doc_id", "n", start("bh", "th", 1).alias("r"), start("bw", "tw", 2).alias("c"))

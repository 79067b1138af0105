"""Boxes and pages. Pixels are 1-based and inclusive; cells are 0-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size(df: DataFrame) -> DataFrame:
    """Adds h and w of boxes x1, x2, y1, y2."""
    return df.withColumn("h", F.col("y2") - F.col("y1") + 1).withColumn("w", F.col("x2") - F.col("x1") + 1)


def clamp(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut at the page's borders."""
    return (
        df.withColumn("x1", F.greatest(F.col("x1"), F.lit(1)))
        .withColumn("y1", F.greatest(F.col("y1"), F.lit(1)))
        .withColumn("x2", F.least(F.col("x2"), width))
        .withColumn("y2", F.least(F.col("y2"), height))
    )


def page_crop(pages: DataFrame, sbin: int) -> DataFrame:
    """Adds the centred crop of a page (h, w) to a multiple of sbin: its origin x_ini, y_ini, its size and its cells without the
    border cell on each side."""
    rest_h, rest_w = F.col("h") % sbin, F.col("w") % sbin
    return (
        pages.withColumn("y_ini", F.floor(rest_h / 2).cast("int") + 1)
        .withColumn("x_ini", F.floor(rest_w / 2).cast("int") + 1)
        .withColumn("crop_h", F.col("h") - rest_h)
        .withColumn("crop_w", F.col("w") - rest_w)
        .withColumn("bh", ((F.col("h") - rest_h) / sbin).cast("int") - 2)
        .withColumn("bw", ((F.col("w") - rest_w) / sbin).cast("int") - 2)
    )


def query_window(queries: DataFrame, sbin: int) -> DataFrame:
    """Queries' boxes grown by a cell on each side and shrunk to a multiple of sbin: the smaller half of what is left over goes
    at the top and left, the larger at the bottom and right. Adds new_h, new_w and the model's cells bh, bw."""
    grown = size(queries.withColumn("x1", F.col("x1") - sbin).withColumn("x2", F.col("x2") + sbin).withColumn("y1", F.col("y1") - sbin).withColumn("y2", F.col("y2") + sbin))
    out = grown.withColumn("rh", F.col("h") % sbin).withColumn("rw", F.col("w") % sbin)
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    out = out.withColumn("y1", F.col("y1") + half("rh")).withColumn("y2", F.col("y2") - (F.col("rh") - half("rh")))
    out = out.withColumn("x1", F.col("x1") + half("rw")).withColumn("x2", F.col("x2") - (F.col("rw") - half("rw")))
    out = out.withColumn("new_h", F.col("h") - F.col("rh")).withColumn("new_w", F.col("w") - F.col("rw"))
    return out.withColumn("bh", (F.col("new_h") / sbin).cast("int") - 2).withColumn("bw", (F.col("new_w") / sbin).cast("int") - 2).drop("rh", "rw", "h", "w")


def window_box(r: Column, c: Column, x_ini: Column, y_ini: Column, new_h: Column, new_w: Column, sbin: int) -> list[Column]:
    """Pixel box of the window whose first cell is (r, c)."""
    x1, y1 = c * sbin + x_ini, r * sbin + y_ini
    return [x1.alias("x1"), (x1 + new_w - 1).alias("x2"), y1.alias("y1"), (y1 + new_h - 1).alias("y2")]


def intersection(a: str, b: str) -> Column:
    """Area that boxes a.x1.. and b.x1.. share."""
    w = F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1")) + 1
    h = F.least(F.col(f"{a}.y2"), F.col(f"{b}.y2")) - F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1")) + 1
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))

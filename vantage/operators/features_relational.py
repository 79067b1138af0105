"""The descriptors of operators.features as a relational plan: windows for the stencils, an aggregation for the votes.

Nothing here leaves Catalyst. It is the form to check the kernel with, and to run where pages are too large for one task:
work is dealt out by rows and columns of pixels, not by pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vantage.operators.features import CLIP, COS, EPS, SIN, TEXTURE


def pixels(pages: DataFrame) -> DataFrame:
    """(doc_id, h, w, y, x, v) of pages (doc_id, h, w, pixels)."""
    rows = pages.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("line", F.substring("pixels", F.col("y") * F.col("w") + 1, F.col("w")))
    value = lambda x: F.conv(F.hex(F.substring("line", x + 1, F.lit(1))), 16, 10).cast("double")
    cells = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("w") - 1), value)).alias("x", "v")
    return rows.select("doc_id", "h", "w", "y", "line").select("doc_id", "h", "w", "y", cells)


def cells_across(side: Column, sbin: int) -> Column:
    return F.floor(side / sbin + 0.5).cast("int")


def gradients(px: DataFrame, sbin: int) -> DataFrame:
    """(doc_id, h, w, y, x, v, o): magnitude and orientation of the visible inner pixels."""
    across, down = W.partitionBy("doc_id", "y").orderBy("x"), W.partitionBy("doc_id", "x").orderBy("y")
    d = px.withColumn("dx", F.lead("v").over(across) - F.lag("v").over(across)).withColumn("dy", F.lead("v").over(down) - F.lag("v").over(down))

    def shown(at: str, side: str) -> Column:
        """Where an inner pixel shows: at its own place, the last one in the rest of its line too, as far as cells reach."""
        end = cells_across(F.col(side), sbin) * sbin - 2
        last = F.greatest(F.col(at), end)
        places = F.when(F.col(at) == F.col(side) - 2, F.sequence(F.col(at), last)).otherwise(F.array(at))
        return F.explode(F.filter(places, lambda p: p <= end))

    d = d.where("dx IS NOT NULL AND dy IS NOT NULL").withColumn("sy", shown("y", "h")).withColumn("sx", shown("x", "w"))
    along = F.array(*[F.lit(sign * c) * F.col("dx") + F.lit(sign * s) * F.col("dy") for c, s in zip(COS, SIN, strict=True) for sign in (1, -1)])
    best = F.array_position("a", F.array_max("a")) - 1
    o = F.when(F.array_max("a") > 0, F.floor(best / 2) + 9 * (best % 2)).otherwise(0).cast("int")
    return d.withColumn("a", along).select("doc_id", "h", "w", F.col("sy").alias("y"), F.col("sx").alias("x"), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("v"), o.alias("o"))


def histograms(grad: DataFrame, sbin: int) -> DataFrame:
    """(doc_id, rows, cols, r, c, o, v): each pixel votes for its four nearest cells, by distance; sums combine before the shuffle."""
    low = grad.withColumn("fy", (F.col("y") + 0.5) / sbin - 0.5).withColumn("fx", (F.col("x") + 0.5) / sbin - 0.5)
    low = low.withColumn("cy", F.floor("fy").cast("int")).withColumn("cx", F.floor("fx").cast("int")).withColumn("ay", F.col("fy") - F.col("cy")).withColumn("ax", F.col("fx") - F.col("cx"))
    vote = lambda i, j: F.struct((F.col("cy") + i).alias("r"), (F.col("cx") + j).alias("c"), (F.col("v") * (F.col("ay") if i else 1 - F.col("ay")) * (F.col("ax") if j else 1 - F.col("ax"))).alias("v"))
    votes = low.select("doc_id", cells_across(F.col("h"), sbin).alias("rows"), cells_across(F.col("w"), sbin).alias("cols"), "o", F.explode(F.array(*[vote(i, j) for i in (0, 1) for j in (0, 1)])).alias("t"))
    inside = votes.select("doc_id", "rows", "cols", "t.r", "t.c", "o", "t.v").where("r >= 0 AND c >= 0 AND r < rows AND c < cols")
    return inside.groupBy("doc_id", "rows", "cols", "r", "c", "o").agg(F.sum("v").alias("v"))


def _adding(clip, scale: str):
    return lambda acc, h: acc + clip(h, scale)


def describe(pages: DataFrame, sbin: int = 12) -> DataFrame:
    """(doc_id, r, c, feat): the 31-dimensional descriptors."""
    hist = histograms(gradients(pixels(pages), sbin), sbin)
    held = hist.groupBy("doc_id", "r", "c").agg(F.map_from_entries(F.collect_list(F.struct("o", "v"))).alias("m"))  # 18 entries
    size = pages.select("doc_id", cells_across(F.col("h"), sbin).alias("rows"), cells_across(F.col("w"), sbin).alias("cols"))
    span = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)))
    every = size.withColumn("r", span("rows")).withColumn("c", span("cols"))
    by = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda o: F.coalesce(F.try_element_at("m", o), F.lit(0.0)))
    cell = every.join(held, ["doc_id", "r", "c"], "left").withColumn("hist", by)
    plain = F.zip_with(F.slice("hist", 1, 9), F.slice("hist", 10, 9), lambda a, b: a + b)
    cell = cell.withColumn("plain", plain).withColumn("e", F.aggregate("plain", F.lit(0.0), lambda acc, v: acc + v * v))
    along, down = W.partitionBy("doc_id", "r").orderBy("c"), W.partitionBy("doc_id", "c").orderBy("r")
    cell = cell.withColumn("e2", F.col("e") + F.lead("e").over(along)).withColumn("s1", 1 / F.sqrt(F.col("e2") + F.lead("e2").over(down) + EPS))
    cell = cell.withColumn("s2", F.lag("s1").over(down)).withColumn("s3", F.lag("s1").over(along)).withColumn("s4", F.lag("s2").over(along))
    inner = cell.where("r BETWEEN 1 AND rows - 2 AND c BETWEEN 1 AND cols - 2")
    clip = lambda h, s: F.least(h * F.col(s), F.lit(CLIP))
    four = lambda v: F.transform(v, lambda h: 0.5 * (clip(h, "s1") + clip(h, "s2") + clip(h, "s3") + clip(h, "s4")))
    texture = F.array(*[TEXTURE * F.aggregate("hist", F.lit(0.0), _adding(clip, s)) for s in ("s1", "s2", "s3", "s4")])
    return inner.select("doc_id", (F.col("r") - 1).alias("r"), (F.col("c") - 1).alias("c"), F.concat(four("hist"), four("plain"), texture).alias("feat"))

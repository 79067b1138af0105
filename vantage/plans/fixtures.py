"""Pages, queries and samples derived from the driver's tables; see FIXTURES.md."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SBIN, SIDE, IMAGE = 12, 10, 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 10 x 10 cells: (vec_id, doc_id, r, c, label, feat)."""
    place = F.col("vec_id") % 100
    return vectors(spark, sf_dir).select("vec_id", F.expr("vec_id div 100").alias("doc_id"), F.floor(place / SIDE).cast("int").alias("r"), (place % SIDE).cast("int").alias("c"), "label", F.col("embedding").alias("feat"))


def queries(cells_: DataFrame, th: int, tw: int) -> DataFrame:
    """One exemplar on each page, from cell (2, 3) on; its class is that cell's label."""
    return cells_.where("r = 2 AND c = 3").select(F.col("doc_id").alias("query_id"), "doc_id", "r", "c", F.lit(th).alias("th"), F.lit(tw).alias("tw"), F.col("label").alias("class_id"))


def truth(cells_: DataFrame, queries_: DataFrame) -> DataFrame:
    """True boxes of each query: the cells of its class."""
    x1, y1 = F.col("c") * SBIN + 1, F.col("r") * SBIN + 1
    boxes = cells_.select("doc_id", F.col("vec_id").alias("gt_id"), F.col("label").alias("class_id"), x1.alias("x1"), (x1 + SBIN - 1).alias("x2"), y1.alias("y1"), (y1 + SBIN - 1).alias("y2"))
    return queries_.select("query_id", "class_id").join(boxes, "class_id").drop("class_id")


def label_means(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """A codebook of one centroid per label, the mean of its vectors: labels x d, so small."""
    rows = vectors(spark, sf_dir).where("label IS NOT NULL").select("label", F.posexplode("embedding").alias("j", "x"))
    found = rows.groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("label", "j").collect()
    labels = sorted({r.label for r in found})
    return np.array([r.m for r in found]).reshape(len(labels), -1)


def codebook(spark: SparkSession, means: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(means)], "code int, centroid array<double>")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, h, w, pixels): 100 vectors of 64 components in [-1, 1] as an 80 x 80 page; pages with missing vectors are left out."""
    pages = vectors(spark, sf_dir).groupBy(F.expr("vec_id div 100").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("s")).where("size(s) = 100")
    values = pages.select("doc_id", F.flatten(F.transform("s", lambda s: s.embedding)).alias("v"))

    def run(batches):
        for batch in batches:
            pixels = [np.floor((np.asarray(v, np.float64) + 1) * 127.5).astype(np.uint8).tobytes() for v in batch["v"]]
            yield batch.assign(h=IMAGE, w=IMAGE, pixels=pixels)[["doc_id", "h", "w", "pixels"]]

    return values.mapInPandas(run, "doc_id long, h int, w int, pixels binary")

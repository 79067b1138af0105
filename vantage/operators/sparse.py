"""Sparse vectors and matrices as rows (i, j, v), and index structures over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vantage.functions import vectors as V


def entries(df: DataFrame, i: str, v: str) -> DataFrame:
    """(i, j, v): the non-zero components of dense vectors, j from 0."""
    return df.select(F.col(i).alias("i"), F.posexplode(V.doubles(F.col(v))).alias("j", "v")).where("v <> 0")


def dots(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, dot) for pairs (a, b) of rows of two sparse tables: an equi-join on row and place, then a sum."""
    a = pairs.join(left.withColumnRenamed("i", "a").withColumnRenamed("v", "x"), "a")
    met = a.join(right.withColumnRenamed("i", "b").withColumnRenamed("v", "y"), ["b", "j"])
    found = met.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("dot", F.lit(0.0)).alias("dot"))


def norms2(df: DataFrame) -> DataFrame:
    """(i, n2): squared norms of the rows of a sparse table."""
    return df.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("n2"))


def axpy(y: DataFrame, a: DataFrame, x: DataFrame) -> DataFrame:
    """y + a x of sparse tables, row by row; a: (i, a). Entries that add up to 0 go."""
    scaled = x.join(a, "i").select("i", "j", (F.col("a") * F.col("v")).alias("v"))
    return y.select("i", "j", "v").unionByName(scaled).groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def from_csr(spark: SparkSession, indptr, indices, data) -> DataFrame:
    """(i, j, v) of a compressed-row matrix held as three arrays on the driver; explicit zeros stay out. Rows go to tasks in Arrow
    batches of bounded size."""
    indptr, indices, data = np.asarray(indptr, np.int64), np.asarray(indices, np.int64), np.asarray(data, np.float64)
    if len(indptr) < 1 or indptr[0] != 0 or (np.diff(indptr) < 0).any() or indptr[-1] != len(indices) or len(indices) != len(data):
        raise ValueError("not a compressed-row matrix")
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    table = pa.table({"i": pa.array(rows, pa.int64()), "j": pa.array(indices.astype(np.int32)), "v": pa.array(data)})
    return spark.createDataFrame(table).where("v <> 0")


def matmul_at(x: DataFrame, w: DataFrame, at: DataFrame) -> DataFrame:
    """at (i, k) with v = x_i . w_k, only at the given places. x: (i, x), w: (k, w), vectors as arrays."""
    return at.join(x, "i").join(w, "k").select("i", "k", V.dot(F.col("x"), F.col("w")).alias("v"))


def gram(x: DataFrame, block: str) -> DataFrame:
    """(block, a, b, v) inner products of the rows a <= b of each block. x: (block, i, x); blocks are bounded by who makes them."""
    a = x.select(block, F.col("i").alias("a"), F.col("x").alias("xa"))
    b = x.select(block, F.col("i").alias("b"), F.col("x").alias("xb"))
    return a.join(b, block).where("a <= b").select(block, "a", "b", V.dot(F.col("xa"), F.col("xb")).alias("v"))


def inverted_index(samples: DataFrame, label: str, i: str) -> DataFrame:
    """(label, n, members): each label's samples in order."""
    return samples.groupBy(label).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(i)).alias("members"))


def prefix_offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """counts with begins: the sum of n over smaller keys. One row per key, so the window is as small as the histogram."""
    before = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("begins", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))

"""Parameter files and generated data."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vantage.functions import draws


def read_gmm(spark: SparkSession, path: str) -> DataFrame:
    """(w, mu, sigma) of a mixture file: int32 d, int32 k, then k weights, k x d means and k x d variances as float32."""

    def decode(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for content in batch["content"]:
                d, k = np.frombuffer(content, "<i4", 2)
                body = np.frombuffer(content, "<f4", k + 2 * k * d, 8)
                out.append((body[:k], list(body[k : k + k * d].reshape(k, d)), list(body[k + k * d :].reshape(k, d))))
            yield pd.DataFrame(out, columns=["w", "mu", "sigma"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "w array<float>, mu array<array<float>>, sigma array<array<float>>")


def gmm_bytes(w: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> bytes:
    k, d = mu.shape
    return np.array([d, k], "<i4").tobytes() + b"".join(np.asarray(x, "<f4").tobytes() for x in (w, mu, sigma))


def toy_mixture(spark: SparkSession, d: int = 2, n_classes: int = 5, per_class: int = 200, spread: float = 0.05, seed: int = 1) -> DataFrame:
    """(idx, label, x, split): a Gaussian around a random centre in the unit cube per class; a random half trains."""
    u = lambda i, j, e: draws.uniform(i.cast("long"), F.lit(j).cast("long"), F.lit(e).cast("long"), seed)
    normal = lambda j: F.sqrt(-2 * F.log(u(F.col("idx"), j, 1))) * F.cos(2 * math.pi * u(F.col("idx"), j, 2))
    rows = spark.range(n_classes * per_class).select(F.col("id").alias("idx"), F.expr(f"cast(id div {per_class} AS int)").alias("label"))
    rows = rows.withColumn("x", F.array(*[u(F.col("label"), j, 0) + spread * normal(j) for j in range(d)]))
    order = draws.key(F.col("idx"), F.lit(0).cast("long"), F.lit(3).cast("long"), seed)
    half = F.row_number().over(W.orderBy(order, "idx")) % 2  # as many rows as are asked for
    return rows.withColumn("split", F.when(half == 0, "test").otherwise("train"))

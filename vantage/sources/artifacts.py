"""Stage results kept as Parquet, under a name that holds a digest of the parameters that made them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def location(folder: str, name: str, params: object) -> str:
    values = asdict(params) if is_dataclass(params) else params
    digest = hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{folder.rstrip('/')}/{name}-{digest}"


def load_or_make(spark: SparkSession, folder: str, name: str, params: object, make: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
    """The kept result of a stage, or make() written there first. Other parameters have another place, so nothing stale is read."""
    path = location(folder, name, params)
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        writer = make().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return spark.read.parquet(path)

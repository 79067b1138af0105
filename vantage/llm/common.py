"""What the operators of this subpackage share: input tables, lineage cuts and Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.shared import BROADCAST_ROWS, cut  # noqa: F401  for the operators
from vantage.shared import folder as shared_dir  # noqa: F401

#: Rows and bytes an Arrow batch holds at most, so that a batch stays small beside a Python worker's memory; a text that is
#: longer by itself makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for so many rows: the session's number, or more where a task would get over per_task rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by rows and by bytes. The setting is read when a plan runs, so it has to stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, rows: int | None = None) -> DataFrame:
    """Apply a kernel to each Arrow batch. Kernels see one batch at a time and keep nothing between batches but caches.
    rows: pieces in which a batch of large values is handed to the kernel."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), rows or max(1, batch.num_rows)):
                yield kernel(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame, names: list[str], added: str) -> T.StructType:
    """The named fields of df, and those of a DDL string."""
    return T.StructType([*(df.schema[n] for n in names), *T.StructType.fromDDL(added).fields])


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def hash60(*columns: Column) -> Column:
    """60 bits of an MD5 over the columns' texts, as a non-negative long that other SQL engines can reproduce.

    Null counts as the empty text; columns are joined by U+001F.
    """
    joined = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a materialised table of narrow rows: broadcast if its counted rows are within the bound, else by shuffle."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def literal_map(weights: dict[str, int]) -> Column:
    pairs = [F.lit(x) for item in weights.items() for x in item]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,int>")

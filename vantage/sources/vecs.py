"""Vector files: records of an int32 dimension and as many float32, int32 or uint8 values, little-endian."""

from __future__ import annotations

import os
import shutil
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"fvecs": np.dtype("<f4"), "ivecs": np.dtype("<i4"), "bvecs": np.dtype("u1")}


def _kind(path: str, kind: str | None) -> str:
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1]
    if kind not in KINDS:
        raise ValueError(f"not a vector file: {path}")
    return kind


def _heads(spark: SparkSession, paths: list[str]) -> list[int]:
    """The first int32 of each file, read through Hadoop's file system: four bytes a file, whatever its length."""
    out = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
        try:
            out.append(struct.unpack("<i", struct.pack(">i", stream.readInt()))[0])
        finally:
            stream.close()
    return out


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and length of the files, as Spark lists them; their content is not read."""
    return sorted((r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())


def file_sizes(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(path, n, d) per file from its length and its first four bytes. No vector is read. Spark lists no empty files."""
    item = KINDS[_kind(path, kind)].itemsize
    files = _files(spark, path)
    heads = dict(zip(full := [p for p, size in files if size], _heads(spark, full), strict=True))
    rows = [(p, size // (4 + item * heads[p]) if p in heads else 0, heads.get(p, 0)) for p, size in files]
    return spark.createDataFrame(rows, "path string, n long, d long")


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, kind: str | None = None, as_float: bool = False) -> DataFrame:
    """(idx, v): vectors with 1-based places first..last inclusive. last beyond the end is cut; last < first gives none.

    Fixed-length records are split among tasks by Hadoop, so a file of any length is read in parallel. Files of a folder
    follow each other by name.
    """
    kind = _kind(path, kind)
    if first is not None and first < 1:
        raise ValueError("places begin at 1")
    paths = [p for p, size in _files(spark, path) if size]
    d, dtype = _heads(spark, paths[:1])[0] if paths else 0, KINDS[kind]
    element = "float" if kind == "fvecs" or as_float else "int"
    schema = f"idx long, v array<{element}>"
    if not d:
        return spark.createDataFrame([], schema)
    length = 4 + d * dtype.itemsize
    # the one place where the RDD API is needed: no DataFrame source splits binary records
    records = spark.sparkContext.binaryRecords(",".join(paths), length).zipWithIndex().toDF("content binary, idx long")
    records = records.select((F.col("idx") + 1).alias("idx"), "content")
    if first is not None:
        records = records.where(F.col("idx") >= first)
    if last is not None:
        records = records.where(F.col("idx") <= last)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = np.frombuffer(b"".join(map(bytes, batch["content"])), np.uint8).reshape(-1, length)
            if len(raw) and (raw[:, :4].copy().view("<i4")[:, 0] != d).any():
                raise ValueError("vectors of different dimensions")
            values = raw[:, 4:].copy().view(dtype)
            yield pd.DataFrame({"idx": batch["idx"], "v": list(values.astype(np.float32 if element == "float" else np.int32))})

    return records.mapInPandas(decode, schema)


def records(vectors: DataFrame, v: str = "v", kind: str = "fvecs") -> DataFrame:
    """vectors with content: each vector's record as bytes."""
    dtype = KINDS[kind]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[struct.pack("<i", len(x)) + np.asarray(x).astype(dtype).tobytes() for x in batch[v]])

    return vectors.mapInPandas(encode, f"{fields}, content binary")


def write_parts(vectors: DataFrame, folder: str, v: str = "v", kind: str = "fvecs") -> list[str]:
    """A file per partition, in a folder that executors and driver share; returns the paths. A task writes beside its file and
    moves it in place when it is whole, so repeated tasks do no harm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():06d}.{kind}"
        with open(own := f"{path}.{context.taskAttemptId()}", "wb") as out:
            for batch in batches:
                out.write(b"".join(map(bytes, batch["content"])))
        os.replace(own, path)
        yield pd.DataFrame({"path": [path]})

    os.makedirs(folder, exist_ok=True)
    return sorted(r.path for r in records(vectors.select(v), v, kind).select("content").mapInPandas(run, "path string").collect())  # one row per file


def write_ordered(vectors: DataFrame, folder: str, order: str = "idx", v: str = "v", kind: str = "fvecs") -> list[str]:
    """Files in the given order, within a file and from file to file by their names, so that read() of the folder gives it back.
    A range of the order is a task; nothing passes through the driver but the paths."""
    return write_parts(vectors.select(order, v).orderBy(order), folder, v, kind)


def write(vectors: DataFrame, path: str, order: str = "idx", v: str = "v", kind: str | None = None) -> None:
    """One local or mounted file in the given order: tasks write its parts beside it, which are then put together byte by byte."""
    folder = f"{path}.parts"
    parts = write_ordered(vectors, folder, order, v, _kind(path, kind))
    with open(path, "wb") as out:
        for part in parts:
            with open(part, "rb") as own:
                shutil.copyfileobj(own, out, 1 << 20)
            os.remove(part)
    os.rmdir(folder)


def read_one(stream: BinaryIO, kind: str = "fvecs") -> np.ndarray | None:
    """The next vector of an open stream, null at its end. For streams that are read as they come; files have read()."""
    head = stream.read(4)
    if not head:
        return None
    if len(head) < 4:
        raise ValueError("a broken record")
    size = struct.unpack("<i", head)[0] * KINDS[kind].itemsize
    if size < 0 or len(raw := stream.read(size)) < size:
        raise ValueError("a broken record")
    return np.frombuffer(raw, KINDS[kind])


def write_one(stream: BinaryIO, vector, kind: str = "fvecs") -> None:
    """One vector to the end of an open stream."""
    values = np.asarray(vector).astype(KINDS[kind])
    stream.write(struct.pack("<i", len(values)) + values.tobytes())

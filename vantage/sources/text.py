"""Annotation files, svmlight files and bags of words."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vantage.functions import geometry, vectors
from vantage.sources import vecs


def _fields(names: list[str]) -> list[Column]:
    parts = F.split(F.trim("value"), r"\s+")
    return [(F.element_at(parts, i + 1).cast("int") if n not in ("path", "text") else F.element_at(parts, i + 1)).alias(n) for i, n in enumerate(names)]


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, x1, x2, y1, y2, text, h, w) of rows `image x1 y1 x2 y2 text`; blank lines are passed over."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    boxes = rows.select(*_fields(["path", "x1", "y1", "x2", "y2", "text"]))
    return geometry.size(boxes).select("path", "x1", "x2", "y1", "y2", "text", "h", "w")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, word_id, x1, x2, y1, y2, text, h, w) of rows `x1 y1 x2 y2 text`, a file per page. Pages are numbered from 1
    by file name; an empty file has a page without words and so no row. word_id grows with the place in a file."""
    rows = spark.read.text(path).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = rows.where(F.trim("value") != "")
    pages = rows.select("file").distinct().withColumn("doc_id", F.row_number().over(W.orderBy("file")))  # one row per page
    words = geometry.size(rows.select("file", "at", *_fields(["x1", "y1", "x2", "y2", "text"]))).join(pages, "file")
    word_id = F.row_number().over(W.partitionBy("doc_id").orderBy("at")).cast("long")
    return words.withColumn("word_id", word_id).select("doc_id", "file", "word_id", "x1", "x2", "y1", "y2", "text", "h", "w")


def svmlight(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """(label, x): dense features of an svmlight file."""
    reader = spark.read.format("libsvm")
    reader = reader.option("numFeatures", n_features) if n_features else reader
    return reader.load(path).select("label", vector_to_array("features").alias("x"))


def svmlight_lines(df: DataFrame, label: str, x: str) -> DataFrame:
    """(value): svmlight lines, non-zero features only, with 10 significant digits."""

    def pair(v: Column, j: Column) -> Column:
        text = F.format_string("%.10g", v)
        short = F.when(text.contains(".") & ~text.contains("e"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
        return F.when(v != 0, F.concat((j + 1).cast("string"), F.lit(":"), short))

    pairs = F.transform(vectors.doubles(F.col(x)), pair)
    return df.select(F.concat_ws(" ", F.col(label).cast("long").cast("string"), F.filter(pairs, lambda p: p.isNotNull())).alias("value"))


def bags_of_words(spark: SparkSession, paths: list[str], n_train: int) -> DataFrame:
    """(class_id, idx, v, split): a vector file per class, classes numbered by sorted name; square roots over their sum. The
    first n_train vectors train, those of the second half test, the rest belong to neither."""
    out = None
    for i, path in enumerate(sorted(paths)):
        n = vecs.file_sizes(spark, path).agg(F.sum("n")).first()[0]
        split = F.when(F.col("idx") <= n_train, "train").when(F.col("idx") > n // 2, "test")
        own = vecs.read(spark, path).select(F.lit(i + 1).alias("class_id"), "idx", vectors.power_l1(F.col("v")).alias("v"), split.alias("split"))
        out = own if out is None else out.unionByName(own)
    return out

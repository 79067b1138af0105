"""Words and classes of annotated pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vantage.shared import cut

NO_CLASS = -1


def words_on_lines(docs: DataFrame, per_line: int = 8, sbin: int = 12) -> DataFrame:
    """(doc_id, pos, text, x1, x2, y1, y2, h, w): a document's words, parted at single spaces, laid out on a grid of cells."""
    out = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    x1, y1 = (F.col("pos") % per_line) * sbin + 1, F.expr(f"cast(pos div {per_line} AS int)") * sbin + 1
    return out.select("doc_id", "pos", "text", x1.alias("x1"), (x1 + sbin - 1).alias("x2"), y1.alias("y1"), (y1 + sbin - 1).alias("y2"), F.lit(sbin).alias("h"), F.lit(sbin).alias("w"))


def class_dictionary(queries: DataFrame, text: str, order: list[str]) -> DataFrame:
    """(text, class_id): different texts numbered from 1 in the order of their first appearance."""
    first = queries.groupBy(F.col(text).alias("text")).agg(F.min(F.struct(*order)).alias("at"))
    return numbered(first, "at", "class_id").select("text", (F.col("class_id") + 1).cast("int").alias("class_id"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with each row's place, from 0, in an order without ties. Ranges of the order are numbered each in its task; the numbers
    of rows of the ranges before it are added, so no task gets all rows."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    before = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # a row per range
    before = before.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))
    return ranged.join(F.broadcast(before), "__range").withColumn(name, F.col("__at") + F.col("__before")).drop("__range", "__at", "__before")


def classify(words: DataFrame, classes: DataFrame) -> DataFrame:
    """words with class_id, -1 for texts outside the dictionary."""
    return words.join(classes, "text", "left").withColumn("class_id", F.coalesce("class_id", F.lit(NO_CLASS)))


def relevant_boxes(words: DataFrame) -> DataFrame:
    """(class_id, doc_id, boxes) of the words that have a class; boxes in order of x1, x2, y1, y2."""
    box = F.struct("x1", "x2", "y1", "y2")
    return words.where(F.col("class_id") != NO_CLASS).groupBy("class_id", "doc_id").agg(F.sort_array(F.collect_list(box)).alias("boxes"))


def relevant_counts(words: DataFrame) -> DataFrame:
    return words.where(F.col("class_id") != NO_CLASS).groupBy("class_id").agg(F.count("*").alias("n_relevant"))

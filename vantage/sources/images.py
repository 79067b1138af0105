"""Page images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, h, w, pixels): one byte per pixel, row by row. Images decoded to several channels give the first of them."""
    image = spark.read.format("image").load(path).select("image.*")

    def first_channel(batches):
        import numpy as np

        for batch in batches:
            one = [np.frombuffer(d, np.uint8)[::n].tobytes() for d, n in zip(batch["data"], batch["nChannels"], strict=True)]
            yield batch.assign(pixels=one)[["path", "h", "w", "pixels"]]

    rows = image.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), "nChannels", "data")
    return rows.mapInPandas(first_channel, "path string, h int, w int, pixels binary")


def crop(boxes: DataFrame) -> DataFrame:
    """boxes with h, w, pixels of their page: adds crop_h, crop_w and crop, the pixels inside the box cut at the page's border."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema.fields)

    def cut(batches):
        import numpy as np

        for batch in batches:
            sizes, crops = [], []
            for r in batch.itertuples():
                im = np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w)[max(1, r.y1) - 1 : min(r.h, r.y2), max(1, r.x1) - 1 : min(r.w, r.x2)]
                sizes.append(im.shape)
                crops.append(im.tobytes())
            yield batch.assign(crop_h=[s[0] for s in sizes], crop_w=[s[1] for s in sizes], crop=crops)

    return boxes.mapInPandas(cut, f"{fields}, crop_h int, crop_w int, crop binary")


def result_crops(queries: DataFrame, detections: DataFrame, pages_: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, name, crop_h, crop_w, crop): the query as 000q.png and its first detections as NNNc.png (relevant) or NNNe.png."""
    own = queries.join(pages_, "doc_id").withColumn("name", F.lit("000q.png"))
    letter = F.when(F.col("is_relevant") == 1, "c").otherwise("e")
    best = detections.where(F.col("rank") <= limit).join(pages_, "doc_id").withColumn("name", F.format_string("%03d%s.png", "rank", letter))
    columns = ["query_id", "name", "x1", "x2", "y1", "y2", "h", "w", "pixels"]
    return crop(own.select(columns).unionByName(best.select(columns))).select("query_id", "name", "crop_h", "crop_w", "crop")

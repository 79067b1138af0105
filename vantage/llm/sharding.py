"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by the leading bits of a key's hash. A bucket over the byte limit splits on one more bit, and
only such a bucket does, until every shard fits. The directory is built from bytes summed per cell of leading bits, so
what is shuffled are cells, not rows; cells that are still too large at the directory's depth are refined with the next
bits of their own rows alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.common import cut, hash60, join_small, parts, table

LIMIT, SMALL = 64 << 20, 64 << 10
BITS = 120
#: Bits by which the directory of a still too large cell is deepened.
STEP = 12


def key_bits(key: list[Column], payload: Column) -> Column:
    """120 bits as text: 60 of the key's hash, then 60 of the payload's, which part rows that repeat a key."""
    return F.concat(*[F.lpad(F.conv(h.cast("string"), 10, 2), 60, "0") for h in (hash60(*key), hash60(payload))])


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """sizes: (bits, bytes). For each level its depth and a table (cell, local_depth, n_bytes, n_rows, oversized): what shard a
    cell of so many leading bits points to; local_depth is null where the next level has to be asked."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    above, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + 1)
    levels, rows = [], sizes
    while True:
        cells = cut(rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")))
        up = F.explode(F.transform(F.sequence(F.lit(above), F.lit(depth)), lambda d: F.struct(d.alias("d"), F.col("cell").substr(F.lit(1), d).alias("p"))))
        paths = cells.withColumn("node", up).select("cell", "b", "n", "node.d", "node.p")
        nodes = paths.groupBy("d", "p").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        split = nodes.where((F.col("b") > limit) & (F.col("n") > 1)).select("d", "p", F.lit(1).alias("split"))
        leaf = paths.select("cell", "d", "p").join(split, ["d", "p"], "left").groupBy("cell").agg(F.coalesce(F.max(F.when(F.col("split") == 1, F.col("d") + 1)), F.lit(above)).alias("local_depth"))
        leaf = leaf.withColumn("full", F.col("local_depth") > depth).withColumn("local_depth", F.least("local_depth", F.lit(depth)))
        sized = leaf.select("cell", "full", "local_depth", F.col("cell").substr(F.lit(1), F.col("local_depth")).alias("p"))
        sized = sized.join(nodes.select(F.col("d").alias("local_depth"), "p", F.col("b").alias("n_bytes"), F.col("n").alias("n_rows")), ["local_depth", "p"])
        last = depth == BITS
        depths = F.col("local_depth") if last else F.when(~F.col("full"), F.col("local_depth"))
        level = cut(sized.select("cell", depths.cast("int").alias("local_depth"), "n_bytes", "n_rows", (F.col("n_bytes") > limit).alias("oversized")))
        levels.append((depth, level))
        full = level.where("local_depth IS NULL").select("cell")
        if last or not full.count():
            return levels
        rows = cut(join_small(rows, cut(full), F.substring(rows.bits, 1, depth) == F.col("cell"), "left_semi"))
        above, depth = depth, min(BITS, depth + STEP)


def shard(docs: DataFrame, key: list[str], payload: str, limit: int = LIMIT) -> DataFrame:
    """docs with shard (its leading hash bits as text), local_depth, shard_bytes, shard_rows, oversized.

    A row weighs the UTF-8 bytes of its payload, null nothing. Null keys hash as the empty text. Rows that repeat a key are
    parted by the hash of their payload; only exact repeats of both cannot be parted by any bit and share a shard. That
    shard, and a row that alone exceeds the limit, is marked oversized. Columns of docs with these five names are replaced.
    """
    fresh = ["shard", "local_depth", "shard_bytes", "shard_rows", "oversized"]
    bits = key_bits([F.col(k) for k in key], F.col(payload))
    sizes = cut(docs.select(bits.alias("bits"), F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("bytes")))
    levels = directory(sizes, limit)
    out = docs.drop(*fresh).withColumn("__vantage_bits", bits)
    names = ["local_depth", "n_bytes", "n_rows", "oversized"]
    for i, (depth, level) in enumerate(levels):
        found = level.where("local_depth IS NOT NULL").select(F.col("cell").alias(f"__vantage_cell{i}"), *[F.col(c).alias(f"__vantage_{c}{i}") for c in names])
        out = join_small(out, found, F.substring("__vantage_bits", 1, depth) == F.col(f"__vantage_cell{i}"), "left")
    first = lambda c: F.coalesce(*[F.col(f"__vantage_{c}{i}") for i in range(len(levels))])
    return out.select(
        *[out[c] for c in docs.columns if c not in fresh],
        F.col("__vantage_bits").substr(F.lit(1), first("local_depth")).alias("shard"), first("local_depth").alias("local_depth"),
        first("n_bytes").alias("shard_bytes"), first("n_rows").alias("shard_rows"), first("oversized").alias("oversized"),
    )


def write_shards(sharded: DataFrame, folder: str) -> None:
    """A Parquet folder `shard_name=s<bits>` for each shard of a shard() result. The rows of a shard meet in one task, which the byte
    limit bounds; several small shards may share a task."""
    n = parts(sharded.sparkSession, sharded.select("shard").distinct().count(), 1)
    named = sharded.withColumn("shard_name", F.concat(F.lit("s"), F.col("shard")))
    named.repartition(n, "shard_name").sortWithinPartitions("shard_name").write.partitionBy("shard_name").parquet(folder)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, ["doc_id"], "text").select("doc_id", "shard", "local_depth", "shard_bytes", "shard_rows", "oversized")


def small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a limit that small tables exceed many times over."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, ["doc_id"], "text", SMALL).select("doc_id", "shard", "local_depth", "shard_bytes", "shard_rows", "oversized")


def shard_sql(limit: int = LIMIT) -> str:
    half = "lpad(bin(('0x' || substr(md5(coalesce({}, '')), 1, 15))::BIGINT), 60, '0')"
    return f"""
        WITH r AS (
            SELECT doc_id, {half.format("doc_id::VARCHAR")} || {half.format("text")} AS bits, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes
            FROM documents),
        node AS (
            SELECT d, substr(bits, 1, d) AS p, sum(bytes) AS b, count(*) AS n
            FROM r, range(0, {BITS} + 1) t(d) GROUP BY ALL),
        leaf AS (
            SELECT bits, least(coalesce(max(d) FILTER (b > {limit} AND n > 1) + 1, 0), {BITS}) AS depth
            FROM (SELECT DISTINCT bits FROM r) x, range(0, {BITS} + 1) t(d) JOIN node USING (d) WHERE p = substr(bits, 1, d) GROUP BY bits)
        SELECT doc_id, substr(r.bits, 1, depth) AS shard, depth::INTEGER AS local_depth, b::BIGINT AS shard_bytes, n::BIGINT AS shard_rows, b > {limit} AS oversized
        FROM r JOIN leaf USING (bits) JOIN node ON d = depth AND p = substr(r.bits, 1, depth)"""

"""The registered queries over the driver's tables, each with the SQL that DuckDB compares it with where SQL can express it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vantage import shared
from vantage.functions import draws as drawn_by
from vantage.functions import geometry
from vantage.functions import vectors as V
from vantage.model import GRID, Params
from vantage.operators import annotations, detections, features, features_relational, pages, quantize, samples, search, sgd, sparse, tuning, windows
from vantage.plans import fixtures, retrieval
from vantage.sources import generators, text, vecs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
PARAMS = Params()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---------------------------------------------------------------- pieces of SQL

CELLS = "cells AS (SELECT vec_id, vec_id // 100 AS doc_id, ((vec_id % 100) // 10)::INTEGER AS r, (vec_id % 10)::INTEGER AS c, label, embedding::DOUBLE[] AS x FROM embeddings)"
MEANS = "parts AS (SELECT label AS code, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL), means AS (SELECT code, j, avg(x) AS m FROM parts GROUP BY ALL), book AS (SELECT (dense_rank() OVER (ORDER BY code) - 1)::INTEGER AS code, centroid FROM (SELECT code, list(m ORDER BY j) AS centroid FROM means GROUP BY code))"
WORDS = "words AS (SELECT doc_id, (pos - 1)::INTEGER AS pos, word AS text, ((pos - 1) % 8 * 12 + 1)::INTEGER AS x1, ((pos - 1) // 8 * 12 + 1)::INTEGER AS y1 FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))"
CLASSES = "classes AS (SELECT text, (row_number() OVER (ORDER BY seen))::INTEGER AS class_id FROM (SELECT word AS text, min({'item_id': item_id, 'pos': pos}) AS seen FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)) GROUP BY word))"
SQL_L2 = "greatest(0, list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x))"
V_ALL = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
Q_SOME = "q AS (SELECT vec_id AS query_id, x FROM v WHERE vec_id % 20 = 0)"


def _mix(*places: str) -> str:
    mixed = "12345::BIGINT"
    for i, p in enumerate(places):
        mixed = f"(({mixed} * 48271 + {p} * {7919 + 2 * i} + 11) % 2147483647)"
    return f"({mixed} % 10007) / 10007.0::DOUBLE"


def sql_windows(th: int, tw: int, norm: bool = True) -> str:
    score = "sum(list_dot_product(a.x, t.w))" + (" / sqrt(sum(list_dot_product(a.x, a.x)))" if norm else "")
    return f"""{CELLS},
        tpl AS (SELECT doc_id AS query_id, r - 2 AS dr, c - 3 AS dc, x AS w FROM cells WHERE r BETWEEN 2 AND {1 + th} AND c BETWEEN 3 AND {2 + tw} QUALIFY count(*) OVER (PARTITION BY doc_id) = {th * tw}),
        win AS (SELECT query_id, doc_id, (r - dr)::INTEGER AS r, (c - dc)::INTEGER AS c, {score} AS score FROM cells a JOIN tpl t ON a.r >= dr AND a.c >= dc GROUP BY query_id, doc_id, r - dr, c - dc HAVING count(*) = {th * tw})"""


def sql_top(th: int, tw: int, k: int, scored: str | None = None) -> str:
    return f"""{scored or sql_windows(th, tw)},
        top AS (SELECT *, (row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, r DESC, c DESC))::INTEGER AS place,
            c * 12 + 1 AS x1, c * 12 + {tw * 12} AS x2, r * 12 + 1 AS y1, r * 12 + {th * 12} AS y2 FROM win QUALIFY place <= {k})"""


def sql_nms(th: int, tw: int, k: int, overlap: float, scored: str | None = None) -> str:
    cut = "greatest(0, least(k.x2, s[i].x2) - greatest(k.x1, s[i].x1) + 1) * greatest(0, least(k.y2, s[i].y2) - greatest(k.y1, s[i].y1) + 1)"
    return f"""{sql_top(th, tw, k, scored)},
        lists AS (SELECT query_id, doc_id, list({{'place': place, 'score': score, 'x1': x1, 'x2': x2, 'y1': y1, 'y2': y2}} ORDER BY place) AS s FROM top GROUP BY ALL),
        fold AS (SELECT query_id, doc_id, s, 2 AS i, [s[1]] AS kept FROM lists
            UNION ALL SELECT query_id, doc_id, s, i + 1, CASE WHEN len(list_filter(kept, lambda k: {cut} >= {overlap} * ((s[i].x2 - s[i].x1 + 1) * (s[i].y2 - s[i].y1 + 1)))) > 0 THEN kept ELSE list_append(kept, s[i]) END FROM fold WHERE i <= len(s)),
        picked AS (SELECT query_id, doc_id, (generate_subscripts(kept, 1) - 1)::INTEGER AS pick, unnest(kept, recursive := true) FROM fold WHERE i > len(s))"""


def sql_hits(scored: str | None = None) -> str:
    return f"""{sql_nms(1, 2, PARAMS.windows_per_page, PARAMS.nms_overlap, scored)},
        qs AS (SELECT doc_id AS query_id, label AS class_id FROM cells WHERE r = 2 AND c = 3),
        gt AS (SELECT query_id, doc_id, vec_id AS gt_id, c * 12 + 1 AS x1, c * 12 + 12 AS x2, r * 12 + 1 AS y1, r * 12 + 12 AS y2 FROM qs JOIN cells ON label = class_id),
        near AS (SELECT p.query_id, p.doc_id, p.pick, g.gt_id, greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1) + 1) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1) + 1) AS cut, (p.x2 - p.x1 + 1) * (p.y2 - p.y1 + 1) AS ap, (g.x2 - g.x1 + 1) * (g.y2 - g.y1 + 1) AS ag FROM picked p JOIN gt g USING (query_id, doc_id)),
        iou AS (SELECT query_id, doc_id, pick, gt_id, cut / (ap + ag - cut) AS iou FROM near WHERE cut > 0),
        hit AS (SELECT DISTINCT query_id, doc_id, pick FROM (SELECT query_id, doc_id, gt_id, min(pick) AS pick FROM iou WHERE iou >= {PARAMS.hit_overlap} GROUP BY ALL)),
        labelled AS (SELECT p.*, (h.pick IS NOT NULL)::INTEGER AS is_relevant FROM picked p LEFT JOIN hit h USING (query_id, doc_id, pick)),
        ordered AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pick))::INTEGER AS rank FROM labelled),
        ranked AS (SELECT * FROM ordered QUALIFY rank <= max(CASE WHEN is_relevant = 1 THEN rank END) OVER (PARTITION BY query_id)),
        ap AS (SELECT query_id, n_relevant, coalesce(s, 0) / nullif(n_relevant, 0) AS ap, coalesce(found, 0) / nullif(n_relevant, 0) AS recall FROM (SELECT query_id, count(*) AS n_relevant FROM gt GROUP BY query_id)
            LEFT JOIN (SELECT query_id, sum(CASE WHEN is_relevant = 1 THEN p ELSE 0 END) AS s, sum(is_relevant) AS found FROM (SELECT *, sum(is_relevant) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / rank AS p FROM ranked) GROUP BY query_id) USING (query_id))"""


# ---------------------------------------------------------------- annotations and geometry


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixtures.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    classes = annotations.class_dictionary(items, "word", ["item_id", "pos"])
    return annotations.classify(annotations.words_on_lines(fixtures.table(spark, sf_dir, "documents")), classes)


@query(f"WITH {WORDS}, {CLASSES} SELECT doc_id, pos, text, x1, x1 + 11 AS x2, y1, y1 + 11 AS y2, coalesce(class_id, -1)::INTEGER AS class_id FROM words LEFT JOIN classes USING (text)")
def gt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", "pos", "text", "x1", "x2", "y1", "y2", "class_id")


@query(f"WITH {CLASSES} SELECT text, class_id FROM classes")
def class_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixtures.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return annotations.class_dictionary(items, "word", ["item_id", "pos"])


@query(f"WITH {WORDS}, {CLASSES} SELECT class_id, count(*) AS n_relevant FROM words JOIN classes USING (text) GROUP BY class_id")
def relevant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.relevant_counts(_words(spark, sf_dir))


@query(f"WITH {WORDS}, {CLASSES} SELECT class_id, doc_id, string_agg(concat_ws(':', x1, x1 + 11, y1, y1 + 11), ',' ORDER BY x1, y1) AS boxes FROM words JOIN classes USING (text) GROUP BY ALL")
def relevant_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotations.relevant_boxes(_words(spark, sf_dir))
    return found.withColumn("boxes", F.array_join(F.transform("boxes", lambda b: F.concat_ws(":", b.x1, b.x2, b.y1, b.y2)), ","))


@query("SELECT doc_id, h, w, h % 12 // 2 + 1 AS y_ini, w % 12 // 2 + 1 AS x_ini, h - h % 12 AS crop_h, w - w % 12 AS crop_w, h // 12 - 2 AS bh, w // 12 - 2 AS bw FROM (SELECT doc_id, (300 + n_chars % 701)::INTEGER AS h, (200 + n_chars % 499)::INTEGER AS w FROM documents)")
def page_crop_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixtures.table(spark, sf_dir, "documents").select("doc_id", (300 + F.col("n_chars") % 701).cast("int").alias("h"), (200 + F.col("n_chars") % 499).cast("int").alias("w"))
    return geometry.page_crop(pages, PARAMS.sbin)


@query("SELECT doc_id, x1 - 12 + w % 12 // 2 AS x1, x2 + 12 - (w % 12 - w % 12 // 2) AS x2, y1 - 12 + h % 12 // 2 AS y1, y2 + 12 - (h % 12 - h % 12 // 2) AS y2, h + 24 - h % 12 AS new_h, w + 24 - w % 12 AS new_w, h // 12 AS bh, w // 12 AS bw FROM (SELECT doc_id, 50 AS x1, (50 + n_chars % 97)::INTEGER AS x2, 70 AS y1, (70 + n_chars % 61)::INTEGER AS y2, (n_chars % 97 + 1)::INTEGER AS w, (n_chars % 61 + 1)::INTEGER AS h FROM documents)")
def query_window_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    boxes = fixtures.table(spark, sf_dir, "documents").select("doc_id", F.lit(50).alias("x1"), (50 + n % 97).cast("int").alias("x2"), F.lit(70).alias("y1"), (70 + n % 61).cast("int").alias("y2"))
    return geometry.query_window(boxes, PARAMS.sbin)


_SHIFTED = "SELECT doc_id, dx, dy, greatest(1, x1 + dx) AS x1, least(w, x2 + dx) AS x2, greatest(1, y1 + dy) AS y1, least(h, y2 + dy) AS y2 FROM (SELECT doc_id, (1 + n_chars % 13)::INTEGER AS x1, (60 + n_chars % 13)::INTEGER AS x2, (1 + n_chars % 7)::INTEGER AS y1, (30 + n_chars % 7)::INTEGER AS y2, 75 AS w, 40 AS h FROM documents), (SELECT unnest(range(-10, 11, 2))::INTEGER AS dx), (SELECT unnest(range(-10, 11, 2))::INTEGER AS dy)"


@query(f"SELECT *, x2 - x1 <> 59 OR y2 - y1 <> 29 AS resized FROM ({_SHIFTED})")
def positive_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    boxes = fixtures.table(spark, sf_dir, "documents").select("doc_id", (1 + n % 13).cast("int").alias("x1"), (60 + n % 13).cast("int").alias("x2"), (1 + n % 7).cast("int").alias("y1"), (30 + n % 7).cast("int").alias("y2"))
    return samples.positive_shifts(boxes, PARAMS.shifts, F.lit(75), F.lit(40)).select("doc_id", "dx", "dy", "x1", "x2", "y1", "y2", "resized")


@query(f"WITH {CELLS} SELECT query_id, doc_id, n, floor(7 * ({_mix('query_id', 'doc_id', 'n', '1')}) + 0.5)::INTEGER AS r, floor(6 * ({_mix('query_id', 'doc_id', 'n', '2')}) + 0.5)::INTEGER AS c FROM (SELECT DISTINCT doc_id AS query_id FROM cells WHERE r = 2 AND c = 3), (SELECT DISTINCT doc_id FROM cells), (SELECT unnest(range(0, 64))::INTEGER AS n)")
def negative_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.cells(spark, sf_dir)
    asked = fixtures.queries(cells, 2, 3).select("query_id", F.col("th").alias("bh"), F.col("tw").alias("bw"))
    pages = cells.select("doc_id").distinct().select("doc_id", F.lit(fixtures.SIDE).alias("bh"), F.lit(fixtures.SIDE).alias("bw"))
    return samples.negative_windows(asked, pages, 64)


# ---------------------------------------------------------------- vectors


def _exploded(df: DataFrame, v) -> DataFrame:
    return df.select("vec_id", F.posexplode(v).alias("j", "v")).select("vec_id", "j", F.round("v", 6).alias("v"))


@query(f"WITH {V_ALL} SELECT vec_id, (generate_subscripts(x, 1) - 1)::INTEGER AS j, round(unnest(x) / sqrt(list_dot_product(x, x)), 6) AS v FROM v")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(fixtures.vectors(spark, sf_dir), V.normalize(F.col("embedding")))


@query(f"WITH {V_ALL}, s AS (SELECT vec_id, list_transform(x, lambda e: sqrt(abs(e))) AS x FROM v) SELECT vec_id, (generate_subscripts(x, 1) - 1)::INTEGER AS j, round(unnest(x) / list_sum(x), 6) AS v FROM s")
def power_l1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(fixtures.vectors(spark, sf_dir), V.power_l1(F.transform("embedding", F.abs)))


@query(f"WITH {V_ALL} SELECT vec_id, round(list_sum(list_transform(x, lambda e: abs(e) ** 3)) ** (1.0 / 3), 6) AS norm3, round(sqrt(list_dot_product(x, x)), 6) AS norm2 FROM v")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    return fixtures.vectors(spark, sf_dir).select("vec_id", F.round(V.norm(x, 3.0), 6).alias("norm3"), F.round(V.norm(x), 6).alias("norm2"))


def _pairs(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    """The stated query set, ids divisible by 20, against all vectors."""
    v = fixtures.vectors(spark, sf_dir)
    if kind == 3:
        v = v.withColumn("embedding", F.transform("embedding", F.abs))
    asked = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return search.cross_distances(asked, v, kind).select("query_id", "vec_id", *rounded("distance"))


def _sql_pairs(distance: str, x: str = "embedding::DOUBLE[]") -> str:
    return f"WITH v AS (SELECT vec_id, {x} AS x FROM embeddings), q AS (SELECT vec_id AS query_id, x FROM v WHERE vec_id % 20 = 0) SELECT query_id, vec_id, round({distance}, 6) AS distance FROM q a CROSS JOIN v b"


_ZIP = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: {}))"


@query(_sql_pairs(SQL_L2))
def pairwise_l2sqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 2)


@query(_sql_pairs(_ZIP.format("abs(p[1] - p[2])")))
def pairwise_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 1)


@query(_sql_pairs(_ZIP.format("coalesce((p[1] - p[2]) ** 2 / nullif(p[1] + p[2], 0), 0)"), "list_transform(embedding::DOUBLE[], lambda e: abs(e))"))
def pairwise_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 3)


@query(_sql_pairs(_ZIP.format("coalesce((p[1] - p[2]) ** 2 / nullif(abs(p[1]) + abs(p[2]), 0), 0)")))
def pairwise_signed_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 4)


@query(_sql_pairs("list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)))"))
def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 16)


@query(f"WITH {V_ALL}, {Q_SOME} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id))::INTEGER AS rank, vec_id, round(d, 6) AS distance FROM (SELECT query_id, vec_id, {SQL_L2} AS d FROM q a CROSS JOIN v b) QUALIFY rank <= 5")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.vectors(spark, sf_dir)
    near = search.knn(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v, 5)
    return near.select("query_id", "rank", "vec_id", *rounded("distance"))


def _sql_k(order: str) -> str:
    return f"WITH e AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS place, unnest(embedding)::DOUBLE AS value FROM embeddings) SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY value {order}, place) - 1)::INTEGER AS k, place, value FROM e QUALIFY k < 3"


def _k(df: DataFrame, found) -> DataFrame:
    return df.select("vec_id", F.posexplode(found).alias("k", "p")).select("vec_id", "k", "p.place", "p.value")


@query(_sql_k("DESC"))
def vector_kmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _k(fixtures.vectors(spark, sf_dir), V.k_largest(F.col("embedding"), 3))


@query(_sql_k("ASC"))
def vector_kmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _k(fixtures.vectors(spark, sf_dir), V.k_smallest(F.col("embedding"), 3))


@query("SELECT vec_id, list_aggregate(list_transform(range(0, 8), lambda i: ((floor((embedding[1]::DOUBLE + 1) * 127)::BIGINT >> i) & 1)::VARCHAR), 'string_agg', '') AS bits FROM embeddings")
def bits_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = F.floor((F.element_at("embedding", 1).cast("double") + 1) * 127).cast("int")
    return fixtures.vectors(spark, sf_dir).select("vec_id", F.array_join(V.bits(F.array(byte)).cast("array<string>"), "").alias("bits"))


# ---------------------------------------------------------------- quantisation


@query("SELECT j::INTEGER AS j, round(avg(x), 6) AS mean FROM (SELECT generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY j")
def pca_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mean, _ = quantize.moments(fixtures.vectors(spark, sf_dir), "embedding")
    return spark.createDataFrame([(j, float(m)) for j, m in enumerate(mean)], "j int, mean double").select("j", *rounded("mean"))


@query("WITH e AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT a.j AS i, b.j AS j, CASE WHEN round(covar_samp(a.x, b.x), 6) = 0 THEN 0 ELSE round(covar_samp(a.x, b.x), 6) END AS cov FROM e a JOIN e b USING (vec_id) GROUP BY a.j, b.j")
def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, cov = quantize.moments(fixtures.vectors(spark, sf_dir), "embedding")
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(rows, "i int, j int, cov double").select("i", "j", *rounded("cov"))


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.vectors(spark, sf_dir)
    return _exploded(quantize.project(v, "embedding", quantize.fit_pca(v, "embedding"), PARAMS.pca_dim), F.col("embedding"))


_ASSIGN = f"{V_ALL}, {MEANS}, coded AS (SELECT a.vec_id, arg_min(code, {{'d': greatest(0, list_dot_product(a.x, a.x) + list_dot_product(centroid, centroid) - 2 * list_dot_product(a.x, centroid)), 'code': code}}) AS code, min(greatest(0, list_dot_product(a.x, a.x) + list_dot_product(centroid, centroid) - 2 * list_dot_product(a.x, centroid))) AS d FROM v a CROSS JOIN book GROUP BY a.vec_id)"


@query(f"WITH {_ASSIGN} SELECT vec_id, code, round(d, 6) AS distance FROM coded")
def vq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = quantize.assign(fixtures.vectors(spark, sf_dir), "embedding", fixtures.label_means(spark, sf_dir), distance="distance")
    return coded.select("vec_id", "code", *rounded("distance"))


@query(f"WITH {_ASSIGN} SELECT code, j, round(avg(x), 6) AS v FROM (SELECT code, (generate_subscripts(x, 1) - 1)::INTEGER AS j, unnest(x) AS x FROM coded JOIN v USING (vec_id)) GROUP BY code, j")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, _ = quantize.lloyd_step(fixtures.vectors(spark, sf_dir), "embedding", fixtures.label_means(spark, sf_dir))
    rows = [(k, j, float(x)) for k in range(len(c)) if n[k] for j, x in enumerate(c[k])]
    return spark.createDataFrame(rows, "code int, j int, v double").select("code", "j", *rounded("v"))


@query(f"WITH {_ASSIGN} SELECT book.code, count(coded.code) AS n FROM book LEFT JOIN coded USING (code) GROUP BY book.code")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n, _ = quantize.lloyd_step(fixtures.vectors(spark, sf_dir), "embedding", fixtures.label_means(spark, sf_dir))
    return spark.createDataFrame([(k, int(x)) for k, x in enumerate(n)], "code int, n long")


def sql_first(k: int, seed: int) -> str:
    """quantize.first_vectors, numbered."""
    place = f"((vec_id % 1000003) * {7919 + 2 * seed} + {131 * seed}) % 1000003"
    return f"SELECT (row_number() OVER (ORDER BY {place}, vec_id) - 1)::INTEGER AS code, x FROM v QUALIFY code < {k}"


def sql_kmeans(k: int, rounds: int, redo: int) -> str:
    """Rounds of each run, one after the other; a run that has converged stays as it is."""
    dist = "greatest(0, list_dot_product(v.x, v.x) + list_dot_product(c.x, c.x) - 2 * list_dot_product(v.x, c.x))"
    coded = f"(SELECT v.vec_id, any_value(v.x) AS x, arg_min(code, {{{{'d': {dist}, 'code': code}}}}) AS code, min({dist}) AS d FROM v CROSS JOIN {{0}} c GROUP BY v.vec_id)"
    parts = []
    for run in range(redo):
        parts.append(f"c{run}_0 AS MATERIALIZED ({sql_first(k, run)})")
        for i in range(rounds):
            last = f"c{run}_{i}"
            means = f"SELECT code, list(m ORDER BY j) AS x FROM (SELECT code, j, avg(e) AS m FROM (SELECT code, generate_subscripts(x, 1) AS j, unnest(x) AS e FROM {coded.format(last)}) GROUP BY code, j) GROUP BY code"
            parts.append(f"c{run}_{i + 1} AS MATERIALIZED (SELECT l.code, coalesce(n.x, l.x) AS x FROM {last} l LEFT JOIN ({means}) n USING (code))")
        parts.append(f"e{run} AS MATERIALIZED (SELECT code, count(*) AS n, sum(d) AS cost FROM {coded.format(f'c{run}_{rounds}')} GROUP BY code)")
    runs = " UNION ALL ".join(f"SELECT {run} AS run, c.code, coalesce(e.n, 0) AS n, c.x AS centroid, (SELECT sum(cost) FROM e{run}) AS cost FROM c{run}_{rounds} c LEFT JOIN e{run} e USING (code)" for run in range(redo))
    return f"WITH {V_ALL}, {', '.join(parts)}, every AS ({runs}) SELECT code, j::INTEGER AS j, n::BIGINT AS n, round(centroid[j + 1], 6) AS v FROM every, range(0, 64) t(j) QUALIFY run = first_value(run) OVER (ORDER BY cost, run)"


@query(sql_kmeans(16, 10, 2))
def kmeans_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, _ = quantize.kmeans(fixtures.vectors(spark, sf_dir), "embedding", "vec_id", 16, rounds=10, redo=2)
    rows = [(k, j, int(n[k]), round(float(x), 6)) for k in range(len(c)) for j, x in enumerate(c[k])]
    return spark.createDataFrame(rows, "code int, j int, n long, v double")


def _books(spark: SparkSession, sf_dir: str) -> list[np.ndarray]:
    return np.split(fixtures.label_means(spark, sf_dir), 4, axis=1)


_PQ = f"{V_ALL}, {MEANS}, p AS (SELECT vec_id, q, x[q * 16 + 1 : q * 16 + 16] AS x FROM v, range(0, 4) t(q)), b AS (SELECT code, q, centroid[q * 16 + 1 : q * 16 + 16] AS y FROM book, range(0, 4) t(q)), pq AS (SELECT vec_id, q, arg_min(code, {{'d': greatest(0, list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y)), 'code': code}}) AS code FROM p JOIN b USING (q) GROUP BY vec_id, q)"


@query(f"WITH {_PQ} SELECT vec_id, q::INTEGER AS q, code FROM pq")
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = quantize.pq_encode(fixtures.vectors(spark, sf_dir), "embedding", _books(spark, sf_dir))
    return coded.select("vec_id", F.posexplode("codes").alias("q", "code"))


@query(f"WITH {_PQ} SELECT vec_id, (q * 16 + i - 1)::INTEGER AS j, round(y[i], 6) AS v FROM pq JOIN b USING (q, code), range(1, 17) t(i)")
def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = _books(spark, sf_dir)
    coded = quantize.pq_encode(fixtures.vectors(spark, sf_dir), "embedding", books)
    return _exploded(coded, quantize.pq_decode(F.col("codes"), quantize.books_column(books)))


@query(f"WITH {_PQ} SELECT vec_id, round(sum(list_dot_product(y, z)), 6) AS dot FROM pq JOIN b USING (q, code) JOIN (SELECT q, y AS z FROM b WHERE code = 0) USING (q) GROUP BY vec_id")
def pq_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products with the first centroid in the code domain."""
    books = _books(spark, sf_dir)
    tables = F.array(*[F.array(*[F.lit(float(c @ b[0])) for c in b]) for b in books])
    coded = quantize.pq_encode(fixtures.vectors(spark, sf_dir), "embedding", books)
    return coded.select("vec_id", F.round(quantize.pq_dot(F.col("codes"), tables), 6).alias("dot"))


@query(f"WITH {_PQ}, d AS (SELECT vec_id, (q * 16 + i - 1)::INTEGER AS j, y[i] AS y FROM pq JOIN b USING (q, code), range(1, 17) t(i)), n AS (SELECT vec_id, sum(y * y) AS n2 FROM d GROUP BY vec_id) SELECT vec_id, j, round(n2, 6) AS n2, round(x[j + 1] - 2 * y, 6) AS v FROM d JOIN n USING (vec_id) JOIN v USING (vec_id)")
def pq_axpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector less twice its coded form, with the coded form's squared norm."""
    books = _books(spark, sf_dir)
    coded = quantize.pq_encode(fixtures.vectors(spark, sf_dir), "embedding", books)
    book = quantize.books_column(books)
    out = coded.select("vec_id", F.round(quantize.pq_norm2(F.col("codes"), book), 6).alias("n2"), F.posexplode(quantize.pq_axpy(F.col("embedding"), F.lit(-2.0), F.col("codes"), book)).alias("j", "v"))
    return out.select("vec_id", "j", "n2", *rounded("v"))


def sql_gmm(k: int, rounds: int, floor: float = 1e-6) -> str:
    """Rounds of EM, one after the other, on rows (component, place)."""
    parts = [f"first AS ({sql_first(k, 0)})", "e AS MATERIALIZED (SELECT vec_id, generate_subscripts(x, 1) - 1 AS j, unnest(x) AS x FROM v)", f"g AS (SELECT j, greatest(var_samp(x), {floor}) AS s FROM e GROUP BY j)"]
    parts.append(f"m0 AS MATERIALIZED (SELECT code AS k, j, x[j + 1] AS m, s, 1 / {k}::DOUBLE AS w FROM first, g)")
    for i in range(rounds):
        parts.append(f"l{i} AS (SELECT vec_id, k, ln(any_value(w)) - 0.5 * sum(ln(2 * pi() * s) + (x - m) ** 2 / s) AS l FROM e JOIN m{i} USING (j) GROUP BY vec_id, k)")
        parts.append(f"x{i} AS (SELECT vec_id, k, exp(l - max(l) OVER (PARTITION BY vec_id)) AS p FROM l{i})")
        parts.append(f"p{i} AS MATERIALIZED (SELECT vec_id, k, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM x{i})")
        sums = f"SELECT k, j, sum(p) AS s0, sum(p * x) AS s1, sum(p * x * x) AS s2 FROM p{i} JOIN e USING (vec_id) GROUP BY k, j"
        parts.append(f"m{i + 1} AS MATERIALIZED (SELECT k, j, s1 / greatest(s0, 1e-12) AS m, greatest(s2 / greatest(s0, 1e-12) - (s1 / greatest(s0, 1e-12)) ** 2, {floor}) AS s, s0 / (SELECT count(*) FROM v) AS w FROM ({sums}))")
    return f"WITH {V_ALL}, {', '.join(parts)} SELECT k, j::INTEGER AS j, round(w, 6) AS w, round(m, 6) AS mu, round(s, 6) AS sigma FROM m{rounds}"


@query(sql_gmm(4, 5))
def gmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quantize.fit_gmm(fixtures.vectors(spark, sf_dir), "embedding", "vec_id", 4, rounds=5)
    rows = [(k, j, *(round(float(x), 6) for x in (m.w[k], m.mu[k, j], m.var[k, j]))) for k in range(len(m.w)) for j in range(m.mu.shape[1])]
    return spark.createDataFrame(rows, "k int, j int, w double, mu double, sigma double")


@query("""
    WITH e AS (SELECT vec_id, vec_id // 100 AS doc_id, label, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j, unnest(embedding)::DOUBLE AS x FROM embeddings),
    g AS (SELECT (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS k, j, m, s FROM (SELECT label, j, avg(x) AS m, var_pop(x) AS s FROM e WHERE label IS NOT NULL GROUP BY ALL)),
    w AS (SELECT (row_number() OVER (ORDER BY label) - 1)::INTEGER AS k, count(*) / sum(count(*)) OVER () AS w FROM embeddings WHERE label IS NOT NULL GROUP BY label),
    l AS (SELECT vec_id, doc_id, k, ln(any_value(w)) - 0.5 * sum(ln(2 * pi() * s) + (x - m) ** 2 / s) AS l FROM e JOIN g USING (j) JOIN w USING (k) GROUP BY vec_id, doc_id, k),
    p AS (SELECT vec_id, k, exp(l - max(l) OVER (PARTITION BY vec_id)) AS p FROM l),
    r AS (SELECT vec_id, k, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM p),
    f AS (SELECT doc_id, k, j, sum(p * (x - m) / sqrt(s)) / any_value(n) / sqrt(any_value(w)) AS f FROM e JOIN r USING (vec_id) JOIN g USING (k, j) JOIN w USING (k) JOIN (SELECT vec_id // 100 AS doc_id, count(*) AS n FROM embeddings GROUP BY 1) USING (doc_id) GROUP BY doc_id, k, j)
    SELECT doc_id, (k * 64 + j)::INTEGER AS j, round(f / sqrt(sum(f * f) OVER (PARTITION BY doc_id)), 6) AS v FROM f""")
def fisher_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher vectors of pages under the mixture with a component per label."""
    cells = fixtures.cells(spark, sf_dir)
    rows = cells.where("label IS NOT NULL").select("label", F.posexplode("feat").alias("j", "x")).withColumn("x", F.col("x").cast("double"))
    found = rows.groupBy("label", "j").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"), F.count("*").alias("n")).orderBy("label", "j").collect()
    k = len({r.label for r in found})
    n = np.array([r.n for r in found], float).reshape(k, -1)[:, 0]
    model = quantize.Gmm(n / n.sum(), np.array([r.m for r in found]).reshape(k, -1), np.array([r.s for r in found]).reshape(k, -1))
    out = quantize.fisher(cells.withColumn("feat", F.col("feat").cast("array<double>")), "doc_id", "feat", model)
    return out.select("doc_id", F.posexplode("fisher").alias("j", "v")).select("doc_id", "j", *rounded("v"))


# ---------------------------------------------------------------- windows and detections


def _scored(spark: SparkSession, sf_dir: str, th: int, tw: int) -> DataFrame:
    cells = fixtures.cells(spark, sf_dir)
    return windows.scores(cells, windows.templates(fixtures.queries(cells, th, tw), cells))


@query(f"WITH {sql_windows(2, 3)} SELECT query_id, doc_id, r, c, round(score, 6) AS score FROM win")
def window_scores_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, 2, 3).select("query_id", "doc_id", "r", "c", *rounded("score"))


def _kernel_scores(spark: SparkSession, sf_dir: str, th: int, tw: int, normalise: bool = True) -> DataFrame:
    cells = fixtures.cells(spark, sf_dir)
    return windows.scores_by_page(windows.page_arrays(cells), windows.templates(fixtures.queries(cells, th, tw), cells), normalise=normalise)


_WHOLE = "AND doc_id IN (SELECT doc_id FROM cells GROUP BY doc_id HAVING count(*) = (max(r) + 1) * (max(c) + 1))"


@query(f"WITH {sql_windows(2, 3)} SELECT query_id, doc_id, r, c, round(score, 6) AS score FROM win WHERE true {_WHOLE}")
def window_scores_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel_scores(spark, sf_dir, 2, 3).select("query_id", "doc_id", "r", "c", *rounded("score"))


@query(f"WITH {sql_windows(4, 6, norm=False)} SELECT query_id, doc_id, r, c, round(score, 6) AS score FROM win WHERE true {_WHOLE}")
def filter_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel_scores(spark, sf_dir, 4, 6, normalise=False).select("query_id", "doc_id", "r", "c", *rounded("score"))


@query(f"WITH {sql_windows(2, 3)}, {MEANS} SELECT query_id, dr::INTEGER AS dr, dc::INTEGER AS dc, code, round(list_dot_product(centroid, w), 6) AS val, round(list_dot_product(centroid, centroid), 6) AS n2 FROM tpl CROSS JOIN book")
def lut_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.cells(spark, sf_dir)
    table = windows.lookup(windows.templates(fixtures.queries(cells, 2, 3), cells), fixtures.codebook(spark, fixtures.label_means(spark, sf_dir)))
    return table.select("query_id", "dr", "dc", "code", *rounded("val", "n2"))


@query(f"""
    WITH {sql_windows(2, 3)}, {_ASSIGN}, lut AS (SELECT query_id, dr, dc, code, list_dot_product(centroid, w) AS val, list_dot_product(centroid, centroid) AS n2 FROM tpl CROSS JOIN book)
    SELECT query_id, doc_id, (r - dr)::INTEGER AS r, (c - dc)::INTEGER AS c, round(sum(val) / sqrt(sum(n2)), 6) AS score FROM cells JOIN coded USING (vec_id) JOIN lut USING (code)
    WHERE r >= dr AND c >= dc GROUP BY query_id, doc_id, r - dr, c - dc HAVING count(*) = 6""")
def window_scores_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.cells(spark, sf_dir)
    means = fixtures.label_means(spark, sf_dir)
    coded = quantize.assign(cells.select("doc_id", "r", "c", "feat"), "feat", means).drop("feat")
    table = windows.lookup(windows.templates(fixtures.queries(cells, 2, 3), cells), fixtures.codebook(spark, means))
    return windows.scores_coded(coded, table).select("query_id", "doc_id", "r", "c", *rounded("score"))


def _paged(spark: SparkSession, sf_dir: str, th: int, tw: int) -> DataFrame:
    cells = fixtures.cells(spark, sf_dir)
    return pages.scores(cells, windows.templates(fixtures.queries(cells, th, tw), cells))


@query(f"WITH {sql_top(2, 3, 50)} SELECT query_id, doc_id, place, r, c, x1, x2, y1, y2, round(score, 6) AS score FROM top")
def topk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = windows.top_windows(retrieval.boxes(_paged(spark, sf_dir, 2, 3), PARAMS.sbin), 50)
    return best.select("query_id", "doc_id", "place", "r", "c", "x1", "x2", "y1", "y2", *rounded("score"))


@query(f"WITH RECURSIVE {sql_nms(2, 3, PARAMS.windows_per_page, PARAMS.nms_overlap)} SELECT query_id, doc_id, pick, place, x1, x2, y1, y2, round(score, 6) AS score FROM picked")
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = windows.top_windows(retrieval.boxes(_paged(spark, sf_dir, 2, 3), PARAMS.sbin), PARAMS.windows_per_page)
    return detections.nms(best, PARAMS.nms_overlap).select("query_id", "doc_id", "pick", "place", "x1", "x2", "y1", "y2", *rounded("score"))


def _picked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = fixtures.cells(spark, sf_dir)
    asked = fixtures.queries(cells, 1, 2)
    scored = pages.scores(cells, windows.templates(asked, cells))
    best = windows.top_windows(retrieval.boxes(scored, PARAMS.sbin), PARAMS.windows_per_page)
    return detections.nms(best, PARAMS.nms_overlap), fixtures.truth(cells, asked)


@query(f"WITH RECURSIVE {sql_hits()} SELECT query_id, doc_id, pick, gt_id, round(iou, 6) AS iou FROM iou")
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.matches(*_picked(spark, sf_dir)).select("query_id", "doc_id", "pick", "gt_id", *rounded("iou"))


@query(f"WITH RECURSIVE {sql_hits()} SELECT query_id, doc_id, pick, is_relevant FROM labelled")
def first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.first_hits(*_picked(spark, sf_dir), PARAMS.hit_overlap).select("query_id", "doc_id", "pick", "is_relevant")


def _detections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = fixtures.cells(spark, sf_dir)
    asked = fixtures.queries(cells, 1, 2)
    truth = fixtures.truth(cells, asked)
    return retrieval.detect_on(cells, windows.templates(asked, cells), truth, PARAMS), truth.groupBy("query_id").agg(F.count("*").alias("n_relevant"))


@query(f"WITH RECURSIVE {sql_hits()} SELECT query_id, rank, doc_id, pick, is_relevant, x1, x2, y1, y2, round(score, 6) AS score FROM ranked")
def ranked_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detections(spark, sf_dir)[0].select("query_id", "rank", "doc_id", "pick", "is_relevant", "x1", "x2", "y1", "y2", *rounded("score"))


@query(f"WITH RECURSIVE {sql_hits()} SELECT query_id, n_relevant, round(ap, 6) AS ap, round(recall, 6) AS recall FROM ap")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.average_precision(*_detections(spark, sf_dir)).select("query_id", "n_relevant", *rounded("ap", "recall"))


@query(f"WITH RECURSIVE {sql_hits()} SELECT round(avg(ap), 6) AS mean_ap, count(ap) AS n_queries FROM ap")
def mean_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ap = detections.average_precision(*_detections(spark, sf_dir))
    return detections.mean_ap(ap).select(*rounded("mean_ap"), "n_queries")


def sql_learned() -> str:
    """Windows of 1 x 2 cells scored in the code domain by templates learned from each query's own window against random ones."""
    side = lambda rest, salt: f"floor({rest} * ({_mix('q.query_id', 'p.doc_id', 'n', str(salt))}) + 0.5)::INTEGER"
    s = PARAMS
    return f"""{CELLS}, {MEANS},
        own AS (SELECT doc_id AS query_id, flatten(list(x ORDER BY c)) AS x FROM cells WHERE r = 2 AND c IN (3, 4) GROUP BY doc_id HAVING count(*) = 2),
        neg AS (SELECT q.query_id, p.doc_id, n, {side(8, 1)} AS r, {side(7, 2)} AS c FROM own q, (SELECT DISTINCT doc_id FROM cells) p, range(0, {s.negatives_per_positive}) t(n)),
        both_x AS (SELECT query_id, 1 AS sense, -1::BIGINT AS n, x FROM own UNION ALL
            SELECT query_id, -1, any_value(g.n + g.doc_id * 1000003), flatten(list(k.x ORDER BY k.c)) FROM neg g JOIN cells k ON k.doc_id = g.doc_id AND k.r = g.r AND k.c BETWEEN g.c AND g.c + 1 GROUP BY query_id, g.doc_id, g.n HAVING count(*) = 2),
        o AS MATERIALIZED (SELECT query_id, sense, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x, row_number() OVER (PARTITION BY query_id ORDER BY {_mix('query_id', '(n + 1)', '7')}, n) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM both_x),
        learned AS (SELECT query_id, any_value(n) AS n, 0::BIGINT AS t, list_transform(range(0, 128), lambda i: 0::DOUBLE) AS w, 0::DOUBLE AS b FROM o GROUP BY query_id
            UNION ALL
            SELECT query_id, n, t + 1, list_transform(range(1, 129), lambda i: w[i] * (1 - eta * {s.lambda_}::DOUBLE) + step * x[i]), b + step * {s.bias_term}
            FROM (SELECT *, CASE WHEN sense * (list_dot_product(w, x) + b * {s.bias_term}) < 1 THEN eta * sense ELSE 0 END AS step
                FROM (SELECT f.*, o.x, o.sense, {s.eta0}::DOUBLE / (1 + {s.lambda_}::DOUBLE * {s.eta0}::DOUBLE * t) AS eta FROM learned f JOIN o ON o.query_id = f.query_id AND o.i = f.t % f.n WHERE t < {s.epochs} * f.n))),
        lut AS (SELECT query_id, dc, code, list_dot_product(centroid, w[dc * 64 + 1 : dc * 64 + 64]) AS val, list_dot_product(centroid, centroid) AS n2 FROM learned, range(0, 2) t(dc), book WHERE learned.t = {s.epochs} * n),
        coded AS (SELECT a.vec_id, arg_min(code, {{'d': greatest(0, list_dot_product(a.x, a.x) + list_dot_product(centroid, centroid) - 2 * list_dot_product(a.x, centroid)), 'code': code}}) AS code FROM cells a CROSS JOIN book GROUP BY a.vec_id),
        win AS (SELECT query_id, doc_id, r::INTEGER AS r, (c - dc)::INTEGER AS c, sum(val) / sqrt(sum(n2)) AS score FROM cells JOIN coded USING (vec_id) JOIN lut USING (code) WHERE c >= dc GROUP BY query_id, doc_id, r, c - dc HAVING count(*) = 2)"""


@query(f"WITH RECURSIVE {sql_hits(sql_learned())} SELECT query_id, n_relevant, round(ap, 6) AS ap, round(recall, 6) AS recall FROM ap")
def retrieval_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned templates, coded cells, suppression and matching, to the average precision of every query."""
    cells = fixtures.cells(spark, sf_dir)
    asked = fixtures.queries(cells, 1, 2)
    pages = cells.select("doc_id").distinct().select("doc_id", F.lit(fixtures.SIDE).alias("bh"), F.lit(fixtures.SIDE).alias("bw"))
    learned = shared.cut(retrieval.learn_drawn(windows.templates(asked, cells), cells, pages, PARAMS, PARAMS.negatives_per_positive))
    means = fixtures.label_means(spark, sf_dir)
    coded = quantize.assign(cells.select("doc_id", "r", "c", "feat"), "feat", means).drop("feat")
    # a cell is its centroid, so scores are those of the code domain
    centroids = coded.join(F.broadcast(fixtures.codebook(spark, means)), "code").select("doc_id", "r", "c", F.col("centroid").alias("feat"))
    truth = fixtures.truth(cells, asked)
    found = retrieval.detect_on(centroids, learned, truth, PARAMS)
    ap = detections.average_precision(found, truth.groupBy("query_id").agg(F.count("*").alias("n_relevant")))
    return ap.select("query_id", "n_relevant", *rounded("ap", "recall"))


# ---------------------------------------------------------------- classifiers

BINARY = sgd.Settings(lambda_=1e-3, eta0=0.1, epochs=2, bias_term=1.0, beta=1)


@query(f"""
    WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL),
    f AS (SELECT label AS k, 0::BIGINT AS t, list_transform(range(0, 64), lambda i: 0::DOUBLE) AS w, 0::DOUBLE AS b FROM (SELECT DISTINCT label FROM s)
        UNION ALL
        SELECT k, t + 1, list_transform(range(1, 65), lambda i: w[i] * (1 - eta * {BINARY.lambda_}) + step * x[i]), b + step
        FROM (SELECT f.*, x, eta, CASE WHEN y * (list_dot_product(w, x) + b) < 1 THEN eta * y ELSE 0 END AS step
            FROM (SELECT f.*, x, CASE WHEN label = k THEN 1 ELSE -1 END AS y, {BINARY.eta0}::DOUBLE / (1 + {BINARY.lambda_}::DOUBLE * {BINARY.eta0}::DOUBLE * t) AS eta FROM f JOIN s ON s.i = f.t % (SELECT count(*) FROM s)) f)
        WHERE t < {BINARY.epochs} * (SELECT count(*) FROM s))
    SELECT k, (generate_subscripts(w, 1) - 1)::INTEGER AS j, round(unnest(w), 6) AS w FROM (SELECT k, list_append(w, b) AS w FROM f WHERE t = {BINARY.epochs} * (SELECT count(*) FROM s))""")
def sgd_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hinge classifier of each label against the others; labels train in parallel."""
    v = fixtures.vectors(spark, sf_dir).where("label IS NOT NULL")
    labels = v.select(F.col("label").alias("k")).distinct()
    rows = v.join(F.broadcast(labels)).withColumn("y", F.when(F.col("label") == F.col("k"), 1).otherwise(-1))  # a row per label
    return sgd.train_per_class(rows, "k", "vec_id", "y", "embedding", BINARY).select("k", "j", *rounded("w"))


def _page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cells(spark, sf_dir).where("label IS NOT NULL").select("doc_id", "vec_id", "label", "feat")


@query(f"""
    WITH RECURSIVE {CELLS}, s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, k, CASE WHEN label = k THEN 1 ELSE -1 END AS y, x FROM cells, range(0, 2) t(k) WHERE label IS NOT NULL),
    o AS MATERIALIZED (SELECT doc_id, k, y, x, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM s),
    f AS (SELECT doc_id, k, any_value(n) AS n, 0::BIGINT AS t, list_transform(range(0, 64), lambda i: 0::DOUBLE) AS w, 0::DOUBLE AS b FROM o GROUP BY doc_id, k
        UNION ALL
        SELECT doc_id, k, n, t + 1, list_transform(range(1, 65), lambda i: w[i] * (1 - eta * {BINARY.lambda_}) + step * x[i]), b + step
        FROM (SELECT *, CASE WHEN y * (list_dot_product(w, x) + b) < 1 THEN eta * y ELSE 0 END AS step
            FROM (SELECT f.*, o.x, o.y, {BINARY.eta0}::DOUBLE / (1 + {BINARY.lambda_}::DOUBLE * {BINARY.eta0}::DOUBLE * t) AS eta FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k AND o.i = f.t % f.n WHERE t < {BINARY.epochs} * f.n)))
    SELECT doc_id, k::INTEGER AS k, (generate_subscripts(w, 1) - 1)::INTEGER AS j, round(unnest(w), 6) AS w FROM (SELECT doc_id, k, list_append(w, b) AS w FROM f WHERE t = {BINARY.epochs} * n)""")
def sgd_binary_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hinge classifiers of two labels on each page's own cells, as a Catalyst fold."""
    rows = _page_samples(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("y", F.when(F.col("label") == F.col("k"), 1).otherwise(-1))
    ordered = rows.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("vec_id", "y", F.col("feat").alias("x")))).alias("s"))  # a page's cells
    m = ordered.select("doc_id", "k", sgd.binary_fold(F.col("s"), 64, BINARY).alias("m"))
    return m.select("doc_id", "k", F.posexplode(F.concat("m.w", F.array("m.b"))).alias("j", "w")).select("doc_id", "k", "j", *rounded("w"))


def _multiclass(spark: SparkSession, sf_dir: str, s: sgd.Settings) -> DataFrame:
    """A model per page, of its own cells: (doc_id, class_id, j, w), bias last."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        m = sgd.train(np.array(rows["feat"].tolist(), np.float64), rows["label"].to_numpy(), 10, s)
        flat = m.flat(s)
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "class_id": np.repeat(np.arange(10), flat.shape[1]), "j": np.tile(np.arange(flat.shape[1]), 10), "w": flat.ravel().round(6)})

    return _page_samples(spark, sf_dir).groupBy("doc_id").applyInPandas(fit, "doc_id long, class_id int, j int, w double")


def sql_draws(i: str, epoch: str, label: str, classes: int = 10, seed: int = 0) -> str:
    """The other classes of the i-th sample in drawn order."""
    key = drawn_by.key_sql(i, "k", epoch, seed)
    return f"list_transform(list_sort(list_transform(list_filter(range(0, {classes}), lambda k: k <> {label}), lambda k: {{'c': {key}, 'k': k}})), lambda drawn_: drawn_.k)"


def sql_fold(algo: str, epochs: int, etas: list[float]) -> str:
    """The fold of a trainer with the default settings, but for its first step, over each page's samples, as f (doc_id, e0, n, t, w);
    the bias is the last component of w."""
    touched = {"ovr": "list_concat([label], others[1:4])", "mul": "range(0, 10)", "rnk": "range(0, 10)", "war": "range(0, 10)"}[algo]
    broken = "list_transform(others, lambda o: 1 - sc[label + 1] + sc[o + 1] > 0)"
    other = {
        "ovr": "label", "mul": "list_position(rival, list_max(rival)) - 1",
        "rnk": f"CASE WHEN ({broken})[1] THEN others[1] ELSE label END",
        "war": f"coalesce(others[nullif(coalesce(list_position({broken}, true), 0), 0)], label)",
    }[algo]
    harmonic = "list_sum(list_transform(range(1, 9 // list_position({0}, true) + 2), lambda r: 1 / r::DOUBLE))".format(broken)
    step = f"CASE WHEN coalesce(list_position({broken}, true), 0) > 0 THEN eta * {harmonic} ELSE 0 END" if algo == "war" else "eta"
    gain = "CASE WHEN NOT list_contains(touched, k) THEN 0 WHEN k = label AND sc[k + 1] < 1 THEN eta WHEN k <> label AND -sc[k + 1] < 1 THEN -eta ELSE 0 END" if algo == "ovr" else "CASE WHEN other = label THEN 0 WHEN k = label THEN step WHEN k = other THEN -step ELSE 0 END"
    return f"""
    WITH RECURSIVE {CELLS}, s AS (SELECT doc_id, label, x, row_number() OVER (PARTITION BY doc_id ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM cells WHERE label IS NOT NULL),
    drawn AS MATERIALIZED (SELECT s.*, e AS epoch, {sql_draws('s.i', 'e', 's.label')} AS others FROM s, range(0, {epochs}) t(e)),
    f AS (SELECT doc_id, e0, any_value(n) AS n, 0::BIGINT AS t, list_transform(range(0, 10), lambda k: list_transform(range(0, 65), lambda i: 0::DOUBLE)) AS w FROM s, (SELECT unnest({etas})::DOUBLE AS e0) GROUP BY doc_id, e0
        UNION ALL
        SELECT doc_id, e0, n, t + 1, list_transform(range(0, 10), lambda k: list_transform(range(1, 66), lambda i: w[k + 1][i] * (CASE WHEN i < 65 AND list_contains(touched, k) THEN 1 - eta * 0.0001::DOUBLE ELSE 1 END)
            + ({gain}) * (CASE WHEN i < 65 THEN x[i] ELSE 0.1::DOUBLE END)))
        FROM (SELECT *, {step} AS step FROM (SELECT *, {other} AS other FROM (SELECT *, {touched} AS touched, list_transform(range(0, 10), lambda k: sc[k + 1] + CASE WHEN k = label THEN 0 ELSE 1 END) AS rival FROM (
            SELECT f.*, d.label, d.x, d.others, e0 / (1 + 0.0001::DOUBLE * e0 * t) AS eta, list_transform(range(0, 10), lambda k: list_dot_product(f.w[k + 1][1:64], d.x) + f.w[k + 1][65] * 0.1::DOUBLE) AS sc
            FROM f JOIN drawn d ON d.doc_id = f.doc_id AND d.i = f.t % f.n AND d.epoch = f.t // f.n)))))"""


def sql_multiclass(algo: str, epochs: int = 3) -> str:
    return f"""{sql_fold(algo, epochs, [0.1])},
    m AS (SELECT doc_id, unnest(range(0, 10))::INTEGER AS class_id, w FROM f WHERE t = {epochs} * n)
    SELECT doc_id, class_id, (j - 1)::INTEGER AS j, round(w[class_id + 1][j] * (CASE WHEN j = 65 THEN 0.1::DOUBLE ELSE 1 END), 6) AS w FROM m, range(1, 66) t(j)"""


def sql_eta(algo: str) -> str:
    """The step that sgd.search_eta finds: objectives after one epoch for powers of two, and the first at which they rise again."""
    own = "sc[label + 1]"
    hinge = "greatest(0, 1 - CASE WHEN k = label THEN 1 ELSE -1 END * sc[k + 1])"
    margin = f"CASE WHEN k = label THEN 0 ELSE 1 END + sc[k + 1] - {own}"
    loss = {"ovr": f"sum({hinge} * CASE WHEN k = label THEN 0.2::DOUBLE / c ELSE 0.8::DOUBLE / (n - c) END)", "mul": f"max({margin})", "rnk": f"sum(greatest(0, {margin}))"}[algo]
    return f"""({sql_fold(algo, 1, [2.0**p for p in range(-16, 9)])},
        z AS (SELECT f.doc_id, e0, f.n, s.i, s.label, w, list_transform(range(0, 10), lambda k: list_dot_product(f.w[k + 1][1:64], s.x) + f.w[k + 1][65] * 0.1::DOUBLE) AS sc FROM f JOIN s ON s.doc_id = f.doc_id WHERE f.t = f.n),
        l AS (SELECT z.doc_id, e0, i, {loss} AS l FROM z JOIN (SELECT doc_id, k, count(*) FILTER (label = k) AS c FROM s, range(0, 10) t(k) GROUP BY doc_id, k) h ON h.doc_id = z.doc_id GROUP BY z.doc_id, e0, i),
        r AS (SELECT doc_id, e0, 0.5 * 0.0001::DOUBLE * list_sum(list_transform(w, lambda v: list_dot_product(v[1:64], v[1:64]) + (v[65] * 0.1::DOUBLE) ** 2)) AS r FROM f WHERE t = n),
        c AS (SELECT doc_id, e0, sum(l) + any_value(r) AS c FROM l JOIN r USING (doc_id, e0) GROUP BY doc_id, e0),
        p AS (SELECT *, lead(c) OVER (PARTITION BY doc_id ORDER BY e0) AS up, lag(c) OVER (PARTITION BY doc_id ORDER BY e0) AS down, any_value(c) FILTER (e0 = 2) OVER w > any_value(c) FILTER (e0 = 1) OVER w AS falls FROM c WINDOW w AS (PARTITION BY doc_id))
        SELECT doc_id, '{algo}' AS algo, CASE WHEN any_value(falls) THEN max(e0) FILTER (e0 <= 1 AND NOT c > down) / 2 ELSE min(e0) FILTER (e0 >= 2 AND NOT c > up) END AS eta0 FROM p GROUP BY doc_id)"""


@query(sql_multiclass("ovr"))
def sgd_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multiclass(spark, sf_dir, sgd.Settings("ovr", epochs=3))


@query(sql_multiclass("mul"))
def sgd_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multiclass(spark, sf_dir, sgd.Settings("mul", epochs=3))


@query(sql_multiclass("rnk"))
def sgd_rnk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multiclass(spark, sf_dir, sgd.Settings("rnk", epochs=3))


@query(sql_multiclass("war"))
def sgd_war(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multiclass(spark, sf_dir, sgd.Settings("war", epochs=3))


@query(sql_multiclass("ovr", 1).replace("PARTITION BY doc_id", "PARTITION BY 0").replace("SELECT vec_id, vec_id // 100 AS doc_id", "SELECT vec_id, 0::BIGINT AS doc_id").replace("SELECT doc_id, class_id,", "SELECT class_id,"))
def sgd_ovr_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model of all samples; a class to a task, samples streaming past it in blocks."""
    v = annotations.numbered(fixtures.vectors(spark, sf_dir).where("label IS NOT NULL"), "vec_id", "place")
    return sgd.train_ovr(v, "place", "label", "embedding", 10, sgd.Settings("ovr", epochs=1)).select("class_id", "j", *rounded("w"))


def _class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the labels' means as weights."""
    w = fixtures.label_means(spark, sf_dir)
    return sgd.score(fixtures.vectors(spark, sf_dir).where("label IS NOT NULL"), "embedding", np.hstack([w, np.zeros((len(w), 1))]))


_SCORES = f"{V_ALL}, {MEANS}, sc AS (SELECT vec_id, label, list(list_dot_product(x, centroid) ORDER BY code) AS s FROM v CROSS JOIN book WHERE label IS NOT NULL GROUP BY vec_id, label)"


@query(f"WITH {_SCORES} SELECT vec_id, (generate_subscripts(s, 1) - 1)::INTEGER AS class_id, round(unnest(s), 6) AS score FROM sc")
def sgd_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_scores(spark, sf_dir).select("vec_id", F.posexplode("scores").alias("class_id", "score")).select("vec_id", "class_id", *rounded("score"))


@query(f"WITH {_SCORES}, k AS (SELECT len(list_filter(s, lambda e: e > s[label + 1])) + len(list_filter(s, lambda e: e = s[label + 1])) // 2 AS r, list_position(s, list_max(s)) - 1 = label AS best FROM sc) SELECT round(avg((r = 0)::INTEGER), 6) AS top1, round(avg(1 / (r + 1)), 6) AS map, round(avg(exp(-r * 0.1)), 6) AS exp, round(avg(best::INTEGER), 6) AS argmax FROM k")
def topn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _class_scores(spark, sf_dir).withColumn("r", sgd.label_rank(F.col("scores"), F.col("label")))
    best = V.argmax(F.col("scores")) == F.col("label")
    out = s.agg(F.avg((F.col("r") == 0).cast("int")).alias("top1"), F.avg(1 / (F.col("r") + 1)).alias("map"), F.avg(F.exp(-F.col("r") * 0.1)).alias("exp"), F.avg(best.cast("int")).alias("argmax"))
    return out.select(*rounded("top1", "map", "exp", "argmax"))


_RHO = 1 / (1 + math.isqrt(10))


@query(f"""WITH {_SCORES}, h AS (SELECT label, count(*) AS n FROM v WHERE label IS NOT NULL GROUP BY label), t AS (SELECT sum(n) AS total FROM h),
    e AS (SELECT vec_id, label, unnest(range(0, len(s)))::INTEGER AS k, unnest(s) AS s, s[label + 1] AS own FROM sc)
    SELECT vec_id, round(sum(CASE WHEN k = e.label THEN {_RHO} / h.n * greatest(0, 1 - s) ELSE {1 - _RHO} / (total - h.n) * greatest(0, 1 + s) END), 6) AS ovr,
        round(max(s + CASE WHEN k = e.label THEN 0 ELSE 1 END - own), 6) AS mul, round(sum(greatest(0, s + CASE WHEN k = e.label THEN 0 ELSE 1 END - own)), 6) AS rnk
    FROM e JOIN h ON h.label = k CROSS JOIN t GROUP BY vec_id""")
def ovr_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sample losses of the three algorithms that have one."""
    s = _class_scores(spark, sf_dir)
    counts = s.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # a row per class
    total = sum(r.n for r in counts)
    e = s.select("vec_id", "label", F.element_at("scores", F.col("label") + 1).alias("own"), F.posexplode("scores").alias("k", "s"))
    mine = F.col("k") == F.col("label")
    n = F.element_at(F.array(*[F.lit(r.n) for r in counts]), F.col("k") + 1)
    ovr = F.when(mine, _RHO / n * F.greatest(F.lit(0.0), 1 - F.col("s"))).otherwise((1 - _RHO) / (total - n) * F.greatest(F.lit(0.0), 1 + F.col("s")))
    margin = F.col("s") + F.when(mine, 0).otherwise(1) - F.col("own")
    out = e.groupBy("vec_id").agg(F.sum(ovr).alias("ovr"), F.max(margin).alias("mul"), F.sum(F.greatest(F.lit(0.0), margin)).alias("rnk"))
    return out.select("vec_id", *rounded("ovr", "mul", "rnk"))


@query(f"""WITH {_SCORES}, e AS (SELECT vec_id, unnest(range(0, len(s)))::INTEGER AS k, unnest(s) AS s, s[label + 1] AS own, label FROM sc)
    SELECT round((SELECT sum(m) FROM (SELECT max(s + CASE WHEN k = label THEN 0 ELSE 1 END - own) AS m FROM e GROUP BY vec_id)) + 0.5 * 0.0001 * (SELECT sum(list_dot_product(centroid, centroid)) FROM book), 6) AS objective""")
def objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    w2 = float((fixtures.label_means(spark, sf_dir) ** 2).sum())
    s = _class_scores(spark, sf_dir)
    worst = F.array_max(F.transform("scores", lambda v, k: v + F.when(k == F.col("label"), 0.0).otherwise(1.0))) - F.element_at("scores", F.col("label") + 1)
    return s.agg(F.round(F.sum(worst) + 0.5 * 1e-4 * w2, 6).alias("objective"))


@query(" UNION ALL ".join(f"SELECT * FROM {sql_eta(a)}" for a in ("ovr", "mul", "rnk")))
def eta0_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        x, y = np.array(rows["feat"].tolist(), np.float64), rows["label"].to_numpy()
        return pd.DataFrame([(int(rows["doc_id"].iloc[0]), a, sgd.search_eta(x, y, 10, sgd.Settings(a, eta0=0.0))) for a in ("ovr", "mul", "rnk")], columns=["doc_id", "algo", "eta0"])

    return _page_samples(spark, sf_dir).groupBy("doc_id").applyInPandas(fit, "doc_id long, algo string, eta0 double")


@query("SELECT vec_id, (((row_number() OVER (ORDER BY vec_id)) * 5 - 1) // count(*) OVER ())::INTEGER AS fold FROM embeddings")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = annotations.numbered(fixtures.vectors(spark, sf_dir).select("vec_id"), "vec_id", "place")
    return placed.select("vec_id", tuning.fold_of(F.col("place"), F.lit(placed.count()), 5).alias("fold"))


@query()
def crossval_hillclimb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of one cross-validation fit a trainer's memory; they are the whole table."""
    rows = fixtures.vectors(spark, sf_dir).where("label IS NOT NULL").orderBy("vec_id").toPandas()
    x, y = np.array(rows["embedding"].tolist(), np.float64), rows["label"].to_numpy()
    best, score = tuning.hill_climb(spark, x, y, 10, sgd.Settings("mul", epochs=2, eval_every=1), {"lambda_": GRID["lambda_"], "eta0": (1e-2, 1e-1, 1.0)}, {"lambda_": 1e-3, "eta0": 1e-1})
    return spark.createDataFrame([(p["lambda_"], p["eta0"], e, round(score, 6)) for p, e in best], "lambda_ double, eta0 double, epoch int, score double")


# ---------------------------------------------------------------- images

_ALONG = "[" + ", ".join(f"{sign}({c}::DOUBLE * dx + {s}::DOUBLE * dy)" for c, s in zip(features.COS, features.SIN, strict=True) for sign in ("", "-")) + "]"
PIXELS = "pix AS MATERIALIZED (SELECT doc_id, (p // 80)::INTEGER AS y, (p % 80)::INTEGER AS x, v FROM (SELECT vec_id // 100 AS doc_id, (vec_id % 100) * 64 + generate_subscripts(embedding, 1) - 1 AS p, floor((unnest(embedding)::DOUBLE + 1) * 127.5) AS v FROM embeddings) WHERE doc_id IN (SELECT vec_id // 100 FROM embeddings GROUP BY 1 HAVING count(*) = 100))"
def sql_gradient(pixels: str, side: int) -> str:
    """Gradients of square pages of that side."""
    return f"""{pixels},
    inl AS (SELECT doc_id, y, x, lead(v) OVER (PARTITION BY doc_id, y ORDER BY x) - lag(v) OVER (PARTITION BY doc_id, y ORDER BY x) AS dx,
        lead(v) OVER (PARTITION BY doc_id, x ORDER BY y) - lag(v) OVER (PARTITION BY doc_id, x ORDER BY y) AS dy FROM pix),
    spread AS (SELECT i, p FROM (SELECT i, least(i, {side - 2}) AS p FROM range(1, {features.half_up(side / 12) * 12 - 1}) t(i))),
    dif AS (SELECT doc_id, b.i AS y, a.i AS x, dx, dy FROM inl JOIN spread a ON a.p = inl.x JOIN spread b ON b.p = inl.y),
    gra AS (SELECT doc_id, y, x, sqrt(dx * dx + dy * dy) AS v, CASE WHEN list_max(a) > 0 THEN (list_position(a, list_max(a)) - 1) // 2 + 9 * ((list_position(a, list_max(a)) - 1) % 2) ELSE 0 END AS o FROM (SELECT *, {_ALONG} AS a FROM dif))"""


VOTES = """pos AS (SELECT *, (y + 0.5::DOUBLE) / 12 - 0.5 AS fy, (x + 0.5::DOUBLE) / 12 - 0.5 AS fx FROM gra),
    low AS (SELECT *, floor(fy)::INTEGER AS cy, floor(fx)::INTEGER AS cx FROM pos)"""


def sql_hist(pixels: str, side: int) -> str:
    last = features.half_up(side / 12) - 1
    return f"""{sql_gradient(pixels, side)}, {VOTES},
    vot AS (SELECT doc_id, cy + i AS r, cx + j AS c, o, v * (CASE WHEN i = 0 THEN 1 - (fy - cy) ELSE fy - cy END) * (CASE WHEN j = 0 THEN 1 - (fx - cx) ELSE fx - cx END) AS v FROM low, range(0, 2) a(i), range(0, 2) b(j)),
    his AS (SELECT doc_id, r::INTEGER AS r, c::INTEGER AS c, o::INTEGER AS o, sum(v) AS v FROM vot WHERE r BETWEEN 0 AND {last} AND c BETWEEN 0 AND {last} GROUP BY ALL)"""



def sql_hog(pixels: str, side: int) -> str:
    n = features.half_up(side / 12)
    return f"""{sql_hist(pixels, side)},
    ful AS MATERIALIZED (SELECT d.doc_id, r::INTEGER AS r, c::INTEGER AS c, o::INTEGER AS o, coalesce(v, 0) AS v FROM (SELECT DISTINCT doc_id FROM pix) d CROSS JOIN range(0, {n}) a(r) CROSS JOIN range(0, {n}) b(c) CROSS JOIN range(0, 18) e(o) LEFT JOIN his USING (doc_id, r, c, o)),
    ene AS (SELECT doc_id, r, c, sum(s * s) AS e FROM (SELECT doc_id, r, c, o % 9 AS o, sum(v) AS s FROM ful GROUP BY ALL) GROUP BY ALL),
    row AS (SELECT doc_id, r, c, e + lead(e) OVER (PARTITION BY doc_id, r ORDER BY c) AS e FROM ene),
    nor AS MATERIALIZED (SELECT * FROM (SELECT doc_id, r, c, 1 / sqrt(e + lead(e) OVER (PARTITION BY doc_id, c ORDER BY r) + 0.0001) AS s FROM row) WHERE s IS NOT NULL),
    inn AS (SELECT f.doc_id, f.r - 1 AS r, f.c - 1 AS c, o, v, CASE WHEN n.r = f.r AND n.c = f.c THEN 0 WHEN n.r = f.r - 1 AND n.c = f.c THEN 1 WHEN n.r = f.r AND n.c = f.c - 1 THEN 2 ELSE 3 END AS k, s
        FROM ful f CROSS JOIN range(0, 2) a(i) CROSS JOIN range(0, 2) b(j) JOIN nor n ON n.doc_id = f.doc_id AND n.r = f.r - a.i AND n.c = f.c - b.j WHERE f.r BETWEEN 1 AND {n - 2} AND f.c BETWEEN 1 AND {n - 2}),
    sig AS (SELECT doc_id, r, c, o AS d, 0.5 * sum(least(v * s, 0.2)) AS v FROM inn GROUP BY ALL),
    uns AS (SELECT doc_id, r, c, o AS d, 0.5 * sum(least(v * s, 0.2)) AS v FROM (SELECT doc_id, r, c, o % 9 AS o, k, s, sum(v) AS v FROM inn GROUP BY doc_id, r, c, o % 9, k, s) GROUP BY ALL),
    tex AS (SELECT doc_id, r, c, k AS d, 0.2357 * sum(least(v * s, 0.2)) AS v FROM inn GROUP BY ALL)"""


GRADIENT, HIST, HOG = sql_gradient(PIXELS, 80), sql_hist(PIXELS, 80), sql_hog(PIXELS, 80)


def _described(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    d = features.describe(fixtures.images(spark, sf_dir), fixtures.SBIN, kind)
    return d.select("doc_id", "r", "c", F.posexplode("feat").alias("d", "v")).select("doc_id", "r", "c", "d", *rounded("v"))


def _per_page(pages: DataFrame, f, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for p in batch.itertuples():
                yield f(p.doc_id, np.frombuffer(p.pixels, np.uint8).reshape(p.h, p.w))

    return pages.mapInPandas(run, schema)


@query(f"WITH {GRADIENT} SELECT doc_id, y::INTEGER AS y, x::INTEGER AS x, round(v, 6) AS v, o::INTEGER AS o FROM gra")
def hog_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(doc, im):
        y, x, v, o = features.gradients(im, fixtures.SBIN)
        return pd.DataFrame({"doc_id": doc, "y": y, "x": x, "v": v, "o": o})

    return _per_page(fixtures.images(spark, sf_dir), f, "doc_id long, y int, x int, v double, o int").select("doc_id", "y", "x", *rounded("v"), "o")


@query(f"WITH {HIST} SELECT doc_id, r, c, o, round(v, 6) AS v FROM his WHERE v > 0.000001")
def hog_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(doc, im):
        h = features.histogram(im, fixtures.SBIN)
        r, c, o = np.nonzero(h > 1e-6)
        return pd.DataFrame({"doc_id": doc, "r": r, "c": c, "o": o, "v": h[r, c, o]})

    return _per_page(fixtures.images(spark, sf_dir), f, "doc_id long, r int, c int, o int, v double").select("doc_id", "r", "c", "o", *rounded("v"))


_UNSIGNED = "SELECT doc_id, r::INTEGER AS r, c::INTEGER AS c, (d + {0})::INTEGER AS d, round(v, 6) AS v FROM uns UNION ALL SELECT doc_id, r::INTEGER, c::INTEGER, (d + {1})::INTEGER, round(v, 6) FROM tex"


_HOG31 = f"WITH {HOG} SELECT doc_id, r::INTEGER AS r, c::INTEGER AS c, d::INTEGER AS d, round(v, 6) AS v FROM sig UNION ALL {_UNSIGNED.format(18, 27)}"


@query(_HOG31)
def hog31_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = features_relational.describe(fixtures.images(spark, sf_dir), fixtures.SBIN)
    return d.select("doc_id", "r", "c", F.posexplode("feat").alias("d", "v")).select("doc_id", "r", "c", "d", *rounded("v"))


@query(_HOG31)
def hog31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir, "hog31")


@query(f"WITH {HOG} {_UNSIGNED.format(0, 9)}")
def hog13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir, "hog13")


@query(f"""WITH {GRADIENT}, {VOTES}, raw AS (SELECT doc_id, cy AS r, cx AS c, o, sum(v) AS v FROM low GROUP BY ALL)
    SELECT doc_id, (r - 1)::INTEGER AS r, (c - 1)::INTEGER AS c, o::INTEGER AS d, round(coalesce(v, 0), 6) AS v
    FROM (SELECT DISTINCT doc_id FROM pix) CROSS JOIN range(1, 6) a(r) CROSS JOIN range(1, 6) b(c) CROSS JOIN range(0, 18) e(o) LEFT JOIN raw USING (doc_id, r, c, o)""")
def hog_raw18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir, "raw18")


_SMALL = features.half_up(fixtures.IMAGE * 0.45)


@query(f"""WITH {PIXELS}, t AS (SELECT i::INTEGER AS i, p::INTEGER AS p, least((i + 1) * 80 / {_SMALL}::DOUBLE, p + 1) - greatest(i * 80 / {_SMALL}::DOUBLE, p) AS s FROM range(0, {_SMALL}) a(i), range(0, 80) b(p)),
    w AS (SELECT i, p, s * {_SMALL} / 80::DOUBLE AS s FROM t WHERE s > 0.001)
    SELECT doc_id, a.i AS y, b.i AS x, round(sum(v * a.s * b.s), 6) AS v FROM pix JOIN w a ON a.p = y JOIN w b ON b.p = x GROUP BY doc_id, a.i, b.i""")
def image_resize_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(doc, im):
        small = features.shrink(im, 0.45)
        y, x = np.divmod(np.arange(small.size), small.shape[1])
        return pd.DataFrame({"doc_id": doc, "y": y, "x": x, "v": small.ravel()})

    return _per_page(fixtures.images(spark, sf_dir), f, "doc_id long, y int, x int, v double").select("doc_id", "y", "x", *rounded("v"))


@query(f"WITH {PIXELS}, l AS (SELECT i, 2.0::DOUBLE ** (-i / 10.0::DOUBLE) AS s FROM range(0, 200) t(i)) SELECT doc_id, i::INTEGER AS level, round(s, 6) AS scale, floor(80 * s + 0.5)::INTEGER AS h, floor(80 * s + 0.5)::INTEGER AS w FROM (SELECT DISTINCT doc_id FROM pix) CROSS JOIN l WHERE s >= 0.01 AND floor(80 * s + 0.5) > 5")
def feature_pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(doc, im):
        s = features.pyramid_scales(*im.shape)
        return pd.DataFrame({"doc_id": doc, "level": range(len(s)), "scale": s, "h": [features.half_up(im.shape[0] * a) for a in s], "w": [features.half_up(im.shape[1] * a) for a in s]})

    return _per_page(fixtures.images(spark, sf_dir), f, "doc_id long, level int, scale double, h int, w int").select("doc_id", "level", *rounded("scale"), "h", "w")


@query()
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all cells of the pages, by axes and a codebook fitted on them."""
    made = retrieval.index(fixtures.images(spark, sf_dir), Params(n_codes=16, pca_dim=8), redo=1, rounds=5)
    return made.coded.select("doc_id", "r", "c", "code")


#: A window in the middle of each page, whose positives are never cut; few of them and few negatives, for SQL's sake.
WINDOW = {"x1": 29, "x2": 52, "y1": 29, "y2": 52}
FEW = Params(shifts=(-4, 0, 4), epochs=2, eta0=0.1, lambda_=1e-2)
NEGATIVES = 4
_PARTS = "SELECT doc_id, r, c, d, v FROM sig UNION ALL SELECT doc_id, r, c, d + 18, v FROM uns UNION ALL SELECT doc_id, r, c, d + 27, v FROM tex"
_SHIFTS = "sh AS (SELECT dx, dy, row_number() OVER (ORDER BY dx, dy) - 1 AS s FROM (SELECT unnest([-4, 0, 4]) AS dx), (SELECT unnest([-4, 0, 4]) AS dy))"
_MOVED = PIXELS.replace("pix AS MATERIALIZED", "page AS MATERIALIZED") + f", {_SHIFTS}, pix AS MATERIALIZED (SELECT doc_id * 100 + s AS doc_id, (y - 16 - dy)::INTEGER AS y, (x - 16 - dx)::INTEGER AS x, v FROM page, sh WHERE y - 16 - dy BETWEEN 0 AND 47 AND x - 16 - dx BETWEEN 0 AND 47)"
_POSITIVES = f"SELECT doc_id // 100 AS query_id, dx::BIGINT AS dx, dy::BIGINT AS dy, j, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM (SELECT doc_id, (r * 2 + c) * 31 + d AS j, v FROM ({_PARTS})) JOIN sh ON s = doc_id % 100"


def _window(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("doc_id").alias("query_id"), "doc_id", *[F.lit(v).alias(k) for k, v in WINDOW.items()])


@query(f"WITH {sql_hog(_MOVED, 48)} SELECT query_id, dx::INTEGER AS dx, dy::INTEGER AS dy, j::INTEGER AS j, round(v, 6) AS v FROM ({_POSITIVES})")
def positive_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of a window on every page at all shifts."""
    pages = fixtures.images(spark, sf_dir)
    found = retrieval.positive_samples(geometry.query_window(_window(pages), PARAMS.sbin), pages, FEW)
    return found.select("query_id", "dx", "dy", F.posexplode("x").alias("j", "v")).select("query_id", "dx", "dy", "j", *rounded("v"))


_CROPPED = PIXELS.replace("pix AS MATERIALIZED", "page AS MATERIALIZED") + ", pix AS MATERIALIZED (SELECT doc_id, (y - 4)::INTEGER AS y, (x - 4)::INTEGER AS x, v FROM page WHERE y BETWEEN 4 AND 75 AND x BETWEEN 4 AND 75)"


def sql_exemplars() -> str:
    s = FEW
    positives = f"pos_x AS MATERIALIZED (WITH {sql_hog(_MOVED, 48)} SELECT query_id, 1 AS sense, {_mix('query_id', '(dx + 1000)', '(dy + 1000)', '3')} AS place, dx AS a, dy AS b, list(v ORDER BY j) AS x FROM ({_POSITIVES}) GROUP BY query_id, dx, dy)"
    cell = f"cell AS MATERIALIZED (WITH {sql_hog(_CROPPED, 72)} SELECT doc_id, r, c, list(v ORDER BY d) AS x FROM ({_PARTS}) GROUP BY doc_id, r, c)"
    start = lambda salt: f"floor(({_mix('q.doc_id', 'p.doc_id', 'n', str(salt))}) + 0.5)::INTEGER"
    windows_ = f"win AS (SELECT q.doc_id AS query_id, p.doc_id, n, {start(1)} AS r, {start(2)} AS c FROM (SELECT DISTINCT doc_id FROM cell) q, (SELECT DISTINCT doc_id FROM cell) p, range(0, {NEGATIVES}) t(n))"
    negatives = f"neg AS (SELECT query_id, w.doc_id, n, flatten(list(x ORDER BY i, j)) AS x FROM win w, range(0, 2) a(i), range(0, 2) b(j) JOIN cell k ON k.doc_id = w.doc_id AND k.r = w.r + i AND k.c = w.c + j GROUP BY query_id, w.doc_id, n)"
    both = f"both_x AS (SELECT * FROM pos_x UNION ALL SELECT query_id, -1, {_mix('query_id', 'doc_id', 'n', '4')}, doc_id, n, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) FROM neg)"
    return f"""WITH RECURSIVE {positives}, {cell}, {windows_}, {negatives}, {both},
        o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, sense, a, b) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM both_x),
        f AS (SELECT query_id, any_value(n) AS n, 0::BIGINT AS t, list_transform(range(0, 124), lambda i: 0::DOUBLE) AS w, 0::DOUBLE AS b FROM o GROUP BY query_id
            UNION ALL
            SELECT query_id, n, t + 1, list_transform(range(1, 125), lambda i: w[i] * (1 - eta * {s.lambda_}::DOUBLE) + step * x[i]), b + step
            FROM (SELECT *, CASE WHEN sense * (list_dot_product(w, x) + b) < 1 THEN eta * sense ELSE 0 END AS step
                FROM (SELECT f.*, o.x, o.sense, {s.eta0}::DOUBLE / (1 + {s.lambda_}::DOUBLE * {s.eta0}::DOUBLE * t) AS eta FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.t % f.n WHERE t < {s.epochs} * f.n)))
        SELECT query_id, (j // 62)::INTEGER AS dr, (j // 31 % 2)::INTEGER AS dc, (j % 31)::INTEGER AS d, round(w[j + 1], 6) AS w FROM f, range(0, 124) t(j) WHERE f.t = {s.epochs} * n"""


@query(sql_exemplars())
def exemplar_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates learned from a window at its shifts against random windows of all pages, on plain descriptors."""
    pages = fixtures.images(spark, sf_dir)
    cells = features.describe(retrieval.crop_to_cells(pages, PARAMS.sbin), PARAMS.sbin)
    learned = retrieval.learn_exemplars(_window(pages), pages, cells, FEW, per_page=NEGATIVES)
    return learned.select("query_id", "dr", "dc", F.posexplode("w").alias("d", "w")).select("query_id", "dr", "dc", "d", *rounded("w"))


def _image_truth(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """The window's place on all pages whose cell at its first corner has the label of the query's."""
    label = fixtures.cells(spark, sf_dir).where("r = 2 AND c = 2").select("doc_id", "label").join(pages.select("doc_id"), "doc_id")
    box = geometry.query_window(_window(pages), PARAMS.sbin).select("doc_id", "x1", "x2", "y1", "y2")
    mine = label.select(F.col("doc_id").alias("query_id"), "label")
    return mine.join(label, "label").join(box, "doc_id").select("query_id", "doc_id", F.col("doc_id").alias("gt_id"), "x1", "x2", "y1", "y2")


@query()
def image_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From page images to average precision: 121 positives and 7,744 negatives a query, axes, codebook, scores, suppression."""
    pages = fixtures.images(spark, sf_dir)
    got = retrieval.retrieve(_window(pages), _image_truth(spark, sf_dir, pages), pages, Params(n_codes=64), redo=1, rounds=10)
    return got.select("query_id", "n_relevant", *rounded("ap", "recall"))


@query()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's settings by the mean average precision of the retrieval that they give; the best one is marked."""
    pages = fixtures.images(spark, sf_dir)
    got = retrieval.retrieve(_window(pages), _image_truth(spark, sf_dir, pages), pages, Params(n_codes=16, pca_dim=8, shifts=(-4, 0, 4)), grid=tuning.grid(GRID), redo=1, rounds=5)
    return retrieval.best_point(got).select("point", *rounded("mean_ap"), "best")


# ---------------------------------------------------------------- sparse data and files


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sparse.entries(fixtures.vectors(spark, sf_dir), "vec_id", "embedding")
    return e.where(F.abs("v") >= 0.1)


_SPARSE = "s AS (SELECT * FROM (SELECT vec_id AS i, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) WHERE abs(v) >= 0.1)"


@query(f"WITH {_SPARSE} SELECT e.vec_id AS a, e.vec_id + 1 AS b, round(coalesce(sum(x.v * y.v), 0), 6) AS dot FROM embeddings e LEFT JOIN s x ON x.i = e.vec_id LEFT JOIN s y ON y.i = e.vec_id + 1 AND y.j = x.j GROUP BY e.vec_id")
def sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector, small components left out, with the next one."""
    s = _sparse(spark, sf_dir)
    pairs = fixtures.vectors(spark, sf_dir).select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return sparse.dots(s, s, pairs).select("a", "b", *rounded("dot"))


@query(f"WITH {_SPARSE}, n AS (SELECT i, sum(v * v) AS n2 FROM s GROUP BY i), e AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM s UNION ALL SELECT i - 1, j, 0.5 * v FROM s) GROUP BY i, j) SELECT i, round(any_value(n2), 6) AS n2, count(*) AS n, round(sum(v * (j + 1)), 6) AS moment FROM e JOIN n USING (i) WHERE v <> 0 GROUP BY i")
def sparse_axpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector, small components left out, plus half the next one: its entries and their first moment, with its squared norm."""
    s = _sparse(spark, sf_dir)
    nxt = s.select((F.col("i") - 1).alias("i"), "j", "v")
    half = nxt.select("i").distinct().withColumn("a", F.lit(0.5))
    e = sparse.axpy(s, half, nxt).join(sparse.norms2(s), "i")
    return e.groupBy("i").agg(F.round(F.first("n2"), 6).alias("n2"), F.count("*").alias("n"), F.round(F.sum(F.col("v") * (F.col("j") + 1)), 6).alias("moment"))


@query(f"WITH {V_ALL}, {MEANS} SELECT vec_id AS i, k, round(list_dot_product(x, centroid), 6) AS v FROM (SELECT vec_id, x, unnest([label, (label + 3) % 10])::INTEGER AS k FROM v WHERE label IS NOT NULL) JOIN book ON code = k")
def sparse_subset_matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.vectors(spark, sf_dir).where("label IS NOT NULL")
    at = v.select(F.col("vec_id").alias("i"), F.explode(F.array(F.col("label"), (F.col("label") + 3) % 10)).alias("k"))
    w = fixtures.codebook(spark, fixtures.label_means(spark, sf_dir)).select(F.col("code").alias("k"), F.col("centroid").alias("w"))
    return sparse.matmul_at(v.select(F.col("vec_id").alias("i"), F.col("embedding").alias("x")), w, at).select("i", "k", *rounded("v"))


@query(f"WITH {V_ALL} SELECT a.vec_id // 16 AS block, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.x, b.x), 6) AS v FROM v a JOIN v b ON a.vec_id // 16 = b.vec_id // 16 AND a.vec_id <= b.vec_id")
def block_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fixtures.vectors(spark, sf_dir).select(F.expr("vec_id div 16").alias("block"), F.col("vec_id").alias("i"), F.col("embedding").alias("x"))
    return sparse.gram(x, "block").select("block", "a", "b", *rounded("v"))


@query("SELECT label, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM embeddings GROUP BY label")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse.inverted_index(fixtures.vectors(spark, sf_dir), "label", "vec_id")
    return found.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("SELECT label, n, (sum(n) OVER (ORDER BY label) - n)::BIGINT AS begins FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.prefix_offsets(fixtures.vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")), "label", "n")


@query("SELECT k::INTEGER AS k, round(sum(1 / (1 + k)) OVER (ORDER BY k), 6) AS weight FROM range(0, 10) t(k)")
def harmonic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.range(10).select(F.col("id").cast("int").alias("k"))
    return k.select("k", F.round(F.sum(1 / (1 + F.col("k"))).over(W.orderBy("k")), 6).alias("weight"))


def _folder(spark: SparkSession) -> str:
    """Where executors and driver both read."""
    return f"{shared.folder(spark).removeprefix('file://')}/files-{uuid.uuid4().hex}"


@query("SELECT dense_rank() OVER (ORDER BY vec_id) AS idx, j, v FROM (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j, round(unnest(embedding)::DOUBLE, 6) AS v FROM embeddings)")
def vecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written to files in id order and read back."""
    vecs.write_ordered(fixtures.vectors(spark, sf_dir), folder := _folder(spark), "vec_id", "embedding")
    back = vecs.read(spark, f"file://{folder}", kind="fvecs")
    return back.select("idx", F.posexplode("v").alias("j", "v")).select("idx", "j", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("SELECT label::DOUBLE AS label, j, v, count(*) AS n FROM (SELECT label, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j, round(format('{:.10g}', unnest(embedding)::DOUBLE)::DOUBLE, 6) AS v FROM embeddings) GROUP BY ALL")
def svmlight_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    text.svmlight_lines(fixtures.vectors(spark, sf_dir), "label", "embedding").write.text(f"file://{folder}")
    back = text.svmlight(spark, f"file://{folder}", 64)
    # what is read back has ten digits, so that many a value is a tie of decimals: as SQL rounds, on the double that six places make
    rows = back.select("label", F.posexplode("x").alias("j", "v")).select("label", "j", (F.round(F.col("v") * 1e6) / 1e6).alias("v"))
    return rows.groupBy("label", "j", "v").agg(F.count("*").alias("n"))


def sql_toy(per_class: int = 200, spread: float = 0.05, seed: int = 1) -> str:
    u = lambda i, j, e: drawn_by.uniform_sql(i, j, str(e), seed)
    noise = f"sqrt(-2 * ln({u('i', 'j', 1)})) * cos(2 * pi() * {u('i', 'j', 2)})"
    half = f"row_number() OVER (ORDER BY {drawn_by.key_sql('i', '0', '3', seed)}, i) % 2"
    return f"""SELECT i AS idx, (i // {per_class})::INTEGER AS label, j::INTEGER AS j, round({u(f'(i // {per_class})', 'j', 0)} + {spread}::DOUBLE * {noise}, 6) AS x, split
        FROM (SELECT i, CASE WHEN {half} = 0 THEN 'test' ELSE 'train' END AS split FROM range(0, {5 * per_class}) a(i)), range(0, 2) b(j)"""


@query(sql_toy())
def toy_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    toy = generators.toy_mixture(spark)
    return toy.select("idx", "label", "split", F.posexplode("x").alias("j", "x")).select("idx", "label", "j", *rounded("x"), "split")

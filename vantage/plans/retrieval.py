"""Query by example, from cells to mean average precision."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vantage.functions import geometry, vectors
from vantage.model import Params
from vantage.operators import detections, features, lockstep, quantize, samples, sgd, windows
from vantage.operators import pages as paged
from vantage.shared import cut


def boxes(scored: DataFrame, sbin: int) -> DataFrame:
    """Scored windows with pixel boxes, on pages without a crop margin."""
    one = F.lit(1)
    return scored.select("*", *geometry.window_box(F.col("r"), F.col("c"), one, one, F.col("th") * sbin, F.col("tw") * sbin, sbin))


def boxes_on(scored: DataFrame, origins: DataFrame, sbin: int) -> DataFrame:
    """Scored windows with pixel boxes on pages (doc_id, x_ini, y_ini) cropped to whole cells. A window has a cell of context on each
    side of those that are scored."""
    box = geometry.window_box(F.col("r"), F.col("c"), F.col("x_ini"), F.col("y_ini"), (F.col("th") + 2) * sbin, (F.col("tw") + 2) * sbin, sbin)
    return scored.join(origins.select("doc_id", "x_ini", "y_ini"), "doc_id").select(*scored.columns, *box)


def detect(scored: DataFrame, truth: DataFrame, params: Params) -> DataFrame:
    """Ranked detections from scored windows and true boxes (query_id, doc_id, gt_id, x1, x2, y1, y2)."""
    return rank(boxes(scored, params.sbin), truth, params)


def detect_on(cells: DataFrame, template: DataFrame, truth: DataFrame, params: Params) -> DataFrame:
    """As detect, of templates (query_id, dr, dc, w, th, tw) over pages of cells, where they lie: only detections are moved."""
    found = paged.detections(cells, template, truth, params.sbin, params.windows_per_page, params.nms_overlap, params.hit_overlap)
    return detections.ranked(boxes(found, params.sbin))


def rank(placed: DataFrame, truth: DataFrame, params: Params) -> DataFrame:
    """Ranked detections from scored windows with their boxes."""
    picked = detections.nms(windows.top_windows(placed, params.windows_per_page), params.nms_overlap)
    return detections.ranked(detections.first_hits(picked, truth, params.hit_overlap))


@dataclass(frozen=True)
class Index:
    """Coded cells (doc_id, r, c, code) of all pages, with what coded them."""

    coded: DataFrame
    pca: quantize.Pca
    codebook: np.ndarray


def sampled_cells(cells: DataFrame, per_page: int, seed: int) -> DataFrame:
    """per_page cells of each page, the first in a seeded hash order. A window per page; pages are bounded by their pixels."""
    order = W.partitionBy("doc_id").orderBy(F.xxhash64("doc_id", "r", "c", F.lit(seed)), "r", "c")
    return cells.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_page).drop("place")


def index(pages: DataFrame, params: Params, kind: str = "hog31", seed: int = 0, redo: int = 3, rounds: int = 100) -> Index:
    """Describe pages (doc_id, h, w, pixels), cropped to whole cells; fit the axes and the codebook on sampled cells; code all."""
    cropped = crop_to_cells(pages, params.sbin)
    cells = cut(features.describe(cropped, params.sbin, kind))  # read by both fits and by the coding
    per_page = max(1, params.pca_cells // max(1, pages.count()))
    pca = quantize.fit_pca(sampled_cells(cells, per_page, seed), "feat")
    low = quantize.project(cells, "feat", pca, params.pca_dim)
    sample = cut(sampled_cells(low, per_page, seed + 1).withColumn("i", F.xxhash64("doc_id", "r", "c")))  # read each round
    book, _, _ = quantize.kmeans(sample, "feat", "i", params.n_codes, rounds, redo, seed)
    return Index(quantize.assign(low, "feat", book).drop("feat"), pca, book)


def crop_to_cells(pages: DataFrame, sbin: int) -> DataFrame:
    """pages with their centred crops to a multiple of sbin in place of h, w and pixels, and the crops' origins x_ini, y_ini."""
    sized = geometry.page_crop(pages, sbin)

    def run(batches):
        for batch in batches:
            inner = [np.frombuffer(p.pixels, np.uint8).reshape(p.h, p.w)[p.y_ini - 1 : p.y_ini - 1 + p.crop_h, p.x_ini - 1 : p.x_ini - 1 + p.crop_w] for p in batch.itertuples()]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "h": batch["crop_h"], "w": batch["crop_w"], "x_ini": batch["x_ini"], "y_ini": batch["y_ini"], "pixels": [c.tobytes() for c in inner]})

    return sized.mapInPandas(run, "doc_id long, h int, w int, x_ini int, y_ini int, pixels binary")


def positive_samples(queries: DataFrame, pages: DataFrame, params: Params, pca: quantize.Pca | None = None, kind: str = "hog31") -> DataFrame:
    """(query_id, dx, dy, x): descriptors of the exemplar's window at every pair of shifts, normalised. queries: query_id, doc_id, x1,
    x2, y1, y2, the window; a window that the page cuts is resized to its full size."""
    sized = queries.select("query_id", "doc_id", "x1", "x2", "y1", "y2").join(pages, "doc_id").withColumn("new_h", F.col("y2") - F.col("y1") + 1).withColumn("new_w", F.col("x2") - F.col("x1") + 1)
    reach = max(map(abs, params.shifts), default=0)

    def around(batches):
        for batch in batches:
            tops = np.clip(batch["y1"] - 1 - reach, 0, batch["h"]), np.clip(batch["x1"] - 1 - reach, 0, batch["w"])
            near = [np.frombuffer(p.pixels, np.uint8).reshape(p.h, p.w)[y : max(0, p.y2 + reach), x : max(0, p.x2 + reach)] for p, y, x in zip(batch.itertuples(), *tops, strict=True)]
            yield batch.drop(columns="pixels").assign(oy=tops[0], ox=tops[1], nh=[n.shape[0] for n in near], nw=[n.shape[1] for n in near], near=[n.tobytes() for n in near])

    columns = [c for c in ("query_id", "x1", "x2", "y1", "y2", "new_h", "new_w", "h", "w")]
    kinds = dict(sized.dtypes)
    # only what the shifts can reach of a page is copied for each of them
    cropped = sized.select(*columns, "pixels").mapInPandas(around, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", oy int, ox int, nh int, nw int, near binary")
    moved = samples.positive_shifts(cropped, params.shifts, F.col("w"), F.col("h"))

    def run(batches):
        for batch in batches:
            out = []
            for p in batch.itertuples():
                im = np.frombuffer(p.near, np.uint8).reshape(p.nh, p.nw)[p.y1 - 1 - p.oy : p.y2 - p.oy, p.x1 - 1 - p.ox : p.x2 - p.ox]
                d = features.hog(features.bicubic(im, p.new_h, p.new_w) if p.resized else im, params.sbin, kind)
                x = d.reshape(-1, d.shape[2])
                x = ((x - pca.mean) @ pca.axes[:, : params.pca_dim] if pca else x).ravel()
                out.append(x / max(np.sqrt(x @ x), 1e-300))
            yield batch[["query_id", "dx", "dy"]].assign(x=out)

    return moved.mapInPandas(run, "query_id long, dx int, dy int, x array<double>")


def negative_samples(windows_: DataFrame, cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """(query_id, doc_id, n, x): descriptors of windows (query_id, doc_id, n, r, c), put together of cells (doc_id, r, c, feat) and
    normalised. shapes: (query_id, bh, bw)."""
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    places = windows_.join(shapes, "query_id").withColumn("dr", span("bh")).withColumn("dc", span("bw"))
    places = places.select("query_id", "n", "doc_id", "dr", "dc", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    own = places.join(cells, ["doc_id", "r", "c"]).groupBy("query_id", "doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("dr", "dc", "feat"))).alias("s"))  # a window's cells
    return own.select("query_id", "doc_id", "n", vectors.normalize(F.flatten(F.transform("s", lambda s: s.feat))).alias("x"))


def learn_exemplars(queries: DataFrame, pages: DataFrame, cells: DataFrame, params: Params, pca: quantize.Pca | None = None, kind: str = "hog31", per_page: int | None = None, grid: list[dict] | None = None) -> DataFrame:
    """(query_id, point, dr, dc, w, th, tw): for each query a template learned from its window at all shifts against random windows
    of all pages. queries: query_id, doc_id, x1, x2, y1, y2; pages: doc_id, h, w, pixels; cells: doc_id, r, c, feat of the cropped
    pages. grid: settings to learn with, one template for each (point: its place); else those of params. per_page: negatives of a
    page; else as many as params asks for. A task trains a query on its own sample, whose size the parameters fix.
    """
    asked = cut(geometry.query_window(queries, params.sbin))
    places = geometry.page_crop(pages.select("doc_id", "h", "w"), params.sbin).select("doc_id", "bh", "bw")
    if per_page is None:
        n = places.count()
        per_page = params.negatives(n) // max(1, n)
    base = sgd.Settings(lambda_=params.lambda_, eta0=params.eta0, epochs=params.epochs, bias_term=params.bias_term, beta=1)
    points = [replace(base, **g) for g in grid or [{}]]
    positives = positive_samples(asked, pages, params, pca, kind)
    if len({p.epochs for p in points}) == 1 and (held := held_cells(cells, places)) is not None:
        shifted = positives.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("dx", "dy", "x"))).alias("s"))
        shifted = shifted.select("query_id", F.transform("s", lambda s: F.concat(F.array(s.dx, s.dy).cast("array<double>"), s.x)).alias("own"))
        shifted = cut(shifted.join(asked.select("query_id", F.col("bh").alias("th"), F.col("bw").alias("tw")), "query_id"))

        def sample(row, docs: np.ndarray, n: np.ndarray):
            own = np.array([np.asarray(v, np.float64) for v in row.own])
            (dx, dy), q = own[:, :2].T.astype(np.int64), row.query_id
            drawn = np.append(lockstep.draw(q, dx + 1000, dy + 1000, 3), lockstep.draw(q, docs, n, 4))
            return own[:, 2:], (np.append(dy, n), np.append(dx, docs), np.repeat([1, -1], [len(own), len(n)]), drawn)

        return learn_held(shifted, held, points, per_page, sample)
    drawn = samples.negative_windows(asked.select("query_id", "bh", "bw"), places, per_page)
    negatives = negative_samples(drawn, cells, asked.select("query_id", "bh", "bw"))
    place = lambda a, b, salt: samples.draw(F.col("query_id"), a, b, F.lit(salt))
    both = positives.select("query_id", F.lit(1).alias("sense"), place(F.col("dx") + 1000, F.col("dy") + 1000, 3).alias("place"), F.col("dx").cast("long").alias("a"), F.col("dy").cast("long").alias("b"), "x")
    both = both.unionByName(negatives.select("query_id", F.lit(-1).alias("sense"), place(F.col("doc_id"), F.col("n"), 4).alias("place"), F.col("doc_id").alias("a"), F.col("n").cast("long").alias("b"), "x"))
    both = both.join(asked.select("query_id", F.col("bh").alias("th"), F.col("bw").alias("tw")), "query_id")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "sense", "a", "b"], kind="stable")
        x, sense = np.array(rows["x"].tolist(), np.float64), rows["sense"].to_numpy()
        q, th, tw = (int(rows[c].iloc[0]) for c in ("query_id", "th", "tw"))
        at, out = np.arange(th * tw), []
        for point, s in enumerate(points):
            model = sgd.Hinge(np.zeros(x.shape[1]))
            for _ in range(s.epochs):
                for i in range(0, len(x), sgd.BLOCK):
                    model.block(x[i : i + sgd.BLOCK], sense[i : i + sgd.BLOCK], s)
            out.append(pd.DataFrame({"query_id": q, "point": point, "dr": at // tw, "dc": at % tw, "w": list(model.w.reshape(th * tw, -1)), "th": th, "tw": tw}))
        return pd.concat(out)

    return both.groupBy("query_id").applyInPandas(fit, "query_id long, point int, dr int, dc int, w array<double>, th int, tw int")


def retrieve(queries: DataFrame, truth: DataFrame, pages: DataFrame, params: Params, kind: str = "hog31", grid: list[dict] | None = None, redo: int = 3, rounds: int = 100) -> DataFrame:
    """(query_id, point, n_relevant, ap, recall): the whole chain from page images. Pages are described, projected and coded; each
    query's template is learned; windows of all pages are scored in the code domain, suppressed, matched with truth (query_id,
    doc_id, gt_id, x1, x2, y1, y2) and ranked. With a grid, for each of its settings."""
    made = index(pages, params, kind, redo=redo, rounds=rounds)
    coded = cut(made.coded)
    spark = pages.sparkSession
    book = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(made.codebook)], "code int, centroid array<double>")
    cells = coded.join(F.broadcast(book), "code").select("doc_id", "r", "c", F.col("centroid").alias("feat"))  # a row per code
    template = cut(learn_exemplars(queries, pages, cells, params, made.pca, kind, grid=grid))
    n = len(grid or [{}])
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point")
    key = (F.col("query_id") * n + F.col("point")).alias("query_id")
    origins = geometry.page_crop(pages.select("doc_id", "h", "w"), params.sbin)
    known = truth.select("*", each).select(key, *[c for c in truth.columns if c != "query_id"])
    # a cell is its centroid, so scores are those of the code domain
    found = paged.detections(cells, template.select(key, "dr", "dc", "w", "th", "tw"), known, params.sbin, params.windows_per_page, params.nms_overlap, params.hit_overlap, 1, origins)
    found = detections.ranked(found)
    relevant = queries.select("query_id", each).select(key).join(known.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_relevant"))
    ap = detections.average_precision(found, relevant)
    return ap.select(F.expr(f"query_id div {n}").alias("query_id"), (F.col("query_id") % n).cast("int").alias("point"), "n_relevant", "ap", "recall")


def best_point(results: DataFrame) -> DataFrame:
    """(point, mean_ap, best) of a grid's results: the best is the highest mean, of equal ones the first."""
    mean = results.groupBy("point").agg(F.avg("ap").alias("mean_ap"))
    best = mean.agg(F.max_by("point", F.struct("mean_ap", -F.col("point"))).alias("__best"))
    return mean.join(F.broadcast(best)).select("point", "mean_ap", (F.col("point") == F.col("__best")).alias("best"))  # one row


def unlearned(positives: DataFrame) -> DataFrame:
    """(query_id, x): the middle one of each query's positives, by dx and dy, as its template."""
    order = W.partitionBy("query_id").orderBy("dx", "dy")
    half = F.floor(F.count("*").over(W.partitionBy("query_id")) / 2)
    return positives.withColumn("at", F.row_number().over(order)).withColumn("half", F.greatest(half, F.lit(1))).where("at = half").select("query_id", "x")


def learn(template: DataFrame, cells: DataFrame, params: Params, negatives: DataFrame) -> DataFrame:
    """(query_id, dr, dc, w, th, tw): templates learned from the exemplar's own window against the negatives (query_id, doc_id, n,
    r, c), all normalised, in a drawn order; for cells without pixels, which cannot be shifted (learn_exemplars is for images). A
    task trains a query on its own sample, whose size the parameters fix."""
    own = template.select("query_id", F.lit(-1).cast("long").alias("n"), "dr", "dc", "th", "tw", F.col("w").alias("x"))
    shape = template.groupBy("query_id").agg(F.first("th").alias("th"), F.first("tw").alias("tw"))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    places = negatives.join(shape, "query_id").withColumn("dr", span("th")).withColumn("dc", span("tw"))
    places = places.select("query_id", "n", "doc_id", "dr", "dc", "th", "tw", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    other = places.join(cells, ["doc_id", "r", "c"]).select("query_id", (F.col("n") + F.col("doc_id") * 1_000_003).alias("n"), "dr", "dc", "th", "tw", F.col("feat").cast("array<double>").alias("x"))
    both = own.unionByName(other).withColumn("place", samples.draw(F.col("query_id"), F.col("n") + 1, F.lit(7)))
    s = sgd.Settings(lambda_=params.lambda_, eta0=params.eta0, epochs=params.epochs, bias_term=params.bias_term, beta=1)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "n", "dr", "dc"], kind="stable")
        th, tw, q = int(rows["th"].iloc[0]), int(rows["tw"].iloc[0]), int(rows["query_id"].iloc[0])
        size = rows.groupby("n").size()
        rows = rows[rows["n"].isin(size[size == th * tw].index)]
        n = rows["n"].to_numpy()[:: th * tw]
        x = np.array(rows["x"].tolist(), np.float64).reshape(len(n), -1)
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        model, sense = sgd.Hinge(np.zeros(x.shape[1])), np.where(n < 0, 1, -1)
        for _ in range(s.epochs):
            for i in range(0, len(x), sgd.BLOCK):
                model.block(x[i : i + sgd.BLOCK], sense[i : i + sgd.BLOCK], s)
        at = np.arange(th * tw)
        return pd.DataFrame({"query_id": q, "dr": at // tw, "dc": at % tw, "w": list(model.w.reshape(th * tw, -1)), "th": th, "tw": tw})

    return both.groupBy("query_id").applyInPandas(fit, "query_id long, dr int, dc int, w array<double>, th int, tw int")


def held_cells(cells: DataFrame, pages: DataFrame):
    """The cells and pages (doc_id, bh, bw), broadcast as arrays, if the cells, counted, are few enough; else None."""
    n, d, missing = cells.agg(F.count("*"), F.max(F.size("feat")), F.count_if(F.col("feat").isNull())).first()
    if not n or missing or 8 * n * d > lockstep.CELL_BYTES:
        return None
    got, sized = cells.select("doc_id", "r", "c", "feat").toArrow(), pages.select("doc_id", "bh", "bw").toArrow()
    x = np.asarray(got.column("feat").combine_chunks().flatten()).reshape(n, -1)
    return cells.sparkSession.sparkContext.broadcast((*(got.column(k).to_numpy() for k in ("doc_id", "r", "c")), x, *(sized.column(k).to_numpy() for k in ("doc_id", "bh", "bw"))))


def learn_held(asked: DataFrame, held, points: list[sgd.Settings], per_page: int, sample: Callable) -> DataFrame:
    """(query_id, point, dr, dc, w, th, tw) of queries (query_id, th, tw, own), trained in blocks against per_page random windows of
    all pages of held cells. sample(query, its row, (pages, numbers) of its windows): its own vectors, and order keys."""
    spark = asked.sparkSession
    together = max(1, lockstep.SAMPLES // max(1, len(held.value[4]) * per_page))
    blocks = max(1, -(-asked.count() // together), spark.sparkContext.defaultParallelism)

    def run(batches):
        rows = [row for batch in batches for row in batch.itertuples()]
        if not rows:
            return
        doc, r, c, x, docs, bh, bw = held.value
        grid = lockstep.Grid(doc, r, c)
        for th, tw in sorted({(row.th, row.tw) for row in rows}):
            alike = [row for row in rows if (row.th, row.tw) == (th, tw)]
            for a in range(0, len(alike), together):
                own, index, sense = [], [], []
                for row in alike[a : a + together]:
                    at, n, y, z = lockstep.starts(row.query_id, docs, per_page, bh - th, bw - tw)
                    found, whole = grid.windows(docs[at], y, z, th, tw)
                    vectors_, keys = sample(row, docs[at][whole], n[whole])
                    found = np.vstack([np.tile(-1 - np.arange(len(vectors_))[:, None], th * tw), found[whole]])
                    order = np.lexsort(keys)
                    own.append(vectors_)
                    index.append(found[order])
                    sense.append(np.where(found[:, 0] < 0, 1, -1)[order])
                learned = lockstep.train(x, index, own, sense, points)
                place = np.arange(th * tw)
                for k, row in enumerate(alike[a : a + together]):
                    for point in range(len(points)):
                        yield pd.DataFrame({"query_id": row.query_id, "point": point, "dr": place // tw, "dc": place % tw, "w": list(learned[point, k].reshape(th * tw, -1)), "th": th, "tw": tw})

    # dealt out evenly, a block a task, however few bytes a query has
    return asked.select("query_id", "th", "tw", "own").repartition(blocks).mapInPandas(run, "query_id long, point int, dr int, dc int, w array<double>, th int, tw int")


def learn_drawn(template: DataFrame, cells: DataFrame, pages: DataFrame, params: Params, per_page: int) -> DataFrame:
    """As learn, against per_page random windows of all pages (doc_id, bh, bw). They are drawn and looked up in the task that trains
    a block of queries, if the cells, counted, are few enough to be there; else samples are shuffled."""
    held = held_cells(cells, pages)
    if held is None:
        shapes = template.groupBy("query_id").agg(F.first("th").alias("bh"), F.first("tw").alias("bw"))
        return learn(template, cells, params, samples.negative_windows(shapes, pages, per_page))
    own = template.groupBy("query_id").agg(F.first("th").alias("th"), F.first("tw").alias("tw"), F.array_sort(F.collect_list(F.struct("dr", "dc", "w"))).alias("s"))
    own = cut(own.select("query_id", "th", "tw", F.flatten(F.transform("s", lambda s: s.w)).alias("own")))
    s = sgd.Settings(lambda_=params.lambda_, eta0=params.eta0, epochs=params.epochs, bias_term=params.bias_term, beta=1)

    def sample(row, docs: np.ndarray, n: np.ndarray):
        number = np.append(-1, n + docs * 1_000_003)
        return np.array(row.own, np.float64).reshape(1, -1), (number, lockstep.draw(row.query_id, number + 1, 7))

    return learn_held(own, held, [s], per_page, sample).drop("point")

"""PCA, k-means, vector and product quantisation, mixtures and Fisher vectors.

Fitting passes over the rows once per round. Each task adds up its batches and gives one matrix of sums, of a size that the
model fixes; the shuffle adds these up place by place, so that the driver gets one matrix whatever the number of tasks.
Models (a mean, a d x d matrix, k centroids) are small by their parameters and go to the tasks with the kernels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions import vectors as V


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


@dataclass(frozen=True)
class Pca:
    mean: np.ndarray
    values: np.ndarray
    axes: np.ndarray  # one column per axis


def summed(df: DataFrame, v: str, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all batches of sums(vectors of a batch), a matrix; null if there are no vectors."""

    def partial(batches):
        total = None
        for batch in batches:
            if len(batch):
                own = sums(matrix(batch[v]))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "s": list(total)})

    rows = df.select(v).mapInPandas(partial, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "x"))
    got = rows.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()  # one row for each place of the matrix
    if not len(got):
        return None
    out = np.zeros((int(got["i"].max()) + 1, int(got["j"].max()) + 1))
    out[got["i"], got["j"]] = got["x"]
    return out


def moments(df: DataFrame, v: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (over n - 1) of the vectors, summed around one of them, so that little cancels."""
    first = df.select(v).limit(1).toPandas()
    if not len(first):
        raise ValueError("no vectors")
    origin = matrix(first[v])[0]

    def sums(x: np.ndarray) -> np.ndarray:
        x = x - origin
        one = np.column_stack([x, np.ones(len(x))])
        return one.T @ one

    total = summed(df, v, sums)
    n, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
    return int(n), origin + mean, (total[:-1, :-1] - n * np.outer(mean, mean)) / max(1, n - 1)


def fit_pca(df: DataFrame, v: str) -> Pca:
    """Axes by falling eigenvalue; each axis points where its largest component is positive."""
    _, mean, cov = moments(df, v)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Pca(mean, values[order], axes)


def project(df: DataFrame, v: str, model: Pca, dim: int) -> DataFrame:
    """df with v replaced by its first `dim` coordinates around the mean."""
    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == v else f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for batch in batches:
            yield batch.assign(**{v: list((matrix(batch[v]) - model.mean) @ model.axes[:, :dim])})

    return df.mapInPandas(run, fields)


def assign(df: DataFrame, v: str, centroids: np.ndarray, code: str = "code", distance: str | None = None) -> DataFrame:
    """df with the code (0-based) of its nearest centroid by squared L2, of equal ones the smallest, and the distance if named."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{code}` int", *([f"`{distance}` double"] if distance else [])])
    c2 = (centroids * centroids).sum(1)

    def run(batches):
        for batch in batches:
            x = matrix(batch[v])
            d = np.maximum(0, (x * x).sum(1)[:, None] + c2[None] - 2 * (x @ centroids.T)) if len(x) else np.empty((0, len(centroids)))
            out = batch.assign(**{code: d.argmin(1).astype(np.int32)})
            yield out.assign(**{distance: d.min(1)}) if distance else out

    return df.mapInPandas(run, fields)


def lloyd_step(df: DataFrame, v: str, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """New centroids, counts and the summed distance. A code without vectors keeps its centroid."""
    k, d = centroids.shape
    c2 = (centroids * centroids).sum(1)

    def sums(x: np.ndarray) -> np.ndarray:
        dist = np.maximum(0, (x * x).sum(1)[:, None] + c2[None] - 2 * (x @ centroids.T))
        code = dist.argmin(1)
        out = np.zeros((k, d + 2))
        np.add.at(out, code, np.column_stack([x, np.ones(len(x)), dist.min(1)]))
        return out

    total = summed(df, v, sums)
    if total is None:
        return centroids.copy(), np.zeros(k, np.int64), 0.0
    counts = total[:, d].astype(np.int64)
    out = np.where(counts[:, None] > 0, total[:, :d] / np.maximum(counts, 1)[:, None], centroids)
    return out, counts, float(total[:, d + 1].sum())


def first_vectors(df: DataFrame, v: str, vid: str, k: int, seed: int) -> np.ndarray:
    """k vectors in an order that a seed sets, by arithmetic on their ids that other SQL engines share."""
    place = F.pmod(F.pmod(F.col(vid).cast("long"), F.lit(1_000_003)) * (7919 + 2 * seed) + 131 * seed, F.lit(1_000_003))
    return matrix(df.select(v, vid).orderBy(place, vid).limit(k).toPandas()[v])


def kmeans(df: DataFrame, v: str, vid: str, k: int, rounds: int = 100, redo: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Centroids, counts and cost of the best of `redo` runs, each from k vectors that come first in a seeded order."""
    best = None
    for run in range(redo):
        c, last = first_vectors(df, v, vid, k, seed + run), None
        for _ in range(rounds):
            c2, counts, cost = lloyd_step(df, v, c)
            if last is not None and cost >= last * (1 - 1e-9):
                break
            c, last = c2, cost
        _, counts, cost = lloyd_step(df, v, c)
        if best is None or cost < best[2]:
            best = (c, counts, cost)
    return best


def pq_encode(df: DataFrame, v: str, books: list[np.ndarray], codes: str = "codes") -> DataFrame:
    """df with codes: the nearest sub-centroid of each equal piece of the vector."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{codes}` array<int>"])

    def run(batches):
        for batch in batches:
            x = matrix(batch[v])
            pieces = np.split(x, len(books), axis=1) if len(x) else [np.empty((0, b.shape[1])) for b in books]
            found = [np.maximum(0, (p * p).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (p @ b.T)).argmin(1) for p, b in zip(pieces, books, strict=True)]
            yield batch.assign(**{codes: list(np.column_stack(found).astype(np.int32))})

    return df.mapInPandas(run, fields)


def books_column(books: list[np.ndarray]) -> Column:
    """Sub-centroids as a literal array by piece and code; small by its parameters."""
    return F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in b]) for b in books])


def pq_decode(codes: Column, books: Column) -> Column:
    return F.flatten(F.transform(codes, lambda code, q: F.element_at(F.element_at(books, q + 1), code + 1)))


def pq_dot(codes: Column, tables: Column) -> Column:
    """Inner product in the code domain: tables holds w's inner products with each piece's sub-centroids."""
    return V.total(F.transform(codes, lambda code, q: F.element_at(F.element_at(tables, q + 1), code + 1)))


def pq_norm2(codes: Column, books: Column) -> Column:
    """Squared norm of a coded vector, from its pieces' sub-centroids."""
    return V.total(F.transform(codes, lambda code, q: V.sqnorm(F.element_at(F.element_at(books, q + 1), code + 1))))


def pq_axpy(y: Column, a: Column, codes: Column, books: Column) -> Column:
    """y + a x for a coded vector x."""
    return F.zip_with(V.doubles(y), pq_decode(codes, books), lambda u, x: u + a * x)


@dataclass(frozen=True)
class Gmm:
    w: np.ndarray
    mu: np.ndarray
    var: np.ndarray  # diagonal

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        log = np.log(self.w) - 0.5 * (np.log(2 * np.pi * self.var).sum(1) + (((x[:, None] - self.mu) ** 2) / self.var).sum(2))
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_gmm(df: DataFrame, v: str, vid: str, k: int, rounds: int = 10, floor: float = 1e-6, seed: int = 0) -> Gmm:
    """Diagonal mixture by EM, from k vectors in a seeded order and the overall variance."""
    n, _, cov = moments(df, v)
    start = first_vectors(df, v, vid, k, seed)
    d = start.shape[1]
    model = Gmm(np.full(len(start), 1 / len(start)), start, np.tile(np.maximum(np.diag(cov), floor), (len(start), 1)))
    for _ in range(rounds):

        def sums(x: np.ndarray, model=model) -> np.ndarray:
            p = model.posteriors(x)
            return np.hstack([p.sum(0)[:, None], p.T @ x, p.T @ (x * x)])

        total = summed(df, v, sums)
        s = np.maximum(total[:, :1], 1e-12)
        mu = total[:, 1 : d + 1] / s
        model = Gmm(total[:, 0] / n, mu, np.maximum(total[:, d + 1 :] / s - mu**2, floor))
    return model


def fisher(df: DataFrame, group: str, v: str, model: Gmm, weights: bool = False, mu: bool = True, sigma: bool = False, normalise: bool = True) -> DataFrame:
    """(group, fisher): gradients of a group's mean log-likelihood by weights, means and deviations, as asked, scaled by the
    inverse Fisher information. Batches give sums per group, so a large group is reduced before it is shuffled."""
    kk, d = model.mu.shape
    dev = np.sqrt(model.var)

    def partial(batches):
        for batch in batches:
            x = matrix(batch[v])
            p = model.posteriors(x)
            z = (x[:, None] - model.mu) / dev
            keys, inverse = np.unique(batch[group].to_numpy(), return_inverse=True)
            for i, key in enumerate(keys):
                rows = inverse == i
                g0, g1, g2 = p[rows].sum(0), np.einsum("nk,nkd->kd", p[rows], z[rows]), np.einsum("nk,nkd->kd", p[rows], z[rows] ** 2 - 1)
                yield pd.DataFrame({"g": [key], "s": [np.concatenate([[rows.sum()], g0, g1.ravel(), g2.ravel()]).tolist()]})

    kind = dict(df.dtypes)[group]
    each = df.select(group, v).mapInPandas(partial, f"g {kind}, s array<double>").select("g", F.posexplode("s").alias("j", "v"))
    sums = each.groupBy("g", "j").agg(F.sum("v").alias("v")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("s"))
    sums = sums.select("g", F.transform("s", lambda p: p.v).alias("s"))  # as many as the model has gradients

    def finish(batches):
        for batch in batches:
            s = matrix(batch["s"]).reshape(len(batch), -1)
            s = s[:, 1:] / s[:, :1]
            parts = []
            if weights:
                parts.append((s[:, :kk] - model.w) / np.sqrt(model.w))
            if mu:
                parts.append((s[:, kk : kk + kk * d].reshape(-1, kk, d) / np.sqrt(model.w)[:, None]).reshape(len(s), -1))
            if sigma:
                parts.append((s[:, kk + kk * d :].reshape(-1, kk, d) / np.sqrt(2 * model.w)[:, None]).reshape(len(s), -1))
            f = np.hstack(parts)
            if normalise:
                length = np.sqrt((f * f).sum(1, keepdims=True))
                f = np.divide(f, length, out=np.zeros_like(f), where=length > 0)
            yield pd.DataFrame({group: batch["g"], "fisher": f.tolist()})

    return sums.mapInPandas(finish, f"`{group}` {kind}, fisher array<double>")

"""Grid search and cross-validation: each round's trainings are the rows of one DataFrame."""

from __future__ import annotations

import itertools
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators import sgd


def fold_of(place: Column, n: Column, folds: int) -> Column:
    """The contiguous fold f with floor(f n / folds) <= place < floor((f + 1) n / folds); place from 0."""
    return F.floor(((place + 1) * folds - 1) / n).cast("int")


def _fold_bounds(n: int, folds: int, f: int) -> tuple[int, int]:
    return f * n // folds, (f + 1) * n // folds


def grid(ranges: dict[str, tuple]) -> list[dict]:
    return [dict(zip(ranges, values, strict=True)) for values in itertools.product(*ranges.values())]


def evaluate(spark: SparkSession, x: np.ndarray, y: np.ndarray, classes: int, base: sgd.Settings, points: list[dict], folds: int) -> DataFrame:
    """(point, fold, epoch, valid): validation accuracies of every point and fold. The samples are those of one cross-validation,
    shared with the tasks once; each task trains one model."""
    shared = spark.sparkContext.broadcast((x, y))
    settings = [asdict(replace(base, **p)) for p in points]
    jobs = spark.range(len(points) * folds, numPartitions=max(1, len(points) * folds)).select((F.col("id") % len(points)).cast("int").alias("point"), F.expr(f"cast(id div {len(points)} AS int)").alias("fold"))

    def run(batches):
        xs, ys = shared.value
        for batch in batches:
            for job in batch.itertuples():
                a, b = _fold_bounds(len(ys), folds, job.fold)
                rest = np.r_[0:a, b : len(ys)]
                m = sgd.train(xs[rest], ys[rest], classes, sgd.Settings(**settings[job.point]), (xs[a:b], ys[a:b]))
                yield pd.DataFrame([(job.point, job.fold, e["epoch"], e["valid"]) for e in m.stats], columns=["point", "fold", "epoch", "valid"])

    return jobs.mapInPandas(run, "point int, fold int, epoch int, valid double")


def best_epochs(evaluated: DataFrame) -> DataFrame:
    """(point, epoch, score): each point's best epoch by its accuracy averaged over the folds, of equal ones the earliest."""
    mean = evaluated.groupBy("point", "epoch").agg(F.avg("valid").alias("score"))
    return mean.groupBy("point").agg(F.max_by("epoch", F.struct("score", -F.col("epoch"))).alias("epoch"), F.max("score").alias("score"))


def hill_climb(spark: SparkSession, x: np.ndarray, y: np.ndarray, classes: int, base: sgd.Settings, ranges: dict[str, tuple], start: dict, folds: int = 5, tolerance: float = 0.05, shrink: float = 0.5) -> tuple[list[tuple[dict, int]], float]:
    """Best-first search over ordered ranges: the best open point's neighbours, one step along one parameter, are evaluated as one
    DataFrame; points within the tolerance of the best stay open, and the tolerance shrinks each round. A step below a range's
    first value leads to its last; one beyond its last leads nowhere. Returns the best points with their epochs, and the score.
    """
    key = lambda p: tuple(sorted(p.items()))
    done: dict[tuple, float] = {}
    best: list[tuple[dict, int]] = []
    top, queue, wave = float("-inf"), [], [start]
    while wave:
        fresh = [p for p in {key(p): p for p in wave}.values() if key(p) not in done]
        if fresh:
            for r in sorted(best_epochs(evaluate(spark, x, y, classes, base, fresh, folds)).collect()):
                p = fresh[r.point]
                done[key(p)] = r.score
                if r.score >= top:
                    best = [*(best if r.score == top else []), (p, r.epoch)]
                    top = r.score
                queue.append((r.score, key(p)))
        queue = sorted(q for q in queue if q[0] > top - tolerance)
        tolerance *= shrink
        if not queue:
            break
        at = dict(queue.pop()[1])
        wave = []
        for name, values in ranges.items():
            i = values.index(at[name])
            wave += [{**at, name: values[j]} for j in (i - 1, i + 1) if j < len(values)]
    return best, top

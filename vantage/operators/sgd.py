"""Linear classifiers by stochastic gradient descent.

Training is a fold over ordered samples. `Linear` folds with numpy, for a query or class per task (applyInPandas); the
binary case is also a Catalyst fold. All random draws are columns or seeded by the sample's place, so that a task that is
repeated trains the same model. Computed in double; steps are eta0 / (1 + lambda eta0 t) with t from 0, over all epochs.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions import draws as drawn_by
from vantage.functions import vectors as V

ALGORITHMS = ("ovr", "mul", "rnk", "war")


@dataclass(frozen=True)
class Settings:
    algo: str = "ovr"
    epochs: int = 10
    lambda_: float = 1e-4
    bias_term: float = 0.1
    eta0: float = 0.1  # 0: searched
    beta: int = 4  # 0: the floor of the root of the number of classes
    fixed_eta: bool = False
    eval_every: int = 10
    stop_below: float = float("-inf")
    seed: int = 0
    # The plain solver: t begins at 1, the bias is a shrunk component of the weights, and the weighted ranking step takes the
    # harmonic sum of so many terms, not one more.
    plain: bool = False

    def __post_init__(self):
        if self.algo not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algo}")
        if self.algo == "war" and not self.eta0:
            raise ValueError("eta0 cannot be searched for war, which has no loss to compare")


@dataclass
class Linear:
    """Weights (classes x d), biases, and the number t of samples seen."""

    w: np.ndarray
    b: np.ndarray
    t: int = 0
    products: int = 0
    changes: int = 0
    stats: list[dict] = field(default_factory=list)

    @staticmethod
    def zero(classes: int, d: int) -> Linear:
        return Linear(np.zeros((classes, d)), np.zeros(classes))

    def scores(self, x: np.ndarray, s: Settings) -> np.ndarray:
        return x @ self.w.T + self.b * s.bias_term

    def flat(self, s: Settings) -> np.ndarray:
        """Weights with the bias times its term as the last component of each class."""
        return np.hstack([self.w, (self.b * s.bias_term)[:, None]])


def draws(n: int, y: np.ndarray, classes: int, s: Settings, epoch: int, first: int = 0) -> np.ndarray:
    """Orders of the other classes per sample, pre-drawn: the first beta of them serve ovr, the first rnk, all war. first: the
    place of the first sample among all."""
    i, k = np.arange(first, first + n)[:, None], np.arange(classes)[None]
    order = drawn_by.key(i, k, epoch, s.seed).argsort(1, kind="stable")
    return order[order != y[:, None]].reshape(n, classes - 1)


def epoch(m: Linear, x: np.ndarray, y: np.ndarray, s: Settings, number: int, given: np.ndarray | None = None) -> None:
    """One pass over the samples in their order. given: draws() of this epoch, or others in their place."""
    classes = len(m.b)
    others = draws(len(y), y, classes, s, number) if given is None else given
    beta = min(s.beta or int(classes**0.5), classes - 1)
    harmonic = np.cumsum(1 / np.arange(1, classes + 1))
    for i in range(len(y)):
        eta = s.eta0 if s.fixed_eta else s.eta0 / (1 + s.lambda_ * s.eta0 * (m.t + s.plain))
        shrink, yi, xi = 1 - eta * s.lambda_, int(y[i]), x[i]
        m.t += 1
        if s.algo == "ovr":
            k = np.concatenate([[yi], others[i, :beta]])
            sense = np.where(k == yi, 1.0, -1.0)
            score = m.w[k] @ xi + m.b[k] * s.bias_term
            m.w[k] *= shrink
            if s.plain:
                m.b[k] *= shrink
            hit = sense * score < 1
            m.w[k[hit]] += eta * sense[hit, None] * xi
            m.b[k[hit]] += eta * sense[hit] * s.bias_term
            m.products, m.changes = m.products + len(k), m.changes + int(hit.sum())
            continue
        other, step = yi, eta
        if s.algo == "mul":
            score = m.w @ xi + m.b * s.bias_term + 1
            score[yi] -= 1
            other, m.products = int(score.argmax()), m.products + classes
        else:
            tried = others[i, :1] if s.algo == "rnk" else others[i]
            score = m.w[tried] @ xi + m.b[tried] * s.bias_term
            broken = np.flatnonzero(1 - (m.w[yi] @ xi + m.b[yi] * s.bias_term) + score > 0)
            if len(broken):
                other = int(tried[broken[0]])
                if s.algo == "war":
                    step = eta * harmonic[(classes - 1) // (int(broken[0]) + 1) - s.plain]
            m.products += 2 if s.algo == "rnk" else int(broken[0]) if len(broken) else classes - 1
        m.w *= shrink
        if s.plain:
            m.b *= shrink
        if other != yi:
            m.w[yi] += step * xi
            m.w[other] -= step * xi
            m.b[yi] += step * s.bias_term
            m.b[other] -= step * s.bias_term
            m.changes += 2


def losses(scores: np.ndarray, y: np.ndarray, s: Settings, beta: int) -> np.ndarray:
    """Loss of each sample: weighted one-versus-rest hinges, the largest margin violation, or the sum of all of them."""
    n, classes = scores.shape
    own = scores[np.arange(n), y][:, None]
    mine = y[:, None] == np.arange(classes)
    if s.algo == "ovr":
        count = np.bincount(y, minlength=classes)
        rho = 1 / (1 + beta)
        with np.errstate(divide="ignore"):
            weight = np.where(mine, rho / count, (1 - rho) / (n - count))
        return np.where(np.isfinite(weight), weight * np.maximum(0, 1 - np.where(mine, 1, -1) * scores), 0).sum(1)
    margin = np.where(mine, 0, 1) + scores - own
    if s.algo == "mul":
        return margin.max(1)
    if s.algo == "rnk":
        return np.maximum(0, margin).sum(1)
    raise ValueError("war has no loss")


def objective(m: Linear, x: np.ndarray, y: np.ndarray, s: Settings) -> float:
    beta = s.beta or int(len(m.b) ** 0.5)
    loss = losses(m.scores(x, s), y, s, beta).sum()
    return float(loss + 0.5 * s.lambda_ * ((m.w**2).sum() + (m.b**2).sum() * s.bias_term**2))


def search_eta(x: np.ndarray, y: np.ndarray, classes: int, s: Settings, subset: int = 1000) -> float:
    """The step from which doubling (or halving, if doubling 1 makes it worse) first raises the objective after an epoch; of the
    last two, the smaller. The objective is taken on the first samples; ovr trains its trial on all, the others on those."""
    first = slice(0, subset)

    def cost(eta: float) -> float:
        m, trial = Linear.zero(classes, x.shape[1]), replace(s, eta0=eta)
        part = slice(None) if s.algo == "ovr" else first
        epoch(m, x[part], y[part], trial, 0)
        return objective(m, x[first], y[first], trial)

    a, b, factor = 1.0, 2.0, 2.0
    cost_a, cost_b = cost(a), cost(b)
    if cost_b > cost_a:
        a, b, cost_a, cost_b, factor = b, a, cost_b, cost_a, 0.5
    while True:
        a, b, cost_a = b, b * factor, cost_b
        cost_b = cost(b)
        if not cost_a > cost_b:
            return min(a, b)


def rank_of_label(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Classes that score above the true one, and half of those that tie with it, the true one included, rounded down."""
    own = scores[np.arange(len(y)), y][:, None]
    return (scores > own).sum(1) + (scores == own).sum(1) // 2


def accuracy(scores: np.ndarray, y: np.ndarray, criterion: str = "top1", coefficient: float = 0.1) -> float:
    rank = rank_of_label(scores, y)
    value = {"top1": rank == 0, "map": 1 / (rank + 1), "exp": np.exp(-rank * coefficient)}[criterion]
    return float(np.mean(value)) if len(y) else float("nan")


def train(x: np.ndarray, y: np.ndarray, classes: int, s: Settings, valid: tuple[np.ndarray, np.ndarray] | None = None, start: Linear | None = None, criterion: str = "top1") -> Linear:
    """Labels from 0. Every eval_every epochs accuracies are noted; with a validation set the best weights are returned, and
    training ends once accuracy falls under the best plus stop_below."""
    if len(y) and (y.min() < 0 or y.max() >= classes):
        raise ValueError("label out of range")
    if not s.eta0:
        s = replace(s, eta0=search_eta(x, y, classes, s))
    m = start or Linear.zero(classes, x.shape[1])
    best, kept = float("-inf"), None
    for number in range(s.epochs):
        if number % s.eval_every == 0 or number == s.epochs - 1:
            own = accuracy(m.scores(x, s), y, criterion)
            held = accuracy(m.scores(valid[0], s), valid[1], criterion) if valid else None
            m.stats.append({"epoch": number, "train": own, "valid": held, "products": m.products, "changes": m.changes})
            if held is not None:
                if held < best + s.stop_below:
                    break
                if held > best:
                    best, kept = held, (m.w.copy(), m.b.copy())
        epoch(m, x, y, s, number)
    if valid:
        held = accuracy(m.scores(valid[0], s), valid[1], criterion)
        m.stats.append({"epoch": s.epochs, "train": accuracy(m.scores(x, s), y, criterion), "valid": held, "products": m.products, "changes": m.changes})
        if kept is not None and held <= best:
            m.w, m.b = kept
    return m


@dataclass
class Hinge:
    """One class against the rest, trained sample by sample or, with the same result up to rounding, block by block: the scores of
    a block are one product with the weights at its beginning, corrected by the block's inner products for what is learned
    inside it."""

    w: np.ndarray
    b: float = 0.0
    t: int = 0

    def block(self, x: np.ndarray, sense: np.ndarray, s: Settings, t: np.ndarray | None = None) -> None:
        """x: samples in order, sense: 1 or -1, t: their steps; they follow each other if none are given."""
        at = np.arange(self.t, self.t + len(x)) if t is None else t
        eta = np.full(len(x), s.eta0) if s.fixed_eta else s.eta0 / (1 + s.lambda_ * s.eta0 * (at + s.plain))
        score, gram = x @ self.w, x @ x.T
        scale, part = 1.0, np.zeros(len(x))  # the weights are scale * w + part @ x
        for i in range(len(x)):
            own = scale * score[i] + part[:i] @ gram[:i, i] + self.b * s.bias_term
            shrink = 1 - eta[i] * s.lambda_
            scale *= shrink
            part[:i] *= shrink
            if s.plain:
                self.b *= shrink
            if sense[i] * own < 1:
                part[i] = eta[i] * sense[i]
                self.b += eta[i] * sense[i] * s.bias_term
        self.w = scale * self.w + part @ x
        self.t += len(x)


#: Samples of a block.
BLOCK = 64


def fold(samples: DataFrame, key: str, order: list[str], sense: str, x: str, s: Settings, t: str | None = None) -> DataFrame:
    """(key, j, w): for each key a Hinge folded over its samples in order; j runs over the components and, last, the bias. Samples
    stream past, sorted, in their task: it holds a batch and a model however many they are. t: the column of the steps."""
    kind = dict(samples.dtypes)[key]
    rows = samples.select(*dict.fromkeys([key, *order, sense, x, *([t] if t else [])])).repartition(key).sortWithinPartitions(key, *order)

    def run(batches):
        at, model = None, None

        def done() -> pd.DataFrame:
            flat = np.append(model.w, model.b * s.bias_term)
            return pd.DataFrame({key: [at] * len(flat), "j": np.arange(len(flat)), "w": flat})

        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            values = np.array(batch[x].tolist(), np.float64)
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(starts, starts[1:], strict=False):
                if model is None or keys[a] != at:
                    if model is not None:
                        yield done()
                    at, model = keys[a], Hinge(np.zeros(values.shape[1]))
                for i in range(a, b, BLOCK):
                    part = slice(i, min(b, i + BLOCK))
                    model.block(values[part], batch[sense].to_numpy()[part], s, batch[t].to_numpy()[part] if t else None)
        if model is not None:
            yield done()

    return rows.mapInPandas(run, f"`{key}` {kind}, j int, w double")


def train_per_class(samples: DataFrame, key: str, order: str, y: str, x: str, s: Settings) -> DataFrame:
    """(key, j, w): the binary hinge classifier of each group's samples (y = 1 or -1) in their order. Groups train in parallel;
    every epoch reads the group once more in the sorted stream."""
    if not s.eta0:
        raise ValueError("the step search needs its samples at hand: use train")
    again = samples.select(key, order, y, x).withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(s.epochs - 1))))
    return fold(again, key, ["__epoch", order], y, x, s)


def train_ovr(samples: DataFrame, place: str, y: str, x: str, classes: int, s: Settings) -> DataFrame:
    """(class_id, j, w) of the one-versus-rest model that train() learns from all samples in the order of their places 0..n-1. Once
    the other classes of each step are drawn, classes do not depend on each other, so each is a task of its own."""
    n = samples.count()
    beta = min(s.beta or int(classes**0.5), classes - 1)
    own = F.col(y).cast("int")
    epochs = samples.select(F.col(place).cast("long").alias("__i"), own.alias("__y"), x, F.explode(F.sequence(F.lit(0), F.lit(s.epochs - 1))).alias("__e"))
    others = F.array(*[F.struct(drawn_by.key(F.col("__i"), F.lit(k).cast("long"), F.col("__e"), s.seed).alias("c"), F.lit(k).alias("k")) for k in range(classes)])
    drawn = F.slice(F.array_sort(F.filter(others, lambda o: o.k != F.col("__y"))), 1, beta)
    touched = F.explode(F.concat(F.array(F.col("__y")), F.transform(drawn, lambda o: o.k))).alias("class_id")
    steps = epochs.select("__i", "__e", "__y", x, touched)
    steps = steps.withColumn("__sense", F.when(F.col("class_id") == F.col("__y"), 1).otherwise(-1)).withColumn("__t", F.col("__e") * n + F.col("__i"))
    return fold(steps, "class_id", ["__t"], "__sense", x, s, "__t")


def binary_fold(samples: Column, d: int, s: Settings) -> Column:
    """The same as a Catalyst fold over an ordered array of (y, x): a struct (w, b, t)."""

    def step(m: Column, e: Column) -> Column:
        eta = F.lit(s.eta0) / (1 + s.lambda_ * s.eta0 * m.t)
        score = V.dot(m.w, e.x) + m.b * s.bias_term
        add = F.when(e.y * score < 1, eta * e.y).otherwise(0.0)
        w = F.zip_with(m.w, V.doubles(e.x), lambda a, v: a * (1 - eta * s.lambda_) + add * v)
        return F.struct(w.alias("w"), (m.b + add * s.bias_term).alias("b"), (m.t + 1).alias("t"))

    zero = F.struct(F.array_repeat(F.lit(0.0), d).alias("w"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("t"))
    rows = samples
    for _ in range(s.epochs - 1):
        rows = F.concat(rows, samples)
    return F.aggregate(rows, zero, step)


def score(df: DataFrame, x: str, weights: np.ndarray) -> DataFrame:
    """df with scores: one per class of weights (classes x (d + 1), the bias last)."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "scores array<double>"])

    def run(batches):
        for batch in batches:
            values = np.array(batch[x].tolist(), np.float64).reshape(len(batch), -1)
            yield batch.assign(scores=list(values @ weights[:, :-1].T + weights[:, -1]) if len(batch) else [])

    return df.mapInPandas(run, fields)


def label_rank(scores: Column, y: Column) -> Column:
    """rank_of_label of a score array."""
    own = F.element_at(scores, y + 1)
    above, same = F.size(F.filter(scores, lambda v: v > own)), F.size(F.filter(scores, lambda v: v == own))
    return above + F.floor(same / 2).cast("int")

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import sgd, tuning


def data(n=200, d=6, classes=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, d)) * 2
    y = rng.integers(0, classes, n)
    return centres[y] + rng.normal(size=(n, d)), y


@pytest.mark.parametrize("algo", sgd.ALGORITHMS)
def test_all_algorithms_learn(algo):
    x, y = data()
    s = sgd.Settings(algo, epochs=10, beta=2)
    m = sgd.train(x, y, 4, s)
    assert sgd.accuracy(m.scores(x, s), y) > 0.85


def test_one_versus_rest_classes_are_independent():
    """With all classes updated at each step, a class trains like the binary problem of its own."""
    x, y = data()
    s = sgd.Settings("ovr", epochs=2, beta=3, bias_term=0.5)
    m = sgd.train(x, y, 4, s)
    for k in range(4):
        two = sgd.train(x, (y != k).astype(int), 2, sgd.Settings("ovr", epochs=2, beta=1, bias_term=0.5))
        assert np.allclose(m.w[k], two.w[0]) and m.b[k] == pytest.approx(two.b[0])


def test_the_bias_is_not_shrunk():
    s = sgd.Settings("ovr", epochs=1, beta=1, lambda_=0.5, eta0=1.0, fixed_eta=True, bias_term=1.0)
    m = sgd.Linear.zero(2, 1)
    sgd.epoch(m, np.array([[4.0], [4.0]]), np.array([0, 0]), s, 0)
    assert m.w[0, 0] == 2.0 and m.b[0] == 1.0 and m.t == 2


def test_kernel_and_catalyst_fold_agree(spark):
    x, y = data(60, 5, 2)
    s = sgd.Settings(epochs=3, beta=1, bias_term=0.7, lambda_=1e-2)
    rows = spark.createDataFrame([(1, i, 1 if y[i] == 0 else -1, x[i].tolist()) for i in range(60)], "k int, i int, y int, x array<double>")
    kernel = [r.w for r in sgd.train_per_class(rows, "k", "i", "y", "x", s).orderBy("j").collect()]
    ordered = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "y", "x"))).alias("s"))
    m = ordered.select(sgd.binary_fold(F.col("s"), 5, s).alias("m")).first().m
    assert np.allclose(kernel, [*m.w, m.b * 0.7], atol=1e-12) and m.t == 180


def test_rank_counts_half_of_the_ties():
    scores = np.array([[1.0, 1.0, 0.0], [2.0, 1.0, 3.0], [1.0, 1.0, 1.0]])
    assert sgd.rank_of_label(scores, np.array([0, 1, 2])).tolist() == [1, 2, 1]


def test_losses():
    scores, y = np.array([[0.5, -2.0, 0.2]]), np.array([0])
    assert sgd.losses(scores, y, sgd.Settings("mul"), 1)[0] == pytest.approx(0.7)
    assert sgd.losses(scores, y, sgd.Settings("rnk"), 1)[0] == pytest.approx(0.7)
    assert sgd.losses(np.vstack([scores, scores]), np.array([0, 1]), sgd.Settings("ovr"), 1)[0] == pytest.approx(0.5 * 0.5 + 0.5 / 1 * 0.0 + 0.5 / 2 * 1.2)


def test_step_search_and_refusals():
    x, y = data(80)
    eta = sgd.search_eta(x, y, 4, sgd.Settings("mul", eta0=0.0))
    assert 0 < eta < 100 and np.log2(eta) == int(np.log2(eta))
    with pytest.raises(ValueError):
        sgd.Settings("war", eta0=0.0)
    with pytest.raises(ValueError):
        sgd.train(x, y + 1, 4, sgd.Settings())


def test_best_weights_are_kept():
    x, y = data(120)
    s = sgd.Settings("mul", epochs=6, eval_every=1)
    m = sgd.train(x[:80], y[:80], 4, s, (x[80:], y[80:]))
    assert sgd.accuracy(m.scores(x[80:], s), y[80:]) == max(e["valid"] for e in m.stats)


def test_folds_are_contiguous_and_even(spark):
    places = spark.range(103).select("id", tuning.fold_of(F.col("id"), F.lit(103), 5).alias("f")).orderBy("id").collect()
    for f in range(5):
        a, b = f * 103 // 5, (f + 1) * 103 // 5
        assert [r.id for r in places if r.f == f] == list(range(a, b))


def test_hill_climb_finds_the_best_neighbour_and_wraps_below(spark):
    x, y = data(100)
    ranges = {"lambda_": (1e-4, 1e-2), "eta0": (1e-4, 1e-1)}
    best, score = tuning.hill_climb(spark, x, y, 4, sgd.Settings("mul", epochs=2, eval_every=1), ranges, {"lambda_": 1e-4, "eta0": 1e-4}, folds=3, tolerance=1.0)
    assert score > 0.7 and best


def test_blocks_learn_what_single_samples_do():
    x, y = data(150, 5, 2)
    s = sgd.Settings(epochs=2, beta=1, bias_term=0.7, lambda_=1e-2)
    m = sgd.train(x, y, 2, s)
    for size in (1, 7, 64, 150):
        h = sgd.Hinge(np.zeros(5))
        for _ in range(2):
            for a in range(0, 150, size):
                h.block(x[a : a + size], np.where(y == 0, 1, -1)[a : a + size], s)
        assert np.allclose(h.w, m.w[0], atol=1e-10) and h.b == pytest.approx(m.b[0]) and h.t == 300


@pytest.mark.parametrize("plain", [False, True])
def test_classes_train_apart_as_they_do_together(spark, plain):
    x, y = data(90, 4, 5)
    s = sgd.Settings("ovr", epochs=2, beta=2, bias_term=0.5, plain=plain)
    want = sgd.train(x, y, 5, s).flat(s)
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(90)], "i long, y int, x array<double>")
    got = {(r.class_id, r.j): r.w for r in sgd.train_ovr(rows, "i", "y", "x", 5, s).collect()}
    assert np.allclose([[got[k, j] for j in range(5)] for k in range(5)], want, atol=1e-10)


def test_draws_are_even():
    y = np.zeros(20_000, int)
    first = np.bincount(sgd.draws(20_000, y, 6, sgd.Settings(), 3)[:, 0], minlength=6)
    assert first[0] == 0 and np.all(np.abs(first[1:] / 4000 - 1) < 0.1)

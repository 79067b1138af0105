import numpy as np

from vantage.model import Params
from vantage.operators import features, sgd
from vantage.plans import retrieval
from vantage.sources import artifacts


def pages(spark, n=3, h=75, w=86):
    rng = np.random.default_rng(6)
    rows = [(d, h, w, rng.integers(0, 256, (h, w), dtype=np.uint8)) for d in range(n)]
    return rows, spark.createDataFrame([(d, a, b, bytearray(p.tobytes())) for d, a, b, p in rows], "doc_id long, h int, w int, pixels binary")


def test_index_codes_every_cell(spark):
    rows, df = pages(spark)
    made = retrieval.index(df, Params(n_codes=5, pca_dim=4), redo=1, rounds=3)
    coded = made.coded.collect()
    assert len(coded) == 3 * 4 * 5 and made.codebook.shape == (5, 4)
    im = rows[1][3][1:73, 1:85]
    low = (features.hog(im).reshape(-1, 31) - made.pca.mean) @ made.pca.axes[:, :4]
    want = ((low[:, None] - made.codebook) ** 2).sum(2).argmin(1)
    assert [r.code for r in sorted(coded) if r.doc_id == 1] == want.tolist()


def test_positive_samples(spark):
    rows, df = pages(spark, 1)
    asked = spark.createDataFrame([(9, 0, 3, 38, 13, 48)], "query_id long, doc_id long, x1 int, x2 int, y1 int, y2 int")
    got = {(r.dx, r.dy): np.array(r.x) for r in retrieval.positive_samples(asked, df, Params(shifts=(-4, 0, 4))).collect()}
    assert len(got) == 9 and all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in got.values())
    im = rows[0][3].astype(float)
    whole = features.hog(im[16:52, 6:42]).ravel()
    assert np.allclose(got[4, 4], whole / np.linalg.norm(whole))
    cut = features.hog(features.bicubic(im[12:48, 0:34], 36, 36)).ravel()
    assert np.allclose(got[-4, 0], cut / np.linalg.norm(cut))
    middle = retrieval.unlearned(retrieval.positive_samples(asked, df, Params(shifts=(-4, 0, 4)))).first()
    assert np.allclose(middle.x, got[0, -4])  # the fourth of nine


def test_the_plain_solver_shrinks_its_bias():
    s = sgd.Settings("ovr", epochs=1, beta=1, lambda_=0.5, eta0=1.0, bias_term=1.0, plain=True)
    m = sgd.Linear.zero(2, 1)
    sgd.epoch(m, np.array([[4.0], [4.0]]), np.array([0, 0]), s, 0)
    first = 1 / 1.5
    assert np.isclose(m.b[0], first * (1 - 0.5 / 2)) and np.isclose(m.w[0, 0], 4 * first * (1 - 0.5 / 2))


def test_artifacts_follow_their_parameters(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    for n in (3, 5):
        for _ in range(2):
            assert artifacts.load_or_make(spark, str(tmp_path), "x", {"n": n}, lambda n=n: make(n)).count() == n
    assert made == [3, 5]
    assert artifacts.location("a/", "x", Params()) != artifacts.location("a", "x", Params(sbin=8))


def test_a_pattern_is_found_on_all_pages_that_show_it(spark):
    """From images to average precision: a drawn pattern on noise, at places of its own on each page."""
    rng = np.random.default_rng(8)
    y, x = np.mgrid[:48, :48]
    pattern = (127 + 120 * np.sign(np.sin(x / 3.0) * np.sin(y / 5.0 + x / 9.0))).astype(np.uint8)
    rows, truth = [], []
    for d in range(4):
        page = rng.integers(90, 160, (120, 132)).astype(np.uint8)
        if d < 3:
            top, left = 12 * (1 + d), 12 * (2 + d)
            page[top : top + 48, left : left + 48] = pattern
            truth.append((0, d, d, left + 1, left + 48, top + 1, top + 48))
        rows.append((d, 120, 132, bytearray(page.tobytes())))
    df = spark.createDataFrame(rows, "doc_id long, h int, w int, pixels binary")
    asked = spark.createDataFrame([(0, 0, 24 + 13, 24 + 36, 12 + 13, 12 + 36)], "query_id long, doc_id long, x1 int, x2 int, y1 int, y2 int")
    true = spark.createDataFrame(truth, "query_id long, doc_id long, gt_id long, x1 int, x2 int, y1 int, y2 int")
    params = Params(n_codes=48, pca_dim=12, shifts=(-2, 0, 2), eta0=0.1, lambda_=1e-4, negatives_per_positive=2)  # few, as small pages have few other windows
    got = retrieval.retrieve(asked, true, df, params, redo=1, rounds=5).collect()
    assert [(r.query_id, r.n_relevant, r.ap, r.recall) for r in got] == [(0, 3, 1.0, 1.0)]
    grid = retrieval.retrieve(asked, true, df, params, grid=[{"eta0": 0.1}, {"eta0": 1e-9, "lambda_": 0.0}], redo=1, rounds=5)
    best = {r.point: (r.mean_ap, r.best) for r in retrieval.best_point(grid).collect()}
    assert best[0] == (1.0, True) and not best[1][1]


def test_exemplars_learn_from_all_positives_and_negatives(spark):
    rows, df = pages(spark, 2)
    asked = spark.createDataFrame([(5, 0, 25, 48, 25, 48)], "query_id long, doc_id long, x1 int, x2 int, y1 int, y2 int")
    params = Params(shifts=(-2, 0, 2), epochs=1, eta0=0.1)
    cells = features.describe(retrieval.crop_to_cells(df, 12), 12)
    learned = retrieval.learn_exemplars(asked, df, cells, params, per_page=7).collect()
    assert len(learned) == 4 and {(r.dr, r.dc) for r in learned} == {(a, b) for a in (0, 1) for b in (0, 1)}
    assert Params().positives == 121 and Params().negatives(20) >= 7744 and Params().negatives(20) % 20 == 0

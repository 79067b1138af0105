import numpy as np
import pytest

from vantage.operators import features as f
from vantage.operators import features_relational as relational


def test_uniform_images_have_no_gradient():
    assert not f.hog(np.full((48, 60), 7.0)).any() and f.hog(np.full((48, 60), 7.0)).shape == (2, 3, 31)


def test_a_vertical_edge_votes_for_the_horizontal_direction():
    im = np.zeros((36, 36))
    im[:, 18:] = 10
    h = f.histogram(im, 12)
    assert h[:, :, 0].sum() == pytest.approx(h.sum()) and h.sum() > 0
    assert f.histogram(-im, 12)[:, :, 9].sum() == pytest.approx(h.sum())


def test_the_strongest_channel_counts():
    rng = np.random.default_rng(1)
    im = rng.random((36, 36))
    three = np.stack([im * 0.1, im, im * 0.5], axis=2)
    assert np.allclose(f.hog(three), f.hog(im)) and np.allclose(f.hog(np.stack([im] * 3, axis=2)), f.hog(im))


def test_kinds_share_their_parts():
    im = np.random.default_rng(2).random((48, 48)) * 255
    full, short = f.hog(im), f.hog(im, kind="hog13")
    assert np.allclose(full[:, :, 18:], short) and f.hog(im, kind="raw18").shape == (2, 2, 18)
    assert f.hog(im[:20, :20]).size == 0


def test_relational_plan_and_kernel_agree(spark):
    """On pages whose sides are more or less than whole cells."""
    rng = np.random.default_rng(9)
    sizes = [(48, 48), (45, 53), (50, 40), (20, 60), (37, 64)]
    rows = [(i, h, w, bytearray(rng.integers(0, 256, h * w, dtype=np.uint8).tobytes())) for i, (h, w) in enumerate(sizes)]
    rows.append((9, 48, 48, bytearray(48 * 48)))
    pages = spark.createDataFrame(rows, "doc_id long, h int, w int, pixels binary")
    a = {(r.doc_id, r.r, r.c): r.feat for r in f.describe(pages).collect()}
    b = {(r.doc_id, r.r, r.c): r.feat for r in relational.describe(pages).collect()}
    assert a.keys() == b.keys() and len(a) == 17 and all(np.allclose(a[k], b[k]) for k in a)


def test_shrinking_keeps_the_mean():
    im = np.random.default_rng(3).random((40, 30))
    half = f.shrink(im, 0.5)
    assert np.allclose(half, im.reshape(20, 2, 15, 2).mean((1, 3)))
    assert np.allclose(f.shrink(im, 1.0), im) and f.shrink(im, 0.37).mean() == pytest.approx(im.mean(), abs=0.01)
    with pytest.raises(ValueError):
        f.shrink(im, 1.1)


def test_cubic_resize():
    x = np.add.outer(np.arange(12.0), np.arange(9.0))
    assert np.allclose(f.bicubic(x, 12, 9), x) and np.allclose(f.bicubic(np.ones((5, 5)), 9, 3), 1)


def test_pyramid():
    levels = f.pyramid(np.random.default_rng(4).random((60, 48)), 12, interval=2)
    assert levels[0][0] == 1 and levels[0][1].shape == (5, 4, 31) and not levels[0][1][0].any()
    assert [s for s, _ in levels] == sorted((s for s, _ in levels), reverse=True)


def test_glyphs():
    w = f.glyph_weights(np.array([[[1.0, -3, 0, 1, 0, 2, 0, 0]]]), fold=4)
    assert w.tolist() == [[[1.0, 0.0]]] and f.glyphs(w, 7).shape == (7, 7) and f.glyphs(w, 7).max() == 1

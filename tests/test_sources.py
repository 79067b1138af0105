import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.functions import geometry
from vantage.functions import vectors as V
from vantage.operators import annotations, quantize, sparse
from vantage.sources import generators, images, text, vecs


@pytest.mark.parametrize("kind,element", [("fvecs", "float"), ("ivecs", "int"), ("bvecs", "int")])
def test_vector_files(spark, tmp_path, kind, element):
    rows = [(i, [float(i), 2.0, 250.0 - i] if kind == "fvecs" else [i, 2, 250 - i]) for i in range(1, 8)]
    df = spark.createDataFrame(rows, f"idx long, v array<{element}>")
    path = f"{tmp_path}/x.{kind}"
    vecs.write(df, path)
    assert vecs.file_sizes(spark, path).first()[1:] == (7, 3)
    read = lambda *a, **k: [(r.idx, list(r.v)) for r in vecs.read(spark, path, *a, **k).orderBy("idx").collect()]
    assert read() == rows and read(3, 5) == rows[2:5] and read(6, 99) == rows[5:] and read(5, 4) == [] and read(None, 2) == rows[:2]
    if kind == "bvecs":
        assert vecs.read(spark, path, as_float=True).dtypes[1][1] == "array<float>"
    with pytest.raises(ValueError):
        vecs.read(spark, path, 0)


def test_ties_of_read_back_decimals_round_as_sql_does(spark, tmp_path):
    """0.1288075 is a tie of decimals, and so a little less as a double times a million."""
    import duckdb

    from vantage.plans import catalogue

    values = [0.1288075, -0.1254455, 0.0651455, 0.2616705, 0.5] + [0.0] * 59
    frame = spark.createDataFrame([(0, 1, values)], "vec_id long, label int, embedding array<double>")
    frame.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT label, j, v, n FROM ({catalogue.oracle_sql()['svmlight_roundtrip']})").fetchall()
    got = catalogue.queries()["svmlight_roundtrip"](spark, str(tmp_path)).select("label", "j", "v", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_vector_files_of_no_or_mixed_vectors(spark, tmp_path):
    (tmp_path / "e.fvecs").write_bytes(b"")
    assert vecs.read(spark, f"{tmp_path}/e.fvecs").count() == 0
    (tmp_path / "m.ivecs").write_bytes(struct.pack("<iii", 2, 1, 1) + struct.pack("<iii", 3, 1, 1))
    with pytest.raises(Exception, match="different dimensions"):
        vecs.read(spark, f"{tmp_path}/m.ivecs").collect()


def test_vector_files_by_parts(spark, tmp_path):
    df = spark.range(50).select(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v")).repartitionByRange(3, F.col("v")[0])
    paths = vecs.write_parts(df, f"{tmp_path}/parts")
    assert len(paths) == 3 and sorted(r.n for r in vecs.file_sizes(spark, f"{tmp_path}/parts/*.fvecs").collect()) and vecs.file_sizes(spark, f"{tmp_path}/parts/*.fvecs").agg(F.sum("n")).first()[0] == 50
    back = vecs.read(spark, f"{tmp_path}/parts", kind="fvecs").collect()
    assert sorted(r.v[0] for r in back) == [float(i) for i in range(50)] and sorted(r.idx for r in back) == list(range(1, 51))


def test_annotation_files(spark, tmp_path):
    (tmp_path / "q.gtp").write_text("p1.tif 5 6 14 25 word\n\n p2.tif  1 1 2 2 other \n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/b.gtp").write_text("1 2 3 4 word\n5 6 7 8 none\n")
    (tmp_path / "d/a.gtp").write_text("9 9 9 9 word")
    (tmp_path / "d/c.gtp").write_text("")
    asked = text.query_list(spark, f"{tmp_path}/q.gtp")
    assert [tuple(r) for r in asked.collect()] == [("p1.tif", 5, 14, 6, 25, "word", 20, 10), ("p2.tif", 1, 2, 1, 2, "other", 2, 2)]
    classes = annotations.class_dictionary(asked.withColumn("pos", F.monotonically_increasing_id()), "text", ["pos"])
    words = annotations.classify(text.annotations(spark, f"{tmp_path}/d/*.gtp"), classes)
    assert sorted((r.doc_id, r.word_id, r.text, r.class_id) for r in words.collect()) == [(1, 1, "word", 1), (2, 1, "word", 1), (2, 2, "none", -1)]
    assert [tuple(r) for r in annotations.relevant_counts(words).collect()] == [(1, 2)]


def test_svmlight_and_bags(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 0.0, 2.0]), (2, [0.0, 0.0, 0.0])], "label int, x array<double>")
    assert [r.value for r in text.svmlight_lines(df, "label", "x").collect()] == ["1 1:0.5 3:2", "2"]
    text.svmlight_lines(df, "label", "x").write.text(f"{tmp_path}/s")
    assert sorted((r.label, list(r.x)) for r in text.svmlight(spark, f"{tmp_path}/s", 3).collect()) == [(1.0, [0.5, 0.0, 2.0]), (2.0, [0.0, 0.0, 0.0])]
    for name, n in (("b", 4), ("a", 6)):
        vecs.write(spark.createDataFrame([(i, [float(i), 4.0]) for i in range(1, n + 1)], "idx long, v array<float>"), f"{tmp_path}/{name}.fvecs")
    bags = text.bags_of_words(spark, [f"{tmp_path}/b.fvecs", f"{tmp_path}/a.fvecs"], 2).collect()
    assert sorted((r.class_id, r.idx, r.split) for r in bags) == [(1, 1, "train"), (1, 2, "train"), (1, 3, None), (1, 4, "test"), (1, 5, "test"), (1, 6, "test"), (2, 1, "train"), (2, 2, "train"), (2, 3, "test"), (2, 4, "test")]
    assert all(sum(r.v) == pytest.approx(1) for r in bags)


def test_mixture_file_and_toy_data(spark, tmp_path):
    (tmp_path / "g").write_bytes(generators.gmm_bytes(np.array([0.25, 0.75]), np.arange(6).reshape(2, 3), np.ones((2, 3))))
    r = generators.read_gmm(spark, f"{tmp_path}/g").first()
    assert list(r.w) == [0.25, 0.75] and [list(m) for m in r.mu] == [[0, 1, 2], [3, 4, 5]]
    toy = generators.toy_mixture(spark, 3, 4, 50).collect()
    assert len(toy) == 200 and sum(r.split == "train" for r in toy) == 100 and {r.label for r in toy} == {0, 1, 2, 3}


def gray_bmp(pixels):
    h, w = pixels.shape
    line = (w + 3) // 4 * 4
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256))
    body = b"".join(pixels[y].tobytes() + bytes(line - w) for y in range(h - 1, -1, -1))
    head = struct.pack("<2sIHHI", b"BM", 54 + len(palette) + len(body), 0, 0, 54 + len(palette))
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, len(body), 0, 0, 256, 256) + palette + body


def test_page_images_and_crops(spark, tmp_path):
    pixels = np.arange(30, dtype=np.uint8).reshape(5, 6)
    (tmp_path / "p.bmp").write_bytes(gray_bmp(pixels))
    page = images.pages(spark, f"{tmp_path}/p.bmp").withColumn("doc_id", F.lit(1)).cache()
    assert bytes(page.first().pixels) == pixels.tobytes() and page.first().h == 5
    q = spark.createDataFrame([(7, 1, 2, 3, 1, 2)], "query_id long, doc_id int, x1 int, x2 int, y1 int, y2 int")
    found = spark.createDataFrame([(7, 1, 1, 1, 5, 99, 4, 99), (7, 1, 2, 0, -3, 1, 1, 1)], "query_id long, doc_id int, rank int, is_relevant int, x1 int, x2 int, y1 int, y2 int")
    crops = {r.name: (r.crop_h, r.crop_w, list(bytes(r.crop))) for r in images.result_crops(q, found, page).collect()}
    assert crops == {"000q.png": (2, 2, [1, 2, 7, 8]), "001c.png": (2, 2, [22, 23, 28, 29]), "002e.png": (1, 1, [0])}


def test_geometry(spark):
    page = geometry.page_crop(spark.createDataFrame([(50, 61)], "h int, w int"), 12).first()
    assert (page.y_ini, page.x_ini, page.crop_h, page.crop_w, page.bh, page.bw) == (2, 1, 48, 60, 2, 3)
    q = geometry.query_window(spark.createDataFrame([(20, 34, 40, 60)], "x1 int, x2 int, y1 int, y2 int"), 12).first()
    assert (q.x1, q.x2, q.y1, q.y2, q.new_w, q.new_h, q.bw, q.bh) == (9, 44, 32, 67, 36, 36, 1, 1)
    assert q.x2 - q.x1 + 1 == q.new_w and q.y2 - q.y1 + 1 == q.new_h


def test_vector_functions(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [5])], "v array<double>, z array<double>, b array<int>").select(
        V.normalize(F.col("v")).alias("n"), V.normalize(F.col("z")).alias("zero"), V.bits(F.col("b")).alias("bits"), V.l2sqr(F.col("v"), F.col("z")).alias("d"), V.k_largest(F.array(F.lit(1), F.lit(2), F.lit(2)), 2).alias("k"), V.argmax(F.col("v")).alias("a"), V.chi2(F.col("v"), F.col("z")).alias("c")
    ).first()
    assert r.n == [0.6, 0.8] and all(np.isnan(r.zero)) and r.bits == [1, 0, 1, 0, 0, 0, 0, 0] and r.d == 25 and [p.place for p in r.k] == [1, 2] and r.a == 1 and r.c == 7


def test_label_colours(spark):
    c = [tuple(r.c) for r in spark.range(3).select(V.label_colour(F.col("id"), 3).alias("c")).collect()]
    assert c == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def test_product_codes_equal_decoded_vectors(spark):
    rng = np.random.default_rng(1)
    books = [rng.normal(size=(5, 3)) for _ in range(2)]
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(20)], "i int, v array<double>")
    w = rng.normal(size=6)
    tables = F.array(*[F.array(*[F.lit(float(c @ part)) for c in b]) for b, part in zip(books, np.split(w, 2))])
    coded = quantize.pq_encode(df, "v", books)
    for r in coded.select("codes", quantize.pq_decode(F.col("codes"), quantize.books_column(books)).alias("x"), quantize.pq_dot(F.col("codes"), tables).alias("dot")).collect():
        assert np.allclose(r.x, np.concatenate([b[k] for b, k in zip(books, r.codes)])) and r.dot == pytest.approx(np.dot(w, r.x))


def test_quantisers(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(40, 3)) * 0.1 + c for c in ([0, 0, 0], [5, 0, 0], [0, 5, 5])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    c, n, cost = quantize.kmeans(df, "v", "i", 3)
    assert sorted(n) == [40, 40, 40] and cost < 10
    model = quantize.fit_pca(df, "v")
    assert np.allclose(model.mean, x.mean(0)) and (np.diff(model.values) <= 0).all()
    low = np.array([r.v for r in quantize.project(df, "v", model, 2).orderBy("i").collect()])
    assert np.allclose(np.cov(low.T), np.diag(model.values[:2]), atol=1e-8)
    g = quantize.fit_gmm(df, "v", "i", 3, rounds=15)
    assert g.w.sum() == pytest.approx(1)
    f = quantize.fisher(df.withColumn("g", F.col("i") % 2), "g", "v", g, weights=True, sigma=True).collect()
    assert len(f) == 2 and all(len(r.fisher) == 3 + 18 and np.linalg.norm(r.fisher) == pytest.approx(1) for r in f)


def test_vectors_one_by_one(tmp_path):
    for kind, vectors in (("fvecs", [[1.5, -2.0], [], [3.0]]), ("ivecs", [[1, -2, 7], [4]]), ("bvecs", [[0, 255]])):
        with open(tmp_path / kind, "wb") as out:
            for v in vectors:
                vecs.write_one(out, v, kind)
        with open(tmp_path / kind, "rb") as stream:
            for v in vectors:
                assert vecs.read_one(stream, kind).tolist() == v
            assert vecs.read_one(stream, kind) is None
    (tmp_path / "broken").write_bytes(struct.pack("<if", 2, 1.0))
    with open(tmp_path / "broken", "rb") as stream, pytest.raises(ValueError):
        vecs.read_one(stream)


def test_ordered_files_are_read_in_order(spark, tmp_path):
    df = spark.range(200).select(((F.col("id") * 37) % 200).alias("k")).select("k", F.array(F.col("k").cast("float")).alias("v")).repartition(5)
    vecs.write_ordered(df, f"{tmp_path}/all", "k")
    assert [r.v[0] for r in vecs.read(spark, f"{tmp_path}/all", kind="fvecs").orderBy("idx").collect()] == [float(i) for i in range(200)]


def test_file_statistics_read_no_vector(spark, tmp_path):
    """Four bytes a file: a file that claims more than it holds is not noticed."""
    (tmp_path / "a.fvecs").write_bytes(struct.pack("<i", 3) + b"x" * 100)
    (tmp_path / "b.fvecs").write_bytes(b"")
    got = sorted((r.path[-7:], r.n, r.d) for r in vecs.file_sizes(spark, f"{tmp_path}/*.fvecs").collect())
    assert got == [("a.fvecs", 104 // 16, 3)]  # Spark lists no empty files


def test_compressed_rows(spark):
    got = sorted(map(tuple, sparse.from_csr(spark, [0, 2, 2, 3], [1, 4, 0], [1.0, 0.0, -2.0]).collect()))
    assert got == [(0, 1, 1.0), (2, 0, -2.0)]
    with pytest.raises(ValueError):
        sparse.from_csr(spark, [0, 2], [1], [1.0])


def test_numbers_of_rows(spark):
    df = spark.range(997).select((F.col("id") * 7919 % 997).alias("k"))
    got = {r.k: r.place for r in annotations.numbered(df, "k", "place").collect()}
    assert got == {i: i for i in range(997)}
    assert annotations.numbered(df.limit(0), "k", "place").count() == 0


def test_fits_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) + 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    for parts in (1, 7, 400):
        n, mean, cov = quantize.moments(df.repartition(parts), "v")
        assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T), atol=1e-6)

"""The whole pipeline on a small corpus, stage by stage against plain Python."""

import random

import corpus_pipeline
from vantage.llm import decontaminate, simhash

LANGS = {"aa": "kalo mipe tusa rano lebi dofu".split(), "bb": "schwund gricht pfalz brucke strom zelt".split()}


def write(spark, folder):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        lang = rng.choice(list(LANGS))
        rows.append((i, " ".join(rng.choice(LANGS[lang]) + str(rng.randrange(40)) for _ in range(rng.randrange(20, 80))), lang, f"src{i % 5}"))
    item = rows[3][1].split()[:14]
    rows += [(1000 + i, rows[i][1], rows[i][2], "src1") for i in range(20)]  # copies
    rows += [(2000, "12 34 !", None, None), (2001, None, "aa", "src1"), (2002, " ".join(["mipe"] * 3 + item + ["kalo"]), "aa", "src2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, " ".join(item)


def test_pipeline(spark, tmp_path):
    rows, item = write(spark, str(tmp_path))
    docs, kept, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), [], []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.columns)
        kept.append([r.doc_id for r in docs.collect()])
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(c == base for c in seen[:-1]) and seen[-1][:5] == base and "shard" in seen[-1]
    ids = {r[0] for r in rows}
    assert set(kept[0]) == ids - {2000, 2001}  # what has no letter goes
    texts = {r[0]: r[1] for r in rows}
    prints = {i: simhash.fingerprint(texts[i].encode()) for i in kept[0]}
    assert not set(kept[1]) & set(range(1000, 1020)) and all(any(bin(prints[i] ^ prints[j]).count("1") <= 3 for j in kept[1]) for i in kept[0])
    leaks = {i for i in kept[1] if any(decontaminate.words(item.encode())[k : k + 10] == decontaminate.words(texts[i].encode())[j : j + 10] for k in range(5) for j in range(200))}
    assert {3, 2002} <= leaks and set(kept[2]) == set(kept[1]) - leaks
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) > 0.8 * len(kept[2])
    assert sorted(kept[4]) == sorted(kept[3])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in run.collect()) == sorted(kept[4])


def test_stages_take_an_empty_table(spark, tmp_path, empty):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, tmp_path, odd):
    docs = odd[0]
    spark.createDataFrame([(1, "x"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() > 0


def test_language_stage_removes_planted_junk_and_keeps_the_rest(spark, tmp_path):
    """Texts of languages that no label names go, clean ones stay."""
    from tests.llm.test_langid import UNLEARNED, make

    rows = [(i, t, lang, "src1", len(t)) for i, t, lang in make(900)]
    rows += [(10_000 + i, t, None, "src1", len(t)) for i, t in enumerate(UNLEARNED)]  # a labelled text would be learned
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).select("doc_id").collect()}
    gone = {r[0] for r in rows} - kept
    assert set(range(10_000, 10_000 + len(UNLEARNED))) <= gone
    assert len(gone & set(range(900))) <= 2


def test_finished_stages_are_removed(spark, tmp_path):
    import glob

    from vantage import shared

    write(spark, str(tmp_path))
    base = shared.folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{base}/pipeline-*/*"))
    corpus_pipeline.run(spark, str(tmp_path)).count()
    left = [p.rsplit("/", 1)[1] for p in set(glob.glob(f"{base}/pipeline-*/*")) - before]
    assert left == ["4-sharding"]

import random
import zlib

import pytest

from vantage.llm import langid

WORDS = {"aa": "kalo mipe tusa rano lebi".split(), "bb": "schwund gricht pfalz brücke strom".split(), "cc": "ção nhão lhes qué así".split()}


def make(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(1, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = make(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, rows=500)
    got = {r.doc_id: r for r in langid.identify(docs, model, keep=["doc_id"]).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = [got[i].lang_pred == lang for i, _, lang in held]
    assert len(held) > 150 and sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) < 5


def test_held_out_column(spark):
    docs = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = [(r.doc_id, r.h) for r in docs.select("doc_id", langid.held_out(docs.doc_id).alias("h")).collect()]
    assert all(h == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) for i, h in got)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 100])
def test_pieces_of_long_texts_agree(monkeypatch, piece):
    rows = make(60)
    model = langid.train([t for _, t, _ in rows], [x for _, _, x in rows])
    for text in (" ".join(t for _, t, x in rows if x == "aa"), "  ab--Çdé  ΣΑΣ. 12x", "ein" * 50, "", " a", "a "):
        monkeypatch.setattr(langid, "PIECE", 1 << 20)
        whole = model.predict(text), [x.tolist() for x in langid.counts(text)]
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (model.predict(text), [x.tolist() for x in langid.counts(text)]) == whole


def test_subwords_are_those_of_a_plain_count():
    text = "Ab-cde f 12 ÉGH"
    w = " ab cde f égh "
    grams = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1) if " " not in w[i + 1 : i + n - 1]]
    assert sum(langid.counts(text)[1]) == len(grams) and len(langid.counts(text)[0]) == len(set(grams))


@pytest.mark.parametrize("text", [None, "", " \n", "123 !? 4", "١٢"])
def test_no_letter_is_und(text):
    model = langid.train(["abc def", "xyz uvw"], ["a", "b"])
    assert model.predict(text) == ("und", 0.0, True)


def test_odd_rows(spark, odd, empty):
    frame, rows = odd
    judged = langid.identify(frame, langid.fit(frame)).collect()
    assert len(judged) == len(rows)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in judged)
    kept = langid.drop_unknown(frame)
    assert kept.columns == frame.columns
    assert langid.drop_unknown(empty).count() == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0


UNLEARNED = [
    "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
    "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar", "minden emberi lény szabadon születik és egyenlő méltósága és joga van",
]


def test_unlearned_languages_are_rejected_and_clean_texts_kept():
    rows = make(900)
    model = langid.train([t for _, t, _ in rows[:700]], [x for _, _, x in rows[:700]])
    assert [model.predict(t)[2] for t in UNLEARNED] == [True] * len(UNLEARNED)
    held = [model.predict(t)[2] for _, t, _ in rows[700:] if len(t.split()) > 4]
    assert len(held) > 150 and sum(held) <= 1


def test_scrambled_texts_are_rejected_at_the_stated_rate():
    import numpy as np

    rows = make(900, seed=3)
    model = langid.train([t for _, t, _ in rows[:700]], [x for _, _, x in rows[:700]])
    rng = np.random.default_rng(1)
    long = [" ".join(t for _, t, x in rows[700:] if x == lang)[:n] for lang in WORDS for n in range(400, 2000, 40)]
    found = sum(model.predict(langid.scrambled(t, rng))[2] for t in long)
    assert found >= 0.3 * len(long)  # five words a language scramble into much of the same
    assert model.thresholds[1] >= model.thresholds[0] > 0
    assert not any(model.predict(t)[2] for t in long)


def test_fit_counts_whole_texts(spark):
    """What is learned lies at the end of very long texts, too."""
    filler = "123 " * 10_000
    rows = [(i, filler + ("kalo mipe tusa rano" if i % 2 else "schwund gricht pfalz strom"), "aa" if i % 2 else "bb") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [model.predict(t)[0] for t in ("mipe tusa", "pfalz gricht")] == ["aa", "bb"]


def test_texts_of_several_learned_languages_stay():
    rows = make(900, seed=3)
    model = langid.train([t for _, t, _ in rows[:700]], [x for _, _, x in rows[:700]])
    by = {lang: " ".join(t for _, t, x in rows[700:] if x == lang)[:600] for lang in WORDS}
    for a in by:
        for b in by:
            assert not model.predict(by[a] + " " + by[b])[2]

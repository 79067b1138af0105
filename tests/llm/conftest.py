import random

import pytest

CLASH = "spans string, items int, score string, h int, fp string, shard string, lang_pred int, n_entities string, rejected int, component_id string, root int, key int, bits int, n int, label int, epoch int, domain string, tie int, doc string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    rng = random.Random(3)
    long = words(rng, 60_000)
    base = words(rng, 120)
    texts = [None, "", " \t\n ", "?!", "one", "two words", long, base, base, base + " extra", base.upper(), "ß É ñ 漢字", words(rng, 50), words(rng, 300)]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "src1", "src2", "odd"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, base, "en", "src1", 5), (None, None, None, None, None), (7, base, "de", "src3", 1), (7, base, "de", "src3", 1), (4, "other text of a repeated id", "en", "src1", 2)]
    n_clash = len(CLASH.split(", "))
    frame = spark.createDataFrame([r + (None,) * n_clash for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    return frame, rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

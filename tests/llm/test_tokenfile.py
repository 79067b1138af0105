import zlib

import numpy as np
import pyarrow as pa
import pytest

from vantage.llm import tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  ", "a  b", "a   b ", "\n foo", " lead", "x \n y", "it's  they've\tgo", "foo<|endoftext|> bar", "é  b c d", "a\x1c b", "a ​ b", "1 2 34 a1 b", "\x85 a b", "word " * 3000, "漢字 kana 漢字"]


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 5000])
@pytest.mark.parametrize("high", [1, 2, 50257, 2**32 - 1])
def test_round_trip(n, high):
    rng = np.random.default_rng(n + high % 7)
    x = rng.integers(0, high, n, dtype=np.uint32)
    if n:
        x[rng.integers(0, n, max(1, n // 50))] = rng.integers(0, 2**32 - 1, max(1, n // 50), dtype=np.uint32)
    ids, lengths, values = tokenfile.read_file(tokenfile.write_file([3, None, 9], [x[: n // 3], x[n // 3 : n // 2], x[n // 2 :]]))
    assert ids == [3, None, 9] and lengths.tolist() == [n // 3, n // 2 - n // 3, n - n // 2] and np.array_equal(values, x)


def test_outliers_cost_little():
    x = np.arange(5120, dtype=np.uint32) % 16
    x[::100] = 1 << 30
    assert len(b"".join(tokenfile.encode_blocks(x))) < 5120 * 0.75


def test_words_are_encoded_like_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]
    encoder = tokenfile.Encoder(PATH)
    assert [bytes(x) for x in encoder.encode(pa.array(TEXTS))] == want
    monkeypatch.setattr(tokenfile, "CACHE", 3)
    assert [bytes(x) for x in encoder.encode(pa.array(TEXTS))] == want
    assert [bytes(x) for x in encoder.encode(pa.array(TEXTS).slice(4, 7))] == want[4:11]


def test_files_against_brute_force(spark, tmp_path, odd, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    rows = [(99 - i, t) for i, t in enumerate(TEXTS)] + [(50, "a tie"), (50, "a tie"), (None, "no id"), (-4, "negative")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenfile.write(docs, f"{tmp_path}/t", PATH, file_ids=500)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read(spark, f"{tmp_path}/t").collect()))
    start, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    frame, odd_rows = odd
    tokenfile.write(frame, f"{tmp_path}/odd", PATH)
    assert tokenfile.read(spark, f"{tmp_path}/odd").count() == len(odd_rows)
    tokenfile.write(empty, f"{tmp_path}/empty", PATH)
    assert tokenfile.read(spark, f"{tmp_path}/empty").count() == 0

import re

import pytest

from vantage.llm import decontaminate as d

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            v = split(t)
            n = min(size, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item) if item is not None else "")
        out.append((str(doc_id), len(w), len(hit), sorted(found)))
    return sorted(out)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "short item"), (3, "one"), (4, None), (5, ""), (6, "!!!"), (None, "an item without an id"),
    (10, "the the the the the the the the the the the"), (1, "A second text of the same item id, of more than ten words in all"),
]
DOCS = [
    (0, None), (1, ""), (2, "xx THE quick, brown-fox jumps over the lazy dog near the old river! yy"), (3, "a Short item, and an item without an id: one."),
    (4, "the " * 30), (5, "quick brown fox jumps over the lazy dog near"), (6, "éß漢 short ITEM"), (7, "nothing at all"), (7, "nothing at all"), (None, "one"),
    (8, "second text of the same item id of more than ten words"),
]


@pytest.mark.parametrize("index_bytes", [1 << 25, 40])
def test_against_brute_force(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(d, "INDEX_BYTES", index_bytes)
    docs = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, spans int")
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc_id string")
    got = d.contamination(docs, items).collect()
    mine = sorted((str(r.doc_id), r.n_words, sum(s.b - s.a for s in r.spans), sorted(r["items"])) for r in got)
    assert mine == brute(DOCS, ITEMS)


def test_clean_documents_stay(spark, odd, empty):
    frame, rows = odd
    items = spark.createDataFrame([(1, " ".join(rows[7][1].split()[20:40]))], "item_id long, text string")
    kept = d.decontaminate(frame, items)
    window = rows[7][1].split()[20:30]
    clean = [r for r in rows if " ".join(window) not in (r[1] or "").lower()]
    assert kept.columns == frame.columns and kept.count() == len(clean)
    assert d.decontaminate(frame, items.limit(0)).count() == len(rows)
    assert d.decontaminate(empty, items).count() == 0


def test_index_against_a_plain_search():
    """Many items that share words and windows, looked up without Spark, also in small steps."""
    import random

    rng = random.Random(4)
    say = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    items = [(str(i % 25), say(rng.randrange(1, 40), 6)) for i in range(40)] + [("r", "w1 " * 50)]
    docs = [(i, say(rng.randrange(0, 200), 7)) for i in range(30)] + [(99, "w1 " * 300)]
    counts = {}
    for _, t in docs:
        for w in set(t.encode().split()):
            counts[w] = counts.get(w, 0) + 1
    for size in (3, 10):
        index = d.build_index([(i, t.encode()) for i, t in items], counts, size)
        for held in (1_000_000, 7):
            d.HELD = held
            got = []
            for i, t in docs:
                spans, names = index.scan(d.words(t.encode()))
                assert all(a < b for a, b in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
                got.append((str(i), len(t.split()), sum(b - a for a, b in spans), names))
            assert sorted(got) == brute(docs, items, size)
    d.HELD = 1_000_000


def test_an_index_stays_small_beside_its_text():
    import random
    import sys

    rng = random.Random(6)
    text = " ".join(f"word{rng.randrange(20_000)}" for _ in range(200_000))
    index = d.build_index([("a", text.encode())], {w: 1 for w in text.encode().split()}, 10)
    flat = sum(x.nbytes for x in (index.text, index.first, index.at, index.length, index.offset, index.owner, index.owned))
    assert flat + sum(map(sys.getsizeof, index.numbers)) + sys.getsizeof(index.numbers) < 12 * len(text)

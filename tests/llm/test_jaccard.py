"""Near copies by 5-word shingles against a comparison of all pairs."""

import random

import numpy as np

import corpus_pipeline
from vantage.llm import jaccard

from tests.llm.conftest import words


def corpus():
    rng = random.Random(21)
    shared = words(rng, 30)
    rows = [(i, words(rng, rng.randrange(3, 150)) + (f" {shared}" if i % 3 == 0 else "")) for i in range(60)]
    for i in range(60):
        own = rows[i][1].split()
        for k in range(3):
            copy = list(own)
            for _ in range(rng.randrange(0, 2 + len(own) // 40)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
            rows.append((1000 + 3 * i + k, " ".join(copy)))
    return rows


def brute(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i in sets:
        for j in sets:
            if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                linked += sets[i] != sets[j]
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in sets if find(i) == i}, linked


def test_all_pairs_of_the_similarity_are_linked(spark, tmp_path):
    rows = corpus()
    want, linked = brute(rows)
    assert linked > 50
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_prefixes_of_similar_sets_meet_in_any_order():
    rng = random.Random(4)
    for text in (words(rng, n) for n in (5, 6, 9, 24, 25, 200)):
        own = text.split()
        for _ in range(20):
            other = own[: rng.randrange(len(own))] + ["x"] + own
            p, q = (jaccard.shingles(" ".join(w).encode()) for w in (own, other))
            both = len(set(p.tolist()) & set(q.tolist()))
            if 100 * both >= 80 * (len(p) + len(q) - both):
                assert both >= jaccard.least_overlap(len(p), len(q), 80)
                assert set(jaccard.prefix(p, p[:0], p[:0], 80).tolist()) & set(jaccard.prefix(q, q[:0], q[:0], 80).tolist())


def test_bitmaps_bound_what_sets_share():
    rng = random.Random(9)
    for n in (1, 5, 40, 400, 40_000):
        for m in (1, 30, 500, 30_000):
            p, q = (jaccard.shingles(words(rng, k + 4, 1000).encode()) for k in (n, m))
            q = np.unique(np.concatenate([q, p[: rng.randrange(len(p) + 1)]]))
            both = len(np.intersect1d(p, q))
            assert both <= jaccard.most_shared(len(p), len(q), jaccard.sketch(p), jaccard.sketch(q)) <= min(len(p), len(q))
    p, q = (jaccard.shingles(words(rng, 500, 1000).encode()) for _ in range(2))
    assert jaccard.most_shared(len(p), len(q), jaccard.sketch(p), jaccard.sketch(q)) < 0.8 * len(p)


def test_small_bitmaps_drop_no_similar_pair():
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(5, 300)) for _ in range(30)]
    texts += [" ".join(w for w in t.split() if rng.random() > 0.01) for t in texts for _ in range(3)]
    own = [jaccard.shingles(t.encode()) for t in texts]
    maps = np.array([jaccard.small_sketch(x) for x in own], np.int64)
    k = len(own)
    n = np.array([len(x) for x in own])
    order = np.argsort(n, kind="stable")
    columns = [np.zeros(k, np.int64), order, n[order], np.zeros(k, np.int64), order, *(maps[order, i] for i in range(jaccard.SMALL))]
    got = {tuple(p) for out in jaccard._pairs(*columns, percent=80) for p in out.tolist()}
    want = {(i, j) for i in range(k) for j in range(i + 1, k) if 100 * len(np.intersect1d(own[i], own[j])) >= 80 * len(np.union1d(own[i], own[j]))}
    assert len(want) > 20 and want <= got and len(got) < k * k // 8


def test_common_shingles_reach_the_driver_as_plain_arrays(spark, monkeypatch):
    """No sort of all counts gathers at the driver and no Python object is made per shingle; those of a count go together."""
    from pyspark.sql import DataFrame

    def refused(*_):
        raise AssertionError("a million rows as Python objects")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(jaccard, "REGION", 100)
    texts = ["a b c d e"] * 5 + ["f g h i j"] * 4 + ["k l m n o"] * 4 + ["p q r s t"] * 3
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for most, want in ((4, [5, 4, 4, 3]), (3, [5, 4, 4]), (2, [5]), (1, [5])):
        monkeypatch.setattr(jaccard, "COMMON", most)
        hashes, times = jaccard._common(rows, 5, 80)
        assert sorted(times.tolist(), reverse=True) == want and (np.diff(hashes.astype(object)) > 0).all()
    monkeypatch.setattr(jaccard, "COMMON", 0)
    assert [len(x) for x in jaccard._common(rows, 5, 80)] == [0, 0]


def just_dissimilar(texts=200):
    """Texts of 90 words with one of 17 places replaced: alike (0.89) at the same place, just not (0.79) at different ones."""
    rng = random.Random(33)
    base = [f"w{i}" for i in range(90)]
    places = [4 + 5 * (i % 17) for i in range(texts)]
    return [(i, " ".join([*base[:p], f"new{i}", *base[p + 1 :]])) for i, p in enumerate(rng.sample(places, texts))]


def test_a_group_that_is_just_not_similar_is_not_paired_out(spark, tmp_path, monkeypatch):
    rows, paired = just_dissimilar(), []

    def counted(pairs, *rest, real=jaccard._possible):
        paired.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard, "_possible", counted)
    want, _ = brute(rows)
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) == 17
    assert sum(paired) < 10 * len(rows)  # of 18,800 pairs of different components


def test_blocks_of_many_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    rows = corpus()[60:] + just_dissimilar(60)
    own = {jaccard.xxhash.xxh64_intdigest(x.tobytes(), 42) - (1 << 63): x for x in (jaccard.shingles(t.encode()) for _, t in rows)}
    texts = {jaccard.xxhash.xxh64_intdigest(jaccard.shingles(t.encode()).tobytes(), 42) - (1 << 63): t for _, t in rows}
    s = sorted(own)
    docs = spark.createDataFrame([(i, texts[v]) for i, v in enumerate(s)], "h long, text string")
    named = spark.createDataFrame(list(enumerate(s)), "h long, s long")
    members = spark.createDataFrame([(v, len(own[v]), v) for v in s], "s long, n int, root long")
    for most, shingles in ((32, 2_000_000), (3, 2_000_000), (3, 2000)):
        monkeypatch.setattr(jaccard, "CHUNKS", most)
        monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", shingles)
        for blocks in (1, 5):
            edges = spark.createDataFrame([(v, s[i % blocks]) for i, v in enumerate(s)], "a long, b long")
            got = jaccard._in_blocks(edges, members, named, docs, 80, 5).collect()
            links = [(a, b) for i, a in enumerate(s) for k, b in enumerate(s[:i]) if i % blocks == k % blocks and 100 * len(np.intersect1d(own[a], own[b])) >= 80 * len(np.union1d(own[a], own[b]))]
            assert len(links) > 20 and connected(got) == connected(links)


def connected(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {(i, find(i)) for i in list(root)}


def test_block_links_join_roots_and_hold_few_pairs(monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 10)
    own = [jaccard.shingles(t.encode()) for _, t in just_dissimilar(100)]
    place = [t.split().index(next(w for w in t.split() if w.startswith("new"))) for _, t in just_dissimilar(100)]
    for i, j in ((0, 0), (0, 1)):
        c = [k % 2 if i != j else 0 for k in range(100)]
        columns = [jaccard.pa.array(v) for v in ([i] * 100, [j] * 100, c, [k // 2 for k in range(100)], [x.tobytes() for x in own])]
        a, b = jaccard._block_links([jaccard.pa.RecordBatch.from_arrays(columns, ["i", "j", "c", "root", "own"])], 80)
        want = [(p // 2, q // 2) for p in range(100) for q in range(p) if place[p] == place[q] and p // 2 != q // 2 and (i == j or c[p] != c[q])]
        assert connected(zip(a.tolist(), b.tolist(), strict=True)) == connected(want) and len(a) < 50


def test_candidates_come_as_an_edge_for_each_set(spark):
    own = [jaccard.shingles(t.encode()) for _, t in just_dissimilar()]
    firsts = [jaccard.prefix(x, x[:0], x[:0], 80).view(np.int64).tolist() for x in own]
    maps = [jaccard.small_sketch(x) for x in own]
    rows = [(t, s, len(own[s]), place, s // 2, *maps[s]) for s, x in enumerate(firsts) for place, t in enumerate(x)]
    columns = ["t", "s", "n", "place", "root", *(f"m{i}" for i in range(jaccard.SMALL))]
    table = [np.array(v) for v in zip(*sorted(rows, key=lambda r: (r[0], r[2], r[1])), strict=True)]
    pairs = np.unique(np.concatenate(list(jaccard._pairs(*table, percent=80))), axis=0)
    rooted = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c in ('n', 'place') else 'long'}" for c in columns))
    for tasks in (1, 4):
        got = jaccard._candidates(rooted, 80, tasks).collect()
        assert connected(got) == connected(pairs.tolist()) and len(got) < tasks * len(own) < len(pairs)
